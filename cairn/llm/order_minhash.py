"""Document fingerprints by Order MinHash, sensitive to edits and to the order of what a text says. DataFrame functions only.

Marçais, DeBlasio, Pandey and Kingsford, "Locality-sensitive hashing for the edit distance", Bioinformatics 35 (2019).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import free_names

#: Words of a k-mer; signatures of a fingerprint, a power of two; a longer word counts as several of so many characters.
K, SIGNATURES, UNIT = 3, 64, 16
_WORD = rf"[^\x20\x09-\x0D]{{1,{UNIT}}}"
#: Bits of a packed number that hold a place in a text; the others hold a hash.
_PLACE = 28
_MASK = (1 << _PLACE) - 1


def _packed(h: Column, place: Column) -> Column:
    return F.shiftleft(h, _PLACE).bitwiseOR(place.cast("long"))


def with_signatures(docs: DataFrame, text: Column, name: str, k: int = K, signatures: int = SIGNATURES) -> DataFrame:
    """docs with an array of signatures of text in column name; it is empty where the text is null or has no word.

    Every k-mer of words (of a shorter text, the whole) is numbered by its occurrence in the text, and the pair is hashed to a place
    on a circle. Each signature has a start of its own on the circle, evenly spaced; from there on, the two first k-mers are its
    minimal ones under the order that begins at that start. They are put back into the order of the text and hashed as a tuple.
    So two texts agree in a signature if they have the same minimal k-mers in the same order.

    Numbering is a sort of the k-mers with their places, in which the occurrences of one are neighbours: how far up its run an entry
    stands is found by doubling steps, so a text of one repeated word costs n log n like any other.
    """
    words, kmers, items, heads = free_names(docs, "words", "kmers", "items", "heads")
    bits = signatures.bit_length() - 1
    out = docs.withColumn(words, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0)))
    run = lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + j) for j in range(1, k)])
    starts = F.slice(F.col(words), 1, F.greatest(F.size(words) - (k - 1), F.least(F.size(words), F.lit(1))))
    out = out.withColumn(kmers, F.transform(starts, lambda w, i: _packed(run(w, i), i)))
    # occurrence numbers: runs of equal hashes in the sorted numbers
    sorted_, numbered = free_names(out, "sorted", "numbered")
    out = out.withColumn(sorted_, F.sort_array(kmers))
    here = lambda i: F.shiftright(F.get(F.col(sorted_), i), _PLACE)
    steps = F.lit([1 << j for j in range(_PLACE - 1, -1, -1)])

    def before(h: Column, i: Column) -> Column:
        """How many entries before i have hash h."""
        up = F.aggregate(steps, F.lit(0), lambda n, s: F.when((i >= n + s) & (here(i - n - s) == h), n + s).otherwise(n))
        return F.when((i > 0) & (here(i - 1) == h), up).otherwise(F.lit(0))

    def item(x: Column, i: Column) -> Column:
        h = F.shiftright(x, _PLACE)
        return _packed(F.xxhash64(h, before(h, i)), x.bitwiseAND(F.lit(_MASK)))

    out = out.withColumn(numbered, F.transform(sorted_, item))
    out = out.withColumn(items, F.sort_array(numbered))
    # an item is the first one from the starts between the arc of the item before it (excluded) and its own (included)
    n = F.size(items)
    arc = lambda i: (F.shiftright(F.get(F.col(items), i), 64 - bits) + signatures // 2).cast("int")
    out = out.withColumn(heads, F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (arc(i) != arc(i - 1)))))
    place = lambda i: F.get(F.col(items), i).bitwiseAND(F.lit(_MASK)).cast("int")
    kmer = lambda at: F.shiftright(F.get(F.col(kmers), at), _PLACE)

    def signature(i: Column) -> Column:
        a, b = place(i), place(F.when(i + 1 < n, i + 1).otherwise(F.lit(0)))
        return F.xxhash64(kmer(F.least(a, b)), kmer(F.greatest(a, b))).bitwiseAND(F.lit(0xFFFF)).cast("int")

    each = F.transform(heads, lambda i, j: F.array_repeat(signature(i), arc(i) - F.when(j > 0, arc(F.get(F.col(heads), j - 1))).otherwise(F.lit(-1))))
    last = F.array_repeat(signature(F.lit(0)), signatures - 1 - arc(n - 1))
    out = out.withColumn(name, F.when(n > 0, F.concat(F.flatten(each), last)).otherwise(F.array().cast("array<int>")))
    return out.drop(words, kmers, sorted_, numbered, items, heads)


def likeness(a: Column, b: Column) -> Column:
    """The share of signatures in which two fingerprints agree; 1 for two texts without words, 0 for one."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)).cast("double") / F.size(a)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), same).otherwise((F.size(a) == F.size(b)).cast("double"))


def fingerprint(signatures: Column) -> Column:
    """Signatures as text, four hexadecimal digits each."""
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def with_next(docs: DataFrame, key: str, columns: list[str], name: str, blocks: int | None = None) -> DataFrame:
    """docs with a struct of columns of the next row by descending key, null keys last, in name; after the last comes the first.

    Rows are dealt to blocks of neighbouring keys, by bounds that a range partitioning of the keys alone gives, a row a block; the
    first rows of a block are sent to the block before it as well. So texts are shuffled once, and no window spans the table.
    Rows of one key stand in one block, in the order of the hashes of columns.
    """
    spark = docs.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, guest, tie = free_names(docs, "at", "guest", "tie")
    keys = docs.select(F.col(key).alias("k")).where("k IS NOT NULL").repartitionByRange(blocks, F.col("k").desc())
    firsts = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.max("k").alias("k"))
    bounds = sorted((r["k"] for r in firsts.collect()), reverse=True)  # a row a block
    n = max(len(bounds), 1)
    # the last bound that is not below the key, by halving; null keys stand behind all others
    edges = F.lit(bounds) if bounds else F.array(F.lit(None).cast(docs.schema[key].dataType))
    steps = F.lit([1 << j for j in range(n.bit_length(), -1, -1)])
    low = F.aggregate(steps, F.lit(0), lambda x, s: F.when((x + s < n) & (F.get(edges, x + s) >= F.col(key)), x + s).otherwise(x))
    block = F.when(F.col(key).isNull(), F.lit(n - 1)).otherwise(low)
    opens = F.coalesce(F.get(edges, F.col(at)) == F.col(key), F.lit(not bounds))
    rows = docs.withColumn(at, block).withColumn(tie, F.xxhash64(*columns))
    before = F.when(F.col(at) > 0, F.col(at) - 1).otherwise(F.lit(n - 1))
    sent = F.when(opens, F.array(F.struct(F.col(at).alias("b"), F.lit(0).alias("g")), F.struct(before.alias("b"), F.lit(1).alias("g")))).otherwise(F.array(F.struct(F.col(at).alias("b"), F.lit(0).alias("g"))))
    dealt = rows.withColumn(guest, F.explode(sent)).withColumn(at, F.col(f"{guest}.b")).withColumn(guest, F.col(f"{guest}.g"))
    order = W.partitionBy(at).orderBy(guest, F.col(key).desc_nulls_last(), tie)
    return dealt.withColumn(name, F.lead(F.struct(*columns)).over(order)).where(F.col(guest) == 0).drop(at, guest, tie)


def edited(text: Column, other: Column) -> Column:
    """text with its last third, in code points, replaced by as many of other's first ones, or all of them."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(other, F.lit(1), cut))


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, signatures: int = SIGNATURES) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    The next document is that with the next smaller key; null keys stand last, rows of one key are ordered by a hash of their text, and after the last one comes the
    first, which for a table of one row is itself. Null texts count as empty; texts without a word have an empty fingerprint, alike (1.0)
    to another such one and to nothing else (0.0). Equal texts have equal fingerprints. Texts are read whole, up to 2^28 words; an empty
    table stays empty; other columns, of any name, are not looked at. With fewer k-mers than signatures, several starts find the same tuples.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = with_next(with_signatures(rows, F.col("text"), "own", k, signatures), "key", ["text", "own"], "next")
    changed = with_signatures(own.withColumn("edit", edited(F.col("text"), F.col("next.text"))), F.col("edit"), "new", k, signatures)
    return changed.select(
        F.col("key").alias(key), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit"), 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("new")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next.own")).alias("near_next"),
    )
