"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BROADCAST_ROWS, durable, free_names, small


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; "" without "://" or for null."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(_low(host), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end; "" without "://" or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _low(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def _prefix(digest: Column) -> Column:
    """The first 32 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _expression(labels: int, chars: int) -> tuple[Column, Column]:
    """The suffix of so many labels of a host and the prefix of so many characters of a path; null where they are shorter."""
    part = F.split("host", r"\.")
    host = F.when((F.size(part) >= labels) & (F.col("host") != ""), F.array_join(F.slice(part, F.greatest(F.size(part) - labels + 1, F.lit(1)), labels), "."))
    return host, F.when(F.length("path") >= chars, F.substring("path", 1, chars))


#: Rules of so many different shapes (labels of the host, characters of the path) at most are looked up one shape after the other.
SHAPES = 16


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", broadcast_rows: int = BROADCAST_ROWS, shapes: int = SHAPES) -> DataFrame:
    """Adds host, path, rule and verdict to every row of pages.

    rules has (host, path, verdict). A rule fits its host and all subdomains if the url's path starts with the rule's path;
    the longest host + path wins, of equally long ones the alphabetically first, and of one rule given as both allow and
    block, block. Without a fitting rule, rule is null and the verdict is default. Null and malformed urls have an empty host
    and path and fit no rule. Repeated pages stay repeated; columns of pages named like the added ones are replaced, others may
    have any names. An empty table of rules leaves every url to default, an empty table of pages stays empty.

    A url is expanded only to the label counts and path lengths that some rule has, whatever the length of the url. The join
    is on 32 bits of the digest, then the full digest is compared. Rules that may be broadcast and have few shapes are looked up
    where the pages are, one shape after the other, as a url fits one rule of each at most; nothing is shuffled. Else each
    distinct (host, path) is expanded once, and only those that a rule fits are joined back, by broadcast while they are few:
    a hot host is spread by its paths, and a hot url is one row on the side that is looked up, so that Spark can split the other.
    """
    named = rules.select(_low(F.coalesce("host", F.lit(""))).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v")).where("h <> ''")
    known = durable(
        named.groupBy("h", "p").agg(F.max("v").alias("v"))  # "block" sorts after "allow"
        .select(F.concat("h", "p").alias("rule"), "v", _digest(F.col("h"), F.col("p")).alias("digest"), F.size(F.split("h", r"\.")).alias("labels"), F.length("p").alias("chars"))
        .withColumn("short", _prefix(F.col("digest"))))
    kinds = known.groupBy("labels", "chars").count().select("labels", "chars").orderBy("labels", "chars").collect()  # bounded by the lengths of names and paths
    pages = pages.drop("host", "path", "rule", "verdict").withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    if not kinds:
        return pages.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    few = small(known, broadcast_rows)
    best = F.struct((-F.length("rule")).alias("n"), F.col("rule").alias("rule"), F.col("v").alias("v"))
    if few and len(kinds) <= shapes:
        out, found = pages, free_names(pages, *[f"rule{i}" for i in range(len(kinds))])
        seen, d, s = free_names(pages.select("*", *[F.lit(0).alias(x) for x in found]), "seen", "digest", "short")
        for kind, name in zip(kinds, found, strict=True):
            own = known.where((F.col("labels") == kind["labels"]) & (F.col("chars") == kind["chars"])).select(F.col("digest").alias(d), F.col("short").alias(s), best.alias(name))
            host, path = _expression(kind["labels"], kind["chars"])
            out = out.withColumn(seen, F.when(host.isNotNull() & path.isNotNull(), _digest(host, path)))
            out = out.join(F.broadcast(own), (_prefix(F.col(seen)) == F.col(s)) & (F.col(seen) == F.col(d)), "left").drop(seen, d, s)
        longest = F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))
        return out.withColumn("rule", longest["rule"]).withColumn("verdict", F.coalesce(longest["v"], F.lit(default))).drop(*found)
    each = F.array(*[F.when(h.isNotNull() & p.isNotNull(), _digest(h, p)) for h, p in (_expression(k["labels"], k["chars"]) for k in kinds)])
    own = known.select("short", "digest", best.alias("best"))
    host_, path_, best_ = free_names(pages, "host", "path", "best")
    hits = (
        pages.where("host <> ''").select("host", "path").distinct().select(F.col("host").alias(host_), F.col("path").alias(path_), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("seen"))
        .withColumn("short", _prefix(F.col("seen"))).join(F.broadcast(own) if few else own, "short").where("seen = digest").groupBy(host_, path_).agg(F.min("best").alias(best_)))
    hits = durable(hits)
    out = pages.join(F.broadcast(hits) if small(hits, broadcast_rows) else hits, (F.col("host") == F.col(host_)) & (F.col("path") == F.col(path_)), "left")
    return out.withColumn("rule", F.col(best_)["rule"]).withColumn("verdict", F.coalesce(F.col(best_)["v"], F.lit(default))).drop(host_, path_, best_)
