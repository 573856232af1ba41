"""Text functions as column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the query semantics.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "with")
TOKEN = r"[a-z0-9]+(?:[._-][a-z0-9]+)*"
BARE_NUMBER = r"(?U)\A\d+(?:\.\d+)*\z"
NUMBERED = r"(?Us)\A(\d+(?:\.\d+)*)\.?\s+(\S.*)\z"
CAPTION_PREFIX = r"(?i)\A\s*(?:figure|fig\.?|table)\s*\d+[a-z]?\s*[:.\-]?\s*"
PAGE_NUMBER = r"(?U)\A\d{1,4}\z"

_SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends; trim() would only take spaces."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def clean_text(text: Column) -> Column:
    """One kind of line end, single spaces, at most one blank line in a row; "" for null."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def unwrap_lines(text: Column) -> Column:
    """Words hyphenated over a line end are joined, single line ends become spaces, blank lines stay."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)(\w)-\n(\w)", "$1$2")
    out = F.regexp_replace(out, r"(?<!\n)\n(?!\n)", " ")
    return strip(F.regexp_replace(out, r" {2,}", " "))


def safe_name(text: Column, limit: int = 60) -> Column:
    """A file name of ASCII letters, digits, "_" and "-"; "untitled" if nothing is left."""
    out = F.left(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_-]+", "_"), F.lit("_")), F.lit(limit))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("untitled"))


def caption_title(text: Column) -> Column:
    """A caption without its "Figure 3:" or "Table 1." in front."""
    return strip(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), CAPTION_PREFIX, ""))


def first_line(text: Column) -> Column:
    return strip(F.split(strip(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")[0])


def tokenize(text: Column) -> Column:
    """Lower-case ASCII words, joined over single dots, dashes and underscores, without stopwords; in order, with repetitions."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda x: ~x.isin(*STOPWORDS))


def stem_of(source: Column) -> Column:
    """A path's file name without its last suffix."""
    name = F.regexp_extract(F.coalesce(source, F.lit("")), r"([^/]*)/*\z", 1)
    return F.coalesce(F.nullif(F.regexp_replace(name, r"(?<=.)\.[^.]+\z", ""), F.lit("")), F.lit("document"))


def stable_id(source: Column, path: Column, content: Column) -> Column:
    """The same id for the same content at the same place, whenever it is read."""
    parts = [F.coalesce(x, F.lit("")) for x in (source, path, content)]
    return F.concat(stem_of(source), F.lit("_"), F.left(F.sha1(F.concat(parts[0], F.lit("\0"), parts[1], F.lit("\0"), parts[2]).cast("binary")), F.lit(16)))


def embedding_text(document: Column, path: Column, content: Column) -> Column:
    section = F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("Section: "), path, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("Document: "), document, F.lit("\n"), section, F.lit("\n"), content)


def item_text(kind: Column, content: Column, title: Column, table_data: Column, fallback: Column) -> Column:
    """The text that an item of a layout stands for in a chunk."""
    some = lambda x: F.nullif(F.coalesce(x, F.lit("")), F.lit(""))
    table = F.concat_ws("\n", F.concat(F.lit("Table: "), some(title)), some(table_data))
    return (
        F.when(kind == "table", table)
        .when(kind == "figure", F.coalesce(F.concat(F.lit("Figure: "), some(title)), F.lit("")))
        .when(kind == "equation", clean_text(fallback))
        .otherwise(unwrap_lines(clean_text(content)))
    )


def citation(source: Column, start: Column, end: Column, path: Column) -> Column:
    page = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    pages = F.when(start.eqNullSafe(end), page(start)).otherwise(F.concat(page(start), F.lit("-"), page(end)))
    return F.concat(source, F.lit(", p."), pages, F.lit(", "), F.coalesce(F.nullif(path, F.lit("")), F.lit("front matter")))


def numbered_context(entries: Column) -> Column:
    """Entries, structs of n, citation and context in order of n, as one text for a prompt."""
    one = lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] ("), x["citation"], F.lit(")\n"), x["context"])
    return F.array_join(F.transform(F.array_sort(entries), one), "\n\n---\n\n")


def answer_markers(answer: Column, numbers: Column) -> Column:
    """The source numbers that an answer cites as [n] and that numbers holds, in order of first mention."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_intersect(found, numbers)


def repair_json(reply: Column, fields: tuple[str, ...] = ("title", "section", "summary")) -> Column:
    """A struct of text fields from a model's reply: the reply as JSON, else without code fences, else its outermost braces, else
    blanks. A reply that is JSON but not an object gives blanks too."""
    fenced = strip(F.regexp_replace(F.regexp_replace(reply, r"(?i)```json", ""), r"```", ""))
    braces = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    parsed = F.coalesce(*[F.try_parse_json(x) for x in (strip(reply), fenced, braces)])
    return F.struct(*[F.coalesce(F.try_variant_get(parsed, f"$.{f}", "string"), F.lit("")).alias(f) for f in fields])


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def image_url(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A/+", "")


def preview(text: Column, limit: int) -> Column:
    return F.left(text, F.lit(limit))


def first_lines(text: Column, n: int = 10) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def to_int(value: Column) -> Column:
    return value.try_cast("int")


# --- tables: arrays of rows, each an array of cells ---

def is_valid_table(table: Column) -> Column:
    """At least two rows with something in them, two columns, and four cells with something in them."""
    full = lambda c: F.coalesce(strip(c) != "", F.lit(False))
    rows = F.filter(table, lambda r: F.exists(r, full))
    cells = F.aggregate(F.transform(rows, lambda r: F.size(F.filter(r, full))), F.lit(0), lambda a, x: a + x)
    return F.coalesce((F.size(rows) >= 2) & (F.array_max(F.transform(table, F.size)) >= 2) & (cells >= 4), F.lit(False))


def table_to_html(table: Column) -> Column:
    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    head = F.concat(F.lit("<thead>"), row(table[0], "th"), F.lit("</thead>"))
    body = F.array_join(F.transform(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0))), lambda r: row(r, "td")), "")
    filled = F.concat(F.lit("<table>"), head, F.lit("<tbody>"), body, F.lit("</tbody></table>"))
    return F.when(F.coalesce(F.size(table), F.lit(0)) > 0, filled).otherwise(F.lit("<table></table>"))


def table_to_markdown(table: Column) -> Column:
    """Header, rule and rows; cells on one line, with "/" for "|"; a row that repeats the one before it is left out."""
    cell = lambda c: F.replace(strip(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){_SPACE}+", " ")), F.lit("|"), F.lit("/"))
    clean = F.transform(table, lambda r: F.transform(r, cell))
    rows = F.filter(clean, lambda r, i: (i == 0) | ~r.eqNullSafe(F.get(clean, i - 1)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(rows[0])))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), rule), body), "\n")).otherwise(F.lit(""))
