"""Classification of text blocks on a page, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import strip

# Fixed values of the query semantics: patterns that count two points (in either case), one point (as written), the characters
# whose density counts, the words that no equation starts with, and the limits of its length.
STRONG = (
    r"MultiHead\s*\(", r"Attention\s*\(", r"FFN\s*\(", r"softmax\s*\(", r"LayerNorm\s*\(", r"PE\s*\(", r"d_\{?model\}?", r"d_\{?k\}?", r"d_\{?v\}?",
    r"W\^?[QKVO]", r"head_?\d", r"∈\s*R", r"\\sqrt", r"\\frac",
)
MEDIUM = (r"[A-Za-z]_\{?[0-9i-n]+\}?", r"[A-Za-z]\^\{[0-9i-nQKVO]+\}", r"=\s*[A-Za-z\\(]", r"[∑∫∏√∞≈≠≤≥∈∉→←]")
MATH_CHARACTERS = "=+-*/^_()[]{}\\∈×÷∑∫"
NOT_EQUATION_STARTS = ("the ", "in this", "we ", "this ", "our ", "figure", "table")
EQUATION_CHARACTERS, EQUATION_SCORE = (12, 300), 3
HEADING = (r"\A\d+(\.\d+)*\s+[A-Z]", r"\A[A-Z][A-Za-z\s]{3,40}\z")
CAPTION = r"(?i)\A(Figure|Fig\.|Table)\s+\d+"
#: Fonts on a page without text.
DEFAULT_FONT = 11.0


def math_score(text: Column) -> Column:
    points = [F.when(text.rlike(f"(?i){p}"), 2).otherwise(0) for p in STRONG] + [F.when(text.rlike(p), 1).otherwise(0) for p in MEDIUM]
    density = (F.length(text) - F.length(F.translate(text, MATH_CHARACTERS, ""))) / F.greatest(F.length(text), F.lit(1))
    return sum(points, F.when(density > 0.22, 2).when(density > 0.15, 1).otherwise(0))


def is_likely_equation(text: Column) -> Column:
    return equation_of(strip(text), F.lower(strip(text)))


def equation_of(bare: Column, low: Column) -> Column:
    """is_likely_equation() of a text given without white space at its ends, and the same in lower case. Cheap tests come first."""
    starts = F.lit(False)
    for x in NOT_EQUATION_STARTS:
        starts = starts | low.startswith(x)
    return F.length(bare).between(*EQUATION_CHARACTERS) & (F.regexp_count(bare, F.lit(r"\. ")) < 2) & ~starts & (math_score(bare) >= EQUATION_SCORE)


def classify_block(text: Column, font_size: Column, is_bold: Column, y0: Column, page_height: Column, median_font: Column) -> Column:
    """title, heading, caption, equation or paragraph: the first that fits."""
    return class_of(strip(text), F.lower(strip(text)), font_size, is_bold, y0, page_height, median_font)


def class_of(bare: Column, low: Column, font_size: Column, is_bold: Column, y0: Column, page_height: Column, median_font: Column) -> Column:
    """classify_block() of a text given without white space at its ends, and the same in lower case. Where these are columns of
    their own, white space is stripped once a block and not in every pattern of every branch."""
    heading = ((font_size >= median_font * 1.1) | is_bold) & (bare.rlike(HEADING[0]) | bare.rlike(HEADING[1]))
    return (
        F.when((y0 < page_height * 0.15) & (font_size > median_font * 1.4), "title").when(heading, "heading").when(bare.rlike(CAPTION), "caption")
        .when(equation_of(bare, low), "equation").otherwise("paragraph")
    )


def upper_median(values: Column) -> Column:
    """The element in the middle, of an even number the upper one; DEFAULT_FONT of none."""
    return F.coalesce(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), F.lit(DEFAULT_FONT))
