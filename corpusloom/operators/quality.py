"""Document quality: page metrics, filters, running headers and footers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

MIN_PAGES = 5


def with_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the quality measures of stripped text and `is_good`."""
    measured = tx.with_measures(docs, text_col)
    return measured.withColumn("is_good", tx.is_good({k: F.col(k) for k in ("n_chars", "letters", "other_letters", "scripts", "symbols", "words")}))


def long_enough(pages: Column, least: int = MIN_PAGES) -> Column:
    """Whether a document has more than `least` pages."""
    return F.size(pages) > least


def is_pdf(content: Column) -> Column:
    """Whether the first 1024 bytes hold a PDF signature."""
    return F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0


def without_headers_footers(docs: DataFrame, id_col: str = "doc_id", pages_col: str = "pages") -> DataFrame:
    """`docs` with lines that open or close 30 % of a document's pages (two at least) removed from all its pages.

    Everything happens inside the row: candidates are counted by value with higher-order
    functions, so nothing is shuffled and documents that end up empty stay.
    """
    split = docs.withColumn("_lines", F.transform(pages_col, tx.lines))
    edges = F.flatten(F.transform(F.filter("_lines", lambda ls: F.size(ls) > 0), lambda ls: F.array(F.get(ls, F.lit(0)), F.element_at(ls, -1))))
    limit = F.greatest(F.lit(2), F.floor(F.size(pages_col) * F.lit(0.3)).cast("int"))
    # Equal candidates are counted as runs of the sorted array: the value `limit - 1` places on is the same.
    often = F.array_distinct(
        F.filter(F.transform("_edges", lambda e, i: F.when(F.get("_edges", i + F.col("_limit") - 1) == e, e)), lambda e: e.isNotNull())
    )
    counted = split.withColumn("_edges", F.array_sort(edges)).withColumn("_limit", limit).withColumn("_often", often)
    kept = F.transform("_lines", lambda ls: F.array_join(F.filter(ls, lambda x: ~F.array_contains("_often", x)), "\n"))
    return counted.withColumn(pages_col, kept).drop("_lines", "_edges", "_limit", "_often")


def single_language(df: DataFrame) -> DataFrame:
    """Records with an abstract, a headline and exactly one language."""
    return df.filter((F.size("abstract") > 0) & (F.size("headline") > 0) & (F.size("in_language") == 1))


def language_matched(texts: Column, language: Column) -> Column:
    """Text of the first {text, lang} in the wanted language, else null."""
    return F.get(F.filter(texts, lambda t: t["lang"] == language), F.lit(0))["text"]
