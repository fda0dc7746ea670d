"""Text of fetched pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>"
TAG = r"<[^>]*>"
BLANKS = r"[ \t\n\f\r]+"


def page_text(html: Column) -> Column:
    """Visible text of a page: markup removed, blanks collapsed; null if none is left."""
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), TAG, " ")
    text = F.trim(F.regexp_replace(text, BLANKS, " "))
    return F.when(text != "", text)


def concat_pages(pages: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """(keys, text): the non-empty page texts of a document in order, one per line, trimmed.

    The result is one string per document, so its pages meet in one row by nature.
    """
    filled = F.when(F.coalesce(F.col(text), F.lit("")) != "", F.struct(
        F.col(order).alias("at"), F.col(text).alias("text")))
    pages = pages.groupBy(*keys).agg(F.sort_array(F.collect_list(filled)).alias("parts"))
    return pages.select(*keys, F.regexp_replace(F.array_join("parts.text", "\n"),
                                                r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "").alias(text))
