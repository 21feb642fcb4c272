"""Segments of texts without paragraphs: groups of lines, and runs of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Fixed value: longer texts are not cut by characters.
MOST_CHARS = 5_000_000


def line_chunks(docs: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, first_line, last_line, text) of every ``size`` lines; blank ones go. A null text has none."""
    lines = F.split("text", "\n", -1)
    at = F.explode(F.sequence(F.lit(0), F.size("l") - 1, F.lit(size))).alias("first_line")
    cut = docs.select("doc_id", lines.alias("l")).where("l IS NOT NULL").select("doc_id", "l", at)
    out = cut.select("doc_id", "first_line", (F.least(F.col("first_line") + size, F.size("l")) - 1).alias("last_line"), X.trim(F.array_join(F.slice("l", F.col("first_line") + 1, size), "\n")).alias("text"))
    return out.where("text <> ''")


def char_chunks(docs: DataFrame, count: int = 10) -> DataFrame:
    """(doc_id, chunk, text): up to ``count`` runs of equal length; blank ones go, as do texts over ``MOST_CHARS``."""
    size = F.greatest(F.lit(1), F.ceil(F.char_length("text") / F.lit(count)).cast("int"))
    sized = docs.where(F.char_length("text").between(1, MOST_CHARS)).select("doc_id", "text", size.alias("size"))
    last = F.ceil(F.char_length("text") / F.col("size")).cast("int") - 1
    cut = sized.select("doc_id", "text", "size", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return cut.select("doc_id", "chunk", X.trim(F.substring("text", F.col("chunk") * F.col("size") + 1, F.col("size"))).alias("text")).where("text <> ''")
