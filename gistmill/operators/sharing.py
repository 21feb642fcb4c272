"""Operators across artefacts and levels: shared lines, balanced selections, histograms, overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def shared_lines(lines: DataFrame, key: str = "doc_id", least: int = 2) -> DataFrame:
    """Trimmed lines that at least ``least`` artefacts hold, with the first of them.

    Artefact and line are made distinct before they are counted, so a line repeated
    within one artefact moves once; counting then combines before its shuffle.
    """
    line = X.trim(F.col("line"))
    each = lines.select(key, line.alias("line")).where("line <> ''").distinct()
    return each.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"), F.min(key).alias("owner")).where(F.col("n_docs") >= least)


def unshared_size(lines: DataFrame, key: str = "doc_id", least: int = 2) -> DataFrame:
    """Per artefact: its lines, and those left when each shared line stays only in its owner."""
    line = X.trim(F.col("line"))
    shared = shared_lines(lines, key, least).select(F.col("line").alias("trimmed"), "owner")
    per = lines.select(key, line.alias("trimmed")).groupBy(key, "trimmed").agg(F.count(F.lit(1)).alias("n"))
    gone = F.when(F.col("owner") != F.col(key), F.col("n")).otherwise(0)
    joined = per.join(shared, "trimmed", "left")
    return joined.groupBy(key).agg(F.sum("n").alias("n_lines"), (F.sum("n") - F.sum(gone)).alias("n_left"))


def balanced(parsed: DataFrame, order: str, caps: dict[str, int]) -> DataFrame:
    """The first entries of each level, up to the level's cap; levels without a cap are left out."""
    rank = F.row_number().over(Window.partitionBy("level").orderBy(order))
    cap = F.coalesce(*(F.when(F.col("level") == k, F.lit(v)) for k, v in caps.items()))
    top = parsed.where(F.col("level").isin(*caps)).withColumn("rank", rank).where(F.col("rank") <= max(caps.values()))
    return top.where(F.col("rank") <= cap).select("level", "rank", order, "message")


def length_buckets(lines: DataFrame, width: int = 50) -> DataFrame:
    """Histogram of line lengths in steps of ``width`` characters."""
    low = (F.floor(F.length("line") / width) * width).cast("long")
    return lines.groupBy(low.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("line")).cast("long").alias("longest"))


def overview(docs: DataFrame, by: str) -> DataFrame:
    """Artefacts, lines and characters per value of ``by``, with the one of most lines (the least key on ties)."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    best = F.max_by("doc_id", F.struct(n, -F.col("doc_id")))
    return docs.groupBy(by).agg(
        F.count(F.lit(1)).alias("files"), F.sum(n).alias("lines"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"), best.alias("longest")
    )


def dominant_level(parsed: DataFrame, key: str) -> DataFrame:
    """Most frequent level of each group; ties go to the more severe."""
    count = {k: F.count_if(F.col("level") == k) for k in ("error", "warning", "info", "debug")}
    counted = parsed.groupBy(key).agg(*(c.alias(k) for k, c in count.items()))
    top = F.greatest(*count)
    return counted.select(key, *count, F.coalesce(*(F.when(F.col(k) == top, F.lit(k)) for k in count)).alias("dominant"))
