"""Compiler output, error signatures, stack frames, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def compiler_errors(lines: DataFrame) -> DataFrame:
    """file, row, col, severity, code, message of compiler lines; other lines go."""
    part = lambda i: F.regexp_extract("line", P.TS_ERROR, i)
    return lines.where(F.col("line").rlike(P.TS_ERROR)).select(
        part(1).alias("file"), part(2).cast("int").alias("row"), part(3).cast("int").alias("col"), part(4).alias("severity"), part(5).alias("code"), part(6).alias("message")
    )


def error_groups(errors: DataFrame) -> DataFrame:
    """Per signature (code and normalised message): count, files, first file. Each distinct message is normalised once."""
    distinct = errors.groupBy("code", "message", "file").agg(F.count(F.lit(1)).alias("n"))
    signature = F.concat("code", F.lit(": "), X.replace_all(F.col("message"), P.ERROR_SIGNATURE))
    return distinct.groupBy(signature.alias("signature")).agg(F.sum("n").alias("n"), F.countDistinct("file").alias("files"), F.min("file").alias("first_file"))


def error_stats(errors: DataFrame) -> DataFrame:
    return error_groups(errors).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("groups"), F.round(100.0 * (1 - F.count(F.lit(1)) / F.sum("n")), 6).alias("reduction")
    )


def carry_forward(lines: DataFrame, header: str) -> DataFrame:
    """The last header line at or before each line, per document."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("header", F.last(F.when(F.col("line").rlike(header), F.col("line")), ignorenulls=True).over(w))


def frame_islands(lines: DataFrame) -> DataFrame:
    """Runs of internal stack frames: start, length."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("internal", F.col("line").rlike(P.INTERNAL_FRAME))
    island = F.sum((~F.col("internal").eqNullSafe(F.lag("internal").over(w))).cast("int"))
    return (
        marked.withColumn("new", (~F.col("internal").eqNullSafe(F.lag("internal").over(w))).cast("int")).withColumn("island", F.sum("new").over(w)).where("internal")
        .groupBy("doc_id", "island").agg(F.min("line_no").cast("long").alias("start"), F.count(F.lit(1)).alias("frames")).drop("island")
    )


def diff_parse(lines: DataFrame) -> DataFrame:
    """Lines of a unified diff with the running file and hunk, and kind: file, hunk, add, del, context."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    line = F.col("line")
    kind = (
        F.when(line.startswith("diff --git"), "file").when(line.startswith("@@"), "hunk").when(line.startswith("+++") | line.startswith("---"), "head")
        .when(line.startswith("+"), "add").when(line.startswith("-"), "del").otherwise("context")
    )
    return lines.withColumn("kind", kind).withColumn("file_no", F.sum((F.col("kind") == "file").cast("int")).over(w)).withColumn("hunk_no", F.sum((F.col("kind") == "hunk").cast("int")).over(w))


def diff_files(parsed: DataFrame) -> DataFrame:
    path = F.max(F.when(F.col("kind") == "file", F.regexp_extract("line", r" b/(\S+)$", 1)))
    return parsed.groupBy("doc_id", "file_no").agg(
        path.alias("path"), F.count_if(F.col("kind") == "add").alias("added"), F.count_if(F.col("kind") == "del").alias("deleted"), F.count_if(F.col("kind") == "hunk").alias("hunks")
    )


def diff_context(parsed: DataFrame, around: int = 1) -> DataFrame:
    """Changed lines and those within ``around`` lines of one in the same hunk."""
    w = Window.partitionBy("doc_id", "hunk_no").orderBy("line_no").rowsBetween(-around, around)
    near = F.max(F.col("kind").isin("add", "del").cast("int")).over(w)
    return parsed.withColumn("near", near).where((F.col("near") == 1) & F.col("kind").isin("add", "del", "context")).select("doc_id", "line_no", "kind")
