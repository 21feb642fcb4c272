"""Operators over lines of documents: runs, groups, templates, search, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def line_groups(lines: DataFrame) -> DataFrame:
    """Per document and normalised line: count, first line, whether any member speaks of errors or warnings; blanks go."""
    norm = X.replace_all(F.col("line"), P.GENERIC_LINE)
    marks = [F.col("line").rlike(X.java(p)) for p in (P.ERROR_LINE, P.WARNING_LINE)]
    grouped = lines.groupBy("doc_id", norm.alias("norm")).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").cast("long").alias("first_line"), F.max(marks[0]).alias("has_error"), F.max(marks[1]).alias("has_warning")
    )
    return grouped.where(F.col("norm") != "")  # after the grouping: the chain of replacements runs once a line


def runs(lines: DataFrame, least: int) -> DataFrame:
    """Runs of consecutive lines with equal normal form, of ``least`` lines or more."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    norm = X.replace_all(F.col("line"), P.GENERIC_LINE)
    marked = lines.withColumn("norm", norm).withColumn("new", (~F.col("norm").eqNullSafe(F.lag("norm").over(w))).cast("int")).withColumn("run", F.sum("new").over(w))
    out = marked.groupBy("doc_id", "run").agg(F.min("line_no").cast("long").alias("start"), F.count(F.lit(1)).alias("n"), F.min("norm").alias("norm"))
    return out.where(F.col("n") >= least).drop("run")


def templates(lines: DataFrame, least: int) -> DataFrame:
    """Line templates: variable parts replaced; count and number of documents."""
    return (
        lines.where(X.trim(F.col("line")) != "").groupBy(X.replace_all(F.col("line"), P.TEMPLATE).alias("template"))
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs")).where(F.col("n") >= least)
    )


def template_anomalies(found: DataFrame) -> DataFrame:
    """Templates whose count exceeds three times the mean count."""
    mean = found.agg(F.avg("n").alias("mean"))
    return found.join(F.broadcast(mean)).where(F.col("n") > 3 * F.col("mean")).select("template", "n")  # one row


def grep(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines that match, with the 1-based column of the first match and the number of matches."""
    hits = lines.where(F.col("line").rlike(pattern))
    return hits.select("doc_id", "line_no", F.regexp_instr("line", F.lit(pattern)).cast("long").alias("col"), F.regexp_count("line", F.lit(pattern)).cast("long").alias("matches"))


def content_type(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Ordered rules: short texts are generic, then trace, log lines (30 %), JSON, code, generic. Columns of ``keep`` stay."""
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(t, "\n", -1)
    logs = F.size(F.filter(lines, lambda x: x.rlike(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"))) / F.size(lines)
    kind = (
        F.when(F.char_length(X.trim(t)) < 10, "generic")
        .when(t.rlike(r"(?m)^\s+at .+:\d+"), "stacktrace")
        .when(logs >= 0.3, "logs")
        .when(t.rlike(r"\A\s*[\[{]") & F.try_parse_json(t).isNotNull(), "config")
        .when(t.rlike(r"(?m)^(import|export|const|let|var|function|class|interface|type|def|fn|func|struct)\s+\S+.*[({;=]"), "code")
        .otherwise("generic")
    )
    return docs.select("doc_id", *(keep or []), kind.alias("content_type"))


def token_report(docs: DataFrame) -> DataFrame:
    """Per language: documents, tokens, and how many exceed 2 000 tokens."""
    n = X.tokens(F.coalesce(F.col("text"), F.lit("")))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(n).alias("tokens"), F.max(n).alias("most"), F.count_if(n > 2000).alias("over"))


def handles(docs: DataFrame) -> DataFrame:
    """Content-addressed handle of each text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.concat(F.lit("d"), F.substring(F.sha1(t), 1, 10)).alias("handle"), F.md5(t).alias("md5"))
