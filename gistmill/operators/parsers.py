"""Parsers of test, build and version-control output: one pass over lines, islands by running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def _signature(code: Column, message: Column) -> Column:
    return F.concat(code, F.lit(":"), X.trim(F.substring(X.replace_all(message, P.SHORT_SIGNATURE), 1, 100)))


def test_results(lines: DataFrame) -> DataFrame:
    """Lines that state a test's result, in five formats, first match: name, status (pass, fail, skip) and milliseconds."""
    line = F.col("line")
    part = lambda p, i, ignore=False: F.regexp_extract(line, X.java(p, ignore), i)
    is_ = lambda p, ignore=False: line.rlike(X.java(p, ignore))
    word = lambda c, fail, skip: F.when(c.isin(*fail), "fail").when(c.isin(*skip), "skip").otherwise("pass")
    result = lambda name, status, ms=F.lit(None): F.struct(name.alias("name"), status.alias("status"), F.when(ms != "", ms).cast("long").alias("ms"))
    found = (
        F.when(is_(P.TEST_SYMBOL), result(X.trim(part(P.TEST_SYMBOL, 2)), word(part(P.TEST_SYMBOL, 1), ["✕"], ["○"]), part(P.TEST_SYMBOL, 3)))
        .when(is_(P.TEST_FILE), result(part(P.TEST_FILE, 2), F.when(part(P.TEST_FILE, 1) == "PASS", "pass").otherwise("fail")))
        .when(is_(P.TEST_NUMBERED), result(X.trim(part(P.TEST_NUMBERED, 3)), F.when(part(P.TEST_NUMBERED, 1) != "", "fail").otherwise("pass"), part(P.TEST_NUMBERED, 4)))
        .when(is_(P.TEST_PYTHON), result(part(P.TEST_PYTHON, 2), word(part(P.TEST_PYTHON, 1), ["FAILED", "ERROR"], ["SKIPPED"])))
        .when(is_(P.TEST_BRACKET, True), result(X.trim(part(P.TEST_BRACKET, 2, True)), word(F.upper(part(P.TEST_BRACKET, 1, True)), ["FAIL"], ["SKIP"])))
    )
    return lines.withColumn("r", found).where("r IS NOT NULL").select("doc_id", "line_no", "r.name", "r.status", "r.ms")


def test_summary(results: DataFrame) -> DataFrame:
    """Per doc_id: results by status, share of passes in per cent, total milliseconds and the first failed test."""
    return results.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "skip").alias("skipped"),
        F.round(100.0 * F.count_if(F.col("status") == "pass") / F.count(F.lit(1)), 4).alias("pass_rate"), F.coalesce(F.sum("ms"), F.lit(0)).alias("ms"),
        F.min_by("name", F.when(F.col("status") == "fail", F.col("line_no"))).alias("first_failed"),
    )


def build_milliseconds(text: Column) -> Column:
    """Duration of a build: the first of four phrasings that its output has; null without one."""
    found = []
    for p in P.DURATIONS:
        value, unit = (F.regexp_extract(text, "(?i)" + p, i) for i in (1, 2))
        found.append(F.when(value != "", value.cast("double") * F.when(F.lower(unit) == "s", 1000).otherwise(1)))
    return F.coalesce(*found)


def bundle_sizes(lines: DataFrame) -> DataFrame:
    """file, size, unit of lines that state a bundle's size."""
    part = lambda i: F.regexp_extract("line", "(?i)" + P.BUNDLE, i)
    return lines.where(part(1) != "").select("doc_id", "line_no", part(1).alias("file"), part(2).cast("double").alias("size"), part(3).alias("unit"))


def rust_errors(lines: DataFrame) -> DataFrame:
    """Errors with a code, each with the last place named before the next error."""
    so_far = Window.partitionBy("doc_id").orderBy("line_no")
    code = F.regexp_extract("line", P.RUST_ERROR, 1)
    marked = lines.withColumn("code", F.when(code != "", F.concat(F.lit("E"), code))).withColumn("error", F.count("code").over(so_far)).where("error > 0")
    place = F.when(F.col("line").rlike(P.RUST_PLACE) & F.col("code").isNull(), F.struct("line_no", "line"))
    found = marked.groupBy("doc_id", "error").agg(F.max("code").alias("code"), F.max(F.when(F.col("code").isNotNull(), F.col("line"))).alias("raw"), F.max(place).alias("at"))
    part = lambda i: F.regexp_extract("at.line", P.RUST_PLACE, i)
    message = F.regexp_extract("raw", P.RUST_ERROR, 2)
    return found.select(
        "doc_id", "error", "code", message.alias("message"), _signature(F.col("code"), message).alias("signature"),
        F.coalesce(part(1), F.lit("unknown")).alias("file"), F.coalesce(part(2).cast("long"), F.lit(0)).alias("row"), F.coalesce(part(3).cast("long"), F.lit(0)).alias("col"),
    )


def go_errors(lines: DataFrame) -> DataFrame:
    """Lines ``file:row:column: message``."""
    part = lambda i: F.regexp_extract("line", P.GO_ERROR, i)
    found = lines.where(F.col("line").rlike(P.GO_ERROR))
    return found.select("doc_id", "line_no", part(1).alias("file"), part(2).cast("long").alias("row"), part(3).cast("long").alias("col"), _signature(F.lit("GO"), part(4)).alias("signature"))


def changed_files(numstat: DataFrame, statuses: DataFrame) -> DataFrame:
    """file, additions, deletions, status of numstat lines; statuses come from name-status lines (the last one of a file), else modified."""
    part = F.split("line", "\t")
    count = lambda i: F.when(part[i] == "-", 0).otherwise(part[i].cast("long"))
    files = numstat.where((X.trim(F.col("line")) != "") & (F.size(part) >= 3)).select(part[2].alias("file"), count(0).alias("additions"), count(1).alias("deletions"))
    mark = F.substring(part[0], 1, 1)
    kind = F.when(mark == "A", "added").when(mark == "D", "deleted").when(mark == "R", "renamed").otherwise("modified")
    named = statuses.where(X.trim(F.col("line")) != "").select(F.element_at(part, -1).alias("file"), "line_no", kind.alias("status"))
    last = named.groupBy("file").agg(F.max_by("status", "line_no").alias("status"))
    return files.join(last, "file", "left").withColumn("status", F.coalesce("status", F.lit("modified")))


def webpack_errors(lines: DataFrame) -> DataFrame:
    """Errors with the last module message before the next error; those without one go."""
    so_far = Window.partitionBy("doc_id").orderBy("line_no")
    head = F.when(F.col("line").rlike(P.WEBPACK_ERROR), F.col("line"))
    message = F.when(~F.col("line").rlike(P.WEBPACK_ERROR) & F.col("line").rlike(P.WEBPACK_MODULE), F.regexp_extract("line", P.WEBPACK_MODULE, 1))
    marked = lines.select("*", head.alias("head"), message.alias("message")).withColumn("error", F.count("head").over(so_far)).where("error > 0")
    found = marked.groupBy("doc_id", "error").agg(F.max("head").alias("head"), F.max_by("message", F.when(F.col("message").isNotNull(), F.col("line_no"))).alias("message"))
    part = lambda i: F.regexp_extract("head", P.WEBPACK_ERROR, i)
    number = lambda i: F.when(part(i) == "", 0).otherwise(part(i).cast("long"))
    return found.where("message <> ''").select(
        "doc_id", "error", part(1).alias("file"), number(2).alias("row"), number(3).alias("col"), "message", _signature(F.lit("WEBPACK"), F.col("message")).alias("signature")
    )


def generic_errors(lines: DataFrame) -> DataFrame:
    """Errors and warnings of any tool, each with the last place named up to it and after the finding before it."""
    so_far = Window.partitionBy("doc_id").orderBy("line_no")
    line = F.col("line")
    part = lambda p, i: F.regexp_extract(line, "(?i)" + p, i)
    finding = lambda p, severity, code: F.when(
        line.rlike("(?i)" + p), F.struct(F.lit(severity).alias("severity"), F.when(part(p, 1) != "", part(p, 1)).otherwise(code).alias("code"), part(p, 2).alias("message"))
    )
    spot = lambda i: F.regexp_extract(line, P.GENERIC_PLACE, i)
    place = F.when(line.rlike(P.GENERIC_PLACE), F.struct(spot(1).alias("file"), spot(2).cast("long").alias("row"), F.coalesce(F.when(spot(3) != "", spot(3)).cast("long"), F.lit(0)).alias("col")))
    marked = lines.select("doc_id", "line_no", F.coalesce(finding(P.GENERIC_ERROR, "error", "ERROR"), finding(P.GENERIC_WARNING, "warning", "WARNING")).alias("f"), place.alias("place"))
    island = marked.withColumn("island", F.count("f").over(so_far.rowsBetween(Window.unboundedPreceding, -1)))
    placed = island.withColumn("at", F.last("place", ignorenulls=True).over(Window.partitionBy("doc_id", "island").orderBy("line_no"))).where("f IS NOT NULL")
    return placed.select(
        "doc_id", "line_no", "f.severity", "f.code", "f.message", _signature(F.col("f.code"), F.col("f.message")).alias("signature"),
        F.coalesce("at.file", F.lit("unknown")).alias("file"), F.coalesce("at.row", F.lit(0)).alias("row"), F.coalesce("at.col", F.lit(0)).alias("col"),
    )
