"""Text out of results, and text made safe to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

ZERO_WIDTH = "​"


def truncated(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def defanged(text: Column) -> Column:
    """Control tags and override phrases broken by a zero-width space."""
    tags = F.regexp_replace(text, X.java(P.CONTROL_TAG, True), f"<$1{ZERO_WIDTH}$2")
    return F.regexp_replace(tags, X.java(P.INJECTION, True), f"$1{ZERO_WIDTH}$2")


def redacted(message: Column, work_dir: str) -> Column:
    """Host paths of an error message replaced."""
    out = F.replace(message, F.lit(work_dir), F.lit("<workdir>"))
    for p, by, ignore in P.HOST_PATHS:
        out = F.regexp_replace(out, X.java(p, ignore), by)
    return out


def cluster_id(pattern: Column) -> Column:
    """31-fold hash of the characters in 32 bits, its amount in base 36."""
    step = lambda h, c: F.pmod(h * 31 + F.ascii(c) + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return F.concat(F.lit("cl_"), F.lower(F.conv(F.abs(F.aggregate(F.split(pattern, ""), F.lit(0).cast("long"), step)).cast("string"), 10, 36)))


def line_range(text: Column, start: int, end: int) -> Column:
    """Lines ``start`` to ``end``, counted from 1, as far as there are."""
    first = max(1, start)
    return F.array_join(F.slice(F.split(text, "\n", -1), first, max(0, end - first + 1)), "\n")


def savings_lines(calls: DataFrame) -> DataFrame:
    """A line for each call (session, call, original, optimized) with what it and its session so far saved."""
    so_far = Window.partitionBy("session").orderBy("call")
    saved = F.greatest(F.col("original") - F.col("optimized"), F.lit(0))
    rows = calls.withColumn("saved", saved).withColumn("total", F.sum("saved").over(so_far)).withColumn("calls", F.row_number().over(so_far))
    share = F.when(F.col("original") > 0, F.floor(100 * F.col("saved") / F.col("original") + 0.5)).otherwise(0).cast("long")
    number = lambda c: F.format_number(F.col(c), 0)
    text = F.concat(F.lit("[saved "), number("saved"), F.lit(" tokens ("), share.cast("string"), F.lit("%) this call; session total "), number("total"), F.lit(" tokens over "), F.col("calls").cast("string"), F.lit(" calls]"))
    return rows.select("session", "call", text.alias("text"))


def diff_summary(files: DataFrame) -> DataFrame:
    """(doc_id, text): totals of a diff, then its files by status; ``files`` has line_no, old_path, path, status, additions, deletions, hunks."""
    size, plural = F.col("hunks").cast("string"), F.when(F.col("hunks") == 1, "").otherwise("s")
    changed = F.concat(F.lit(": +"), "additions", F.lit("/-"), "deletions", F.lit(", "), size, F.lit(" hunk"), plural)
    entry = (
        F.when(F.col("status") == "added", F.concat("path", F.lit(" (+"), "additions", F.lit(")")))
        .when(F.col("status") == "modified", F.concat(F.col("path"), changed))
        .when(F.col("status") == "deleted", F.concat("old_path", F.lit(" (-"), "deletions", F.lit(")")))
        .otherwise(F.concat("old_path", F.lit(" -> "), "path"))
    )
    rank = F.array_position(F.array(*[F.lit(s) for s in ("added", "modified", "deleted", "renamed")]), F.col("status"))
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.concat(F.lit("- "), "entry").alias("e")))), lambda x: x["e"]), "\n")
    sections = files.select("*", entry.alias("entry"), rank.alias("rank")).groupBy("doc_id", "status", "rank").agg(
        F.count(F.lit(1)).alias("n"), F.sum("additions").alias("a"), F.sum("deletions").alias("d"), entries.alias("entries")
    )
    section = F.concat(F.lit("### "), F.initcap("status"), F.lit(" ("), "n", F.lit(")\n"), "entries")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", section.alias("s")))), lambda x: x["s"]), "\n\n")
    head = F.concat(F.lit("## Diff Summary\n- Files changed: "), F.sum("n"), F.lit("\n- Additions: +"), F.sum("a"), F.lit("\n- Deletions: -"), F.sum("d"), F.lit("\n\n"))
    return sections.groupBy("doc_id").agg(F.concat(head, joined).alias("text"))


def error_groups(groups: DataFrame, threshold: int = 2, keep_first: int = 1) -> DataFrame:
    """(doc_id, text): groups of ``threshold`` or more in full, most frequent first, then some rarer ones by their first line.

    ``groups`` has first_no (order of appearance), code, message, n, first and the array locations.
    """
    repeated, most = F.col("n") >= threshold, keep_first * 5
    rank = F.row_number().over(Window.partitionBy("doc_id", repeated).orderBy(F.desc("n"), "first_no"))
    title = F.concat(F.when(F.col("code") == "", "").otherwise(F.concat("code", F.lit(": "))), truncated(F.col("message"), 80))
    others, left = F.array_join(F.slice("locations", 2, 5), ", "), F.size("locations") - 6
    also = F.when(F.size("locations") > 1, F.concat(F.lit("   Also in: "), others, F.when(left > 0, F.concat(F.lit(" (+"), left, F.lit(" more)"))).otherwise(""), F.lit("\n"))).otherwise("")
    full = F.concat("k", F.lit(". "), title, F.lit("\n   Occurrences: "), "n", F.lit("\n   First: "), truncated(F.col("first"), 100), F.lit("\n"), also)
    ranked = groups.withColumn("repeated", repeated).withColumn("k", rank)
    entry = ranked.select("doc_id", "repeated", "k", F.when(F.col("repeated"), full).otherwise(F.concat(F.lit("  "), "first")).alias("entry"))
    listed = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("k", "entry")))), lambda x: x["entry"])
    rare = F.count_if(~F.col("repeated"))
    found = entry.groupBy("doc_id").agg(listed(F.col("repeated")).alias("all"), listed(~F.col("repeated") & (F.col("k") <= most)).alias("some"), (rare - most).alias("more"))
    empty = F.array().cast("array<string>")
    top = F.when(F.size("all") > 0, F.concat(F.array(F.lit("DEDUPLICATED ERRORS:")), "all")).otherwise(empty)
    rest = F.when(F.col("more") > 0, F.array(F.concat(F.lit("  ...and "), "more", F.lit(" more unique errors")))).otherwise(empty)
    bottom = F.when(F.size("some") > 0, F.concat(F.array(F.lit("UNIQUE ERRORS:")), "some", rest, F.array(F.lit("")))).otherwise(empty)
    return found.select("doc_id", F.array_join(F.concat(top, bottom), "\n").alias("text"))


def concatenated(files: DataFrame) -> DataFrame:
    """(doc_id, text): the files of each doc_id one behind the other in order of path, each under its path."""
    part = F.concat(F.lit("// === "), "path", F.lit(" ===\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", part.alias("p")))), lambda x: x["p"])
    return files.groupBy("doc_id").agg(F.array_join(parts, "\n").alias("text"))
