"""Code scans and dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def quick_scan(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, name) of declarations, by line patterns."""
    kinds = [F.when(F.regexp_extract("line", p, 1) != "", F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", p, 1).alias("name"))) for k, p in P.TS_QUICK.items()]
    return lines.withColumn("e", F.coalesce(*kinds)).where("e IS NOT NULL").select("doc_id", "line_no", "e.kind", "e.name")


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """(src, dst, depth) reachable in at most ``depth`` steps, with the least number of steps.

    Each step joins the newest pairs with the edges and keeps the pairs not seen before.
    """
    edges = edges.select("src", "dst").distinct()
    seen = edges.withColumn("depth", F.lit(1))
    newest = seen
    for d in range(2, depth + 1):
        step = newest.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        newest = step.join(seen, ["src", "dst"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(newest)
    return seen


def unused(defined: DataFrame, used: DataFrame) -> DataFrame:
    """Names that no other file uses; the defining file does not count."""
    users = used.groupBy("name").agg(F.min("file").alias("lo"), F.max("file").alias("hi"))  # another file uses it if either differs
    found = defined.join(users, "name", "left").where(F.col("lo").isNull() | ((F.col("lo") == F.col("file")) & (F.col("hi") == F.col("file"))))
    return found.select(*defined.columns)
