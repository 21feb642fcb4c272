"""Files: existence, loading by several patterns, capped search and counts by folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most files of a search, and deepest folder of a tree.
MOST_FOUND, DEEPEST = 500, 5


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def load(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(path, content) of the files that any of the patterns (with ``{a,b}``, ``*``, ``?``) matches, each file once; those that vanish or cannot be read are skipped."""
    matched = []
    for pattern in patterns:
        p, fs = _path(spark, pattern)
        if fs.globStatus(p):
            matched.append(pattern)
    if not matched:
        return spark.createDataFrame([], "path string, content string")
    files = spark.read.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").text(matched, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).dropDuplicates(["path"])


def search(files: DataFrame, pattern: str, most: int = MOST_FOUND) -> DataFrame:
    """The first ``most`` files by path whose path matches the regular expression."""
    return files.where(F.col("path").rlike(pattern)).orderBy("path").limit(most)


def tree(files: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """(folder, level, files, size) of every folder down to ``depth``; the root is the empty name. ``files`` has path and size."""
    parts = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    levels = F.sequence(F.lit(0), F.least(F.size("parts"), F.lit(depth)))
    rows = files.select("size", parts.alias("parts")).select("size", "parts", F.explode(levels).alias("level"))
    return rows.groupBy(F.array_join(F.slice("parts", F.lit(1), F.col("level")), "/").alias("folder"), "level").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))
