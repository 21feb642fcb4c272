"""Tables, and artefacts derived from them: log lines, compiler output, diffs, chats, code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 0, line) of every text; a trailing empty line stays."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END"
MESSAGE = """concat('user ', user_id, ' sent ', event_type, ' to /api/', event_type, '/', event_id % 50, ' in ', event_id % 900, 'ms from 10.0.', user_id % 5, '.', user_id % 200, ' "', event_type, '"')"""
METHOD = "CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'error' THEN 'DELETE' ELSE 'GET' END"
REQUEST = f"concat({METHOD}, ' /api/', event_type, '/', event_id % 50, '?q=', user_id, ' ', CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 11 = 0 THEN 404 ELSE 200 END, ' ', event_id % 900, 'ms')"
COMPILER = "concat('src/part', l_partkey % 37, '.ts(', l_orderkey % 80 + 1, ',', l_linenumber, '): error TS', 2300 + l_suppkey % 7, ': Property ''p', l_partkey % 11, ''' is missing in line ', l_orderkey % 90)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, line): ``events`` as application log lines."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.expr(LEVEL), F.lit("] "), F.expr(MESSAGE)).alias("line"))


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(REQUEST).alias("line"))


def compiler_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(COMPILER).alias("line"))
