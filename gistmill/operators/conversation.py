"""Conversation operators: last turns, constraints, decisions, code references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("k", rank).where(F.col("k") <= n).select("conv_id", "turn", "role", X.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def constraints(turns: DataFrame, most: int = 20) -> DataFrame:
    """Lines of 8 to 240 characters that state a constraint, without list marks, first occurrence each whatever its case, at most ``most`` a conversation."""
    line = turns.select("conv_id", "turn", F.posexplode(F.split("text", r"\n")).alias("pos", "raw")).withColumn("line", X.trim(F.col("raw")))
    states = F.lit(False)
    for p in P.CONSTRAINTS:
        states = states | F.col("line").rlike(X.java(p, True))
    hits = line.where(F.char_length("line").between(8, 240) & states)
    clean = F.regexp_replace(F.regexp_replace("line", r"^[-*]\s+", ""), r"^\d+\.\s+", "")
    first = hits.withColumn("line", clean).groupBy("conv_id", F.lower("line").alias("key")).agg(F.min(F.struct("turn", "pos", "line")).alias("at")).withColumn("line", F.col("at.line"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("at"))
    return first.withColumn("k", rank).where(F.col("k") <= most).select("conv_id", "k", "line", F.col("at.turn").alias("turn"))


def decisions(turns: DataFrame) -> DataFrame:
    """What follows a decision phrase, up to the end of its sentence."""
    what = F.regexp_extract("text", r"(?i)(?:decided to|will use|let's use|going with)\s+([^.\n]+)", 1)
    return turns.withColumn("decision", X.trim(what)).where(F.char_length("decision") > 0).select("conv_id", "turn", "decision")


def code_refs(turns: DataFrame) -> DataFrame:
    """File names and the first turn that has each, per conversation."""
    found = turns.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(X.java(P.CODE_FILE)), F.lit(0))).alias("file"))
    return found.groupBy("conv_id", "file").agg(F.min("turn").alias("turn"), F.count(F.lit(1)).alias("mentions"))
