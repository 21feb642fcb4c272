"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; a document's expected number of copies is
target / size of its source. The whole part is certain. The fractional parts go
through pivotal steps: two documents with probabilities p and q exchange mass, weighted by
their sizes so that the expected words stay the same, until one probability becomes 0 or 1;
which of the two outcomes happens is drawn so that either's mean is unchanged.

Leaves of the reduction tree are (source, hash bucket) groups of about ``LEAF`` documents;
each leaves one undecided document. The undecided ones meet in groups of ``FAN`` leaves,
level by level, until one is left per source, which goes to its nearer bound. A hot
source has many leaves, so no task sees more than a leaf. Draws depend on the seed and
the group alone: reruns agree.

Edge cases: null text has size 0 and takes 0; a null source is a source of its own, last;
equal rows (doc_id, source, size) get the same number of copies as one unit; a source without
words has target 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, skew_join, write_table

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
LEAF, FAN = 4096, 64
STATE = "source_key string, leaf long, doc_id long, size long, units long, p double"


def n_words(text: Column) -> Column:
    """Runs of characters that are not white space."""
    packed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.char_length(F.translate(packed, SPACES, "")).cast("long")


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source_key, docs, source_size, target: one row per source.

    Water-filling: capped sources are those with the least cap per weight; the rest share what is left by weight.
    """
    sources = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy("source_key")  # per-source totals only
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)) + 1)
    full = F.col("source_size") * F.lit(float(cap))
    least = Window.orderBy("ratio", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        sources.withColumn("weight", weight)
        .withColumn("full", full)
        .withColumn("ratio", F.col("full") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) * share - F.coalesce(F.sum("full").over(least), F.lit(0.0)))
        .withColumn("shares", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(least), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("shares"))
    )
    # the first source in this order that the level does not fill sets the level for all after it
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source_key", "level"))).over(everything)["level"]
    target = F.least(F.col("full"), F.coalesce(level * F.col("weight"), F.col("full")))
    return ranked.select("source_key", "docs", "source_size", target.cast("double").alias("target"))


def pivotal(rows: list[tuple[int, float]], draw: Callable[[], float]) -> tuple[list[int], int | None, float]:
    """Rounded probabilities of (mass, p) rows, and the one row (index, p) left undecided.

    A decided row holds 0 or 1; the undecided one holds -1. Rows without mass are 0.
    """
    out = [0] * len(rows)
    held: int | None = None
    p_held = 0.0
    for i, (mass, p) in enumerate(rows):
        if mass == 0 or p <= 0:
            continue
        if p >= 1:
            out[i] = 1
            continue
        if held is None:
            held, p_held = i, p
            continue
        a, b = rows[held][0], mass
        up = min((1 - p_held) * a, p * b)  # words that can go from i to held
        down = min(p_held * a, (1 - p) * b)
        if draw() * (up + down) < down:
            step = up
        else:
            step = -down
        q_held, q = p_held + step / a, p - step / b
        # whichever reached its bound is decided; take it from the bound that set the step, not from rounding
        first = (1 - p_held) * a <= p * b if step > 0 else p_held * a <= (1 - p) * b
        if first:
            out[held] = 1 if step > 0 else 0
            held, p_held = i, q
        else:
            out[i] = 0 if step > 0 else 1
            p_held = q_held
        if p_held <= 1e-12 or p_held >= 1 - 1e-12:
            out[held] = int(p_held > 0.5)
            held = None
    if held is not None:
        out[held] = -1
    return out, held, p_held


def _round_group(seed: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="first")  # the one left is seldom large
        source, leaf = group["source_key"].iloc[0], int(group["leaf"].iloc[0])
        draw = random.Random(f"{seed}/{level}/{source}/{leaf}").random
        mass = group["size"] * group["units"]
        out, held, p = pivotal(list(zip(mass.tolist(), group["p"].tolist(), strict=True)), draw)
        if last and held is not None:
            out[held] = int(p >= 0.5)  # the nearer one: the source is off by half a document at most
        return group.assign(extra=out, p=[p if x == -1 else 0.0 for x in out])

    return run


def mix(docs: DataFrame, *, seed: int = 7) -> DataFrame:
    """Per row of ``docs``: doc_id, source_key, size, source_size, target, copies, taken."""
    sizes = write_table(docs.select("doc_id", source_key(F.col("source")).alias("source_key"), n_words(F.col("text")).alias("size")), "sizes")
    per_source = write_table(targets(sizes), "targets")
    total = sizes.count()
    leaves = max(1, math.ceil(total / LEAF))
    units = sizes.groupBy("doc_id", "source_key", "size").agg(F.count(F.lit(1)).alias("units"))
    units = skew_join(units, per_source, "source_key", "docs", total, F.struct("doc_id", "size"), how="inner")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.withColumn("rate", rate).withColumn("base", F.floor("rate"))
    state = units.select(
        "source_key", F.pmod(F.xxhash64("doc_id", "size"), F.lit(leaves)).alias("leaf"), "doc_id", "size", "units", (F.col("rate") - F.col("base")).alias("p"),
        "source_size", "target", "base",
    )
    carry = ", source_size long, target double, base long"
    done = None
    level = 0
    while True:
        last = leaves == 1
        rounded = state.groupBy("source_key", "leaf").applyInPandas(_round_group(seed, level, last), STATE + carry + ", extra long")
        rounded = write_table(rounded, f"mix{level}")
        decided = rounded.where("extra >= 0")
        done = decided if done is None else done.unionByName(decided)
        if last:
            break
        leaves = math.ceil(leaves / FAN)
        level += 1
        state = rounded.where("extra < 0").drop("extra").withColumn("leaf", F.floor(F.col("leaf") / FAN))
    copies = F.col("base") + F.col("extra")
    return done.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("units").cast("int")))).select(
        "doc_id", "source_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixing_stage(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    copies = mix(docs.select("doc_id", "source", "text")).where("copies > 0").select("doc_id", "source_key", "size", "copies").distinct()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), source_key(docs["source"]).alias("key"), n_words(docs["text"]).alias("words"))
    taken = rows.join(copies, F.expr("id <=> doc_id AND key = source_key AND words = size"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import documents

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
