"""Exact deduplication as a stateful stream.

Arrivals (digest, identifier, content locator; never the text) go through a
streaming aggregation whose keyed state lies on disk in RocksDB and has no
watermark, so it never expires: per digest it keeps the number of rows and the
largest (doc_id, locator). A digest that has been hit (two rows or more) is then
checked on the full bytes: the texts behind it, those of earlier arrivals read back by their
locators, are grouped by their content, and if one digest stands for several texts, each text becomes a
class of its own. Content that no longer has the digest it came with stops the job.

Only DataFrame functions are used. Grouping by content combines copies on the map
side first, so a group with a third of all rows sends one text per task; the
join of members to classes splits hot digests (see ``common.skew_join``).

A locator is a file and a row in it. What arrives must stay in its files as long as the state lives: a frame that is not a plain file scan
is written to the shared folder, a ``text`` computed on top of a scan must be written by the caller.

Edge cases: a null text counts as empty; a null doc_id is smaller than any other;
of rows with the same doc_id and text the one with the larger locator stays;
an empty table gives an empty result; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, located, skew_join, work_dir

_STATE = "spark.sql.streaming.stateStore"
#: State on disk; no space reserved ahead and no store kept open between micro-batches, as there are many small ones.
STATE_CONF = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.allowFAllocate": "false",
    f"{_STATE}.unloadOnCommit": "true",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _rocksdb(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class StreamingDeduper:
    """Keyed digest state in ``folder``; ``ingest`` may be called again with later arrivals."""

    def __init__(self, spark: SparkSession, folder: str | None = None, files_per_batch: int = 1000) -> None:
        self.spark, self.folder, self.files_per_batch = spark, folder or work_dir(spark, "dedup"), files_per_batch
        self.arrivals, self.updates, self.offsets = (f"{self.folder}/{x}" for x in ("arrivals", "updates", "offsets"))

    def ingest(self, arrivals: DataFrame) -> str:
        """Append rows (digest, doc_id, locator, ...), run all micro-batches that are due and return the call's name, column ``call`` of the arrivals."""
        call = uuid.uuid4().hex
        arrivals = arrivals.withColumn("call", F.lit(call))
        arrivals.write.mode("append").parquet(self.arrivals)
        stream = self.spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(self.arrivals)
        state = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "locator")).alias("keep"))

        def keep_batch(batch: DataFrame, epoch: int) -> None:  # the same epoch overwrites its folder: safe to repeat
            batch.write.mode("overwrite").parquet(f"{self.updates}/epoch={epoch}")

        with _rocksdb(self.spark):
            query = (
                state.writeStream.outputMode("update").option("checkpointLocation", self.offsets).trigger(availableNow=True).foreachBatch(keep_batch).start()
            )
            query.awaitTermination()
        return call

    def seen(self) -> DataFrame:
        """All arrivals."""
        return self.spark.read.parquet(self.arrivals)

    def groups(self) -> DataFrame:
        """Latest state of each digest: digest, n, keep(doc_id, locator)."""
        last = F.max(F.struct("epoch", "n", "keep")).alias("s")
        return self.spark.read.parquet(self.updates).groupBy("digest").agg(last).select("digest", "s.n", "s.keep")


def _contents(seen: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, doc_id, locator, text of arrivals (digest, doc_id, locator), read back from their files."""
    spark = seen.sparkSession
    files = [r[0] for r in seen.select(F.substring_index("locator", "#", 1)).distinct().collect()]  # paths, one a file
    stored = located(spark.read.parquet(*files).select("text"), "_place").select("_place", F.coalesce("text", F.lit("")).alias("text"))
    changed = F.raise_error(F.concat(F.lit("the content has changed at "), F.col("locator")))
    found = seen.select("digest", "doc_id", "locator").join(stored, F.col("locator") == F.col("_place"))
    return found.select("digest", "doc_id", "locator", F.when(digest(F.col("text")) == F.col("digest"), F.col("text")).otherwise(changed).alias("text"))


def _classes_of_collided(texts: DataFrame) -> tuple[DataFrame, bool]:
    """Classes (digest, text, n, keep) of the digests that stand for more than one of ``texts``; whether there are any."""
    classes = texts.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "locator")).alias("keep"))
    bad = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    return classes.join(bad, "digest", "left_semi"), bool(bad.take(1))


def exact_dedup(
    docs: DataFrame,
    *,
    digest: Callable[[Column], Column] = sha256,
    deduper: StreamingDeduper | None = None,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """One row per arrival, those of ``docs`` and of earlier calls of ``deduper``: doc_id, locator, keep_id, group_size, kept, text_sha256."""
    return _dedup(located(docs.select("doc_id", "text")), digest, deduper or StreamingDeduper(docs.sparkSession), broadcast_rows)


def _dedup(docs: DataFrame, digest: Callable[[Column], Column], deduper: StreamingDeduper, broadcast_rows: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "locator", text.alias("text")).withColumn("digest", digest(F.col("text")))
    own = [] if digest is sha256 else [F.sha2("text", 256).alias("text_sha256")]
    call = deduper.ingest(rows.select("digest", "doc_id", "locator", *own))
    groups, seen = deduper.groups(), deduper.seen()
    stats = groups.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("hits")).first()
    total, hits = stats["rows"] or 0, stats["hits"]
    members = skew_join(seen, groups, "digest", "n", total, F.col("locator"), how="inner")
    members = members.withColumn("text_sha256", F.col("text_sha256" if own else "digest"))
    if hits:
        hit = groups.where("n > 1").select(F.xxhash64("digest").alias("_h"))
        # Up to broadcast_rows (8 bytes each) the hit digests filter the texts before the shuffle; beyond, a shuffled join does.
        hit = F.broadcast(hit) if hits <= broadcast_rows else hit.hint("shuffle_hash")
        was_hit = lambda df: df.withColumn("_h", F.xxhash64("digest")).join(hit, "_h", "left_semi").drop("_h")
        texts = was_hit(rows)
        earlier = was_hit(seen.where(F.col("call") != call))
        if earlier.take(1):
            texts = texts.unionByName(_contents(earlier, digest))
        split, collided = _classes_of_collided(texts)
        if collided:
            fixed = texts.join(split, ["digest", "text"]).select("locator", F.col("n").alias("_n"), F.col("keep").alias("_keep"))
            members = members.join(fixed, "locator", "left").select(
                "doc_id", "locator", "text_sha256", F.coalesce("_n", "n").alias("n"), F.coalesce("_keep", "keep").alias("keep")
            )
    return members.select(
        "doc_id",
        "locator",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("locator") == F.col("keep.locator")).alias("kept"),
        "text_sha256",
    )


def dedup_stage(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, with the columns of ``docs``."""
    place, missing = free_name(docs.columns, "locator"), free_name(docs.columns, "gone")
    rows = located(docs, place)
    found = _dedup(rows.select("doc_id", "text", F.col(place).alias("locator")), sha256, StreamingDeduper(docs.sparkSession), 1_000_000)
    gone = found.where("NOT kept").select(F.col("locator").alias(missing))
    return rows.join(gone, F.col(place) == F.col(missing), "left_anti").select(*docs.columns)


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     c AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, c.keep_id, c.group_size, t.doc_id = c.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN c USING (text)
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import documents

    return exact_dedup(documents(spark, sf_dir)).drop("locator")
