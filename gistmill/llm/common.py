"""Shared pieces of the training-data operators: the shared work folder, skew-proof joins, text constants."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character class and as a string.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names.

    Only where that setting is missing (local tests) a temporary folder of this
    machine is used, and then driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gistmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark then removes the shuffle files of a query as soon as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, name: str, *, drop_shuffles: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    With ``drop_shuffles`` the shuffle files of the write go as it ends; nothing cached may depend on them.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    if drop_shuffles:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Remove tables of ``write_table`` that nothing still to be computed reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_memory(spark: SparkSession) -> None:
    """Give back what ended jobs still hold: shuffle files and broadcasts of plans that nothing refers to any more,
    and the driver's freed native memory.

    Spark removes such files only once the driver happens to collect its garbage. The C library keeps what short-lived
    threads and the compiler have freed; ``trim_native`` returns it to the system.
    """
    for pause in (0.1, 0):  # the second round finds what Spark's threads have let go since the first
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)
    trim_native(spark)


def trim_native(spark: SparkSession) -> str:
    """Have the driver's C library return freed pages; what the JVM says of it, or nothing where it has no such command."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def array(kind: object, *items: object) -> object:
        out = new(kind, len(items))
        for i, item in enumerate(items):
            out[i] = item
        return out

    with contextlib.suppress(Py4JError):  # by reflection: the bean's own class is not open to callers
        named = jvm.java.lang.Class.forName
        kinds = map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.Class, *kinds))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return str(invoke.invoke(beans, array(jvm.Object, commands, "systemTrimNativeHeap", None, None)))
    return ""


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores before it while a column has that name."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def located(docs: DataFrame, name: str = "locator") -> DataFrame:
    """``docs`` with the column ``name``: file and row index of each row, so that its content can be found again.

    A frame that is not a plain file scan is written to the shared folder first. Call it once and pass the
    frame on: a second call would write, and name, other files.
    """
    where = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    try:
        return docs.select(*docs.columns, where.alias(name))
    except AnalysisException:
        return write_table(docs, "located").select(*docs.columns, where.alias(name))


def skew_join(
    left: DataFrame, right: DataFrame, key: str, rows: str, total: int, salt: Column, how: str = "left", share: float = 1 / 512
) -> DataFrame:
    """Equi-join in which hot keys are spread over many partitions.

    ``right`` has one row per ``key`` and in ``rows`` the number of rows that
    ``left`` has of it; ``total`` is the sum. Keys with more than ``share`` of
    all rows are fewer than 1/share, so the list of them can be broadcast
    whatever the size of the input; each is split in pieces of ``share`` by
    ``salt``, and its row of ``right`` repeated for each piece. Null keys match nothing.
    """
    piece = max(1.0, total * share)
    parts = F.ceil(F.col(rows) / F.lit(piece)).cast("int")
    hot = right.where((F.col(rows) > piece) & F.col(key).isNotNull()).select(key, parts.alias("_parts"))
    spread = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(salt), F.col("_parts")).cast("int"))
    )
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return spread.join(copies, [key, "_salt"], how).drop("_salt", "_parts")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pieces(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``size`` bytes of text, or one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size)))
            yield b.slice(at, to - at)
            at = to


def gathered(values: np.ndarray, begin: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values[begin[k] : begin[k + 1]]`` of each k of ``numbers`` in a row, and the end of each in it."""
    size = np.diff(begin)[numbers]
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[numbers] - (ends - size), size)
    return values[at], ends


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts in a row, bounds of each); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "i8")
    first, last = int(bounds[0]), int(bounds[-1])
    data = np.frombuffer(texts.buffers()[2], "u1")[first:last] if last > first else np.zeros(0, "u1")
    return data, bounds - first


def large_strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The strings ``data[bounds[k] : bounds[k + 1]]``, without a copy."""
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, "<i8")), pa.py_buffer(np.ascontiguousarray(data)))
