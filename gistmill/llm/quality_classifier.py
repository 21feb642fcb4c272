"""Quality classifier: supervised subword embeddings.

A word stands for the hashed vectors of itself and of its character n-grams (3 to 5,
with word bounds), two words in a row for a vector of the pair. A document is the average
of all of them, followed by a softmax layer; everything is learned together by stochastic
gradient descent in numpy. Scores are then linear in the average, so a word's share of
the score is one number, computed once for each distinct word of a piece of a batch.

Training uses at most ``MAX_TRAIN`` labelled rows (documented bound), those with the least hash
of doc_id, as hashed feature counts made on the executors from whole texts, with all features of each
(``BUCKETS`` at most). The driver keeps them in a temporary file and reads them row by row.
Scoring reads every document and every word.

Edge cases: null, empty and blank texts have no features and score the bias alone; without
both labels in the training rows all scores are the share of label 1 (0.5 without rows);
repeated rows score alike (each is learned from); null labels and null doc_ids are not learned from; long texts count with all
their words; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import documents, pieces, write_table

BUCKETS = 1 << 17
DIM = 8
EPOCHS = 6
RATE = 0.5
MAX_TRAIN = 6000
THRESHOLD = 0.3
_ODD, _EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, index of its word) of each feature of ``words``, the words themselves and their character n-grams; hashes of the words."""
    own = np.fromiter((zlib.crc32(w.encode()) for w in words), "u8", len(words))
    marked = [f"<{w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype("u8")
    size = np.fromiter(map(len, marked), "i8", len(words))
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(chars))  # characters from here to the word's end
    ids, owner = [_bucket(own + np.uint64(1))], [np.arange(len(words))]
    gram = np.zeros(len(chars), "u8")
    for n in range(1, 6):
        gram = gram[: len(chars) - n + 1] * _ODD + chars[n - 1 :] if len(chars) >= n else chars[:0]
        if n >= 3:
            inside = left[: len(gram)] >= n
            ids.append(_bucket(gram[inside] + np.uint64(n)))
            owner.append(word[: len(gram)][inside])
    return np.concatenate(ids), np.concatenate(owner), own


def _bucket(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _EVEN
    return ((x >> np.uint64(29)) % np.uint64(BUCKETS)).astype("i8")


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Buckets of words in a row."""
    return _bucket(hashes[:-1] * _ODD + hashes[1:])


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, index in the list of distinct words) of every word, in order, and the distinct words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    rows, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    keep = pc.not_equal(flat, "")
    rows, coded = rows[keep.to_numpy(zero_copy_only=False)], pc.dictionary_encode(flat.filter(keep))
    return rows, coded.indices.to_numpy(), coded.dictionary.to_pylist()


@dataclass
class Model:
    """``weight``: what each bucket adds to the log odds, before averaging; ``bias``: the rest."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows, index, words = split_words(texts)
        n = len(texts)
        ids, owner, hashes = word_features(words)
        total = np.bincount(rows, np.bincount(owner, self.weight[ids], len(words))[index], n)
        count = np.bincount(rows, np.bincount(owner, minlength=len(words))[index], n)
        if len(index) > 1:
            same = rows[1:] == rows[:-1]
            total += np.bincount(rows[1:][same], self.weight[_pairs(hashes[index])[same]], n)
            count += np.bincount(rows[1:][same], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            _, index, words = split_words(b["text"].slice(i, 1))
            ids, owner, hashes = word_features(words)
            counts = np.bincount(ids, np.bincount(index, minlength=len(words))[owner], BUCKETS)
            if len(index) > 1:
                counts += np.bincount(_pairs(hashes[index]), minlength=BUCKETS)
            ids = np.flatnonzero(counts)
            n = counts[ids]
            row = [int(b["doc_id"][i].as_py()), int(b["label"][i].as_py()), ids.astype("<i4").tobytes(), (n / max(1, n.sum())).astype("<f4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["doc_id", "label", "ids", "share"])


class FeatureFile(Sequence):
    """Rows of label, buckets and shares in a temporary file of the driver; what stays in memory is a few numbers a row."""

    def __init__(self, rows: Iterable[tuple[int, int, bytes, bytes]]) -> None:
        self._file, places, at = tempfile.TemporaryFile(), [], 0
        for doc_id, label, ids, share in rows:
            self._file.write(ids + share)
            places.append((doc_id, label, hashlib.sha256(ids + share).digest(), at, len(ids)))
            at += 2 * len(ids)
        self._places = sorted(places)
        self.longest = max((p[4] // 4 for p in places), default=0)
        self.labels = [p[1] for p in self._places]

    def __len__(self) -> int:
        return len(self._places)

    def __getitem__(self, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        _, label, _, at, size = self._places[k]
        self._file.seek(at)
        data = self._file.read(2 * size)
        return label, np.frombuffer(data[:size], "<i4"), np.frombuffer(data[size:], "<f4")

    def close(self) -> None:
        self._file.close()


def train(rows: FeatureFile, *, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Model:
    """Embeddings and softmax by stochastic gradient descent; rows: label, buckets, shares."""
    ones = sum(rows.labels)
    if not ones or ones == len(rows):
        share = (ones + 1e-9) / len(rows) if rows else 0.5
        return Model(np.zeros(BUCKETS, "f4"), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype("f4")
    out = rng.uniform(-0.5, 0.5, (2, dim)).astype("f4")
    whole = emb.view(f"V{4 * dim}")[:, 0]  # a row as one item, which is quicker to put back
    held, spare = (np.empty((rows.longest, dim), "f4") for _ in range(2))
    bias = np.zeros(2, "f4")
    balance = (len(rows) / (2 * (len(rows) - ones)), len(rows) / (2 * ones))
    steps, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            label, ids, share = rows[k]
            lr = rate * (1 - steps / total)
            steps += 1
            ids, own, change = ids.astype("i8"), held[: len(ids)], spare[: len(ids)]
            np.take(emb, ids, axis=0, out=own, mode="clip")
            hidden = share @ own
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            g = (p * balance[label]).astype("f4")
            back = g @ out
            out -= lr * np.outer(g, hidden)
            bias -= lr * g
            own -= np.multiply.outer(share, (lr * min(len(ids), 50) * back).astype("f4"), out=change)
            whole[ids] = own.view(whole.dtype)[:, 0]
    return Model((emb @ (out[1] - out[0])).astype("f4"), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN) -> Model:
    """Learn from labelled rows that are not held out, at most ``max_train``."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_train rows at most
    seen = texts.select(F.col("doc_id").cast("long"), F.col("label").cast("long"), "text").mapInArrow(_count_features, "doc_id long, label long, ids binary, share binary")
    found = write_table(seen, "features").toLocalIterator()
    rows = FeatureFile((r["doc_id"], r["label"], bytes(r["ids"]), bytes(r["share"])) for r in found)
    try:
        return train(rows)
    finally:
        rows.close()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 is likelier)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            values = pa.array(shared.value.scores(b["text"]), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, values], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def classify_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier takes for good, with the columns of ``docs``."""
    model = fit(docs, labels)
    own = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score(own, model).where(F.col("score") >= THRESHOLD).select("row.*")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
