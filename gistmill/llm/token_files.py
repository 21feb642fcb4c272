"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Each part has ``<name>.bin``, the ids of its documents back to back as little-endian
unsigned integers (16 bits if the vocabulary allows it, else 32), and ``<name>.idx``:
the number of documents, their ids (64-bit), a null mask and n + 1 token offsets (64-bit). Parts are
ranges of doc_id of about ``PART_BYTES`` of text, so that part after part is ascending; a part's base is the prefix
sum of the token counts of those before it (one number a part, summed in groups). Readers map the files.

Texts are cut where the pre-tokeniser always has a bound: before a space or a full stop that stands behind and before
certain characters, and around a single line feed. The distinct pieces of a batch are found in Arrow; each is encoded once
per worker, its ids kept in a bounded table, and the ids of whole texts are gathered from that table with numpy.

Files are written under a name of their own for each attempt, and only files that a
finished task reports are read: a lost executor leaves at most an unused file.

Edge cases: null text counts as empty and has the end id alone; rows of equal doc_ids are ordered by
their text; a null doc_id comes first; long texts are pieces like others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, large_strings, pieces, text_bytes, work_dir, write_table

#: Pieces that a worker remembers before it starts afresh.
REMEMBERED = 200_000
PART_BYTES = 32 << 20
#: Parts whose token counts are summed as one for the prefix sums.
GROUP = 1024
#: New pieces that are encoded in one string, and bytes of text that are encoded at once.
JOINED, ENCODED_BYTES = 200, 4 << 20
PART_SCHEMA = pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])


def _bytes(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


_BLANK = _bytes(b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0")
#: Bytes that white space beyond ASCII begins with.
_LEAD = _bytes(b"\xc2\xe1\xe2\xe3")
_STOP = _bytes(b".,;:!?")
_ALNUM = _bytes(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places at which pieces of the texts that begin at ``starts`` begin; sorted, those of empty texts left out."""
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        solid = ~_BLANK[data] & ~_LEAD[data]
        cut[:-1] |= (data[:-1] == 32) & solid[1:]
        ascii_solid = ~_BLANK[data] & (data < 128)
        line = data == 10
        cut[1:] |= line[1:] & ascii_solid[:-1]
        cut[2:] |= line[1:-1] & ascii_solid[:-2] & solid[2:] & ~_BLANK[data[2:]]
        cut[1:] |= _STOP[data[1:]] & _ALNUM[data[:-1]]
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Texts to ids by a tokenizers file, each distinct piece encoded once."""

    def __init__(self, definition: str, end_id: int | None, dtype: str) -> None:
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(definition)
        self.dtype = dtype
        self.end = [] if end_id is None else [end_id]
        added = self.tokenizer.get_added_tokens_decoder().values()
        kind = type(self.tokenizer.pre_tokenizer).__name__
        # cuts are known to be bounds of the byte-level pre-tokeniser, and only if no added token reaches across one
        self.whole = kind != "ByteLevel" or self.tokenizer.normalizer is not None or any(t.lstrip or t.rstrip or set(" \n.,;:!?") & set(t.content) for t in added)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, "i8")  # bytes of each id: the byte-level alphabet has a character a byte
        for text, i in vocab.items():
            self.width[i] = len(text)
        for t, token in self.tokenizer.get_added_tokens_decoder().items():
            self.width[t] = len(token.content.encode())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin = np.array(self.end, self.dtype), np.array([0, len(self.end)], "i8")  # number 0 is the end

    def _encoded(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of the texts, and how many each has."""
        found, sizes = [], []
        for i in range(0, len(texts), 10_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 10_000], add_special_tokens=False)]
            sizes += map(len, ids)
            found.append(np.fromiter(chain.from_iterable(ids), self.dtype))
        return found, np.array(sizes, "i8")

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces that may follow one another, and how many each has: encoded in a row and parted by the bytes that each id stands for."""
        length = np.array([len(x.encode()) for x in pieces], "i8")
        found, _ = self._encoded(["".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)])
        ids = np.concatenate(found)
        ends, bounds = np.cumsum(self.width[ids]), np.cumsum(length)
        at = np.searchsorted(ends, bounds)
        if at[-1] >= len(ends) or (ends[at] != bounds).any():
            return None
        return ids, np.diff(at + 1, prepend=0)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Number of each of these distinct pieces; ``ids[begin[k] : begin[k + 1]]`` are the ids of number k."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self._forget()
        known = self.known
        out = np.fromiter(map(known.get, pieces, repeat(-1)), "i8", len(pieces))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [pieces[i] for i in missing.tolist()]
            apart = [x[0] != " " or len(x) < 2 or x[1] == " " for x in new] if not self.whole else [True] * len(new)
            row = [x for x, odd in zip(new, apart, strict=True) if not odd]
            joined = self._joined(row) if row else None
            if joined is None:
                apart, row = [True] * len(new), []
            alone = [x for x, odd in zip(new, apart, strict=True) if odd]
            found, sizes = self._encoded(alone)
            if row:
                found, sizes = [*found, joined[0]], np.concatenate([sizes, joined[1]])
            n = len(self.begin) - 1
            known.update(zip(alone + row, range(n, n + len(new)), strict=True))
            self.ids, self.begin = np.concatenate([self.ids, *found]), np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
            out[missing] = np.fromiter(map(known.__getitem__, new), "i8", len(new))
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's), each with the end id."""
        data, bounds = text_bytes(texts)
        full = bounds[:-1][np.diff(bounds) > 0]
        starts = full if self.whole else cuts(data, full)
        coded = large_strings(data, np.append(starts, len(data))).dictionary_encode()
        own = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(starts) else np.zeros(0, "i8")
        # the end, number 0, behind the last piece of each text
        behind = np.searchsorted(starts, bounds[1:], "left")
        ids, ends = gathered(self.ids, self.begin, np.insert(own, behind, 0))
        return ids, np.concatenate([[0], ends[behind + np.arange(len(behind))]])


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(*setting) -> Encoder:
    """The worker's encoder: it and the pieces it knows outlive a task."""
    if setting not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[setting] = Encoder(*setting)
    return _ENCODERS[setting]


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class PartWriter:
    """One part, written as its documents come: only ids and offsets are held."""

    def __init__(self, folder: str, name: str, dtype: str) -> None:
        self.fs, path = _fs(folder)
        self.fs.create_dir(path, recursive=True)
        self.uri, self.path, self.width = f"{folder}/{name}", f"{path}/{name}", np.dtype(dtype).itemsize
        self.bin = self.fs.open_output_stream(self.path + ".bin")
        self.ids: list[int | None] = []
        self.offsets = [np.zeros(1, "i8")]

    def add(self, doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> None:
        self.bin.write(ids.tobytes())
        self.ids.extend(doc_ids)
        self.offsets.append(self.offsets[-1][-1] + bounds[1:])

    @property
    def tokens(self) -> int:
        return int(self.offsets[-1][-1])

    def close(self) -> None:
        self.bin.close()
        with self.fs.open_output_stream(self.path + ".idx") as out:
            out.write(np.array([len(self.ids)], "<u8").tobytes())
            out.write(np.array([x or 0 for x in self.ids], "<i8").tobytes())
            out.write(np.array([x is None for x in self.ids], "u1").tobytes())
            out.write(np.concatenate(self.offsets).astype("<u8").tobytes())


def _buffer(uri: str) -> pa.Buffer:
    """A file's content: mapped into memory where it is local, else read."""
    fs, path = _fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def read_part(uri: str, dtype: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, offset of its first id in the part, its ids) of each document, over mapped files."""
    index, data = _buffer(uri + ".idx"), _buffer(uri + ".bin")
    n = int(np.frombuffer(index, "<u8", 1)[0])
    ids = np.frombuffer(index, "<i8", n, 8)
    nulls = np.frombuffer(index, "u1", n, 8 + 8 * n)
    offsets = np.frombuffer(index, "<u8", n + 1, 8 + 9 * n).tolist()
    tokens = np.frombuffer(data, dtype)
    for i in range(n):
        yield None if nulls[i] else int(ids[i]), offsets[i], tokens[offsets[i] : offsets[i + 1]]


def write_tokens(docs: DataFrame, folder: str, definition: str, *, end_id: int | None = None, vocab_size: int = 1 << 16, part_bytes: int = PART_BYTES) -> DataFrame:
    """Encode and write; returns the parts: part, path, docs, tokens, base, dtype."""
    dtype = "<u2" if vocab_size <= 1 << 16 else "<u4"
    setting = docs.sparkSession.sparkContext.broadcast((definition, end_id, dtype))
    n_bytes = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = _encoder(*setting.value), None
        for whole in batches:
            for b in pieces(iter([whole]), ENCODED_BYTES):
                k = b["part"][0].as_py()
                out = out or PartWriter(folder, f"part-{k:07d}-{uuid.uuid4().hex[:8]}", dtype)
                out.add(b["doc_id"].to_pylist(), *encoder(b["text"]))
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": k, "path": out.uri, "docs": len(out.ids), "tokens": out.tokens}], schema=PART_SCHEMA)

    ranged = docs.select("doc_id", "text").repartitionByRange(max(1, -(-n_bytes // part_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    parts = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(write, "part int, path string, docs long, tokens long")
    return with_bases(write_table(parts, "token-parts")).withColumn("dtype", F.lit(dtype))


def with_bases(parts: DataFrame, group: int = GROUP) -> DataFrame:
    """``parts`` with ``base``, the tokens of all parts before: sums of groups first (one number for each ``group`` parts), then within."""
    grouped = parts.withColumn("_group", F.floor(F.col("part") / group).cast("int"))
    sums = grouped.groupBy("_group").agg(F.sum("tokens").alias("n")).orderBy("_group").collect()
    bases, base = [], 0
    for r in sums:
        bases.append((r["_group"], base))
        base += r["n"]
    first = parts.sparkSession.createDataFrame(bases, "_group int, _first long")
    before = Window.partitionBy("_group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.join(F.broadcast(first), "_group").withColumn("base", F.col("_first") + F.coalesce(F.sum("tokens").over(before), F.lit(0))).drop("_group", "_first")


def read_tokens(parts: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base, dtype in zip(b["path"].to_pylist(), b["base"].to_pylist(), b["dtype"].to_pylist(), strict=True):
                rows = [(d, base + at, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, at, x in read_part(path, dtype)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return parts.repartitionById(max(1, parts.count()), F.col("part")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from .common import documents

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    parts = write_tokens(documents(spark, sf_dir), work_dir(spark, "tokens"), definition, end_id=2, vocab_size=50_257)
    return read_tokens(parts)
