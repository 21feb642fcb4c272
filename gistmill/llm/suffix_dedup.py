"""Byte-level deduplication of passages: distributed difference-cover suffix sorting.

Contract of ``repeated_bytes``: a 50-byte string of a document is repeated if it also starts in
a document with a smaller doc_id; every byte that such strings cover goes.

1. *Blocks.* Each 50-byte window has an anchor, the 16-byte string of least hash in it, so
   equal windows have equal anchors at equal places. Consecutive windows with one anchor
   make a block, known by the hashes of its anchor and of all its bytes. Equal blocks of several
   documents keep the least doc_id; in all others their windows are repeated. Anchors whose
   blocks are all equal are settled: no further window can match in part.
2. *Suffixes.* Blocks that share an anchor but differ hold what is left to compare. Their bytes
   travel to the part of their anchor, where equal windows must meet, and the suffix array of
   all bytes of a part is built by the difference cover modulo 3: suffixes at places 1 and 2
   modulo 3 are sorted by triples and named, the names form a text that is sorted in the same way until
   all are unique (the recursion), and the suffixes at 0 modulo 3 are merged in by the symbols
   before the next sampled suffix and that one's rank. Adjacent suffixes whose first 50
   bytes agree form a class; its least doc_id marks the others.
3. *Cutting.* Repeated windows of each document become maximal runs, and the rest is hashed.

A suffix array over every byte would move each position several times as a row, ten times the
input; step 1 settles equal blocks first, so only bytes around places where copies begin, end
or differ are sorted. Blocks and fragments move as packed arrays; equal blocks of a map batch are merged
before the shuffle, so a passage of a third of all documents sends one entry a batch.

Edge cases: null counts as empty; texts under 50 bytes lose nothing; matches never cross
documents; rows that repeat a doc_id must repeat its text and get equal results, and do not count as smaller;
a null doc_id loses nothing and matches nothing; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_bytes, write_table

LENGTH = 50
GRAM = 16
_SPAN = LENGTH - GRAM + 1
#: A window that holds an anchor also holds so many bytes on one side of it.
HALF = (LENGTH - GRAM) // 2
BUCKET_BYTES = 16 << 20
#: Parts of fragments to a bucket of blocks: a suffix array takes about 100 bytes a byte of a part.
PARTS = 4
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
_TABLE = np.random.default_rng(5).integers(0, 2**64, 256, dtype="u8")
_POWER = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as big-endian integers: numbers in byte order."""
    view = np.lib.stride_tricks.sliding_window_view(data, 8)
    return np.ascontiguousarray(view).view(">u8")[:, 0].astype("u8")


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.ones(n, "u8")
    step = 1
    factor = base
    while step < n:
        out[step : 2 * step] = out[: min(step, n - step)] * factor
        factor = factor * factor
        step *= 2
    return out


def blocks(data: np.ndarray) -> dict[str, np.ndarray]:
    """Every block of one text of LENGTH bytes or more: hashes of its anchor and content, first window, windows, place of the
    anchor behind it, and 16-bit hashes of the anchor with the HALF bytes before and behind it (0: the text has none)."""
    n = len(data) - LENGTH + 1
    w = _words(data)
    with np.errstate(over="ignore"):
        gram = _mix(w[:-8] * _A + _mix(w[8:]))  # 16 bytes from each place
        key = (gram & ~np.uint64(0xFFFFFFFF)) | np.arange(len(gram), dtype="u8")  # the leftmost of equal ones
        least, width = key, 1
        while 2 * width <= _SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < _SPAN:
            least = np.minimum(least[: -(_SPAN - width)], least[_SPAN - width :])
        at = (least[:n] & np.uint64(0xFFFFFFFF)).astype("i8")
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(first, n))
        up = _powers(len(data), _POWER)
        prefix = np.zeros(len(data) + 1, "u8")
        np.cumsum(_TABLE[data] * up, out=prefix[1:])
        down = _powers(len(data), _INVERSE)
        ends = first + count + LENGTH - 1
        body = (prefix[ends] - prefix[first]) * down[first]
        anchor = at[first]
        content = _mix(body + _mix(((anchor - first) * 4096 + count).astype("u8")) * _C)
        low, high = np.maximum(anchor - HALF, 0), np.minimum(anchor + GRAM + HALF, len(data))
        left = _mix((prefix[anchor + GRAM] - prefix[low]) * down[low]) >> np.uint64(48) | np.uint64(1)
        right = _mix((prefix[high] - prefix[anchor]) * down[anchor]) >> np.uint64(48) | np.uint64(1)
        left[anchor < HALF] = 0
        right[anchor + GRAM + HALF > len(data)] = 0
    return {"anchor": gram[anchor], "content": content, "first": first, "count": count, "behind": anchor - first, "left": left, "right": right}


def _pieces(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[list[tuple[int, bytes]]]:
    """(doc_id, bytes) of rows that are long enough, in lists of about ``size`` bytes."""
    rows, held = [], 0
    for b in batches:
        texts = b["text"]
        for i, d in enumerate(b["doc_id"].to_pylist()):
            data = texts[i].as_buffer() if texts[i].is_valid else None
            if d is None or data is None or len(data) < LENGTH:
                continue
            rows.append((d, data))
            held += len(data)
            if held >= size:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


_PACKED = [("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("first", "<u4"), ("count", "u1"), ("behind", "u1"), ("left", "<u2"), ("right", "<u2")]


def _pack(x: dict[str, np.ndarray]) -> bytes:
    return b"".join(x[n].astype(t).tobytes() for n, t in _PACKED)


def _unpack(data: list[bytes]) -> dict[str, np.ndarray]:
    size = sum(np.dtype(t).itemsize for _, t in _PACKED)
    parts: dict[str, list] = {n: [np.zeros(0, t)] for n, t in _PACKED}
    for d in data:
        n, at = len(d) // size, 0
        for name, t in _PACKED:
            parts[name].append(np.frombuffer(d, t, n, at))
            at += n * np.dtype(t).itemsize
    return {n: np.concatenate(v) for n, v in parts.items()}


def _settle(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Rows sorted by (anchor, content, doc), and which of them stand in a larger document than their block's least."""
    order = np.lexsort((x["doc"], x["content"], x["anchor"]))
    x = {k: v[order] for k, v in x.items()}
    new = np.ones(len(order), bool)
    new[1:] = (x["anchor"][1:] != x["anchor"][:-1]) | (x["content"][1:] != x["content"][:-1])
    least = x["doc"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else x["doc"]
    return x, x["doc"] > least


def _shared_side(x: dict[str, np.ndarray], side: str) -> np.ndarray:
    """Which rows have the anchor and its bytes on one side in common with a row of another content."""
    order = np.lexsort((x["content"], x[side], x["anchor"]))
    a, s, c = x["anchor"][order], x[side][order], x["content"][order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])])
    differs = np.concatenate([[False], ~new[1:] & (c[1:] != c[:-1])])
    group = np.cumsum(new) - 1
    out = np.zeros(len(order), bool)
    out[order] = (np.bincount(group, differs)[group] > 0) & (s != 0)
    return out


def _unsettled(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Windows that may lie in a block of other content: those on a side that such a block shares."""
    if not len(x["anchor"]):
        return x
    left, right = _shared_side(x, "left"), _shared_side(x, "right")
    x = _take(x, left | right)
    left, right = left[left | right], right[left | right]
    anchor = x["first"].astype("i8") + x["behind"]
    low, high = x["first"].astype("i8"), x["first"].astype("i8") + x["count"]  # windows low to high - 1
    low = np.where(left, low, np.maximum(low, anchor - HALF))
    high = np.where(right, high, np.minimum(high, anchor - HALF + 1))
    keep = high > low
    return _take({**x, "first": low, "count": high - low}, keep)


def _take(x: dict[str, np.ndarray], keep: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[keep] for k, v in x.items()}


def _fragments(x: dict[str, np.ndarray], parts: int) -> list[tuple[int, int, bytes]]:
    """(FRAGMENT, doc, packed (first, count, part of the anchor) triples) of each document."""
    if not len(x["doc"]):
        return []
    x = _take(x, np.lexsort((x["first"], x["doc"])))
    part = _mix(x["anchor"].astype("u8")) % np.uint64(parts)
    at = np.flatnonzero(np.concatenate([[True], x["doc"][1:] != x["doc"][:-1]]))
    triples = np.stack([x["first"].astype("<u4"), x["count"].astype("<u4"), part.astype("<u4")], axis=1)
    return [(FRAGMENT, int(x["doc"][a]), triples[a:b].tobytes()) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(x["doc"])], strict=True)]


def _ranges(x: dict[str, np.ndarray], kind: int) -> list[tuple[int, int, bytes]]:
    """(kind, doc, packed (first, count) pairs) of each document."""
    if not len(x["doc"]):
        return []
    order = np.lexsort((x["first"], x["doc"]))
    doc, first, count = x["doc"][order], x["first"][order].astype("<u4"), x["count"][order].astype("<u4")
    if kind == 0:  # adjoining runs of repeated windows become one
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > first[:-1] + count[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(doc)) - 1
        count = (first[last] + count[last] - first[at]).astype("<u4")
        doc, first = doc[at], first[at]
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = np.append(at[1:], len(doc))
    pairs = np.stack([first, count], axis=1)
    return [(kind, int(doc[a]), pairs[a:b].tobytes()) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]


_OUT = "kind int, bucket int, doc_id long, data binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("data", pa.binary())])
REPEATED, FRAGMENT, BLOCK = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def block_ranges(docs: DataFrame, buckets: int) -> DataFrame:
    """(kind, doc_id, data): repeated windows that whole blocks settle, and the windows of blocks still to compare."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches):
            found: dict[str, list] = {n: [] for n, _ in _PACKED}
            for doc, data in rows:
                own = blocks(np.frombuffer(data, "u1"))
                for name, v in own.items():
                    found[name].append(v)
                found["doc"].append(np.full(len(own["first"]), doc, "i8"))
            x, repeated = _settle({k: np.concatenate(v) for k, v in found.items()})
            out = [(k, d % buckets, d, p) for k, d, p in _ranges(_take(x, repeated), REPEATED)]
            x = _take(x, ~repeated)
            bucket = (x["anchor"] % np.uint64(buckets)).astype("i8")
            order = np.lexsort((x["first"], x["doc"], bucket))
            x, bucket = _take(x, order), bucket[order]
            ids, at = np.unique(bucket, return_index=True)
            for i, a, b in zip(ids.tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True):
                out.append((BLOCK, i, None, _pack(_take(x, slice(a, b)))))
            yield _batch(out)

    def compare(table: pa.Table) -> pa.Table:
        kinds, data = table["kind"].to_pylist(), table["data"].to_pylist()
        passed = [(k, None, d, p) for k, d, p in zip(kinds, table["doc_id"].to_pylist(), data, strict=True) if k == REPEATED]
        x, repeated = _settle(_unpack([p for k, p in zip(kinds, data, strict=True) if k == BLOCK]))
        out = passed + [(k, None, d, p) for k, d, p in _ranges(_take(x, repeated), REPEATED)]
        with np.errstate(over="ignore"):
            out += [(k, None, d, p) for k, d, p in _fragments(_unsettled(_take(x, ~repeated)), PARTS * buckets)]
        return pa.Table.from_batches([_batch(out)])

    dealt = docs.select("doc_id", F.encode("text", "utf-8").alias("text")).mapInArrow(deal, _OUT)
    settled = dealt.groupBy("bucket").applyInArrow(compare, _OUT)
    return write_table(settled.select("kind", "doc_id", "data"), "ranges", drop_shuffles=True)  # the blocks are over twice the input


def _named(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense names from 1 on of the keys in their order, and how many there are."""
    distinct, names = np.unique(keys, return_inverse=True)
    return names.astype("i8") + 1, len(distinct)


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """Rank of each suffix of ``s`` (integers, 1 or more), a shorter one before those that it begins: difference cover modulo 3."""
    n = len(s)
    if n < 2:
        return np.zeros(n, "i8")
    padded = np.concatenate([s.astype("i8"), np.zeros(3, "i8")])
    size = int(padded.max()) + 1
    pair = padded[:-1] * size + padded[1:]
    if size * size * max(size, n + 2) >= 2**63:
        pair = _named(pair)[0]
    # suffixes at 1 and 2 modulo 3; the empty one ends the first list where its last triple would not show the end
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names, found = _named(pair[sample] * size + padded[np.minimum(sample + 2, n)])
    order = np.empty(len(sample), "i8")
    if found < len(sample):  # the text of names, sorted in the same way
        order[suffix_ranks(names)] = sample
    else:
        order[names - 1] = sample
    m = len(order)
    rank = np.zeros(n + 3, "i8")
    rank[order] = np.arange(1, m + 1)
    # those at 0 modulo 3 by one symbol and the rank behind it, each placed among both lists of sampled ones
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(padded[rest] * (m + 1) + rank[rest + 1])]
    first, second = order[order % 3 == 1], order[order % 3 == 2]
    before = np.searchsorted(padded[first] * (m + 1) + rank[first + 1], padded[rest] * (m + 1) + rank[rest + 1])
    before += np.searchsorted(pair[second] * (m + 1) + rank[second + 2], pair[rest] * (m + 1) + rank[rest + 2])
    out = np.empty(n + 1, "i8")
    out[rest] = np.arange(len(rest)) + before
    out[order] = np.arange(m) + np.cumsum(np.bincount(before, minlength=m + 1))[:m]
    return out[:n] - (n % 3 == 1)  # the empty suffix takes no rank


def shared_windows(data: np.ndarray, doc: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, window) of the windows that a fragment of a smaller document has too.

    ``data`` holds the fragments one behind the other, each of ``count`` windows and so of ``count`` + LENGTH - 1 bytes.
    """
    sizes = count + LENGTH - 1
    begin = np.cumsum(sizes + 1) - (sizes + 1)  # each fragment ends with a symbol below all bytes
    at = np.arange(len(data)) + np.repeat(np.arange(len(doc)), sizes)
    symbols, plain = np.ones(len(data) + len(doc), "i8"), np.zeros(len(data) + len(doc) + LENGTH, "u1")
    symbols[at], plain[at] = data.astype("i8") + 2, data
    fragment = np.repeat(np.arange(len(doc)), count)
    window = np.arange(len(fragment)) - np.repeat(np.cumsum(count) - count, count)
    place = begin[fragment] + window
    order = np.argsort(suffix_ranks(symbols)[place])
    place, owner = place[order], doc[fragment[order]]
    words = _words(plain)
    new = np.zeros(len(place), bool)
    new[:1] = True
    for step in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        w = words[place + step]
        new[1:] |= w[1:] != w[:-1]
    least = np.minimum.reduceat(owner, np.flatnonzero(new))[np.cumsum(new) - 1]
    found = order[owner > least]
    return fragment[found], window[found]


_PART = "part int, doc binary, first binary, count binary, data binary"


def repeated_windows(docs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(doc_id, data): windows of the fragments that a smaller document has too."""
    wanted = fragments.groupBy("doc_id").agg(F.collect_list("data").alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b["text"])
            packed = [b"".join(p) for p in b["parts"].to_pylist()]
            row = np.repeat(np.arange(b.num_rows), [len(p) // 12 for p in packed])
            first, count, part = np.frombuffer(b"".join(packed), "<u4").reshape(-1, 3).astype("i8").T
            order = np.argsort(part, kind="stable")
            row, first, count, part = row[order], first[order], count[order], part[order]
            begin = bounds[row] + first
            sizes = count + LENGTH - 1
            ends = np.cumsum(sizes)
            found = data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)]
            doc = b["doc_id"].to_numpy()[row]
            ids, at = np.unique(part, return_index=True)
            out = []
            for i, a, z in zip(ids.tolist(), at.tolist(), [*at[1:].tolist(), len(part)], strict=True):
                held = found[int(ends[a] - sizes[a]) : int(ends[z - 1])]
                out.append((i, doc[a:z].astype("<i8").tobytes(), first[a:z].astype("<u4").tobytes(), count[a:z].astype("u1").tobytes(), held.tobytes()))
            if out:
                kinds = [pa.int32()] + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "doc", "first", "count", "data"])

    def sort(table: pa.Table) -> pa.Table:
        column = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        doc, first, count = column("doc", "<i8"), column("first", "<u4"), column("count", "u1").astype("i8")
        fragment, window = shared_windows(column("data", "u1"), doc, count)
        x = {"doc": doc[fragment], "first": first[fragment].astype("i8") + window, "count": np.ones(len(fragment), "i8")}
        found = _ranges(x, REPEATED)
        return pa.table({"doc_id": pa.array([d for _, d, _ in found], pa.int64()), "data": pa.array([p for _, _, p in found], pa.binary())})

    rows = docs.join(wanted, "doc_id").select("doc_id", "text", "parts")
    return rows.mapInArrow(cut, _PART).groupBy("part").applyInArrow(sort, "doc_id long, data binary")


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    ranges = block_ranges(docs, buckets)
    late = repeated_windows(docs, ranges.where(F.col("kind") == FRAGMENT))
    windows = ranges.where(F.col("kind") == REPEATED).select("doc_id", "data").unionByName(late).groupBy("doc_id").agg(F.collect_list("data").alias("parts"))
    rows = docs.select("doc_id", F.encode("text", "utf-8").alias("text")).join(windows, "doc_id", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, parts in zip(b["doc_id"].to_pylist(), b["text"], b["parts"].to_pylist(), strict=True):
                data = text.as_py()
                spans = _spans(np.frombuffer(b"".join(parts or []), "<u4").reshape(-1, 2).astype("i8"))
                digest, at = hashlib.sha256(), 0
                for a, z in spans:
                    digest.update(data[at:a])
                    at = z
                digest.update(data[at:])
                out.append((doc, len(data), sum(z - a for a, z in spans), len(spans), digest.hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _spans(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows (first, count)."""
    if not len(pairs):
        return []
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    low, high = pairs[:, 0], np.maximum.accumulate(pairs[:, 0] + pairs[:, 1] + LENGTH - 1)
    new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    return list(zip(low[new].tolist(), high[np.append(new[1:], len(low)) - 1].tolist(), strict=True))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import documents

    return repeated_bytes(documents(spark, sf_dir))
