"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct shingles (as 64-bit hashes): of 4 words at 85 % in op10, of 5 words
at 80 % in the pipeline. Documents with equal token sets (128-bit digest) are one node, represented by their least doc_id.

*Rare tokens, singly.* Tokens in at most ``TAU`` documents are rare. They are counted over all documents, for the
lowest ``COUNTED`` share of hashes, into two bitmaps of at most 2 ** ``MAX_BITS`` bits (what is broadcast): seen
twice, and seen more than ``TAU`` times; a clash of two tokens in a bitmap makes one look more frequent and costs work,
never a link. In the order rare first, by hash within, two linked sets share a token of their first n - ceil(s n) + 1.
A set with so many rare tokens indexes them singly, and those seen once are not sent at all. A list has ``TAU`` members at most.

*Frequent tokens, in combinations.* Sets with fewer rare tokens (near copies of many others, texts made of shared passages) meet
once more among themselves, where all their tokens are counted exactly, by a shuffle. Sets that are still short of
rare ones index their frequent tokens in combinations: two linked sets x and y that share no rare token differ in at most
b = (1 - s) / (1 + s) (|x| + |y|) - rare(x) - rare(y) frequent ones. Tokens fall in classes by hash, a quarter more than b + 1;
all tokens of a class are one combination. The pair agrees in more than a quarter of the classes, so
in one of the first b + 1 of each (those with the most tokens first; classes that agree have equal places in that
order). The number of classes belongs to the pair: it comes from its larger size, in steps of 1 / s, and from
b, in powers of two, and a set indexes itself for each that its partners may have.

*Lists.* In each list of a combination the member with the fewest rare tokens, the most central one, is checked with all
others; links make components. Lists that then hold several components give their pairs across components that sizes, b and
the 128-byte parity sketches leave possible (bounds, never guesses). Checks compare whole sets. No link is lost.
What stays quadratic is only the test of b and sketches, without output, within a combination's list whose members are in many components.

Edge cases: null, empty and blank texts have an empty set and link with nothing; with fewer words
than a shingle the whole sequence is one token; repeated rows link; rows that share a doc_id
are one document that links if any of its texts does; a row with a null doc_id has the component of an equal set, else null;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, drop_tables, pieces, release_memory, skew_join, write_table

SHINGLE = 4
PERCENT = 85
COUNTED = 0.3
TAU = 4
MIN_BITS, MAX_BITS = 16, 26
CONTRACTED = 1_000_000
BUCKET_BYTES = 16 << 20
SKETCH_BITS = 1024
HASH_BYTES = 1 << 20
MAX_BROADCAST_IDS = 1_000_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(32))) * _M[3]
    x = (x ^ (x >> np.uint64(29))) * _M[0]
    return x ^ (x >> np.uint64(32))


def _word_codes() -> np.ndarray:
    """A 64-bit code of each byte; A-Z have those of a-z."""
    codes = _mix((np.arange(256, dtype="u8") + np.uint64(1)) * _M[2])
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


_CODES = _word_codes()
_IS_SPACE = np.isin(np.arange(256), [ord(c) for c in SPACES])
_BASE = np.uint64(0x9E3779B97F4A7C13)  # odd, so that it has an inverse modulo 2 ** 64
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[np.uint64, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, HASH_BYTES + 1), base, "u8")
        x[0] = 1
        _powers[base] = np.cumprod(x, dtype="u8")
    return _powers[base][:n]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes, modulo 2 ** 64, of the words ``data[start:end]``, in blocks of about HASH_BYTES."""
    out, at = np.zeros(len(starts), "u8"), 0
    while at < len(starts):
        first = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, first + HASH_BYTES)))
        part = data[first : int(ends[to - 1])]
        sums = np.zeros(len(part) + 1, "u8")
        np.cumsum(_CODES[part] * _power(_BASE, len(part)), out=sums[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        out[at:to] = _mix((sums[e] - sums[s]) * _power(_UNBASE, len(part))[s])
        at = to
    return out


def token_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[0] == bounds[-1]:
        return [np.zeros(0, "u8")] * len(texts)
    data = np.frombuffer(texts.buffers()[2], "u1")[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = ~_IS_SPACE[data]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    rows = bounds[:-1][np.diff(bounds) > 0]
    new[rows] = inside[rows]  # words end with their text
    last = inside.copy()
    last[:-1] &= ~inside[1:] | new[1:]
    starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
    h, cuts = _word_hashes(data, starts, ends), np.searchsorted(starts, bounds)
    rolled = h[: max(0, len(h) - shingle + 1)].copy()
    for i in range(1, shingle):
        rolled = (rolled ^ (rolled >> np.uint64(31))) * _M[0] + h[i : i + len(rolled)] * _M[1]
    rolled, out = _mix(rolled), []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a == b:
            out.append(np.zeros(0, "u8"))
        elif b - a < shingle:
            out.append(_mix(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())], "u8")))
        else:
            x = np.sort(rolled[a : b - shingle + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
    return out


def need(n: int, percent: int = PERCENT) -> int:
    """Least overlap of a set of n tokens with a linked one."""
    return -(-n * percent // 100)


def differ(total: int, percent: int = PERCENT) -> int:
    """In how many tokens two linked sets may differ whose sizes add up to ``total``."""
    return (100 - percent) * total // (100 + percent)


@cache
def sizes(percent: int) -> list[int]:
    """Least size of each step; linked sets are in one step or in adjoining ones."""
    if not 50 <= percent < 100:
        raise ValueError("percent must be 50 to 99")
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return out


def combinations(frequent: np.ndarray, n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(key, budget) of the combinations that a set of n tokens with these frequent ones indexes.

    A pair with b differing frequent tokens at most meets under the budget that is the least one not below b.
    """
    rare, steps, out = n - len(frequent), sizes(percent), []
    own = int(np.searchsorted(steps, n, "right")) - 1
    hashes = _mix(frequent)
    for step in (own, own + 1):
        if 100 * n // percent < steps[step]:
            continue  # no partner is so large
        largest = steps[step + 1] - 1
        most = differ(n + min(largest, 100 * n // percent), percent) - rare
        budget = differ(2 * largest, percent)
        while most >= 0:
            if most > budget // 2 or not budget:
                spare = -(-(budget + 1) // 4) if budget else 0
                classes = budget + 1 + spare
                group = ((_mix(frequent ^ np.uint64(budget + 1)) >> np.uint64(11)) % np.uint64(classes)).astype("i8")
                size, content = np.bincount(group, minlength=classes), np.zeros(classes, "u8")
                np.add.at(content, group, hashes)
                first = np.lexsort((np.arange(classes), -size))[: min(budget, most) + 1]
                own_salt = np.uint64((step * int(_M[1]) + budget * int(_M[3])) % 2**64)
                keys = _mix(content[first] + first.astype("u8") * _M[2] + own_salt)
                out.extend((k, budget) for k in keys.view("i8").tolist())
            if not budget:
                break
            budget //= 2
    return out


def _dealt(values: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    if not len(values):
        return
    order = np.argsort(bucket, kind="stable")
    values, bucket = values[order], bucket[order]
    ids, starts = np.unique(bucket, return_index=True)
    ends = [*starts[1:].tolist(), len(values)]
    data = [values[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([kind] * len(ids), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])


def _low(tokens: np.ndarray) -> np.ndarray:
    """Those of the counted range."""
    return tokens[: np.searchsorted(tokens, np.uint64(int(COUNTED * 2**64)))]


def _place(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Place of each token in a bitmap of 2 ** bits."""
    return (_mix(tokens + _M[1]) >> np.uint64(64 - bits)).astype("i8")


def _marked(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> 3] >> (place & 7).astype("u1")) & 1 == 1


def bitmaps(docs: DataFrame, n_bytes: int, shingle: int = SHINGLE, tau: int = TAU) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, seen twice, seen more than ``tau`` times) over the counted tokens of all documents."""
    bits = min(MAX_BITS, max(MIN_BITS, int(n_bytes).bit_length()))  # about 16 places a counted token, up to MAX_BITS
    share = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    width = max(6, bits - (share - 1).bit_length())  # places of a bucket, as a power of two
    one, many = 0, 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            t, n = np.unique(np.concatenate([_low(s) for s in token_sets(b["text"], shingle)]), return_counts=True)
            bucket = (_place(t, bits) >> width).astype("i4")
            yield from _dealt(t[n == 1], bucket[n == 1], one)
            yield from _dealt(np.stack([t[n > 1], n[n > 1].astype("u8")], axis=1), bucket[n > 1], many)

    def count(table: pa.Table) -> pa.Table:
        tokens, times = [np.zeros(0, "u8")], [np.zeros(0, "i8")]
        for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True):
            x = np.frombuffer(data, "<u8")
            tokens.append(x if kind == one else x[::2])
            times.append(np.ones(len(x), "i8") if kind == one else x[1::2].astype("i8"))
        t, at = np.unique(np.concatenate(tokens), return_inverse=True)
        n, place = np.bincount(at, np.concatenate(times), len(t)), _place(t, bits)

        def bitmap(chosen: np.ndarray) -> bytes:
            out = np.zeros(1 << width, "u1")
            out[place[chosen] & ((1 << width) - 1)] = 1
            return np.packbits(out, bitorder="little").tobytes()

        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "twice": [bitmap(n > 1)], "often": [bitmap(n > tau)]})

    twice, often = (np.zeros(1 << (bits - 3), "u1") for _ in range(2))
    found = docs.select("text").mapInArrow(deal, "bucket int, kind int, data binary").groupBy("bucket").applyInArrow(count, "bucket int, twice binary, often binary")
    for r in found.toLocalIterator():  # both bitmaps, whatever the input
        for whole, part in ((twice, r["twice"]), (often, r["often"])):
            whole[r["bucket"] << (width - 3) : (r["bucket"] + 1) << (width - 3)] = np.frombuffer(part, "u1")
    return bits, twice, often


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the token counts in SKETCH_BITS buckets, as longs: two sketches differ in no more places than their sets differ in tokens."""
    n = np.bincount((tokens >> np.uint64(8)) % np.uint64(SKETCH_BITS), minlength=SKETCH_BITS)
    return np.packbits((n & 1).astype("u1")).view("<i8")


_INDEX = "doc_id long, n_shingles long, key binary, sketch array<long>, singles array<long>, tokens binary"


def index(docs: DataFrame, shared: Broadcast, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: size, digest (null: empty set) and sketch of its set, its rare tokens to index, and the whole set if those are too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, twice, often = shared.value
        for b in pieces(batches):
            sets = token_sets(b["text"], shingle)
            low = [_low(s) for s in sets]
            flat, length = np.concatenate(low), np.array([len(x) for x in low], "i8")
            n = np.array([len(s) for s in sets], "i8")
            wanted = n + (-n * percent // 100) + 1  # the prefix
            place, row = _place(flat, bits), np.repeat(np.arange(len(sets)), length)
            rare = ~_marked(often, place)
            rank = np.cumsum(rare)
            before = np.concatenate([[0], rank])[np.cumsum(length) - length]
            few = np.bincount(row, rare, len(sets)) < wanted
            chosen = rare & (rank - before[row] <= wanted[row]) & _marked(twice, place)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, chosen, len(sets)))]).astype("i4")
            columns = [
                b["doc_id"], pa.array(n), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[chosen].view("i8"))),
                pa.array([s.tobytes() if len(s) and short else None for s, short in zip(sets, few.tolist(), strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _INDEX.split(", ")])

    return docs.mapInArrow(run, _INDEX)


def _list_pairs(postings: DataFrame) -> DataFrame:
    """(a, b) of all members of the lists of (sig, node), which have TAU members at most."""
    members = postings.groupBy("sig").agg(F.sort_array(F.collect_set("node")).alias("m")).where(F.size("m") > 1)
    pair = F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> named_struct('a', x, 'b', y))))")
    return members.select(F.explode(pair).alias("p")).select("p.a", "p.b")


def shared_tokens(short: DataFrame, total: int) -> DataFrame:
    """(key, node, n, place, token, count) of the tokens that several of the sets (key, node, tokens) have, ``place`` in the sorted set."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                tokens = np.frombuffer(b["tokens"][i].as_buffer(), "<i8")
                n = len(tokens)
                same = [pa.repeat(b[c][i], n) for c in ("key", "node")]
                yield pa.RecordBatch.from_arrays([*same, pa.repeat(pa.scalar(n, pa.int64()), n), pa.array(np.arange(n)), pa.array(tokens)], names=["key", "node", "n", "place", "token"])

    tokens = short.select("key", "node", "tokens").mapInArrow(spread, "key binary, node long, n long, place long, token long")
    counts = write_table(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("count")).where("count > 1"), "shared-tokens")
    return skew_join(tokens, counts, "token", "count", max(1, total), F.col("key"), "inner")


def combination_postings(shared: DataFrame, percent: int = PERCENT, tau: int = TAU) -> DataFrame:
    """(sig, node, n, rare, budget) of the sets whose shared tokens are given; a budget of -1 stands for a rare token."""
    fields = "sig long, node long, n long, rare long, budget long"

    def entries(rows: dict[str, np.ndarray]) -> list[tuple]:
        n, node, frequent = int(rows["n"][0]), int(rows["node"][0]), rows["count"] > tau
        rank = rows["place"] - (np.cumsum(frequent) - frequent)  # rare tokens before each token
        prefix, rare = n - need(n, percent) + 1, n - int(frequent.sum())
        out = [(t, node, n, rare, -1) for t in rows["token"][~frequent & (rank < prefix)].tolist()]
        if rare < prefix:
            out += [(k, node, n, rare, b) for k, b in combinations(rows["token"][frequent].view("u8"), n, percent)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n", "node", "place", "token", "count")
        key, held = None, []

        def closed() -> list[tuple]:
            return entries({c: np.concatenate([x[c] for x in held]) for c in names}) if held else []

        for b in batches:
            keys = b["key"].dictionary_encode()
            at = keys.indices.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
            columns, out = {c: b[c].to_numpy() for c in names}, []
            for i, z in zip(starts, [*starts[1:], len(at)], strict=True):
                own = keys.dictionary[at[i]].as_py()
                if own != key:
                    out += closed()
                    key, held = own, []
                held.append({c: v[i:z] for c, v in columns.items()})
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in fields.split(", ")])
        if out := closed():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in fields.split(", ")])

    placed = shared.select("key", "node", "n", "place", "token", "count").repartition("key").sortWithinPartitions("key", "place")
    return placed.mapInArrow(run, fields)


def _possible(percent: int, a: str, b: str) -> str:
    """Whether two members (n, rare) of a list can be linked by its budget: they share no rare token."""
    least = f"({100 - percent} * ({a}.n + {b}.n)) div {100 + percent} - {a}.rare - {b}.rare"
    return f"{least} <= budget AND ({least} > budget div 2 OR budget = 0 AND {least} = 0) AND 100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"


def _apart(percent: int, a: str, b: str) -> str:
    """Whether two sketches rule out a link of the sets."""
    places = f"aggregate(zip_with({a}.sketch, {b}.sketch, (s, t) -> bit_count(s ^ t)), 0, (s, t) -> s + t)"
    return f"{100 + percent} * {places} > {100 - percent} * ({a}.n + {b}.n)"


def star_pairs(combos: DataFrame, total: int, percent: int = PERCENT) -> DataFrame:
    """(a, b): in each list the most central member with all others that can be linked with it."""
    least = F.min(F.struct((F.col("rare") / F.col("n")).alias("share"), "node", "n", "rare")).alias("y")
    lists = write_table(combos.groupBy("sig", "budget").agg(least, F.count(F.lit(1)).alias("m")).where("m > 1").drop("budget"), "lists")
    member = combos.select("sig", "budget", F.struct("node", "n", "rare").alias("x"))
    met = skew_join(member, lists, "sig", "m", max(1, total), F.col("x.node"), "inner").where("x.node <> y.node").where(_possible(percent, "x", "y"))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def crossing_pairs(combos: DataFrame, comp: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of different components within a list that sizes, budget and sketches leave possible."""
    member = combos.join(comp.withColumnRenamed("doc_id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    opened = member.groupBy("sig", "budget").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi AND m > 2").select("sig", "budget")
    member = write_table(member.join(opened, ["sig", "budget"], "left_semi").join(sketches, "node"), "members")
    side = lambda c: member.select("sig", "budget", F.struct("node", "n", "rare", "comp", "sketch").alias(c))
    rule = f"x.node < y.node AND x.comp <> y.comp AND {_possible(percent, 'x', 'y')} AND NOT {_apart(percent, 'x', 'y')}"
    x, y = side("x"), side("y").withColumnsRenamed({"sig": "_sig", "budget": "_budget"})
    return x.join(y, F.expr(f"sig = _sig AND budget = _budget AND {rule}")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def plausible_pairs(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` that sizes and sketches of ``sets`` (node, n, sketch) do not rule out; a linked pair always stays."""
    side = lambda c, k: sets.select(F.col("node").alias(k), F.struct("n", "sketch").alias(c))
    fits = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND NOT {_apart(percent, 'x', 'y')}"
    return pairs.join(side("x", "a"), "a").join(side("y", "b"), "b").where(fits).select("a", "b").distinct()


def linked_pairs(pairs: DataFrame, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of ``pairs`` whose documents' sets have the similarity."""
    wanted = write_table(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    if wanted.count() <= MAX_BROADCAST_IDS:  # else the texts are shuffled
        wanted = F.broadcast(wanted)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([s.tobytes() for s in token_sets(b["text"], shingle)], pa.binary())], names=["doc_id", "tokens"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"], strict=True):
                s, t = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                small, large = (s, t) if len(s) <= len(t) else (t, s)
                if 100 * len(small) < percent * len(large) or not len(small):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = write_table(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(pack, "doc_id long, tokens binary"), "sets")
    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the same components: up to CONTRACTED of a task at a time become stars around their least nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def stars() -> pa.RecordBatch:
            found = [(x, root(x)) for x in list(up)]
            u, v = (np.array([e[k] for e in found if e[0] != e[1]], "i8") for k in (0, 1))
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
                x, y = root(u), root(v)
                up[max(x, y)] = min(x, y)
            if len(up) >= CONTRACTED:
                yield stars()
        if up:
            yield stars()

    return edges.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, comp): least doc_id reachable, for every doc_id in a link. Large-star and small-star steps until nothing changes."""
    mark = lambda t: tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = write_table(_contracted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), "edges")
    before = mark(edges)
    while before[0]:
        # large star: larger neighbours move to the least of the neighbourhood; u > v always
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(edges.join(least, "u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges, old = write_table(small, "edges"), edges
        drop_tables(old)
        release_memory(links.sparkSession)
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct())


def _several_sets(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): nodes that share a doc_id, because rows of one doc_id have different texts."""
    several = rows.where("key IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("doc_id")
    nodes = rows.select("doc_id", "key").join(several, "doc_id").join(groups.select("key", "node"), "key")
    return nodes.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")


def jaccard_components(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id; sets of ``shingle`` words link from ``percent`` (50 to 99) on."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps(docs, n_bytes, shingle))
    rows = write_table(index(docs, shared, shingle, percent), "index")
    shared.destroy()
    stats = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("tokens").isNotNull(), F.col("n_shingles"))).alias("tokens")).first()
    found = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    groups = write_table(found, "groups")
    first = groups.where("node IS NOT NULL").select(F.col("key").alias("_key"), "node")
    own = rows.join(first, F.expr("key = _key AND doc_id = node")).dropDuplicates(["key"])  # one row of each set
    own = write_table(own.select("key", "node", F.col("n_shingles").alias("n"), "sketch", "singles", "tokens"), "own")
    release_memory(docs.sparkSession)
    short = own.where("tokens IS NOT NULL")
    postings = write_table(combination_postings(shared_tokens(short, stats["tokens"] or 0), percent), "postings")
    combos = postings.where("budget >= 0")
    pairs = _list_pairs(own.select(F.explode("singles").alias("sig"), "node")).union(_list_pairs(postings.where("budget < 0")))
    pairs = pairs.union(star_pairs(combos, combos.count(), percent)).where("a <> b").distinct()
    tried = write_table(plausible_pairs(pairs, own, percent), "pairs")
    release_memory(docs.sparkSession)
    links = write_table(linked_pairs(tried, docs, shingle, percent).union(_several_sets(rows, groups)), "links")
    comp = components(links)
    across = crossing_pairs(combos, comp, own.select("node", "sketch").dropDuplicates(["node"]), percent).distinct().join(tried, ["a", "b"], "left_anti")
    across = write_table(across, "across")
    if across.take(1):
        more = write_table(linked_pairs(across, docs, shingle, percent), "links")
        if more.take(1):
            comp = components(links.unionByName(more))
    groups = groups.join(comp.select(F.col("doc_id").alias("node"), "comp"), "node", "left").select("key", "copies", F.coalesce("comp", "node").alias("component_id"))
    rows = rows.select("doc_id", "n_shingles", "key")
    out = skew_join(rows, groups, "key", "copies", max(1, stats["rows"]), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_dedup_stage(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of the least doc_id, with the columns of ``docs``; rows with a null doc_id stay."""
    found = jaccard_components(docs, shingle=shingle, percent=percent)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import documents

    return jaccard_components(documents(spark, sf_dir))


ORACLE_SQL = None
