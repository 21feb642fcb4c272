"""SentencePiece encoding and decoding: Viterbi over a double-array trie of pieces.

Pieces come from a model file that the caller names. A unigram model's scores are
log probabilities and used as they are; a BPE model's are merge ranks, turned to
log probabilities by Zipf's law (``-log(rank + 2)``, normalised). White space is
marked by U+2581, a marker is put before the text, and a character without a piece is spelled
by the pieces of its UTF-8 bytes, at the least score less 10. A literal U+2581 of a text is
spelled by bytes too, so decoding returns every text exactly.

No piece has a marker after another character (checked on loading), so the best path
splits before each run of markers: the distinct units of a batch are found in Arrow, each is solved once per worker, kept in a
bounded table, and the ids of whole texts are gathered from it with numpy. A unit is scanned over UTF-8 bytes in time linear in its length
times the longest piece; units of up to ``WIDE`` bytes are scanned side by side, one place of all of them at a time.
In the trie and in units a marker is a space byte.

Edge cases: null counts as empty and gives no ids; empty texts give no ids; an empty table gives an empty result; further
columns are ignored, whatever their names; repeated rows give equal results; a null doc_id stays null; long texts are solved unit by unit.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import gathered, large_strings, pieces, text_bytes

MARK = "▁"
UNK_PENALTY = 10.0
REMEMBERED = 150_000
WIDE, ROWS = 64, 20_000
ENCODED_BYTES = 1 << 20


class DoubleArrayTrie:
    """base/check arrays over bytes; ``value`` holds the piece that ends at a state, or -1."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        self.base, self.check, self.value = array("i", [0]), array("i", [-2]), array("i", [-1])
        self._free = 1
        children: dict[bytes, set[int]] = {b"": set()}
        for key in keys:
            for i in range(len(key)):
                children.setdefault(key[:i], set()).add(key[i])
        states = {b"": 0}
        for prefix in sorted(children, key=lambda p: (len(p), p)):
            codes = sorted(children[prefix])
            state, base = states[prefix], self._place(codes)
            self.base[state] = base
            for c in codes:
                at = base + c
                self.check[at] = state
                key = prefix + bytes([c])
                self.value[at] = keys.get(key, -1)
                if key in children:
                    states[key] = at

    def _place(self, codes: list[int]) -> int:
        """A single child takes the next free slot (slots are passed once); several go behind the last state."""
        if len(codes) == 1:
            while self._free < len(self.check) and (self.check[self._free] != -1 or self._free <= codes[0]):
                self._free += 1
            base = max(1, self._free - codes[0])
        else:
            base = max(1, len(self.check) - codes[0])
        need = base + codes[-1] + 1 - len(self.check)
        if need > 0:
            for a, fill in ((self.base, 0), (self.check, -1), (self.value, -1)):
                a.extend([fill] * need)
        return base

    def matches(self, data: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, piece) of every piece that begins at ``start``, shortest first."""
        base, check, value, state, size = self.base, self.check, self.value, 0, len(self.check)
        for i in range(start, len(data)):
            at = base[state] + data[i]
            if at >= size or check[at] != state or at == 0:
                return
            state = at
            if value[at] >= 0:
                yield i + 1, value[at]


@dataclass
class Pieces:
    """What a model file holds: piece texts, log scores, and the ids of the byte pieces."""

    texts: list[str]
    scores: list[float]
    byte_ids: list[int]
    usable: list[bool]

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        with open(path, "rb") as f:
            model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        n = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        is_byte = [model.is_byte(i) for i in range(n)]
        usable = [not (is_byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        raw = [model.get_score(i) for i in range(n)]
        ranks = [-x for x, ok in zip(raw, usable, strict=True) if ok]
        if all(float(x).is_integer() for x in ranks):  # merge ranks of a BPE model
            total = math.log(sum(1 / (x + 2) for x in ranks))
            scores = [-math.log(max(0.0, -x) + 2) - total for x in raw]
        else:
            scores = raw
        byte_ids = [i for _, i in sorted((int(texts[i][3:5], 16), i) for i in range(n) if is_byte[i])]
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        if any(MARK in t.lstrip(MARK) for t, ok in zip(texts, usable, strict=True) if ok):
            raise ValueError("a piece has a white space marker after another character")
        if not any(t == MARK for t, ok in zip(texts, usable, strict=True) if ok):
            raise ValueError("the white space marker is no piece")
        return cls(texts, scores, byte_ids, usable)


class Codec:
    """Encoder and decoder over one set of pieces; picklable, so that it can be broadcast."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        trie = DoubleArrayTrie({t.replace(MARK, " ").encode(): i for i, t in enumerate(pieces.texts) if pieces.usable[i]})
        self.trie, self.arrays = trie, [np.array(x, "i4") for x in (trie.base, trie.check, trie.value)]
        self.scores = np.array(pieces.scores)
        self.unknown = min(s for s, ok in zip(pieces.scores, pieces.usable, strict=True) if ok) - UNK_PENALTY
        self.byte_ids = np.array(pieces.byte_ids, "i4")
        low = {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}
        spelled = [low.get(i, t.replace(MARK, " ").encode()) for i, t in enumerate(pieces.texts)]
        self.spelled, self.spelled_at = np.frombuffer(b"".join(spelled), "u1"), np.cumsum([0, *map(len, spelled)])
        self._forget()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "ids": np.zeros(0, "i4"), "begin": np.zeros(1, "i8")}

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin = np.zeros(0, "i4"), np.zeros(1, "i8")

    def viterbi(self, unit: str) -> list[int]:
        """Best ids of a unit; of equal scores the path with the longest last piece that was found first."""
        data, scores = unit.replace(MARK, " ").encode(), self.pieces.scores
        n = len(data)
        best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, single = best[at], False
            for end, piece in self.trie.matches(data, at):
                single |= end == at + width
                score = here + scores[piece]
                if score > best[end]:
                    best[end], back[end] = score, (at, piece)
            if not single and here + self.unknown > best[at + width]:
                best[at + width], back[at + width] = here + self.unknown, (at, -1)
            at += width
        out: list[int] = []
        at = n
        while at:
            begin, piece = back[at]
            out.extend([self.pieces.byte_ids[x] for x in reversed(data[begin:at])] if piece < 0 else [piece])
            at = begin
        return out[::-1]

    def viterbi_rows(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``viterbi`` of many units: rows of bytes, of which the first ``size`` count; (ids of all, how many each has)."""
        base, check, value = self.arrays
        n, longest = rows.shape
        best = np.full((n, longest + 5), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, longest + 5), "i4"), np.full((n, longest + 5), -1, "i4")
        width = np.select([rows < 0x80, rows < 0xE0, rows < 0xF0], [1, 2, 3], 4)
        for at in range(longest):
            row = np.flatnonzero((size > at) & (best[:, at] > -np.inf))
            state, here, single = np.zeros(len(row), "i4"), best[row, at], np.zeros(n, bool)
            unit = row
            for end in range(at + 1, longest + 1):
                to = base[state] + rows[unit, end - 1]
                ok = (size[unit] >= end) & (to < len(check)) & (to != 0)
                ok &= check[np.where(ok, to, 0)] == state
                unit, state, here = unit[ok], to[ok], here[ok]
                if not len(unit):
                    break
                found = value[state]
                hit = found >= 0
                u, p, score = unit[hit], found[hit], here[hit] + self.scores[found[hit]]
                single[u[width[u, at] == end - at]] = True
                more = score > best[u, end]
                u, p = u[more], p[more]
                best[u, end], start[u, end], piece[u, end] = score[more], at, p
            row = row[~single[row]]
            end = at + width[row, at]
            score = best[row, at] + self.unknown
            more = score > best[row, end]
            row, end = row[more], end[more]
            best[row, end], start[row, end], piece[row, end] = score[more], at, -1
        steps, row, end = [], np.arange(n), size.astype("i8")
        while len(row):
            first, own = start[row, end], piece[row, end]
            steps.append((row, first, own, np.where(own < 0, end - first, 1)))
            row, end = row[first > 0], first[first > 0]
        row, first, own, count = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((first, row))
        row, first, own, count = row[order], first[order], own[order], count[order]
        ids, last = np.repeat(own, count), np.cumsum(count)
        byte = np.flatnonzero(ids < 0)
        step = np.searchsorted(last, byte, "right")
        ids[byte] = self.byte_ids[rows[row[step], first[step] + byte - (last - count)[step]]]
        return ids, np.bincount(row, count, n).astype("i8")

    def _solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units (with spaces for markers) in a row, and how many each has."""
        size = np.array([len(u.encode()) for u in units], "i8")
        order = np.argsort(size, kind="stable")
        narrow = order[size[order] <= WIDE]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(0, len(narrow), ROWS):
            at = narrow[i : i + ROWS]
            longest = int(size[at[-1]])
            rows = np.frombuffer(b"".join(units[k].encode().ljust(longest, b"\0") for k in at.tolist()), "u1").reshape(-1, longest)
            found.append((at, *self.viterbi_rows(rows, size[at])))
        for k in order[len(narrow) :].tolist():
            ids = self.viterbi(units[k])
            found.append((np.array([k]), np.array(ids, "i4"), np.array([len(ids)])))
        at, ids, count = (np.concatenate(x) for x in zip(*found, strict=True))
        back = np.argsort(at, kind="stable")
        return gathered(ids, np.concatenate([[0], np.cumsum(count)]), back)[0], count[back]

    def _add(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Keep the ids of new units; their numbers."""
        first = len(self.begin) - 1
        self.ids, self.begin = np.concatenate([self.ids, ids]), np.concatenate([self.begin, self.begin[-1] + np.cumsum(count)])
        return np.arange(first, first + len(count))

    def _numbers(self, units: list[str]) -> np.ndarray:
        """Number of each of these distinct units; ``ids[begin[k] : begin[k + 1]]`` are the ids of number k."""
        if len(self.known) + len(units) > REMEMBERED:
            self._forget()
        out = np.fromiter(map(self.known.get, units, repeat(-1)), "i8", len(units))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [units[i] for i in missing.tolist()]
            out[missing] = self._add(*self._solve(new))
            self.known.update(zip(new, out[missing].tolist(), strict=True))
        return out

    def _solve_marked(self, text: str) -> list[int]:
        """A text that holds U+2581 itself, which is spelled by its bytes."""
        literal = [self.pieces.byte_ids[x] for x in MARK.encode()]
        ids: list[int] = []
        for i, part in enumerate(text.split(MARK)):
            ids.extend(literal if i else ())
            for unit in re.findall(" +[^ ]*|[^ ]+", part if i else " " + part):
                ids.extend(self.viterbi(unit))
        return ids

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds of each text's)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = np.flatnonzero(pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False))
        apart = [self._solve_marked(texts[i].as_py()) for i in marked.tolist()]
        if apart:
            texts = pc.if_else(pc.match_substring(texts, MARK), "", texts)
        data, bounds = text_bytes(texts)
        full = np.diff(bounds) > 0
        data = np.insert(data, bounds[:-1][full], 32)  # the marker before each text
        bounds = np.concatenate([[0], np.cumsum(np.diff(bounds) + full)])
        first = (data == 32) & ~np.concatenate([[False], data[:-1] == 32])
        first[bounds[:-1][full]] = True
        starts = np.flatnonzero(first)
        coded = large_strings(data, np.append(starts, len(data))).dictionary_encode()
        own = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(starts) else np.zeros(0, "i8")
        last = np.searchsorted(starts, bounds[1:], "left")
        if apart:
            numbers = self._add(np.array([x for y in apart for x in y], "i4"), np.array([len(x) for x in apart], "i8"))
            own = np.insert(own, last[marked], numbers)
            last = last + np.searchsorted(marked, np.arange(len(last)), "right")
        ids, ends = gathered(self.ids, self.begin, own)
        return ids, np.concatenate([[0], np.concatenate([[0], ends])[last]]).astype("i8")

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts that the ids stand for, where those spell whole characters."""
        data, ends = gathered(self.spelled, self.spelled_at, ids)
        at = np.concatenate([[0], ends])[bounds].astype("i8")
        first = at[:-1][np.diff(at) > 0]
        mark = first[data[first] == 32]
        return large_strings(np.delete(data, mark), at - np.searchsorted(mark, at, "left"))

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.large_string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        text = gathered(self.spelled, self.spelled_at, np.array(ids, "i8"))[0].tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode_documents(docs: DataFrame, model: str, *, with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32, decoded_sha256 (of the text that the ids decode to), round_trip, ids, and decoded (that text)."""
    codec = docs.sparkSession.sparkContext.broadcast(Codec(Pieces.load(model)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    names = ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "decoded_sha256", "round_trip"] + ["ids"] * with_ids + ["decoded"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec.value
        is_byte = np.zeros(len(c.pieces.texts), "i8")
        is_byte[c.pieces.byte_ids] = 1
        for b in pieces(batches, ENCODED_BYTES):
            ids, bounds = c.encode_all(b["text"])
            back = c.decode_all(ids, bounds)
            each = [memoryview(ids[i:j]).cast("B") for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            spelled = np.concatenate([[0], np.cumsum(is_byte[ids])])[bounds]
            columns = [
                b["doc_id"],
                pa.array(np.diff(bounds)),
                pa.array(np.diff(spelled)),
                pa.array([zlib.crc32(x) for x in each], pa.int64()),
                pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in back], pa.string()),
                pc.equal(back, pc.fill_null(b["text"].cast(pa.large_string()), "")),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype("i4")), pa.array(ids)))
            if with_text:
                columns.append(back.cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, fields + ", ids array<int>" * with_ids + ", decoded string" * with_text)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import documents

    return encode_documents(documents(spark, sf_dir), default_model(), with_text=True)
