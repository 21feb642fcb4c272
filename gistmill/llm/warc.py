"""WARC archives and their capture index, merged from sorted runs.

Writing: records go to rotating ``.warc.gz`` archives, one gzip member a record. Of records
with equal payloads of ``MIN_REVISIT`` bytes or more the one with the least page_id is
a response and the others are revisits that refer to it. Each archive comes with a sorted
run of its captures: (URL key, timestamp, page_id, type, digest, archive, offset, length).

Index: the runs' entries are dealt out by ranges of the URL key; in each range a loser
tree merges the runs by URL key and timestamp, so ranges in order give one globally
ordered capture history. Only index entries move, never payloads, and a merge holds one
entry a run besides the range's own entries.

Reading: the merged index's entries say where each record lies; they are dealt out by blocks of archives and
read there. Payload bytes and digest of a response are computed from its bytes, those of a revisit are the ones of its record's headers.

A hot payload (or host) does not gather in one task: rows meet their payload's group through a
salted join, and index ranges are cut by key and page_id. Archives are written under
names of their own for each attempt and only those reported by finished tasks are read.

Edge cases: null html is an empty payload; a null url is written as ``about:blank``; a null
page_id is the least; repeated rows are records of their own, and of equal page_ids with equal payload
one is the response; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import located, skew_join, work_dir, write_table

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
INDEX_FIELDS = "url_key string, ts string, page_id long, record_type string, digest string, archive string, offset long, length long"
RANGE_ENTRIES = 50_000
BLOCK_BYTES = 8 << 20


class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, the winner stands on top."""

    def __init__(self, runs: Iterable[Iterable[Any]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _next(self, i: int) -> tuple:
        """(0, entry), or (1,) at the end of a run, which loses to any entry."""
        for entry in self.runs[i]:
            return (0, entry)
        return (1,)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            held = self.tree[node]
            if held < 0:  # first pass: wait for the opponent
                self.tree[node] = winner
                return
            if (self.heads[held], held) < (self.heads[winner], winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[Any]:
        while self.k:
            top = self.tree[0]
            head = self.heads[top]
            if head[0]:
                return
            yield head[1]
            self.heads[top] = self._next(top)
            self._replay(top)


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, then path and query; scheme, ``www.`` and fragment dropped."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit("about:blank"))), r"^[a-z]+://(www\.)?", "")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    tail = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)


def timestamp_of(page_id: int | None) -> str:
    """The tables have no capture times: a second a page_id after a fixed start, within 10^9 s."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_bytes(row: dict, payload: bytes) -> bytes:
    """One WARC record."""
    revisit = row["record_type"] == "revisit"
    body = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(row['page_id']))}>",
        f"WARC-Date: {timestamp_of(row['page_id'])}",
        "WARC-Target-URI: " + (row["url"] or "about:blank").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(row['refers_to']))}>")
        if row["refers_to"] is not None:
            head.append(f"X-Refers-To-Page: {row['refers_to']}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class ArchiveWriter:
    """One archive and the sorted run of its captures."""

    def __init__(self, folder: str) -> None:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"capture-{uuid.uuid4().hex}.warc.gz"
        self.uri, self.out, self.offset, self.run = f"{folder}/{name}", fs.open_output_stream(f"{path}/{name}", compression=None), 0, []

    def add(self, row: dict) -> None:
        data = gzip_member(record_bytes(row, (row["html"] or "").encode()))
        self.out.write(data)
        entry = (row["url_key"], timestamp_of(row["page_id"]), row["page_id"], row["record_type"], row["digest"], self.uri, self.offset, len(data))
        self.run.append(entry)
        self.offset += len(data)

    def close(self) -> list[tuple]:
        self.out.close()
        return sorted(self.run, key=_order)


def _order(entry: tuple) -> tuple:
    return (entry[0], entry[1], -1 if entry[2] is None else entry[2], entry[5], entry[6])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in INDEX_FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def with_record_types(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, url_key, html, digest, record_type, refers_to`` of every row."""
    rows = located(pages.select("page_id", "url", "html")).withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.sha2("html", 256))
    large = F.octet_length("html") >= min_revisit
    first = F.min(F.struct(F.coalesce(F.col("page_id"), F.lit(-(2**63))).alias("order"), "locator", "page_id")).alias("first")
    found = rows.where(large).groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = write_table(found, "payloads")
    total = groups.agg(F.sum("n")).first()[0] or 0
    joined = skew_join(rows, groups, "digest", "n", max(1, total), F.col("locator"))
    revisit = large & (F.col("first.locator") != F.col("locator"))
    return joined.select(
        "page_id", "url", url_key(F.col("url")).alias("url_key"), "html", "digest",
        F.when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response").alias("record_type"),
        F.when(F.coalesce(revisit, F.lit(False)), F.col("first.page_id")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row; returns the runs: INDEX_FIELDS, sorted within each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for b in batches:
            for i in range(0, b.num_rows, 100):
                for row in b.slice(i, 100).to_pylist():
                    writer = writer or ArchiveWriter(folder)
                    writer.add(row)
                    if writer.offset >= archive_bytes:
                        yield _batch(writer.close())
                        writer = None
        if writer:
            yield _batch(writer.close())

    return write_table(with_record_types(pages).mapInArrow(run, INDEX_FIELDS), "capture-runs")


def merge_index(runs: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """The capture index in global order by (url_key, ts): partition after partition."""
    n = max(1, -(-runs.count() // range_entries))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # entries come run by run, each in order; where the shuffle broke a run in two, each part is a run
        runs: list[list[tuple]] = []
        for b in batches:
            for entry in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keyed = (_order(entry), entry)
                if not runs or runs[-1][-1][1][5] != entry[5] or keyed[0] < runs[-1][-1][0]:
                    runs.append([])
                runs[-1].append(keyed)
        out: list[tuple] = []
        for _, entry in LoserTree(runs):
            out.append(entry)
            if len(out) == 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return runs.repartitionByRange(n, "url_key", "ts", "page_id").mapInArrow(merge, INDEX_FIELDS)


def parse_records(stream: Any) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a .warc.gz stream, read member by member."""
    pending = b""
    while True:
        z = zlib.decompressobj(31)
        out = []
        while not z.eof:
            if not pending:
                pending = stream.read(1 << 18)
                if not pending:
                    if out:
                        raise ValueError("the archive ends within a record")
                    return
            out.append(z.decompress(pending))
            pending = z.unused_data if z.eof else b""
        data = b"".join(out)
        head, _, block = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield headers, block[: int(headers["Content-Length"])]


def _parsed(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record."""
    page = int(headers["X-Page-Id"]) if "X-Page-Id" in headers else None
    if headers["WARC-Type"] == "revisit":
        refers = headers.get("X-Refers-To-Page")
        return page, int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", refers and int(refers)
    payload = block.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha256(payload).hexdigest()
    if digest != headers["WARC-Payload-Digest"].removeprefix("sha256:"):
        raise ValueError(f"page {page}: the payload does not have its digest")
    return page, len(payload), digest, "response", None


def read_captures(index: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per entry of the index: page_id, payload_bytes, payload_digest, record_type, refers_to, read at the entry's place.

    Entries are dealt out by archive and block of ``block_bytes``, so archives are read in many tasks, each block front to back.
    """
    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, Any] = ("", None)
        for b in batches:
            rows = []
            for uri, offset, length in zip(b["archive"].to_pylist(), b["offset"].to_pylist(), b["length"].to_pylist(), strict=True):
                if uri != opened[0]:
                    if opened[1]:
                        opened[1].close()
                    fs, path = pafs.FileSystem.from_uri(uri)
                    opened = uri, fs.open_input_file(path)
                opened[1].seek(offset)
                (record,) = parse_records(io.BytesIO(opened[1].read(length)))
                rows.append(_parsed(*record))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in fields.split(", ")])
        if opened[1]:
            opened[1].close()

    placed = index.select("archive", "offset", "length", F.floor(F.col("offset") / block_bytes).alias("block"))
    return placed.repartition("archive", "block").sortWithinPartitions("archive", "offset").mapInArrow(run, fields)


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives, merge their index, and read back every capture that the index holds."""
    folder = folder or work_dir(pages.sparkSession, "warc")
    return read_captures(write_table(merge_index(write_archives(pages, folder)), "capture-index"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM p JOIN f USING (payload_digest)
"""
