"""URL allow and block rules in a trie over reversed host labels and path segments.

The trie is broadcast; it holds the rules that the caller lists, so its size is that
list's (``MAX_RULES`` at most). A lookup walks the host from its last label and, at each
label that ends a rule's host, the path segment by segment; the last segment of a rule
may match the start of one of the url's. The longest host wins, then the longest path;
a rule given as both allow and block blocks.

Edge cases: a null url or one without ``://`` has an empty host and path and matches
nothing; an empty rule list matches nothing; urls without a match take ``default``;
repeated rows are judged alike; a null id stays null; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Nodes are dicts: a label or segment leads on, HOST to the rules' paths, ENDS to (rest of segment, rule, verdict)."""

    HOST, ENDS = 0, 1

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
        self.root: dict = {}
        for verdict, host, path in sorted(rules, reverse=True):  # block before allow: the first of equal rules stays
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self.HOST, {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(self.ENDS, [])
            if rest not in [x[0] for x in ends]:
                ends.append((rest, host + path, verdict))
                ends.sort(key=lambda x: -len(x[0]))

    def _path(self, node: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            for rest, rule, verdict in node.get(self.ENDS, ()):
                if segment.startswith(rest):
                    best = rule, verdict
                    break
            if segment not in node:
                break
            node = node[segment]
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            if label not in node:
                break
            node = node[label]
            if self.HOST in node:
                best = self._path(node[self.HOST], path) or best
        return best


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], *, default: str = "allow", id_col: str = "page_id") -> DataFrame:
    """Per row: id, host, path, rule (null: none fits), verdict."""
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    schema = pages.select(id_col).schema.add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for b in batches:
            found = [find(h, p) or (None, default) for h, p in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True)]
            columns = [b[id_col], b["host"], b["path"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.select(id_col, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).mapInArrow(judge, schema)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def _oracle() -> str:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH u AS (SELECT row_number() OVER () AS n, page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(v, h, p) AS (VALUES {rows}),
m AS (SELECT n, v, h || p AS rule, row_number() OVER (PARTITION BY n ORDER BY length(h) DESC, length(p) DESC, v DESC) AS k
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (n)
"""


ORACLE_SQL = _oracle()
