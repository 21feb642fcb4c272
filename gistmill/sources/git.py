"""Readers of a version-control folder on the driver: changes, history, blame, status and branches as frames."""

from __future__ import annotations

import re
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.parsers import changed_files

#: Fixed value: most commits of one reading.
MOST_COMMITS = 100
_REF = re.compile(r"[A-Za-z0-9_./^~@{}][A-Za-z0-9_./^~@{}-]*")


@dataclass(frozen=True)
class Repository:
    """A folder under git. Only reading commands run, without a shell; a failing one raises ``CalledProcessError``."""

    spark: SparkSession
    folder: str

    def _run(self, *args: str) -> str:
        return subprocess.run(["git", "-C", self.folder, *args], capture_output=True, text=True, check=True, timeout=60).stdout

    def _lines(self, text: str) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(text.splitlines())), "line_no int, line string")

    def diff(self, ref: str = "HEAD") -> DataFrame:
        """file, additions, deletions, status of what differs from ``ref``."""
        return changed_files(self._lines(self._run("diff", "--numstat", _safe(ref), "--")), self._lines(self._run("diff", "--name-status", _safe(ref), "--")))

    def raw_diff(self, ref: str = "HEAD") -> DataFrame:
        """(doc_id, line_no, line) of the unified diff, as ``build.diff_parse`` takes it."""
        return self._lines(self._run("diff", _safe(ref), "--")).select(F.lit(0).alias("doc_id"), "line_no", "line")

    def log(self, most: int = 10) -> DataFrame:
        """position, hash, short_hash, author, date, message of the latest commits, ``MOST_COMMITS`` at most."""
        out = self._run("log", f"-{max(1, min(most, MOST_COMMITS))}", "-z", "--format=%H%n%h%n%an%n%aI%n%s")
        rows = [(i, *entry.split("\n", 4)) for i, entry in enumerate(out.rstrip("\0").split("\0")) if entry]
        return self.spark.createDataFrame(rows, "position int, hash string, short_hash string, author string, date string, message string")

    def blame(self, file: str, line: int | None = None) -> DataFrame:
        """line, hash (7 characters), author, time, content of each line of ``file`` or of one line."""
        if file.startswith("/") or ".." in file.split("/"):
            raise ValueError(f"not a file below the folder: {file}")
        part = [] if line is None else [f"-L{line},{line}"]
        text = self._lines(self._run("blame", "--line-porcelain", *part, "--", file))
        # every line of the file is an entry of its own, from its head (hash, line before, line now) to the tab
        head = r"^([0-9a-f]{40}) \d+ (\d+)"
        so_far = Window.partitionBy(F.lit(0)).orderBy("line_no")  # one file
        at = text.withColumn("entry", F.sum((F.col("line").rlike(head)).cast("int")).over(so_far))
        value = lambda p, i: F.max(F.when(F.col("line").rlike(p), F.regexp_extract("line", p, i)))
        found = at.groupBy("entry").agg(
            value(head, 2).cast("int").alias("line"), F.substring(value(head, 1), 1, 7).alias("hash"), value(r"^author (.+)$", 1).alias("author"),
            F.timestamp_seconds(value(r"^author-time (\d+)$", 1).cast("long")).alias("time"), value(r"^\t(.*)$", 1).alias("content"),
        )
        return found.drop("entry")

    def status(self) -> DataFrame:
        """kind (staged, modified, untracked) and file of each change of the work tree."""
        line = self._lines(self._run("status", "--porcelain"))
        index = F.substring("line", 1, 1)
        kind = F.when(index == "?", "untracked").when(index != " ", "staged").otherwise("modified")
        return line.where(F.trim("line") != "").select(kind.alias("kind"), F.substring("line", 4, 100_000).alias("file"))

    def branches(self) -> DataFrame:
        """name, current of each local branch."""
        now = self._run("rev-parse", "--abbrev-ref", "HEAD").strip()
        names = [b for b in self._run("branch", "--format=%(refname:short)").splitlines() if b.strip()]
        return self.spark.createDataFrame([(b, b == now) for b in names], "name string, current boolean")


def _safe(ref: str) -> str:
    if not _REF.fullmatch(ref):
        raise ValueError(f"not a reference: {ref!r}")
    return ref
