"""Search over lines of code: definitions and uses of a symbol, and declared symbols by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

_SPECIAL = r"[.*+?^${}()|\[\]\\]"


def escaped(col: Column) -> Column:
    """Text as a regular expression that matches just it."""
    return F.regexp_replace(col, f"({_SPECIAL})", r"\\$1")


def usages(lines: DataFrame, symbol: str, width: int = 100) -> DataFrame:
    """Lines that define or use ``symbol``, one row each; uses carry the trimmed line, up to ``width`` characters."""
    name = re.sub(_SPECIAL, lambda m: "\\" + m[0], symbol)
    line = F.col("line")
    defines = line.rlike(X.java(P.DEFINED + name + r"\b")) | line.rlike(name + P.BOUND)
    found = lines.where(F.contains(line, F.lit(symbol))).withColumn("kind", F.when(defines, "definition").when(line.rlike(X.java(rf"\b{name}\b")), "usage")).where("kind IS NOT NULL")
    return found.select("doc_id", "line_no", "kind", F.when(F.col("kind") == "usage", F.substring(X.trim(line), 1, width)).alias("context"))


def symbols(declared: DataFrame, part: str) -> DataFrame:
    """Declarations whose name holds ``part``, in any case."""
    return declared.where(F.contains(F.lower("name"), F.lit(part.lower())))


def references(lines: DataFrame, symbol: str) -> DataFrame:
    """Places of ``symbol`` with 1-based columns: of a line its definition, else its import, else every use of the word."""
    name = re.sub(_SPECIAL, lambda m: "\\" + m[0], symbol)
    word, line = X.java(rf"\b{name}\b"), F.col("line")
    forms = {"definition": X.java(P.DEFINED + name + r"\b"), "import": X.java(rf"import\s+(?:\{{[^}}]*\b{name}\b[^}}]*\}}|{name})")}
    before = lambda p: F.char_length(F.regexp_extract(line, f"^(.*?){p}", 1)) + 1
    pieces = F.split(line, word, -1)
    uses = F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 1),
        lambda k: F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda a, x: a + F.char_length(x)) + (k - 1) * len(symbol) + 1,
    )
    place = lambda kind, columns: F.struct(F.lit(kind).alias("kind"), columns.alias("columns"))
    found = F.when(line.rlike(word), place("usage", uses))
    for kind in ("import", "definition"):
        found = F.when(line.rlike(forms[kind]), place(kind, F.array(before(forms[kind])))).otherwise(found)
    placed = lines.where(F.contains(line, F.lit(symbol))).withColumn("r", found).where("r IS NOT NULL")
    return placed.select("doc_id", "line_no", "r.kind", F.explode("r.columns").alias("col"), X.trim(line).alias("context"))
