"""Detectors: kind of log, build tool, stack trace, configuration, language, and marks of single lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def any_of(col: Column, found: list[str], ignore_case: bool = True) -> Column:
    out = F.lit(False)
    for p in found:
        out = out | col.rlike(X.java(p, ignore_case))
    return out


def line_marks(lines: DataFrame) -> DataFrame:
    """``lines`` with is_error, is_warning, is_key_event and is_likely_error of column ``line``."""
    line = F.col("line")
    return lines.select(
        "*", line.rlike(X.java(P.ERROR_LINE)).alias("is_error"), line.rlike(X.java(P.WARNING_LINE)).alias("is_warning"),
        any_of(line, P.KEY_EVENT).alias("is_key_event"), any_of(line, P.LIKELY_ERROR).alias("is_likely_error"),
    )


def log_type(lines: DataFrame) -> DataFrame:
    """Per doc_id: the first log type of whose patterns enough lines have one; blank lines do not count."""
    kinds = list(P.LOG_TYPES)
    marks = []
    for kind in kinds:
        found = F.lit(False)
        for p, ignore in P.LOG_TYPES[kind][0]:
            found = found | F.col("line").rlike(X.java(p, ignore))
        marks.append(F.avg(found.cast("int")).alias(kind))
    shares = lines.where(X.trim(F.col("line")) != "").groupBy("doc_id").agg(*marks)
    out = F.lit("generic")
    for kind in reversed(kinds):
        out = F.when(F.col(kind) >= P.LOG_TYPES[kind][1], kind).otherwise(out)
    return shares.select("doc_id", out.alias("log_type"))


def build_tool(text: Column) -> Column:
    """Ordered tests of what a build's output holds."""
    has = lambda s: F.contains(text, F.lit(s))
    return (
        F.when(has("error TS") | has("warning TS"), "tsc").when((has("error") & has("warning") & text.rlike(r"\d+:\d+")) | has("eslint"), "eslint")
        .when(has("ERROR in") | has("webpack"), "webpack").when(has("[vite]"), "vite").when(has("✘ [ERROR]"), "esbuild").when(has("error[E") | has("rustc"), "rust")
        .when(text.rlike(r"\.go:\d+:\d+:"), "go").otherwise("generic")
    )


def stack_type(text: Column) -> Column:
    out = F.lit("unknown")
    for kind, p in reversed(P.STACK_TYPES.items()):
        out = F.when(text.rlike(p), kind).otherwise(out)
    return out


def config_type(text: Column) -> Column:
    """json (an object or a list that parses), yaml (a line ``key:``), else unknown."""
    start = F.substring(X.trim(text), 1, 1)
    return F.when(start.isin("{", "[") & F.try_parse_json(text).isNotNull(), "json").when(text.rlike(P.YAML_LINE), "yaml").otherwise("unknown")


def language(path: Column) -> Column:
    """Language by a path's extension; a name that is only an extension has none."""
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))
    pairs = [F.lit(x) for name, exts in P.LANGUAGES.items() for e in exts.split() for x in (e, name)]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("unknown"))


def strategy(text: Column, content_type: Column) -> Column:
    """How a text is condensed: as build output or a diff if it looks like one, else by its content type."""
    build = text.rlike("(?i)" + P.BUILD_PLACE)
    for word in P.BUILD_WORDS:
        build = build | F.contains(text, F.lit(word))
    diff = F.contains(text, F.lit("diff --git ")) | (F.contains(text, F.lit("--- a/")) & F.contains(text, F.lit("+++ b/"))) | text.rlike(P.DIFF_HUNK)
    by_type = F.when(content_type == "code", "semantic").when(content_type.isin("logs", "stacktrace", "config"), content_type).otherwise("auto")
    return F.when(build, "build").when(diff, "diff").otherwise(by_type)


def blocked(path: Column) -> Column:
    """Whether the access policy keeps a path from being read: its name or itself matches the denylist."""
    return any_of(F.regexp_extract(path, r"([^/]*)/*\z", 1), P.BLOCKED_PATHS) | any_of(path, P.BLOCKED_PATHS)


def analysis(content_type: Column) -> list[Column]:
    """The condenser that a content type gets, and how much it is likely to save (an indication, not a measure)."""
    condenser = F.when(content_type.isin("logs", "stacktrace", "config"), content_type).otherwise("generic")
    saving = F.when(content_type == "logs", "70-90%").when(content_type == "stacktrace", "50-80%").when(content_type == "config", "30-60%").otherwise("20-50%")
    return [condenser.alias("condenser"), saving.alias("saving")]
