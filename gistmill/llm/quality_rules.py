"""Quality rules whose thresholds adapt to each language and source.

Every rule is a ratio of counts, scaled to an integer. Its distribution per
(lang, source) is kept in a quantile sketch of relative-error buckets: exact up to
64, then 32 buckets for each power of two (at most 3 % off). Bucket counts of two
sketches add up, so sketches merge in any order: partial sums on the map side,
sources into languages, languages into the whole corpus. A group with fewer than
``MIN_ROWS`` rows takes its language's sketch, and a language with fewer the corpus's.

A rule's cutoff is the fence ``q75 + FENCE * max(q75 - q50, floor)``; a document beyond
the fence of its group on any rule goes. The fences replace fixed cutoffs: text that
is usual for its language and source stays.

Only DataFrame functions are used. Repeated 3-word windows are found in each row: a
64-bit word per window holds bits of its hash above those of its place (as many as the text's number of words takes), one
primitive sort brings equal windows together, and neighbours up to two apart are compared as words. What
this can miss are two windows of a text, both repeated, that share a hash and interleave: for 100,000 words a
chance of 10^-5 that any two share one.

Edge cases: null or empty text has no words and fails the base rules; null lang or
source is a group of its own; repeated rows are judged alike, once each; a null doc_id stays null; texts are as long as an array
can be; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, skew_join, write_table

#: What the base rules count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MIN_ROWS = 100
FENCE = 4
#: rule: (scaled count, floor of the spread); all integers, so that every engine agrees.
RULES = {
    "word_length": ("(100 * word_chars) div n_words", 50),
    "symbols": ("(1000 * n_symbols) div n_words", 20),
    "dup_lines": ("(1000 * n_dup_lines) div n_words", 20),
    "repeats": ("(1000 * n_repeat_words) div n_words", 100),
}


def _without(col: Column, chars: str) -> Column:
    return F.translate(col, chars, "")


def _place_bits(words: Column) -> Column:
    """Bits that the place of a window takes in its key."""
    return F.char_length(F.bin(F.size(words).cast("long")))


def _window_keys(words: Column) -> Column:
    """The sorted keys of all 3-word windows: bits of the hash, then those of the place."""
    windows, bits = F.size(words) - 2, _place_bits(words)
    key = lambda i: F.call_function("shiftleft", F.xxhash64(words[i], words[i + 1], words[i + 2]), bits).bitwiseOR(i.cast("long"))
    places = F.when(windows > 1, F.sequence(F.lit(0), windows - 1)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(places, key))


def _twins(keys: Column, words: Column, step: int) -> Column:
    """Places of the windows whose words equal those of the window ``step`` further in the sorted keys."""
    bits = _place_bits(words)
    place = lambda key: key.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
    near = lambda a, b: F.call_function("shiftrightunsigned", a, bits) == F.call_function("shiftrightunsigned", b, bits)
    same = lambda a, b: (words[a] == words[b]) & (words[a + 1] == words[b + 1]) & (words[a + 2] == words[b + 2])
    later = F.slice(keys, step + 1, F.greatest(F.size(keys) - step, F.lit(0)))
    pairs = F.zip_with(keys, later, lambda a, b: F.when(near(a, b), F.when(same(place(a), place(b)), F.array(place(a), place(b)))))
    return F.flatten(F.filter(pairs, lambda x: x.isNotNull()))


def _covered(starts: Column) -> Column:
    """Words covered by 3-word windows at these ascending places."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, s: F.struct((acc["n"] + F.least(F.lit(3), s - acc["last"])).alias("n"), s.alias("last")),
        lambda acc: acc["n"],
    ).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of the base rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: _without(x, SPACES) != "")
    return (
        docs.select("doc_id", "lang", "source", text.alias("text"))
        .withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda x: x != ""))
        .withColumn("keys", _window_keys(F.col("words")))
        .withColumn("lines", lines)
        .select(
            "doc_id",
            "lang",
            "source",
            F.size("words").cast("long").alias("n_words"),
            F.char_length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
            (F.char_length("text") - F.char_length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _covered(
                F.sort_array(F.array_distinct(F.concat(*[_twins(F.col("keys"), F.col("words"), step) for step in (1, 2)])))
            ).alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def _bucket(value: Column) -> Column:
    """Smallest value of the sketch bucket that holds a non-negative integer."""
    drop = F.greatest(F.char_length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n over the documents that pass the base rules: mergeable by adding n."""
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(x).alias("value")) for r, (x, _) in RULES.items()])
    long = counts.where(~F.col("base_failed")).select("lang", "source", F.explode(rules).alias("r"))
    return long.groupBy("lang", "source", F.col("r.rule").alias("rule"), _bucket(F.col("r.value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Cutoff of each rule and number of documents for each group of ``keys``."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    steps = F.array_sort(F.collect_list(F.struct("bucket", "n")))  # a sketch: at most a few hundred buckets
    quantile = lambda q: F.expr(
        f"""aggregate(s, named_struct('seen', 0L, 'at', cast(null as bigint)),
            (a, x) -> named_struct('seen', a.seen + x.n, 'at', coalesce(a.at, if(100 * (a.seen + x.n) >= {q} * total, x.bucket, null))), a -> a.at)"""
    )
    floor = F.create_map(*[F.lit(v) for r, (_, x) in RULES.items() for v in (r, x)])[F.col("rule")]
    cut = quantile(75) + FENCE * F.greatest(quantile(75) - quantile(50), floor)
    groups = merged.groupBy(*keys, "rule").agg(steps.alias("s"), F.sum("n").alias("total")).select(*keys, "rule", "total", cut.alias("cut"))
    return groups.groupBy(*keys).agg(
        F.max("total").alias("rows"), *[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES]
    )


def thresholds(counts: DataFrame) -> DataFrame:
    """One row per (lang, source): key, rows and the cutoffs that hold for it."""
    sketch = sketches(counts)
    names = [f"cut_{r}" for r in RULES]
    known = F.col("rows") >= MIN_ROWS
    by_lang = fences(sketch, ["lang"]).where(known).select(F.col("lang").alias("_lang"), *[F.col(n).alias(f"lang_{n}") for n in names])
    overall = fences(sketch, []).select(*[F.col(n).alias(f"all_{n}") for n in names])
    return (
        counts.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"))
        .join(fences(sketch, ["lang", "source"]).withColumnsRenamed({"lang": "l", "source": "s"}), F.expr("lang <=> l AND source <=> s"), "left")
        .join(by_lang, F.expr("lang <=> _lang"), "left")
        .join(F.broadcast(overall), F.lit(True), "left")  # one row
        .select(
            _group_key().alias("group"), "docs",
            *[F.coalesce(F.when(known, F.col(n)), F.col(f"lang_{n}"), F.col(f"all_{n}")).alias(n) for n in names],
        )
    )


def _group_key() -> Column:
    return F.to_json(F.struct("lang", "source"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept."""
    counts = write_table(base_counts(docs), "quality")
    total = counts.count()
    judged = skew_join(counts.withColumn("group", _group_key()), thresholds(counts), "group", "docs", total, F.col("doc_id"))
    within = F.lit(True)
    for rule, (value, _) in RULES.items():
        within = within & F.coalesce(F.expr(value) <= F.col(f"cut_{rule}"), F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within).alias("kept")
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import documents

    return quality_rules(documents(spark, sf_dir))


def _oracle() -> str:
    names = list(RULES)
    values = ", ".join(f"{x.replace(' div ', ' // ')} AS {r}" for r, (x, _) in RULES.items())
    bucket = "(v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0)"
    floors = "CASE rule " + " ".join(f"WHEN '{r}' THEN {x}" for r, (_, x) in RULES.items()) + " END"

    def level(name: str, keys: str) -> str:
        on = f"{keys}, " if keys else ""
        return f"""{name}_c AS (SELECT {on}rule, b, sum(n) AS n FROM sk GROUP BY {on}rule, b),
{name}_q AS (SELECT {on}rule, sum(n) OVER (PARTITION BY {on}rule) AS total, b, sum(n) OVER (PARTITION BY {on}rule ORDER BY b) AS seen FROM {name}_c),
{name}_f AS (SELECT {on}rule, max(total) AS total, min(b) FILTER (100 * seen >= 75 * total) AS q75, min(b) FILTER (100 * seen >= 50 * total) AS q50 FROM {name}_q GROUP BY {on}rule),
{name} AS (SELECT {on}max(total) AS total, {", ".join(f"max(q75 + {FENCE} * greatest(q75 - q50, {floors})) FILTER (rule = '{r}') AS {name}_{r}" for r in names)} FROM {name}_f {"GROUP BY " + keys if keys else ""})"""

    cuts = " AND ".join(
        f"coalesce({r} <= coalesce(CASE WHEN g.total >= {MIN_ROWS} THEN g_{r} END, CASE WHEN l.total >= {MIN_ROWS} THEN l_{r} END, a_{r}), true)" for r in names
    )
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM p),
cov AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM tri, range(3) AS r(d) WHERE c > 1 GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
c AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
v AS (SELECT *, {values} FROM c WHERE NOT base_failed),
u AS (SELECT lang, source, rule, v FROM v UNPIVOT (v FOR rule IN ({", ".join(names)}))),
sk AS (SELECT lang, source, rule, {bucket} AS b, count(*) AS n FROM u GROUP BY ALL),
{level("g", "lang, source")}, {level("l", "lang")}, {level("a", "")}
SELECT v2.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {cuts} AS kept
FROM (SELECT c.*, v.* EXCLUDE (doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) FROM c LEFT JOIN v USING (doc_id)) v2
LEFT JOIN g ON v2.lang IS NOT DISTINCT FROM g.lang AND v2.source IS NOT DISTINCT FROM g.source
LEFT JOIN l ON v2.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a
"""


ORACLE_SQL = _oracle()
