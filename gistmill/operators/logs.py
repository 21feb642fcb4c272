"""Log operators: parsing, grouping, statistics, scores, endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X


def parse(lines: DataFrame) -> DataFrame:
    """Adds ts_raw, level and message (the line without time stamp and level bracket)."""
    ts = F.regexp_extract("line", P.ISO_TIME, 1)
    message = F.regexp_replace(F.regexp_replace("line", P.ISO_TIME, ""), X.java(r"\[?\b(ERROR|ERR|FATAL|CRITICAL|WARN(?:ING)?|INFO|DEBUG|TRACE|VERBOSE)\b\]?", True), "")
    return lines.select("*", F.when(ts != "", ts).alias("ts_raw"), X.level(F.col("line")).alias("level"), X.trim(message).alias("message"))


def group(parsed: DataFrame, order: str) -> DataFrame:
    """Groups of equal normalised messages: count, sample and level of the first member."""
    norm = X.replace_all(F.col("message"), P.LOG_MESSAGE)
    return (
        parsed.groupBy(norm.alias("pattern"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_line"), F.min_by("level", order).alias("level"), F.min_by("line", order).alias("sample"))
        .orderBy(F.desc(F.col("level") == "error"), F.desc(F.col("level") == "warning"), F.desc("n"), "first_line")
    )


def dedup(parsed: DataFrame, order: str) -> DataFrame:
    """Entries collapsed by their grouping form, keeping the first."""
    norm = F.lower(X.replace_all(F.col("message"), P.LOG_GROUP))
    return parsed.groupBy(norm.alias("form")).agg(F.count(F.lit(1)).alias("n"), F.min_by("message", order).alias("message"), F.min(order).alias("first_line"))


def level_stats(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("message").alias("messages"))


def timespan(parsed: DataFrame) -> DataFrame:
    ts = F.try_to_timestamp("ts_raw", F.lit("yyyy-MM-dd HH:mm:ss"))
    return parsed.agg(
        F.date_format(F.min(ts), "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss").alias("last"), F.count(ts).alias("n"),
        (F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))).alias("seconds"),
    )


def numbered(rows: DataFrame, order: str, pieces: int = 4096) -> DataFrame:
    """``rows`` with index, from 0 by ascending ``order`` (distinct numbers), and total: numbered within ``pieces`` ranges, offset by prefix sums of their counts."""
    span = rows.agg(F.min(order).alias("_lo"), F.greatest(F.ceil((F.max(order) - F.min(order) + 1) / pieces), F.lit(1)).alias("_width"))
    placed = rows.join(F.broadcast(span)).withColumn("_piece", F.floor((F.col(order) - F.col("_lo")) / F.col("_width")))  # one row
    counts = placed.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a piece
    offsets = counts.select("_piece", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    within = F.row_number().over(Window.partitionBy("_piece").orderBy(order))
    return placed.join(F.broadcast(offsets), "_piece").withColumn("index", F.col("_base") + within - 1).drop("_lo", "_width", "_piece", "_base")


def message_tfidf(counted: DataFrame) -> DataFrame:
    """message, tfidf: the mean weight of its terms, halved, 1 at most; each entry is a segment, equal messages are weighed once (message, n)."""
    words = counted.select("message", "n", F.posexplode(X.terms(F.col("message"), P.TFIDF_STOPWORDS)).alias("pos", "term"))
    tf = words.groupBy("message", "n", "term").agg(F.count(F.lit(1)).alias("c"))
    df = tf.groupBy("term").agg(F.sum("n").alias("df"))
    total = counted.agg(F.sum("n").alias("all"))
    weight = F.col("c") / F.sum("c").over(Window.partitionBy("message")) * F.log(F.col("all") / F.col("df"))
    rated = tf.join(df, "term").join(F.broadcast(total)).withColumn("weight", weight)  # one row
    return rated.groupBy("message").agg(F.least(F.avg("weight") / 2, F.lit(1.0)).alias("tfidf"))


def entry_scores(parsed: DataFrame, order: str, edge: int = 5) -> DataFrame:
    """level, ``order``, score and n of every entry: .3 level + .3 tfidf + .2 position (ends high) + .2 rarity (1 - frequency / highest).

    Messages are normalised and weighed once for each distinct one.
    """
    messages = parsed.groupBy("message").agg(F.count(F.lit(1)).alias("n"))
    forms = messages.withColumn("form", X.replace_all(F.lower("message"), P.SCORE_PATTERN))
    counts = forms.groupBy("form").agg(F.sum("n").alias("often"))
    top = counts.agg(F.max("often").alias("most"))
    known = forms.join(counts, "form").join(message_tfidf(messages), "message", "left").join(F.broadcast(top))  # one row
    i, n = F.col("index"), F.col("total")
    last = n - 1 - i
    middle = 0.3 + 0.4 * F.abs((i - edge) / (n - 2 * edge) - 0.5) * 2
    place = F.when(n <= 1, 1.0).when(i < edge, 1.0 - i / edge * 0.3).when(last < edge, 0.7 + (1 - last / edge) * 0.3).otherwise(middle)
    rated = numbered(parsed, order).join(known.select("message", "often", "most", F.coalesce("tfidf", F.lit(0.0)).alias("tfidf")), "message")
    score = 0.3 * X.level_score(F.col("level")) + 0.3 * F.col("tfidf") + 0.2 * place + 0.2 * (1 - F.col("often") / F.col("most"))
    return rated.select("level", order, F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 6).alias("score"), F.col("often").alias("n"))


def scores(parsed: DataFrame, order: str, k: int) -> DataFrame:
    """Top ``k`` entries per level by ``entry_scores``."""
    rank = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("score"), order))
    return entry_scores(parsed, order).withColumn("k", rank).where(F.col("k") <= k).select("level", "k", order, "score", "n")


def score_stats(scored: DataFrame) -> DataFrame:
    """Entries, mean, least and highest score, and how many are high (.7 and more), medium (.4 and more) and low."""
    return scored.agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg("score"), 4).alias("mean"), F.min("score").alias("least"), F.max("score").alias("highest"),
        F.count_if(F.col("score") >= 0.7).alias("high"), F.count_if((F.col("score") >= 0.4) & (F.col("score") < 0.7)).alias("medium"), F.count_if(F.col("score") < 0.4).alias("low"),
    )


def quick_score(parsed: DataFrame, order: str) -> DataFrame:
    """Half the level's score, half that of words in the message: no corpus needed."""
    low = F.lower("message")
    has = lambda words: F.expr("false") if not words else low.rlike("|".join(words))
    words = F.when(has(P.HIGH_WORDS), 1.0).when(has(P.MEDIUM_WORDS), 0.7).when(F.col("message").rlike(X.java(P.TRACE_HINT, True)), 0.8).otherwise(0.3)
    return parsed.select(order, F.round(0.5 * X.level_score(F.col("level")) + 0.5 * words, 6).alias("score"))


def in_timeframe(parsed: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Entries between two times, bounds included; entries without a time stay."""
    ts = F.try_to_timestamp("ts_raw", F.lit("yyyy-MM-dd HH:mm:ss"))
    keep = F.lit(True)
    if start:
        keep = keep & (ts >= F.lit(start).cast("timestamp"))
    if end:
        keep = keep & (ts <= F.lit(end).cast("timestamp"))
    return parsed.where(ts.isNull() | keep)


def duration_text(ms):
    """Milliseconds as people read them."""
    part = lambda by, of: F.floor(F.pmod(ms, F.lit(of)) / by).cast("string")
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, F.concat(F.format_string("%.1f", ms / 1000), F.lit("s")))
        .when(ms < 3_600_000, F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "), part(1000, 60_000), F.lit("s")))
        .otherwise(F.concat(F.floor(ms / 3_600_000).cast("string"), F.lit("h "), part(60_000, 3_600_000), F.lit("m")))
    )


def requests(lines: DataFrame) -> DataFrame:
    """method, path, status, ms of request lines; other lines go."""
    part = lambda i: F.regexp_extract("line", X.java(P.HTTP_REQUEST, True), i)
    return lines.where(F.col("line").rlike(X.java(P.HTTP_REQUEST, True))).select(
        F.upper(part(1)).alias("method"), part(2).alias("path"), part(3).cast("int").alias("status"), F.when(part(4) != "", part(4)).cast("double").alias("ms")
    )


def endpoints(found: DataFrame) -> DataFrame:
    """Per method and path template: requests, mean time over all of them, errors (400 and more)."""
    path = F.regexp_replace(F.regexp_replace(F.split("path", r"\?")[0], r"/\d+", "/:id"), r"(?i)/[a-f0-9-]{36}", "/:uuid")
    return found.groupBy("method", path.alias("endpoint")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("ms"), F.lit(0.0)) / F.count(F.lit(1)), 6).alias("mean_ms"),
        F.count_if(F.col("status") >= 400).alias("errors"), F.count_if(F.col("status") >= 500).alias("server_errors"),
    )
