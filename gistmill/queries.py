"""Queries of the operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import patterns as P
from .functions import text as X
from .operators import build, conversation, graph, lines, logs, scoring, sharing
from .plans.flow import Flow
from .sources import tables as T
from .streaming import events as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chain(col: str, chain: list[tuple[str, str, bool]]) -> str:
    for pattern, by, ignore in chain:
        col = f"regexp_replace({col}, {_q(pattern)}, {_q(by)}, '{'gi' if ignore else 'g'}')"
    return _trim(col)


def _trim(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


_LINES = "unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no"
_DOC_LINES = f"l AS (SELECT doc_id, {_LINES} FROM documents)"
_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(line, {_q(p)}, 'i') THEN '{n}'" for n, p in P.LEVELS) + " ELSE 'info' END"
_STRIP = r"\[?\b(ERROR|ERR|FATAL|CRITICAL|WARN(?:ING)?|INFO|DEBUG|TRACE|VERBOSE)\b\]?"
_PARSED = f"""e AS (SELECT event_id, concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' [', {T.LEVEL}, '] ', {T.MESSAGE}) AS line FROM events),
p AS (SELECT *, nullif(regexp_extract(line, {_q(P.ISO_TIME)}, 1), '') AS ts_raw, {_LEVEL} AS level,
      {_trim(f"regexp_replace(regexp_replace(line, {_q(P.ISO_TIME)}, '', 'g'), {_q(_STRIP)}, '', 'gi')")} AS message FROM e)"""
_TERMS = r"list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 2)"
_STOP = "[" + ", ".join(f"'{w}'" for w in P.TFIDF_STOPWORDS) + "]"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse(T.log_lines(spark, sf_dir))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents")


@query(f"WITH {_PARSED} SELECT {_chain('message', P.LOG_MESSAGE)} AS pattern, count(*) AS n, min(event_id) AS first_line, arg_min(level, event_id) AS level, arg_min(line, event_id) AS sample FROM p GROUP BY 1")
def log_group(spark, sf_dir):
    return logs.group(_parsed(spark, sf_dir), "event_id")


@query(f"WITH {_PARSED} SELECT lower({_chain('message', P.LOG_GROUP)}) AS form, count(*) AS n, arg_min(message, event_id) AS message, min(event_id) AS first_line FROM p GROUP BY 1")
def log_dedup(spark, sf_dir):
    return logs.dedup(_parsed(spark, sf_dir), "event_id")


@query(f"WITH {_PARSED} SELECT level, count(*) AS n, count(DISTINCT message) AS messages FROM p GROUP BY 1")
def log_level_stats(spark, sf_dir):
    return logs.level_stats(_parsed(spark, sf_dir))


@query(f"WITH {_PARSED} SELECT min(ts_raw) AS first, max(ts_raw) AS last, count(ts_raw) AS n, epoch(max(ts_raw)::TIMESTAMP)::BIGINT - epoch(min(ts_raw)::TIMESTAMP)::BIGINT AS seconds FROM p")
def log_timespan(spark, sf_dir):
    return logs.timespan(_parsed(spark, sf_dir))


_ENTRIES = f"""{_PARSED}, m AS (SELECT message, count(*) AS n FROM p GROUP BY 1), f AS (SELECT *, {_chain('lower(message)', P.SCORE_PATTERN)} AS form FROM m), c AS (SELECT form, sum(n) AS often FROM f GROUP BY 1),
w AS (SELECT event_id, unnest(list_filter({_TERMS.format('message')}, lambda w: NOT list_contains({_STOP}, w))) AS term FROM p), t1 AS (SELECT event_id, term, count(*) AS c FROM w GROUP BY ALL),
t2 AS (SELECT event_id, term, c / sum(c) OVER (PARTITION BY event_id) AS tf, count(*) OVER (PARTITION BY term) AS df FROM t1), t3 AS (SELECT event_id, least(avg(tf * ln((SELECT count(*) FROM p) / df)) / 2, 1.0) AS t FROM t2 GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS total FROM p),
s AS (SELECT i.event_id, level, often::BIGINT AS n, round(greatest(0, least(1, 0.3::DOUBLE * CASE level WHEN 'error' THEN 1.0 WHEN 'warning' THEN 0.7 WHEN 'info' THEN 0.3 ELSE 0.1 END::DOUBLE + 0.3::DOUBLE * coalesce(t, 0)
+ 0.2::DOUBLE * CASE WHEN total <= 1 THEN 1.0 WHEN i < 5 THEN 1.0 - i / 5 * 0.3::DOUBLE WHEN total - 1 - i < 5 THEN 0.7::DOUBLE + (1 - (total - 1 - i) / 5) * 0.3::DOUBLE ELSE 0.3::DOUBLE + 0.4::DOUBLE * abs((i - 5) / (total - 10) - 0.5::DOUBLE) * 2 END::DOUBLE
+ 0.2::DOUBLE * (1 - often / (SELECT max(often) FROM c)))), 6) AS score FROM i JOIN f USING (message) JOIN c USING (form) LEFT JOIN t3 ON t3.event_id = i.event_id)"""


@query(f"""WITH {_ENTRIES}, r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, event_id) AS k FROM s) SELECT level, k, event_id, score, n FROM r WHERE k <= 10""")
def log_score_topk(spark, sf_dir):
    return logs.scores(_parsed(spark, sf_dir), "event_id", 10)


_HTTP = f"""r AS (SELECT {T.REQUEST} AS line FROM events), h AS (SELECT upper(regexp_extract(line, {_q(P.HTTP_REQUEST)}, 1, 'i')) AS method, regexp_extract(line, {_q(P.HTTP_REQUEST)}, 2, 'i') AS path,
regexp_extract(line, {_q(P.HTTP_REQUEST)}, 3, 'i')::INT AS status, nullif(regexp_extract(line, {_q(P.HTTP_REQUEST)}, 4, 'i'), '')::DOUBLE AS ms FROM r WHERE regexp_matches(line, {_q(P.HTTP_REQUEST)}, 'i'))"""


@query(rf"""WITH {_HTTP} SELECT method, regexp_replace(string_split(path, '?')[1], '/\d+', '/:id', 'g') AS endpoint, count(*) AS n, round(coalesce(sum(ms), 0) / count(*), 6) AS mean_ms,
count(*) FILTER (status >= 400) AS errors, count(*) FILTER (status >= 500) AS server_errors FROM h GROUP BY 1, 2""")
def http_endpoint_stats(spark, sf_dir):
    return logs.endpoints(logs.requests(T.request_lines(spark, sf_dir)))


@query(f"WITH {_HTTP} SELECT status, count(*) AS n FROM h GROUP BY 1")
def http_status_histogram(spark, sf_dir):
    return logs.requests(T.request_lines(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_ERR = r"'\b(error|Error|ERROR|fail|Fail|FAIL|fatal|Fatal|FATAL)\b'"


@query(f"WITH {_DOC_LINES}, n AS (SELECT *, {_chain('line', P.GENERIC_LINE)} AS norm FROM l) SELECT doc_id, norm, count(*) AS n, min(line_no) AS first_line, bool_or(regexp_matches(line, {_ERR})) AS has_error, bool_or(regexp_matches(line, {_q(P.WARNING_LINE)})) AS has_warning FROM n WHERE norm <> '' GROUP BY 1, 2")
def generic_line_groups(spark, sf_dir):
    return lines.line_groups(T.lines(_docs(spark, sf_dir)))


@query(f"""WITH {_DOC_LINES}, n AS (SELECT *, {_chain('line', P.GENERIC_LINE)} AS norm FROM l), m AS (SELECT *, (norm IS DISTINCT FROM lag(norm) OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS new FROM n),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM m) SELECT doc_id, min(line_no) AS start, count(*) AS n, min(norm) AS norm FROM r GROUP BY doc_id, run HAVING count(*) >= 2""")
def consecutive_runs(spark, sf_dir):
    return lines.runs(T.lines(_docs(spark, sf_dir)), 2)


@query(f"WITH {_DOC_LINES} SELECT {_chain('line', P.TEMPLATE)} AS template, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l WHERE {_trim('line')} <> '' GROUP BY 1 HAVING count(*) >= 2")
def templates(spark, sf_dir):
    return lines.templates(T.lines(_docs(spark, sf_dir)), 2)


@query(f"WITH {_DOC_LINES}, t AS (SELECT {_chain('line', P.TEMPLATE)} AS template, count(*) AS n FROM l WHERE {_trim('line')} <> '' GROUP BY 1 HAVING count(*) >= 2) SELECT template, n FROM t WHERE n > 3 * (SELECT avg(n) FROM t)")
def pattern_anomalies(spark, sf_dir):
    return lines.template_anomalies(templates(spark, sf_dir))


_GREP = r"[0-9]{2,}"


@query(f"WITH {_DOC_LINES} SELECT doc_id, line_no::INT AS line_no, length(string_split_regex(line, '{_GREP}')[1]) + 1 AS col, len(regexp_extract_all(line, '{_GREP}')) AS matches FROM l WHERE regexp_matches(line, '{_GREP}')")
def grep(spark, sf_dir):
    return lines.grep(T.lines(_docs(spark, sf_dir)), _GREP)


@query("SELECT lang, count(*) AS docs, sum(ceil(length(coalesce(text, '')) / 4.0))::BIGINT AS tokens, max(ceil(length(coalesce(text, '')) / 4.0))::BIGINT AS most, count(*) FILTER (ceil(length(coalesce(text, '')) / 4.0) > 2000) AS over FROM documents GROUP BY 1")
def token_report(spark, sf_dir):
    return lines.token_report(_docs(spark, sf_dir))


@query("""WITH l AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, CASE WHEN length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'generic' WHEN regexp_matches(t, '(?m)^\\s+at .+:\\d+') THEN 'stacktrace'
WHEN len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}'))) / len(string_split(t, chr(10))) >= 0.3 THEN 'logs'
WHEN regexp_matches(t, '\\A\\s*[\\[{]') AND json_valid(t) THEN 'config' WHEN regexp_matches(t, '(?m)^(import|export|const|let|var|function|class|interface|type|def|fn|func|struct)\\s+\\S+.*[({;=]') THEN 'code' ELSE 'generic' END AS content_type FROM l""")
def content_type(spark, sf_dir):
    return lines.content_type(_docs(spark, sf_dir))


@query("SELECT doc_id, 'd' || left(sha1(coalesce(text, '')), 10) AS handle, md5(coalesce(text, '')) AS md5 FROM documents")
def origin_handles(spark, sf_dir):
    return lines.handles(_docs(spark, sf_dir))


_TFIDF = f"""{_DOC_LINES}, w AS (SELECT doc_id, line_no, unnest(list_filter({_TERMS.format('line')}, lambda w: NOT list_contains({_STOP}, w))) AS term FROM l),
c AS (SELECT doc_id, line_no, term, count(*) AS n FROM w GROUP BY ALL), tf AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id, line_no) AS tf FROM c), df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
sz AS (SELECT doc_id, count(*) AS segments FROM l GROUP BY 1), ti AS (SELECT doc_id, line_no, term, tf, ln(segments / df) AS idf FROM tf JOIN df USING (doc_id, term) JOIN sz USING (doc_id))"""


@query(f"WITH {_TFIDF} SELECT doc_id, line_no::INT AS line_no, term, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tf * idf, 6) AS tfidf FROM ti")
def tfidf_terms(spark, sf_dir):
    t = scoring.tfidf(T.lines(_docs(spark, sf_dir)))
    return t.select("doc_id", "line_no", "term", *[F.round(c, 6).alias(c) for c in ("tf", "idf", "tfidf")])


_WORDS = " + ".join(f"CASE WHEN regexp_matches(line, {_q(p)}) THEN {w} ELSE 0 END::DOUBLE" for p, w in P.KEYWORDS.values())
_SCORED = f"""{_TFIDF}, seg AS (SELECT doc_id, line_no, least(avg(tf * idf) / 2, 1.0) AS t FROM ti GROUP BY ALL), pos AS (SELECT *, line_no / count(*) OVER (PARTITION BY doc_id) AS place FROM l),
sc AS (SELECT doc_id, line_no, ceil(length(line) / 4.0)::BIGINT AS tokens, round(0.4::DOUBLE * coalesce(t, 0) + 0.3::DOUBLE * CASE WHEN place <= 0.1::DOUBLE OR place >= 0.9::DOUBLE THEN 1.0 WHEN place <= 0.2::DOUBLE OR place >= 0.8::DOUBLE THEN 0.85
WHEN place <= 0.3::DOUBLE OR place >= 0.7::DOUBLE THEN 0.7 ELSE 0.6 END::DOUBLE + 0.3::DOUBLE * least({_WORDS}, 1), 6) AS score FROM pos LEFT JOIN seg USING (doc_id, line_no))"""


@query(f"WITH {_SCORED} SELECT doc_id, line_no::INT AS line_no, tokens, score FROM sc")
def segment_scores(spark, sf_dir):
    return scoring.segment_scores(T.lines(_docs(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_SCORED}, g AS (SELECT doc_id, floor(sum(tokens) * 0.5)::BIGINT AS budget, list({{'l': line_no, 't': tokens}} ORDER BY score DESC, line_no) AS s FROM sc GROUP BY 1),
r AS (SELECT doc_id, budget, list_reduce(s, lambda a, x: CASE WHEN a.u + x.t <= budget THEN {{'u': a.u + x.t, 'p': list_append(a.p, x.l)}} ELSE a END, {{'u': 0::BIGINT, 'p': []::BIGINT[]}}) AS f FROM g)
SELECT doc_id, budget, f.u AS used, coalesce(array_to_string(list_sort(f.p), ','), '') AS picked FROM r""")
def semantic_select(spark, sf_dir):
    return scoring.select_budget(scoring.segment_scores(T.lines(_docs(spark, sf_dir))), 0.5)


_ASK = ["the", "and", "nation", "the", "thing"]


@query(f"""WITH w AS (SELECT doc_id, {_TERMS.format("coalesce(text, '')")} AS w FROM documents), st AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w), q(term, times) AS (VALUES {', '.join(f"('{t}', {_ASK.count(t)})" for t in dict.fromkeys(_ASK))}),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id, round(sum(times * ln((docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_search(spark, sf_dir):
    return scoring.bm25(_docs(spark, sf_dir), _ASK, 20)


@query(f"""WITH s AS (SELECT item_id, list_distinct({_TERMS.format('text')}) AS w FROM benchmark), p AS (SELECT a.item_id, b.item_id AS other, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 6) AS similarity FROM s a JOIN s b ON a.item_id < b.item_id WHERE len(a.w) > 0 AND len(b.w) > 0)
SELECT * FROM p WHERE similarity >= 0.1""")
def jaccard_pairs(spark, sf_dir):
    return scoring.prefix_pairs(T.table(spark, sf_dir, "benchmark"), 0.1)


@query("SELECT p_brand, p_partkey, p_name, levenshtein(p_name, first) AS distance FROM (SELECT *, first_value(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS first FROM part)")
def edit_distance(spark, sf_dir):
    from pyspark.sql import Window

    first = F.first("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return T.table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", F.levenshtein("p_name", first).alias("distance"))


_BUILD = f"""b AS (SELECT {T.COMPILER} AS line FROM lineitem), x AS (SELECT {', '.join(f"regexp_extract(line, {_q(P.TS_ERROR)}, {i}) AS {n}" for i, n in [(1, 'file'), (4, 'severity'), (5, 'code'), (6, 'message')])} FROM b WHERE regexp_matches(line, {_q(P.TS_ERROR)})),
g AS (SELECT code || ': ' || {_chain('message', P.ERROR_SIGNATURE)} AS signature, count(*) AS n, count(DISTINCT file) AS files, min(file) AS first_file FROM x GROUP BY 1)"""


@query(f"WITH {_BUILD} SELECT * FROM g")
def error_signatures(spark, sf_dir):
    return build.error_groups(build.compiler_errors(T.compiler_lines(spark, sf_dir)))


@query(f"WITH {_BUILD} SELECT sum(n)::BIGINT AS total, count(*) AS groups, round(100.0::DOUBLE * (1 - count(*) / sum(n)), 6) AS reduction FROM g")
def build_stats(spark, sf_dir):
    return build.error_stats(build.compiler_errors(T.compiler_lines(spark, sf_dir)))


@query(f"WITH {_BUILD} SELECT code, severity, count(*) AS n FROM x GROUP BY ALL ORDER BY n DESC, code LIMIT 3")
def build_code_histogram(spark, sf_dir):
    return build.compiler_errors(T.compiler_lines(spark, sf_dir)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(3)


_NUMBERED = "WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, CASE WHEN o_orderkey % 3 = 1 THEN 'src/f' || o_orderkey % 9 || '.ts' ELSE '  ' || o_orderkey || ':1 error' END AS line FROM orders)"


@query(f"{_NUMBERED} SELECT doc_id, line_no, line, last_value(CASE WHEN starts_with(line, 'src/') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS header FROM o")
def eslint_carry(spark, sf_dir):
    line = F.expr("CASE WHEN o_orderkey % 3 = 1 THEN concat('src/f', o_orderkey % 9, '.ts') ELSE concat('  ', o_orderkey, ':1 error') END")
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), line.alias("line"))
    return build.carry_forward(rows, "^src/")


_STACK = "CASE WHEN o_orderkey % 5 < 2 THEN concat('    at Module.x (node_modules/m', o_orderkey % 9, '.js:1:1)') ELSE concat('    at run (/src/app.ts:', o_orderkey, ':3)') END"


@query(f"""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, {_STACK} AS line FROM orders), m AS (SELECT *, regexp_matches(line, {_q(P.INTERNAL_FRAME)}) AS i FROM o), n AS (SELECT *, (i IS DISTINCT FROM lag(i) OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS new FROM m),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM n) SELECT doc_id, min(line_no)::BIGINT AS start, count(*) AS frames FROM r WHERE i GROUP BY doc_id, island""")
def stack_islands(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.expr(_STACK).alias("line"))
    return build.frame_islands(rows)


_DIFF = "CASE o_orderkey % 7 WHEN 1 THEN concat('diff --git a/f', o_orderkey % 9, '.ts b/f', o_orderkey % 9, '.ts') WHEN 2 THEN '@@ -1,3 +1,4 @@' ELSE concat(CASE o_orderkey % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END, 'x', o_orderkey) END"
_DIFFED = f"""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, {_DIFF} AS line FROM orders), k AS (SELECT *, CASE WHEN starts_with(line, 'diff --git') THEN 'file' WHEN starts_with(line, '@@') THEN 'hunk' WHEN starts_with(line, '+') THEN 'add' WHEN starts_with(line, '-') THEN 'del' ELSE 'context' END AS kind FROM o),
d AS (SELECT *, sum((kind = 'file')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS file_no, sum((kind = 'hunk')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS hunk_no FROM k)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.expr(_DIFF).alias("line"))
    return build.diff_parse(rows)


@query(_DIFFED + r" SELECT doc_id, file_no::BIGINT AS file_no, max(CASE WHEN kind = 'file' THEN regexp_extract(line, ' b/(\S+)$', 1) END) AS path, count(*) FILTER (kind = 'add') AS added, count(*) FILTER (kind = 'del') AS deleted, count(*) FILTER (kind = 'hunk') AS hunks FROM d GROUP BY doc_id, file_no")
def diff_files(spark, sf_dir):
    return build.diff_files(_diff(spark, sf_dir))


@query(_DIFFED + ", n AS (SELECT *, max((kind IN ('add', 'del'))::INT) OVER (PARTITION BY doc_id, hunk_no ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM d) SELECT doc_id, line_no, kind FROM n WHERE near = 1 AND kind IN ('add', 'del', 'context')")
def diff_context(spark, sf_dir):
    return build.diff_context(_diff(spark, sf_dir))


_CHAT = "concat(text, chr(10), CASE turn % 5 WHEN 0 THEN concat(CASE conv_id % 3 WHEN 0 THEN '- ' WHEN 1 THEN '2. ' ELSE '' END, CASE turn % 2 WHEN 0 THEN 'You must' ELSE 'YOU MUST' END, ' never drop table t') WHEN 1 THEN 'We decided to use parquet files. Fine' WHEN 2 THEN concat('See src/app', conv_id % 7, '.ts and lib/x.py') ELSE 'ok' END)"


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr(_CHAT).alias("text"))


_CHATS = f"c AS (SELECT conv_id, turn, role, {_CHAT} AS text FROM conversations)"


@query("SELECT conv_id, turn, role, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 5")
def conv_last_n(spark, sf_dir):
    return conversation.last_turns(T.table(spark, sf_dir, "conversations"), 5)


@query(f"""WITH {_CHATS}, l AS (SELECT conv_id, turn, {_trim('unnest(string_split(text, chr(10)))')} AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM c),
h AS (SELECT * FROM l WHERE length(line) BETWEEN 8 AND 240 AND ({' OR '.join(f"regexp_matches(line, {_q(p)}, 'i')" for p in P.CONSTRAINTS)})),
x AS (SELECT conv_id, turn, turn * 1000000 + pos AS place, regexp_replace(regexp_replace(line, '^[-*]\\s+', ''), '^\\d+\\.\\s+', '') AS line FROM h),
f AS (SELECT conv_id, arg_min(line, place) AS line, min(place) AS place, min(turn) AS turn FROM x GROUP BY conv_id, lower(line)), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS k FROM f) SELECT conv_id, k, line, turn FROM r WHERE k <= 20""")
def conv_constraints(spark, sf_dir):
    return conversation.constraints(_chat(spark, sf_dir))


_DEC = r"(?:decided to|will use|let's use|going with)\s+([^.\n]+)"


@query(f"WITH {_CHATS}, d AS (SELECT conv_id, turn, {_trim(f'''regexp_extract(text, {_q(_DEC)}, 1, 'i')''')} AS decision FROM c) SELECT * FROM d WHERE decision <> ''")
def conv_decisions(spark, sf_dir):
    return conversation.decisions(_chat(spark, sf_dir))


@query(f"WITH {_CHATS}, f AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, {_q(P.CODE_FILE)})) AS file FROM c) SELECT conv_id, file, min(turn) AS turn, count(*) AS mentions FROM f GROUP BY 1, 2")
def conv_code_refs(spark, sf_dir):
    return conversation.code_refs(_chat(spark, sf_dir))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def unique_first(spark, sf_dir):
    return Flow(T.table(spark, sf_dir, "events")).unique("user_id", order="event_id").build().select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def sort_take_skip(spark, sf_dir):
    return Flow(T.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")).sort(F.desc("o_totalprice"), "o_orderkey").skip(10).take(50).build()


@query("SELECT count(*) AS n, max(o_orderkey) AS top, bit_xor(o_custkey) AS mixed FROM orders")
def reduce_fold(spark, sf_dir):
    return Flow(T.table(spark, sf_dir, "orders")).reduce(n=F.count(F.lit(1)), top=F.max("o_orderkey"), mixed=F.bit_xor("o_custkey")).build()


@query("WITH s AS (SELECT ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS o, ceil(length(coalesce(text, '')) * 2 // 5 / 4.0)::BIGINT AS p FROM documents) SELECT count(*) FILTER (o > p) AS calls, sum(o - p) FILTER (o > p)::BIGINT AS saved, sum(o)::BIGINT AS original FROM s")
def savings(spark, sf_dir):
    n = F.char_length(F.coalesce("text", F.lit("")))
    s = _docs(spark, sf_dir).select(F.ceil(n / 4.0).alias("o"), F.ceil(F.floor(n * 2 / 5) / 4.0).alias("p"))
    return s.agg(F.count_if(F.col("o") > F.col("p")).alias("calls"), F.sum(F.when(F.col("o") > F.col("p"), F.col("o") - F.col("p"))).alias("saved"), F.sum("o").alias("original"))


_CODE = "CASE l_linenumber % 5 WHEN 0 THEN concat('export class C', l_partkey % 13, ' {') WHEN 1 THEN concat('  async function f', l_suppkey, '() {') WHEN 2 THEN concat('export const k', l_linenumber, ' = 1;') WHEN 3 THEN 'interface I {' ELSE '  return 1;' END"


@query(f"WITH o AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, {_CODE} AS line FROM lineitem), s AS (SELECT doc_id, line_no, {', '.join(f'regexp_extract(line, {_q(p)}, 1) AS n_{k}' for k, p in P.TS_QUICK.items())} FROM o) SELECT doc_id, line_no, CASE {' '.join(f'''WHEN n_{k} <> '' THEN '{k}' ''' for k in P.TS_QUICK)} END AS kind, coalesce({', '.join(f'''nullif(n_{k}, '')''' for k in P.TS_QUICK)}) AS name FROM s WHERE kind IS NOT NULL")
def quick_scan(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.expr(_CODE).alias("line"))
    return graph.quick_scan(rows)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, (p_partkey * 7 + p_size) % (SELECT max(p_partkey) FROM part) + 1 AS dst FROM part), r AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT r.src, e.dst, depth + 1 FROM r JOIN e ON r.dst = e.src WHERE depth < 5)
SELECT src, dst, min(depth) AS depth, src = dst AS cycle FROM r GROUP BY 1, 2""")
def recursive_deps(spark, sf_dir):
    part = T.table(spark, sf_dir, "part")
    last = part.agg(F.max("p_partkey").alias("last"))
    e = part.crossJoin(F.broadcast(last)).select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + F.col("p_size")) % F.col("last") + 1).alias("dst"))  # one row
    return graph.closure(e, 5).withColumn("cycle", F.col("src") == F.col("dst"))


@query("""WITH d AS (SELECT DISTINCT p_partkey % 50 AS file, p_partkey * 64 + p_size AS name FROM part), u AS (SELECT DISTINCT l_suppkey % 50 AS file, l_partkey * 64 + l_quantity::BIGINT AS name FROM lineitem)
SELECT file, name FROM d WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.name = d.name AND u.file <> d.file)""")
def dead_exports(spark, sf_dir):
    d = T.table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("file"), (F.col("p_partkey") * 64 + F.col("p_size")).alias("name")).distinct()
    u = T.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("file"), (F.col("l_partkey") * 64 + F.col("l_quantity").cast("long")).alias("name")).distinct()
    return graph.unused(d, u)


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return S.error_counts(T.table(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT *, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    return S.sessions(T.table(spark, sf_dir, "events"))


_SHARED = f"{_DOC_LINES}, t AS (SELECT doc_id, {_trim('line')} AS line FROM l), s AS (SELECT line, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS owner FROM t WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2)"


@query(f"WITH {_SHARED} SELECT line, n_docs, owner FROM s")
def shared_lines(spark, sf_dir):
    return sharing.shared_lines(T.lines(_docs(spark, sf_dir)))


@query(f"WITH {_SHARED} SELECT t.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE s.owner IS NULL OR s.owner = t.doc_id) AS n_left FROM t LEFT JOIN s ON s.line = t.line GROUP BY 1")
def unshared_size(spark, sf_dir):
    return sharing.unshared_size(T.lines(_docs(spark, sf_dir)))


@query(f"""WITH {_PARSED}, r AS (SELECT level, row_number() OVER (PARTITION BY level ORDER BY event_id) AS rank, event_id, {_trim('message')} AS message FROM p)
SELECT * FROM r WHERE rank <= CASE level WHEN 'error' THEN 40 WHEN 'warning' THEN 20 WHEN 'info' THEN 10 ELSE 0 END""")
def balanced_levels(spark, sf_dir):
    return sharing.balanced(_parsed(spark, sf_dir), "event_id", {"error": 40, "warning": 20, "info": 10})


@query(f"WITH {_DOC_LINES} SELECT length(line) // 50 * 50 AS bucket, count(*) AS n, max(length(line)) AS longest FROM l GROUP BY 1")
def length_buckets(spark, sf_dir):
    return sharing.length_buckets(T.lines(_docs(spark, sf_dir)))


@query("""WITH d AS (SELECT *, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)
SELECT lang, count(*) AS files, sum(n)::BIGINT AS lines, sum(coalesce(length(text), 0))::BIGINT AS chars, first(doc_id ORDER BY n DESC, doc_id) AS longest FROM d GROUP BY 1""")
def corpus_overview(spark, sf_dir):
    return sharing.overview(_docs(spark, sf_dir), "lang")


@query(f"""WITH {_PARSED}, g AS (SELECT user_id, p.level FROM p JOIN events USING (event_id)),
c AS (SELECT user_id, count(*) FILTER (WHERE level = 'error') AS error, count(*) FILTER (WHERE level = 'warning') AS warning, count(*) FILTER (WHERE level = 'info') AS info, count(*) FILTER (WHERE level = 'debug') AS debug FROM g GROUP BY 1)
SELECT *, CASE greatest(error, warning, info, debug) WHEN error THEN 'error' WHEN warning THEN 'warning' WHEN info THEN 'info' ELSE 'debug' END AS dominant FROM c""")
def dominant_levels(spark, sf_dir):
    users = T.table(spark, sf_dir, "events").select("event_id", "user_id")
    return sharing.dominant_level(_parsed(spark, sf_dir).join(users, "event_id"), "user_id")


from . import detector_queries, search_queries  # noqa: E402, F401  register their queries
