"""Queries of the general parsers, the strategy router, code search and text segments, with their SQL twins; registered by ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .detector_queries import _any, _headed, _HEADS, _match, _signature, _x
from .functions import patterns as P
from .operators import detect, graph, lines, parsers, render, scoring, search, segments
from .plans.flow import Flow
from .queries import _CODE, ORACLE_SQL, _docs, _q, _trim, query
from .sources import files
from .sources import tables as T


def _orders(spark, sf_dir, line):
    return T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.expr(line).alias("line"))


_WEBPACK = """CASE o_orderkey % 5 WHEN 0 THEN concat('ERROR in ./src/f', o_orderkey % 9, '.js:', o_orderkey % 70, ':4') WHEN 1 THEN concat('Module build failed (from ./loader.js): Unexpected "x', o_orderkey, '"')
WHEN 2 THEN 'ERROR in ./src/whole.js' WHEN 3 THEN concat('Module failed to load: no file ', o_orderkey) ELSE 'webpack compiled' END"""


def _number(p: str, i: int, of: str = "line") -> str:
    return f"coalesce(nullif(regexp_extract({of}, {_q(p)}, {i}), '')::BIGINT, 0)"


@query(f"""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, {_WEBPACK} AS line FROM orders), c AS (SELECT *, CASE WHEN {_match('line', P.WEBPACK_ERROR, False)} THEN line END AS head FROM o),
m AS (SELECT *, count(head) OVER (PARTITION BY doc_id ORDER BY line_no) AS error, CASE WHEN head IS NULL THEN nullif({_x(P.WEBPACK_MODULE, 1)}, '') END AS said FROM c),
g AS (SELECT doc_id, error, max(head) AS head, arg_max(said, line_no) FILTER (said IS NOT NULL) AS message FROM m WHERE error > 0 GROUP BY 1, 2)
SELECT doc_id, error, regexp_extract(head, {_q(P.WEBPACK_ERROR)}, 1) AS file, {_number(P.WEBPACK_ERROR, 2, 'head')} AS row, {_number(P.WEBPACK_ERROR, 3, 'head')} AS col, message, {_signature("'WEBPACK'", 'message')} AS signature FROM g WHERE message IS NOT NULL""")
def webpack_errors(spark, sf_dir):
    return parsers.webpack_errors(_orders(spark, sf_dir, _WEBPACK))


_GENERIC = """CASE o_orderkey % 7 WHEN 0 THEN concat('  at src/f', o_orderkey % 9, '.c:', o_orderkey % 70, ':3') WHEN 1 THEN concat('Error[E', o_orderkey % 5, ']: cannot read "x', o_orderkey, '"') WHEN 2 THEN concat('warning: old call ', o_orderkey)
WHEN 3 THEN concat('--> lib/a.c:', o_orderkey % 50) WHEN 4 THEN 'ERROR no place' WHEN 5 THEN 'error: see lib/b.c:7' ELSE 'a note' END"""
_FOUND = f"CASE WHEN {_match('line', P.GENERIC_ERROR)} THEN 'error' WHEN {_match('line', P.GENERIC_WARNING)} THEN 'warning' END"
_PICK = lambda i, other: f"CASE severity WHEN 'error' THEN {_x(P.GENERIC_ERROR, i, True)} ELSE {other} END"


@query(f"""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, {_GENERIC} AS line FROM orders), c AS (SELECT *, {_FOUND} AS severity, CASE WHEN {_match('line', P.GENERIC_PLACE, False)} THEN line END AS place FROM o),
i AS (SELECT *, count(severity) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island FROM c),
p AS (SELECT *, last_value(place IGNORE NULLS) OVER (PARTITION BY doc_id, island ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spot FROM i),
f AS (SELECT *, coalesce(nullif({_PICK(1, _x(P.GENERIC_WARNING, 1, True))}, ''), upper(severity)) AS code, {_PICK(2, _x(P.GENERIC_WARNING, 2, True))} AS message FROM p WHERE severity IS NOT NULL)
SELECT doc_id, line_no, severity, code, message, {_signature('code', 'message')} AS signature, coalesce(regexp_extract(spot, {_q(P.GENERIC_PLACE)}, 1), 'unknown') AS file, {_number(P.GENERIC_PLACE, 2, 'spot')} AS row, {_number(P.GENERIC_PLACE, 3, 'spot')} AS col FROM f""")
def generic_errors(spark, sf_dir):
    return parsers.generic_errors(_orders(spark, sf_dir, _GENERIC))


_TYPED = """CASE WHEN length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'generic' WHEN regexp_matches(t, '(?m)^\\s+at .+:\\d+') THEN 'stacktrace'
WHEN len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}'))) / len(string_split(t, chr(10))) >= 0.3 THEN 'logs' WHEN regexp_matches(t, '\\A\\s*[\\[{]') AND json_valid(t) THEN 'config'
WHEN regexp_matches(t, '(?m)^(import|export|const|let|var|function|class|interface|type|def|fn|func|struct)\\s+\\S+.*[({;=]') THEN 'code' ELSE 'generic' END"""


@query(f"""WITH {_HEADS}, c AS (SELECT doc_id, t, {_TYPED} AS kind FROM h) SELECT doc_id, CASE WHEN {' OR '.join(f"contains(t, {_q(w)})" for w in P.BUILD_WORDS)} OR {_match('t', P.BUILD_PLACE)} THEN 'build'
WHEN contains(t, 'diff --git ') OR (contains(t, '--- a/') AND contains(t, '+++ b/')) OR {_match('t', P.DIFF_HUNK, False)} THEN 'diff' WHEN kind = 'code' THEN 'semantic' WHEN kind = 'generic' THEN 'auto' ELSE kind END AS strategy FROM c""")
def strategy(spark, sf_dir):
    docs = _headed(spark, sf_dir).withColumnRenamed("t", "text")
    return lines.content_type(docs, keep=["text"]).select("doc_id", detect.strategy(F.col("text"), F.col("content_type")).alias("strategy"))


_FILES = "concat('src/', CASE p_partkey % 9 WHEN 0 THEN '.env.local' WHEN 1 THEN 'a.PEM' WHEN 2 THEN 'my_secret.ts' WHEN 3 THEN 'keys/id_rsa.pub' WHEN 4 THEN 'passwords/x.ts' WHEN 5 THEN 'monkey' ELSE 'part' END, p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.key' ELSE '.ts' END)"
_NAME = "regexp_extract(path, '([^/]*)/*$', 1)"


@query(f"WITH f AS (SELECT p_partkey, {_FILES} AS path FROM part) SELECT p_partkey, path, {_any(_NAME, P.BLOCKED_PATHS)} OR {_any('path', P.BLOCKED_PATHS)} AS blocked FROM f")
def blocked_paths(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select("p_partkey", F.expr(_FILES).alias("path")).withColumn("blocked", detect.blocked(F.col("path")))


_USES = """CASE o_orderkey % 6 WHEN 0 THEN concat('  const $run = f', o_orderkey, '()') WHEN 1 THEN 'run: async () => {' WHEN 2 THEN concat('    return run(', o_orderkey, ') + run(2)') WHEN 3 THEN 'let runner = 1' WHEN 4 THEN concat('function run(a) { // ', o_orderkey) ELSE 'rerun()' END"""


@query(rf"""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, {_USES} AS line FROM orders), k AS (SELECT *, CASE WHEN {_match('line', P.DEFINED + r'run\b', False)} OR {_match('line', 'run' + P.BOUND, False)} THEN 'definition' WHEN {_match('line', r'\brun\b', False)} THEN 'usage' END AS kind FROM o)
SELECT doc_id, line_no, kind, CASE kind WHEN 'usage' THEN substring({_trim('line')}, 1, 100) END AS context FROM k WHERE kind IS NOT NULL""")
def symbol_usages(spark, sf_dir):
    return search.usages(_orders(spark, sf_dir, _USES), "run")


@query(f"WITH o AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, {_CODE} AS line FROM lineitem), s AS (SELECT doc_id, line_no, {', '.join(f'regexp_extract(line, {_q(p)}, 1) AS n_{k}' for k, p in P.TS_QUICK.items())} FROM o), f AS (SELECT doc_id, line_no, CASE {' '.join(f'''WHEN n_{k} <> '' THEN '{k}' ''' for k in P.TS_QUICK)} END AS kind, coalesce({', '.join(f'''nullif(n_{k}, '')''' for k in P.TS_QUICK)}) AS name FROM s) SELECT * FROM f WHERE contains(lower(name), '1')")
def symbols_named(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.expr(_CODE).alias("line"))
    return search.symbols(graph.quick_scan(rows), "1")


@query(r"SELECT p_partkey, regexp_replace(concat(p_name, ' (a+b)*[c]\d.$^{e|f}?'), '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS pattern FROM part")
def escaped_patterns(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select("p_partkey", search.escaped(F.concat("p_name", F.lit(r" (a+b)*[c]\d.$^{e|f}?"))).alias("pattern"))


@query(f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, l, unnest(range(0, len(l), 10)) AS f FROM d),
t AS (SELECT doc_id, f::INT AS first_line, (least(f + 10, len(l)) - 1)::INT AS last_line, {_trim("array_to_string(l[f + 1:f + 10], chr(10))")} AS text FROM c) SELECT * FROM t WHERE text <> ''""")
def line_chunks(spark, sf_dir):
    return segments.line_chunks(_docs(spark, sf_dir))


@query(f"""WITH d AS (SELECT doc_id, text, greatest(1, ceil(length(text) / 10.0))::BIGINT AS n FROM documents WHERE length(text) BETWEEN 1 AND {segments.MOST_CHARS}), c AS (SELECT *, unnest(range(0, ceil(length(text) / n::DOUBLE)::BIGINT)) AS k FROM d),
t AS (SELECT doc_id, k::INT AS chunk, {_trim('substring(text, k * n + 1, n)')} AS text FROM c) SELECT * FROM t WHERE text <> ''""")
def char_chunks(spark, sf_dir):
    return segments.char_chunks(_docs(spark, sf_dir))


_DIFF_FILE = """o_custkey AS doc_id, o_orderkey AS line_no, concat('src/old', o_orderkey, '.ts') AS old_path, concat('src/f', o_orderkey, '.ts') AS path, CASE o_orderkey % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END AS status,
o_orderkey % 40 AS additions, o_orderkey % 30 AS deletions, o_orderkey % 4 AS hunks"""


@query(f"""WITH f AS (SELECT {_DIFF_FILE} FROM orders), e AS (SELECT *, CASE status WHEN 'added' THEN 1 WHEN 'modified' THEN 2 WHEN 'deleted' THEN 3 ELSE 4 END AS rank, '- ' || CASE status WHEN 'added' THEN path || ' (+' || additions || ')'
WHEN 'modified' THEN path || ': +' || additions || '/-' || deletions || ', ' || hunks || CASE hunks WHEN 1 THEN ' hunk' ELSE ' hunks' END WHEN 'deleted' THEN old_path || ' (-' || deletions || ')' ELSE old_path || ' -> ' || path END AS entry FROM f),
s AS (SELECT doc_id, rank, count(*) AS n, sum(additions)::BIGINT AS a, sum(deletions)::BIGINT AS d, '### ' || upper(status[1]) || status[2:] || ' (' || count(*) || ')' || chr(10) || string_agg(entry, chr(10) ORDER BY line_no) AS section FROM e GROUP BY doc_id, rank, status)
SELECT doc_id, '## Diff Summary' || chr(10) || '- Files changed: ' || sum(n)::BIGINT || chr(10) || '- Additions: +' || sum(a)::BIGINT || chr(10) || '- Deletions: -' || sum(d)::BIGINT || chr(10) || chr(10) || string_agg(section, chr(10) || chr(10) ORDER BY rank) AS text FROM s GROUP BY 1""")
def diff_summary(spark, sf_dir):
    return render.diff_summary(T.table(spark, sf_dir, "orders").selectExpr(*_split_columns(_DIFF_FILE)))


def _split_columns(columns: str) -> list[str]:
    """The columns of a select list whose commas within parentheses do not count."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


_REFS = """CASE o_orderkey % 6 WHEN 0 THEN concat('  export const run = f', o_orderkey, '()') WHEN 1 THEN 'import { a, run } from "x"' WHEN 2 THEN concat('    return run(', o_orderkey, ') + run(2)') WHEN 3 THEN 'run run' WHEN 4 THEN 'import runner' ELSE 'rerun()' END"""
_DEF, _IMP = P.DEFINED + r"run\b", r"import\s+(?:\{[^}]*\brun\b[^}]*\}|run)"


@query(rf"""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, {_REFS} AS line FROM orders), k AS (SELECT *, CASE WHEN {_match('line', _DEF, False)} THEN 'definition' WHEN {_match('line', _IMP, False)} THEN 'import' WHEN {_match('line', r'\brun\b', False)} THEN 'usage' END AS kind, string_split_regex(line, '\brun\b') AS s FROM o),
p AS (SELECT doc_id, line_no, kind, line, unnest(CASE kind WHEN 'definition' THEN [length({_x(f'^(.*?){_DEF}', 1)}) + 1] WHEN 'import' THEN [length({_x(f'^(.*?){_IMP}', 1)}) + 1]
ELSE list_transform(range(1, len(s)), lambda k: length(array_to_string(s[1:k], '')) + (k - 1) * 3 + 1) END) AS col FROM k WHERE kind IS NOT NULL) SELECT doc_id, line_no, kind, col::INT AS col, {_trim('line')} AS context FROM p""")
def symbol_references(spark, sf_dir):
    return search.references(_orders(spark, sf_dir, _REFS), "run")


_ERROR = "o_custkey AS doc_id, o_orderkey AS line_no, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE concat('TS', o_orderkey % 2) END AS code, concat(repeat('cannot read the field of x ', 1 + o_orderkey % 4), o_orderkey % 8) AS message, concat('f', o_orderkey, '.ts:3') AS place"


@query(f"""WITH e AS (SELECT {_ERROR} FROM orders), g AS (SELECT doc_id, code, message, min(line_no) AS first_no, count(*) AS n, arg_min(place, line_no) || ' ' || message AS first, list(place ORDER BY line_no) AS l FROM e GROUP BY 1, 2, 3),
r AS (SELECT *, n >= 2 AS rep, row_number() OVER (PARTITION BY doc_id, n >= 2 ORDER BY n DESC, first_no) AS k FROM g),
t AS (SELECT doc_id, rep, k, CASE WHEN rep THEN k || '. ' || CASE code WHEN '' THEN '' ELSE code || ': ' END || CASE WHEN length(message) <= 80 THEN message ELSE left(message, 77) || '...' END || chr(10) || '   Occurrences: ' || n || chr(10) || '   First: '
|| CASE WHEN length(first) <= 100 THEN first ELSE left(first, 97) || '...' END || chr(10) || CASE WHEN len(l) > 1 THEN '   Also in: ' || array_to_string(l[2:6], ', ') || CASE WHEN len(l) > 6 THEN ' (+' || (len(l) - 6) || ' more)' ELSE '' END || chr(10) ELSE '' END ELSE '  ' || first END AS entry FROM r),
d AS (SELECT doc_id, string_agg(entry, chr(10) ORDER BY k) FILTER (rep) AS a, string_agg(entry, chr(10) ORDER BY k) FILTER (NOT rep AND k <= 5) AS s, count(*) FILTER (NOT rep) - 5 AS more FROM t GROUP BY 1)
SELECT doc_id, concat_ws(chr(10), 'DEDUPLICATED ERRORS:' || chr(10) || a, 'UNIQUE ERRORS:' || chr(10) || s || CASE WHEN more > 0 THEN chr(10) || '  ...and ' || more || ' more unique errors' ELSE '' END || chr(10)) AS text FROM d""")
def error_group_text(spark, sf_dir):
    found = T.table(spark, sf_dir, "orders").selectExpr(*_split_columns(_ERROR)).groupBy("doc_id", "code", "message").agg(
        F.min("line_no").alias("first_no"), F.count(F.lit(1)).alias("n"), F.min_by("place", "line_no").alias("at"), F.array_sort(F.collect_list(F.struct("line_no", "place"))).alias("places")
    )
    return render.error_groups(found.withColumn("first", F.concat("at", F.lit(" "), "message")).withColumn("locations", F.col("places.place")))


@query("""SELECT o_custkey AS doc_id, string_agg('// === src/f' || o_orderkey || '.ts ===' || chr(10) || o_orderpriority || chr(10), chr(10) ORDER BY 'src/f' || o_orderkey || '.ts') AS text FROM orders GROUP BY 1""")
def concatenated_files(spark, sf_dir):
    files = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.expr("concat('src/f', o_orderkey, '.ts')").alias("path"), F.col("o_orderpriority").alias("content"))
    return render.concatenated(files)


@query("WITH f AS (SELECT doc_id, lang, n_chars // 100 AS size FROM documents WHERE n_chars > 200) SELECT lang, max(size) AS largest, count(*) AS n FROM (SELECT DISTINCT lang, size FROM f) GROUP BY 1 HAVING max(size) > 5")
def step_array(spark, sf_dir):
    steps = [{"filter": "n_chars > 200"}, {"map": {"size": "n_chars div 100"}}, {"unique": ["lang", "size"]}]
    distinct = Flow(_docs(spark, sf_dir)).run(steps).build()
    return Flow(distinct.groupBy("lang").agg(F.max("size").alias("largest"), F.count(F.lit(1)).alias("n"))).run([{"filter": "largest > 5"}]).build()


@query(ORACLE_SQL["semantic_select"].replace("floor(sum(tokens) * 0.5)::BIGINT", "60::BIGINT"))
def budget_fill(spark, sf_dir):
    return scoring.select_budget(scoring.segment_scores(T.lines(_docs(spark, sf_dir))), most=60)


@query(f"""WITH {_HEADS}, c AS (SELECT doc_id, {_TYPED} AS content_type FROM h) SELECT doc_id, content_type, CASE WHEN content_type IN ('logs', 'stacktrace', 'config') THEN content_type ELSE 'generic' END AS condenser,
CASE content_type WHEN 'logs' THEN '70-90%' WHEN 'stacktrace' THEN '50-80%' WHEN 'config' THEN '30-60%' ELSE '20-50%' END AS saving FROM c""")
def content_analysis(spark, sf_dir):
    typed = lines.content_type(_headed(spark, sf_dir).withColumnRenamed("t", "text"))
    return typed.select("doc_id", "content_type", *detect.analysis(F.col("content_type")))


_TREE = "concat(CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('a', p_partkey % 7, '/b', p_partkey % 5, '/') ELSE 'c/d/e/f/g/h/i/' END, 'f', p_partkey, '.ts')"


@query(f"""WITH f AS (SELECT p_size AS size, string_split({_TREE}, '/')[:-2] AS parts FROM part), e AS (SELECT size, parts, unnest(range(0, least(len(parts), 5) + 1)) AS level FROM f)
SELECT array_to_string(parts[1:level], '/') AS folder, level::INT AS level, count(*) AS files, sum(size)::BIGINT AS size FROM e GROUP BY 1, 2""")
def folder_tree(spark, sf_dir):
    return files.tree(T.table(spark, sf_dir, "part").select(F.expr(_TREE).alias("path"), F.col("p_size").alias("size")))


@query(f"WITH f AS (SELECT {_TREE} AS path FROM part) SELECT path FROM f WHERE regexp_matches(path, 'f\\d*1\\.ts$') ORDER BY path LIMIT 500")
def file_search(spark, sf_dir):
    return files.search(T.table(spark, sf_dir, "part").select(F.expr(_TREE).alias("path")), r"f\d*1\.ts\z")
