from pyspark.sql import functions as F

from gistmill.functions import patterns as P
from gistmill.functions import text as X
from gistmill.operators import build, conversation, lines, logs, scoring
from gistmill.plans.flow import Flow


def one(df):
    return [tuple(r) for r in df.collect()]


def test_word_bounds_are_ascii(spark):
    df = spark.createDataFrame([("cafeé error",), ("errors",), ("ERROR",)], "line string")
    assert [r[0] for r in one(df.select(X.level(F.col("line"))))] == ["error", "info", "error"]


def test_log_group_takes_flags_of_first_member(spark):
    rows = [(1, "2024-01-01 10:00:00 [ERROR] disk 1 full"), (2, "2024-01-01 10:00:01 [ERROR] disk 2 full"), (3, "2024-01-01 10:00:02 [INFO] ok")]
    found = logs.group(logs.parse(spark.createDataFrame(rows, "id long, line string")), "id").collect()
    assert [(r["pattern"], r["n"], r["level"], r["first_line"]) for r in found] == [("disk N full", 2, "error", 1), ("ok", 1, "info", 3)]


def test_budget_skips_what_does_not_fit(spark):
    scored = spark.createDataFrame([(1, 0, 3, 0.9), (1, 1, 4, 0.8), (1, 2, 2, 0.7)], "doc_id long, line_no int, tokens long, score double")
    r = scoring.select_budget(scored, 5 / 9).first()
    assert (r["budget"], r["used"], r["picked"]) == (5, 5, "0,2")


def test_runs_and_carry(spark):
    rows = [(1, i, t) for i, t in enumerate(["a 1", "a 2", "b", "a 3"])]
    df = spark.createDataFrame(rows, "doc_id long, line_no int, line string")
    assert one(lines.runs(df, 2).select("start", "n", "norm")) == [(0, 2, "a N")]
    assert [r["header"] for r in build.carry_forward(df, "^a").orderBy("line_no").collect()] == ["a 1", "a 2", "a 2", "a 3"]


def test_constraints_first_occurrence(spark):
    df = spark.createDataFrame([(1, 0, "u", "You must never do it\nok"), (1, 1, "u", "You must never do it")], "conv_id long, turn long, role string, text string")
    assert one(conversation.constraints(df)) == [(1, 1, "You must never do it", 0)]


def test_error_signature_chain(spark):
    df = spark.createDataFrame([("at /a/b.ts:3:4 line 9 'x' 123456",)], "m string")
    assert df.select(X.replace_all(F.col("m"), P.ERROR_SIGNATURE)).first()[0] == "at <FILE>:<LINE> line <LINE> '<VALUE>' <ID>"


def test_flow_is_immutable(spark):
    flow = Flow.from_data(spark, [(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    longer = flow.unique("k", order="v").filter("k > 1").map(w=F.upper("v"))
    assert flow.steps == ("from_data",) and longer.steps == ("from_data", "unique", "filter", "map")
    assert one(longer.build()) == [(2, "b", "B")]
    assert one(flow.exclude("v", "a*").sort("v").skip(1).take(1).build()) == [(2, "c")]


def test_whole_graph_queries(spark):
    from gistmill import queries as Q

    sf = "/root/testdata/sf0.001"
    deps = Q.QUERIES["recursive_deps"](spark, sf)
    assert {r["depth"] for r in deps.select("depth").distinct().collect()} == {1, 2, 3, 4, 5}
    assert deps.select("src").distinct().count() == spark.read.parquet(f"{sf}/part.parquet").count()
    assert all(r["cycle"] == (r["src"] == r["dst"]) for r in deps.collect())
    dead = Q.QUERIES["dead_exports"](spark, sf).count()
    assert 0 < dead < spark.read.parquet(f"{sf}/part.parquet").count()
