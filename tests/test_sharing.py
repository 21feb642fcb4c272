from pyspark.sql import functions as F

from gistmill.operators import sharing


def test_shared_lines_keep_their_owner(spark):
    lines = spark.createDataFrame([(1, 0, "a "), (1, 1, "a"), (2, 0, " a"), (2, 1, "b"), (3, 0, ""), (4, 0, "")], "doc_id long, line_no int, line string")
    assert [tuple(r) for r in sharing.shared_lines(lines).collect()] == [("a", 2, 1)]
    assert {tuple(r) for r in sharing.unshared_size(lines).collect()} == {(1, 2, 2), (2, 2, 1), (3, 1, 1), (4, 1, 1)}
    assert sharing.unshared_size(lines.limit(0)).count() == 0


def test_balanced_and_dominant_levels(spark):
    rows = [(i, level, f"m{i}", i % 2) for i, level in enumerate(["error", "info", "error", "info", "error", "debug"])]
    parsed = spark.createDataFrame(rows, "event_id long, level string, message string, k long")
    got = sharing.balanced(parsed, "event_id", {"error": 2, "info": 1}).select("level", "event_id").orderBy("event_id")
    assert [tuple(r) for r in got.collect()] == [("error", 0), ("info", 1), ("error", 2)]
    found = dict(sharing.dominant_level(parsed, "k").select("k", "dominant").collect())
    assert found == {0: "error", 1: "info"}
    assert sharing.dominant_level(parsed.where(F.lit(False)), "k").count() == 0
