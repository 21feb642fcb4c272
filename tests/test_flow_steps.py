import pytest
from pyspark.sql import functions as F

from gistmill.functions.guard import safe_patterns
from gistmill.plans.flow import Flow


def test_steps_as_data(spark):
    flow = Flow.from_data(spark, [(3, "a"), (1, "b"), (2, "a"), (9, "c")], "n int, s string")
    out = flow.run([{"filter": "n < 9"}, {"map": {"m": "n * 10"}}, {"sort": ["n", "desc"]}, {"limit": 2}])
    assert [tuple(r) for r in out.build().collect()] == [(3, "a", 30), (2, "a", 20)]
    assert out.steps == ("from_data", "filter", "map", "sort", "take")
    assert flow.run([{"unique": "s"}, {"reduce": {"n": "count(1)"}}]).build().first()[0] == 3
    with pytest.raises(ValueError):
        flow.run([{"jump": 1}])


def test_recover_replaces_a_failed_flow(spark):
    flow = Flow.from_data(spark, [("x",)], "s string").map(n=F.expr("raise_error('bad')"))
    other = spark.createDataFrame([("none",)], "s string")
    assert flow.recover(lambda e: other, check=lambda df: df.collect()).build().first()[0] == "none"
    good = Flow.from_data(spark, [("x",)], "s string")
    assert good.recover(lambda e: other).build().first()[0] == "x"


def test_unsafe_and_invalid_patterns_are_left_out():
    kept, warnings = safe_patterns(["a+b*", r"\d{2}(x|y)+", "(a+)+$", "[", "x" * 501])
    assert kept == ["a+b*", r"\d{2}(x|y)+"]
    assert [w.split(":")[0] for w in warnings] == ["Skipped unsafe regex pattern (ReDoS risk)", "Skipped invalid regex pattern", "Skipped unsafe regex pattern (ReDoS risk)"]
