"""A fluent, immutable dataflow builder over DataFrames: every step is lazy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from fnmatch import translate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


@dataclass(frozen=True)
class Flow:
    """Steps over a frame. ``build`` gives the frame; ``steps`` the names of the steps so far."""

    df: DataFrame
    steps: tuple[str, ...] = field(default=())

    @classmethod
    def from_data(cls, spark: SparkSession, rows: list, schema: str) -> Flow:
        return cls(spark.createDataFrame(rows, schema), ("from_data",))

    @classmethod
    def from_files(cls, spark: SparkSession, folder: str, pattern: str = "*") -> Flow:
        """One row a file: path, content. Hidden folders and node_modules are left out."""
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern.rsplit("/", 1)[-1]).text(folder, wholetext=True)
        rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
        return cls(rows.where(~F.col("path").rlike(r"/(\.[^/]+|node_modules)/")), ("from_files",))

    def _then(self, name: str, df: DataFrame) -> Flow:
        return replace(self, df=df, steps=(*self.steps, name))

    def filter(self, condition: Column | str) -> Flow:
        return self._then("filter", self.df.where(condition))

    def exclude(self, column: str, glob: str) -> Flow:
        """Drops rows whose column has a match of the glob anywhere."""
        return self._then("exclude", self.df.where(~F.col(column).rlike(translate(glob).removeprefix("(?s:").split(r")\Z")[0].split(r")\z")[0])))

    def map(self, **columns: Column) -> Flow:
        return self._then("map", self.df.withColumns(columns))

    def flat_map(self, array: Column, name: str) -> Flow:
        return self._then("flat_map", self.df.withColumn(name, F.explode(array)))

    def sort(self, *keys: str | Column) -> Flow:
        return self._then("sort", self.df.orderBy(*keys))

    def take(self, n: int) -> Flow:
        return self._then("take", self.df.limit(n))

    def skip(self, n: int) -> Flow:
        return self._then("skip", self.df.offset(n))

    def unique(self, *keys: str, order: str | Column | None = None) -> Flow:
        """First row of each key by ``order``; without an order any row of it."""
        if order is None:
            return self._then("unique", self.df.dropDuplicates(list(keys) or None))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        return self._then("unique", self.df.withColumn("_k", rank).where("_k = 1").drop("_k"))

    def reduce(self, **aggregates: Column) -> Flow:
        return self._then("reduce", self.df.agg(*[c.alias(n) for n, c in aggregates.items()]))

    def tap(self, name: str, *observed: Column) -> Flow:
        return self._then("tap", self.df.observe(name, *observed))

    def apply(self, f: Callable[[DataFrame], DataFrame], name: str = "apply") -> Flow:
        return self._then(name, f(self.df))

    def run(self, steps: list[dict]) -> Flow:
        """Steps given as data, each a dict of one step: filter, map, reduce, limit, skip, sort (a key, or key and direction) or unique (keys)."""
        flow = self
        for step in steps:
            if len(step) != 1:
                raise ValueError(f"a step has one name: {sorted(step)}")
            name, value = next(iter(step.items()))
            match name:
                case "filter":
                    flow = flow.filter(value)
                case "map" | "reduce":
                    flow = getattr(flow, name)(**{n: F.expr(c) for n, c in value.items()})
                case "limit":
                    flow = flow.take(value)
                case "skip":
                    flow = flow.skip(value)
                case "sort":
                    key, direction = (value, "asc") if isinstance(value, str) else value
                    flow = flow.sort(F.desc(key) if direction == "desc" else F.asc(key))
                case "unique":
                    flow = flow.unique(*([value] if isinstance(value, str) else value))
                case _:
                    raise ValueError(f"unknown step: {name}")
        return flow

    def recover(self, other: Callable[[Exception], DataFrame], check: Callable[[DataFrame], object] = DataFrame.count) -> Flow:
        """This flow if ``check`` (an action) runs over it, else the frame that ``other`` makes of the error."""
        try:
            check(self.df)
        except Exception as error:  # whatever the steps before raised
            return self._then("recover", other(error))
        return self._then("recover", self.df)

    def build(self) -> DataFrame:
        return self.df
