"""User hooks: named column builders, transforms, filters and mapped functions that keep order and report failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Registry:
    """Named builders; ``build`` looks a name up, ``listing`` is sorted by name."""

    def __init__(self):
        self._made: dict[str, Callable[..., Column]] = {}

    def register(self, name: str | None = None):
        def wrap(fn):
            key = name or fn.__name__
            if key in self._made:
                raise KeyError(f"{key} is registered")
            self._made[key] = fn
            return fn

        return wrap

    def build(self, name: str, *args, **kwargs) -> Column:
        return self._made[name](*args, **kwargs)

    def listing(self) -> list[str]:
        return sorted(self._made)


def transform(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Transforms in turn."""
    for s in steps:
        df = df.transform(s)
    return df


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function over Arrow batches; rows carry their own order column, partitions run in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)


def map_with_retries(df: DataFrame, fn: Callable, column: str, out_type: str, tries: int = 5) -> DataFrame:
    """``fn`` on each value, tried up to ``tries`` times; status is ``done`` or ``failed``, never a lost row."""
    kind = T._parse_datatype_string(out_type)
    schema = T.StructType([*df.schema.fields, T.StructField("result", kind), T.StructField("status", T.StringType()), T.StructField("tries", T.IntegerType())])

    def one(x):
        for k in range(1, tries + 1):
            try:
                return fn(x), "done", k
            except Exception:
                if k == tries:
                    return None, "failed", k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(x) for x in b[column]]
            yield b.assign(result=[g[0] for g in got], status=[g[1] for g in got], tries=[g[2] for g in got])

    return df.mapInPandas(run, schema)


def scored(df: DataFrame, prompt: str, score: Callable[[list[str], list[int]], list[str]], length: Column, max_tokens: int) -> DataFrame:
    """A pluggable batch completion: each row's budget is what its prompt leaves of ``max_tokens``."""
    schema = T.StructType([*df.schema.fields, T.StructField("budget", T.LongType()), T.StructField("completion", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(completion=score(b[prompt].tolist(), b["budget"].tolist()))

    return df.withColumn("budget", F.greatest(F.lit(max_tokens) - length, F.lit(0)).cast("long")).mapInPandas(run, schema)


def unwrap_completion(response: Column) -> Column:
    """Text and token total of a completion's JSON."""
    return F.struct(
        F.get_json_object(response, "$.choices[0].text").alias("text"),
        F.get_json_object(response, "$.usage.total_tokens").cast("long").alias("tokens"),
    )


def register_sql(spark: SparkSession, registry: dict[str, Callable], types: dict[str, str]) -> None:
    """Python functions by name for SQL, as Arrow batch functions."""
    for name, fn in registry.items():
        spark.udf.register(name, F.pandas_udf(fn, types[name]))
