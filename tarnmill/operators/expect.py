"""Expectations: one pass over the data, an error that names what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpectationError(ValueError):
    """Some rows break a rule."""


def expect(df: DataFrame, **rules: Column) -> DataFrame:
    """Returns df if every rule holds for every row (null counts as broken)."""
    broken = df.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items())).first().asDict()
    if bad := {k: v for k, v in broken.items() if v}:
        raise ExpectationError(", ".join(f"{k}: {v} rows" for k, v in sorted(bad.items())))
    return df


def guarded(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """Like expect(), but lazily: the query fails when it meets such a row."""
    return df.where(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def unique(df: DataFrame, *keys: str) -> DataFrame:
    if twice := df.groupBy(*keys).count().where("count > 1").limit(3).collect():
        raise ExpectationError(f"repeated keys {[tuple(r)[:-1] for r in twice]}")
    return df


def disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if a.join(b, key, "left_semi").limit(1).count():
        raise ExpectationError(f"both sides hold the same {key}")


def covers(part: DataFrame, key: str, count: int) -> DataFrame:
    """key must be a permutation of 0 ... count - 1."""
    unique(part, key)
    return expect(part.agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")), complete=(F.col("n") == count) & ((F.col("lo") == 0) & (F.col("hi") == count - 1) | F.lit(count == 0)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
