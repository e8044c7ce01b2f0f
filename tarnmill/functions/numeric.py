"""Numeric and array expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column) -> Column:
    each = lambda x: F.array_repeat(x, F.size(logits))  # evaluated once, not for each component
    e = F.zip_with(logits, each(F.array_max(logits).cast("double")), lambda x, top: F.exp(x.cast("double") - top))
    return F.zip_with(e, each(array_sum(e)), lambda x, total: x / total)


def top_k(values: Column, k: int) -> Column:
    """Indices (from 0) of the k largest values, ties to the smaller index."""
    ranked = F.array_sort(F.transform(values, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def lr_multiplier(step: Column, total: int, warmup: int, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine from 1 to the floor."""
    done = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step <= warmup, step / F.lit(float(max(1, warmup)))).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * F.least(done, F.lit(1.0)))))


def exploration(step: Column, total: int) -> Column:
    return F.greatest(F.lit(0.0), 1 - step / F.lit(float(total)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Negative log probability of the target index under unnormalised logits."""
    top = F.array_max(logits)
    return F.log(array_sum(F.transform(logits, lambda x: F.exp(x - top)))) + top - F.element_at(logits, target + 1)


def causal_loss(rows: DataFrame, block: str, position: str, logits: str, token: str) -> DataFrame:
    """block, targets, nll: the sum of the negative log probabilities that the logits at each position give the token at the
    next one. The first token is no target, and the last position's logits are not used."""
    following = F.lead(token).over(Window.partitionBy(block).orderBy(position))
    d = rows.withColumn("__next", following).where("__next is not null")
    return d.groupBy(block).agg(F.count("*").alias("targets"), F.sum(cross_entropy(F.col(logits), F.col("__next"))).alias("nll"))


def is_whole(x: Column) -> Column:
    """Whether a number is a positive integer, also one that is stored as a float."""
    return F.coalesce((x > 0) & (x == F.floor(x)), F.lit(False))
