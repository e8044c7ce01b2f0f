"""Vector statistics that merge: counts, means, population deviations; scaling and projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_moments(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """n, mu and population sigma for each key and dimension."""
    d = rows.select(*keys, F.posexplode(vector).alias("dim", "x"))
    x = F.col("x").cast("double")
    return d.groupBy(*keys, "dim").agg(F.count("*").alias("n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma"))


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    m = vector_moments(rows, [key], vector)
    return m.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "mu"))), lambda s: s["mu"]).alias("centroid"))


def pair_distance_ratio(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean squared distance of pairs within a key over that of all pairs, from sums alone: for n vectors the pairs'
    squared distances add up to n * sum |x|^2 - |sum x|^2. Null if a side has no pair or the overall mean vanishes."""
    d = rows.select(F.col(key).alias("k"), F.posexplode(vector).alias("dim", "x"))
    x = F.col("x").cast("double")
    by = d.groupBy("k", "dim").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    one = by.groupBy("k").agg(F.max("n").alias("n"), (F.max("n") * F.sum("q") - F.sum(F.col("s") ** 2)).alias("total"))
    within = one.agg(F.sum("total").alias("wt"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("wn"))
    whole = by.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).agg((F.max("n") * F.sum("q") - F.sum(F.col("s") ** 2)).alias("at"), (F.max("n") * (F.max("n") - 1) / 2).alias("an"))
    w, a = F.col("wt") / F.nullif(F.col("wn"), F.lit(0.0)), F.col("at") / F.nullif(F.col("an"), F.lit(0.0))
    return within.join(F.broadcast(whole)).select(w.alias("within"), a.alias("overall"), F.when(a > 1e-20, w / a).alias("ratio"))  # one row each


def scaled(rows: DataFrame, vector: str) -> DataFrame:
    """Adds `scaled`: vectors less the column means, over the root of the mean squared norm of the centred rows; zeros
    where that energy vanishes against the raw one."""
    d = rows.select(F.posexplode(vector).alias("dim", "x"))
    x = F.col("x").cast("double")
    per = d.groupBy("dim").agg(F.avg(x).alias("mu"), F.avg(x * x).alias("raw"), F.var_pop(x).alias("var"))
    one = per.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mu"))), lambda s: s["mu"]).alias("__mu"), F.sum("var").alias("__e"), F.sum("raw").alias("__r"))
    flat = F.col("__e") <= F.greatest(F.lit(1e-20), 1e-12 * F.col("__r"))
    out = rows.join(F.broadcast(one)).withColumn("scaled", F.zip_with(F.col(vector).cast("array<double>"), "__mu", lambda a, m: F.when(flat, F.lit(0.0)).otherwise((a - m) / F.sqrt("__e"))))  # one row
    return out.drop("__mu", "__e", "__r")


def project(rows: DataFrame, vector: str, matrix: DataFrame) -> DataFrame:
    """Adds `projected`: the vector times a matrix given as rows (row, weights); the matrix has a fixed size."""
    m = matrix.agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "weights"))), lambda s: s["weights"]).alias("__m"))
    dim = F.size(F.get("__m", F.lit(0)))
    cell = lambda j: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), "__m", lambda x, w: x * F.get(w, j)), F.lit(0.0), lambda s, x: s + x)
    return rows.join(F.broadcast(m)).withColumn("projected", F.transform(F.sequence(F.lit(0), dim - 1), cell)).drop("__m")
