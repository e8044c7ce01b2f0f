"""Clustering of experts, apportionment, agreement and plans. Groups are a layer's experts: dozens of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .expect import finite, guarded

def largest_remainder(scores: DataFrame, budget: int, by: list[str], key: str, score: str) -> DataFrame:
    """Adds `seats`: shares of the budget rounded down, and one more for the largest remainders, ties by key. A budget below 1,
    and scores that are negative, not finite or all zero, are errors."""
    if budget < 1:
        raise ValueError("the budget must be 1 or more")
    w = Window.partitionBy(*by)
    fair = finite(F.col(score).cast("double")) & (F.col(score) >= 0) & (F.sum(score).over(w) > 0)
    d = guarded(scores.withColumn("__fair", fair), F.col("__fair"), "scores must be finite, not negative and not all zero").drop("__fair")
    d = d.withColumn("__q", F.col(score) * F.lit(float(budget)) / F.sum(score).over(w)).withColumn("__f", F.floor("__q"))
    left = F.lit(budget) - F.sum("__f").over(w)
    rank = F.row_number().over(w.orderBy((F.col("__q") - F.col("__f")).desc(), F.col(key)))
    return d.withColumn("__r", rank).withColumn("seats", (F.col("__f") + F.when(F.col("__r") <= left, 1).otherwise(0)).cast("long")).drop("__q", "__f", "__r")


def greedy_copies(scores: DataFrame, budget: int, by: list[str], key: str, score: str, cap: int = 3) -> DataFrame:
    """The first `budget` parents of the list that repeats each expert `cap` times, by falling score, ties by key."""
    d = scores.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(cap))))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(key), F.col("copy")))
    return d.withColumn("place", place).where(F.col("place") <= budget).select(*by, "place", F.col(key).alias("parent"))


def cycled_parents(scores: DataFrame, budget: int, by: list[str], key: str, order: list) -> DataFrame:
    """`budget` parents per group: all experts in the given order, again from the start as often as needed."""
    w = Window.partitionBy(*by)
    d = scores.withColumn("__r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    d = d.withColumn("place", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(budget)), lambda i: i * F.col("__n") + F.col("__r")), lambda p: p < budget)))
    return d.select(*by, (F.col("place") + 1).cast("int").alias("place"), F.col(key).alias("parent"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings of the same rows; fewer than two rows or a degenerate case give 1."""
    two = lambda n: n * (n - 1) / 2
    cell = pairs.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    rows, cols = cell.groupBy(a).agg(F.sum("n").alias("n")), cell.groupBy(b).agg(F.sum("n").alias("n"))
    s = lambda d, name: d.agg(F.coalesce(F.sum(two(F.col("n"))), F.lit(0.0)).alias(name), F.coalesce(F.sum("n"), F.lit(0.0)).alias(f"{name}_n"))
    d = s(cell, "ij").join(F.broadcast(s(rows, "i"))).join(F.broadcast(s(cols, "j")))  # one row each
    expected = F.col("i") * F.col("j") / F.nullif(two(F.col("ij_n")), F.lit(0.0))
    top = (F.col("i") + F.col("j")) / 2 - expected
    return d.select(F.when((F.col("ij_n") < 2) | (F.abs(top) < 1e-12), 1.0).otherwise((F.col("ij") - expected) / top).alias("adjusted_rand"))


def canonical_labels(rows: DataFrame, by: list[str], key: str, label: str) -> DataFrame:
    """Adds `canonical`: labels numbered from 0 by their first occurrence in the order of key."""
    first = rows.groupBy(*by, label).agg(F.min(key).alias("__first"))
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy("__first")) - 1
    return rows.join(first.withColumn("canonical", rank.cast("int")).drop("__first"), [*by, label])


def nearest_parent_coverage(points: DataFrame, parents: DataFrame, key: str, vector: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """by, coverage: traffic-weighted mean of the squared distance to the nearest chosen parent of the same group; ratio:
    that over the mean squared distance of all pairs of the group, null if that is at most 1e-20 or there is no pair.
    parents: a bounded list of keys. The pairs' mean is 2 n / (n - 1) times the sum of the dimensions' variances."""
    by = by or []
    own = points.join(parents.select(*by, key).distinct(), [*by, key], "left_semi")
    chosen = own.groupBy(*by).agg(F.collect_list(F.struct(F.col(vector).alias("v"))).alias("__p"))
    dist = lambda p: F.aggregate(F.zip_with(F.col(vector), p["v"], lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda s, x: s + x)
    d = points.join(F.broadcast(chosen), by, "left") if by else points.join(F.broadcast(chosen))
    d = d.withColumn("__d", F.array_min(F.transform("__p", dist)))  # a layer's parents
    cover = d.groupBy(*by).agg((F.sum(F.col(weight) * F.col("__d")) / F.sum(weight)).alias("coverage"))
    per = points.select(*by, F.posexplode(vector).alias("dim", "x")).groupBy(*by, "dim").agg(F.count("*").alias("n"), F.var_pop(F.col("x").cast("double")).alias("var"))
    pairs = per.groupBy(*by).agg((2 * F.max("n") / F.nullif(F.max("n") - 1, F.lit(0)) * F.sum("var")).alias("__a"))
    both = cover.join(pairs, by, "left") if by else cover.join(pairs)  # one row each
    return both.select(*by, "coverage", F.when(F.col("__a") > 1e-20, F.col("coverage") / F.col("__a")).alias("ratio"))


def _distances(gram: np.ndarray) -> np.ndarray:
    d = np.diag(gram)[:, None] + np.diag(gram)[None] - 2 * gram
    np.fill_diagonal(d, 0.0)
    return np.maximum(d, 0.0)


def _assign(gram: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Squared distances of all points to the k cluster means, from the Gram matrix."""
    one = np.eye(k)[labels]
    size = one.sum(0)
    cross = gram @ one / size
    return np.maximum(np.diag(gram)[:, None] - 2 * cross + (one.T @ gram @ one)[range(k), range(k)] / size**2, 0.0)


def _repair(labels: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Gives each empty cluster the farthest point of a cluster that has others left."""
    labels = labels.copy()
    for c in range(k):
        size = np.bincount(labels, minlength=k)
        if not size[c]:
            far = np.where(size[labels] > 1, dist[np.arange(len(labels)), labels], -1.0)
            labels[int(far.argmax())] = c
    return labels


def gram_kmeans(gram: np.ndarray, k: int, seed: int, starts: int = 10, steps: int = 300) -> np.ndarray:
    """Lloyd's algorithm on a Gram matrix from squared-distance seeding; the best of several starts, canonical labels."""
    n, dist, rng = len(gram), _distances(gram), np.random.default_rng(seed)
    if len(np.unique(np.round(dist, 12), axis=0)) < k:
        raise ValueError("fewer distinct points than clusters")
    best, least = None, np.inf
    for _ in range(starts):
        chosen = [int(rng.integers(n))]
        while len(chosen) < k:
            near = dist[:, chosen].min(1)
            chosen.append(int(rng.choice(n, p=near / near.sum())))
        labels = _repair(dist[:, chosen].argmin(1), dist[:, chosen], k)
        for _ in range(steps):
            to = _assign(gram, labels, k)
            new = _repair(to.argmin(1), to, k)
            if (new == labels).all():
                break
            labels = new
        else:
            raise RuntimeError("the clusters did not converge")
        inertia = float(_assign(gram, labels, k)[np.arange(n), labels].sum())
        if inertia < least:
            best, least = labels, inertia
    first = {c: i for i, c in enumerate(dict.fromkeys(best.tolist()))}
    return np.array([first[c] for c in best.tolist()])


def farthest_first(gram: np.ndarray, members: list[int]) -> list[int]:
    """Members from the one nearest to their mean, each next one farthest from those before; ties to the lowest."""
    g = gram[np.ix_(members, members)]
    dist = _distances(g)
    order = [int((np.diag(g) - 2 * g.mean(1)).argmin())]
    while len(order) < len(members):
        near = dist[:, order].min(1)
        near[order] = -1
        order.append(int(near.argmax()))
    return [members[i] for i in order]


def group_plans(points: DataFrame, by: list[str], key: str, vector: str, traffic: str, clusters: int, budget: int, seed: int) -> DataFrame:
    """Clusters each group's experts, shares the budget among clusters by traffic and copies members in farthest-first
    order, cycled: by, cluster, members, new_experts, parents."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array(pdf[vector].tolist(), float)
        x = x - x.mean(0)
        gram = x @ x.T
        labels = gram_kmeans(gram, min(clusters, len(x)), seed)
        share = np.bincount(labels, pdf[traffic].to_numpy(float))
        exact = share * budget / share.sum()
        seats = np.floor(exact).astype(int)
        for c in np.argsort(-(exact - seats), kind="stable")[: budget - seats.sum()]:
            seats[c] += 1
        ids, out = pdf[key].to_numpy(), []
        for c in range(len(share)):
            order = farthest_first(gram, np.flatnonzero(labels == c).tolist())
            out.append([*(pdf[b].iloc[0] for b in by), c, [int(ids[i]) for i in order], int(seats[c]), [int(ids[order[j % len(order)]]) for j in range(seats[c])]])
        return pd.DataFrame(out, columns=[*by, "cluster", "members", "new_experts", "parents"])

    kinds = dict(points.dtypes)
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", cluster int, members array<long>, new_experts int, parents array<long>"
    return points.select(*by, key, vector, traffic).groupBy(*by).applyInPandas(one, schema)


def distance_table(points: DataFrame, by: list[str], key: str, vector: str, tile: int = 256) -> DataFrame:
    """by, a, b, distance: squared distances of all pairs a < b of a group, each once.

    Points are dealt to tiles of about `tile` by their key; a tile meets itself and those behind it, so a point is sent once for each tile of
    its group and no task holds more than two tiles at a time.
    """
    n = points.groupBy(*by).agg(F.ceil(F.count("*") / tile).cast("int").alias("__tiles")) if by else points.agg(F.ceil(F.count("*") / tile).cast("int").alias("__tiles"))
    p = points.select(*by, F.col(key).alias("__k"), F.col(vector).alias("__v"))
    p = (p.join(n, by) if by else p.join(F.broadcast(n))).withColumn("__t", F.pmod(F.xxhash64("__k"), F.col("__tiles")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1))
    left = p.select(*by, F.col("__k").alias("ka"), F.col("__v").alias("va"), F.col("__t").alias("ta"), others.alias("tb")).where("ta <= tb")
    right = p.select(*by, F.col("__k").alias("kb"), F.col("__v").alias("vb"), F.col("__t").alias("tb"), others.alias("ta")).where("ta <= tb")
    met = left.join(right, [*by, "ta", "tb"]).where((F.col("ta") < F.col("tb")) | (F.col("ka") < F.col("kb")))
    distance = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda t, x: t + x)
    return met.select(*by, F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), distance.alias("distance"))


def distance_ratio(table: DataFrame, labels: DataFrame, by: list[str], key: str, label: str) -> DataFrame:
    """by, within, overall, ratio: the mean distance of the pairs of one label over that of all pairs, from a distance_table() and
    any labels (by, key, label). Null without a pair of one label, or if the overall mean is at most 1e-20."""
    side = lambda k, name: labels.select(*by, F.col(key).alias(k), F.col(label).alias(name))
    own = [c for c in by if c in table.columns]
    d = table.join(side("a", "__la"), [*own, "a"]).join(side("b", "__lb"), [*by, "b"])
    g = d.groupBy(*by).agg(F.avg(F.when(F.col("__la") == F.col("__lb"), F.col("distance"))).alias("within"), F.avg("distance").alias("overall"))
    return g.withColumn("ratio", F.when(F.col("overall") > 1e-20, F.col("within") / F.col("overall")))


def permuted_labels(labels: DataFrame, by: list[str], key: str, label: str, repeats: int, seed: int) -> DataFrame:
    """by, rep, key, label: for each repetition the labels of a group, dealt anew: the i-th key gets the label of the key with
    the i-th smallest digest of (seed, repetition, key)."""
    d = labels.select(*by, F.col(key).alias("__k"), F.col(label).alias("__l")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("__k").cast("string")), 256)
    group = Window.partitionBy(*by, "rep")
    d = d.withColumn("__i", F.row_number().over(group.orderBy("__k"))).withColumn("__j", F.row_number().over(group.orderBy(draw, "__k")))
    return d.select(*by, "rep", F.col("__i").alias("__p"), F.col("__k").alias(key)).join(d.select(*by, "rep", F.col("__j").alias("__p"), F.col("__l").alias(label)), [*by, "rep", "__p"]).drop("__p")


def permutation_null(points: DataFrame, by: list[str], key: str, label: str, vector: str, repeats: int, seed: int) -> DataFrame:
    """Within-to-overall distance ratio of each group, and its mean and 5 % and 95 % quantiles when labels are permuted; a
    permutation without a ratio does not count."""
    table = distance_table(points, by, key, vector)
    own = distance_ratio(table, points, by, key, label).select(*by, "ratio")
    drawn = distance_ratio(table, permuted_labels(points, by, key, label, repeats, seed), [*by, "rep"], key, label)
    null = drawn.groupBy(*by).agg(F.avg("ratio").alias("null_mean"), F.percentile("ratio", 0.05).alias("null_q05"), F.percentile("ratio", 0.95).alias("null_q95"))
    return own.join(null, by, "left")
