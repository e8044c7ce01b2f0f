"""Experiment results: completeness, summaries, curves, paired differences, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expect import finite, guarded


def matrix(models: DataFrame, methods: DataFrame, seeds: DataFrame) -> DataFrame:
    """All runs that an experiment expects; three short lists."""
    return models.join(methods).join(seeds)


def completeness(expected: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """expected, with `finished`."""
    return expected.join(finished.select(*keys).distinct().withColumn("__f", F.lit(True)), keys, "left").withColumn("finished", F.coalesce("__f", F.lit(False))).drop("__f")


def excluded(runs: DataFrame, expected: DataFrame, keys: list[str], complete: Column) -> DataFrame:
    """Why a run does not count: `incomplete` first, then `not in the matrix`; null if it counts."""
    d = runs.join(expected.select(*keys).distinct().withColumn("__e", F.lit(True)), keys, "left")
    return d.withColumn("reason", F.when(~F.coalesce(complete, F.lit(False)), "incomplete").when(F.col("__e").isNull(), "not in the matrix")).drop("__e")


def mean_sd(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean and sample deviation of finite values; one value has no deviation, none has neither."""
    x = F.when(finite(F.col(value).cast("double")), F.col(value).cast("double"))
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))


def summary(expected: DataFrame, runs: DataFrame, keys: list[str], by: list[str], value: str) -> DataFrame:
    """A row for each `by` of the matrix, even without a run."""
    d = expected.join(runs.select(*keys, value), keys, "left")
    out = mean_sd(d, by, value)
    return out.join(expected.groupBy(*by).agg(F.count("*").alias("expected")), by)


def all_or_nothing(rows: DataFrame, by: list[str], value: str, expected: int) -> DataFrame:
    """100 times the mean, but only if all tasks were measured."""
    x = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.count(x).alias("measured"), F.when(F.count(x) == expected, 100 * F.avg(x)).alias("average"))


def excess_auc(curve: DataFrame, by: list[str], x: str, y: str, reference: float) -> DataFrame:
    """Trapezoids under the positive excess of y over the reference; null for a single point."""
    w = Window.partitionBy(*by).orderBy(x)
    e = F.greatest(F.lit(0.0), F.col(y) - reference)
    d = curve.withColumn("__e", e).withColumn("__pe", F.lag("__e").over(w)).withColumn("__px", F.lag(x).over(w))
    return d.groupBy(*by).agg(F.sum((F.col(x) - F.col("__px")) * (F.col("__e") + F.col("__pe")) / 2).alias("auc"))


def first_crossing(curve: DataFrame, by: list[str], x: str, y: str, reference: float) -> DataFrame:
    """The first x, in order, at which y is at most the reference; censored if there is none."""
    d = curve.groupBy(*by).agg(F.min(F.when(F.col(y) <= reference, F.col(x))).alias("first"))
    return d.withColumn("right_censored", F.col("first").isNull())


def step_band(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return points.groupBy(*by).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.stddev_samp(y).alias("sd"))


def paired_delta(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Differences on the rows that both sides must have; a row of one side only is an error."""
    d = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys, "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return d.select(*keys, F.when(both, F.col("__a") - F.col("__b")).otherwise(F.raise_error(F.lit("the sides have different rows")).cast("double")).alias("delta"))


def block_groups(rows: DataFrame, by: list[str], block: str, value: str, size: int = 32) -> DataFrame:
    """Means of contiguous groups of blocks; a run whose number of blocks the size does not divide is an error."""
    whole = F.count("*").over(Window.partitionBy(*by)) % size == 0
    rows = guarded(rows.withColumn("__whole", whole), F.col("__whole"), f"the number of blocks is no multiple of {size}")
    return rows.groupBy(*by, F.floor(F.col(block) / size).alias("block_group")).agg(F.count("*").alias("blocks"), F.avg(value).alias("mean"))


def bootstrap(groups: DataFrame, seed_col: str, group_col: str, value: str, repeats: int = 2000, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """by, mean, low, high: hierarchical percentile intervals; each repetition resamples seeds and block groups and averages the
    cells of both draws.

    A draw is a digest of (seed, repetition, position) modulo the number of seeds or groups, the same for each `by`, so that a
    result can be repeated anywhere. A repetition joins the grid with the multiplicities of its draws.
    """
    by = by or []

    def multiplicities(col: str, salt: str) -> DataFrame:
        ids = groups.select(*by, col).distinct()
        all_ = Window.partitionBy(*by)
        ids = ids.withColumn("__k", F.row_number().over(all_.orderBy(col)) - 1).withColumn("__n", F.count("*").over(all_))
        d = ids.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col("rep").cast("string"), F.col("__k").cast("string")), 256)
        drawn = d.select(*by, "rep", (F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long") % F.col("__n")).cast("int").alias("__k"))
        return drawn.groupBy(*by, "rep", "__k").agg(F.count("*").alias(f"__m_{salt}")).join(ids.drop("__n"), [*by, "__k"]).drop("__k")

    cells = multiplicities(seed_col, "s").join(multiplicities(group_col, "g"), [*by, "rep"]).join(groups.select(*by, seed_col, group_col, value), [*by, seed_col, group_col])
    weight = F.col("__m_s") * F.col("__m_g")
    means = cells.groupBy(*by, "rep").agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("mean"))
    bands = means.groupBy(*by).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    own = groups.groupBy(*by).agg(F.avg(value).alias("mean"))
    return own.join(bands, by) if by else own.join(bands)  # one row each


def quantile_band(rows: DataFrame, by: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Linearly interpolated quantiles."""
    return rows.groupBy(*by).agg(F.percentile(value, low).alias("low"), F.percentile(value, 0.5).alias("median"), F.percentile(value, high).alias("high"))


def stage(complete: Column, evaluated: Column, step: Column, total: Column, warm: Column, started: Column) -> Column:
    """The stage of a run, by the first rule that fits."""
    return F.when(complete, "complete").when(evaluated, "tasks").when(step >= total, "final evaluation").when(step > 0, "training").when(warm, "warm-start").when(started, "initialization").otherwise("pending")


def latest(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(*by).agg(F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("m")).select(*by, *(F.col(f"m.{c}").alias(c) for c in dict.fromkeys([*order, *columns])))


def manifest_diff(expected: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """missing, unexpected or changed entries."""
    d = expected.select(key, F.col(digest).alias("__e")).join(found.select(key, F.col(digest).alias("__f")), key, "full_outer")
    kind = F.when(F.col("__f").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("__e") != F.col("__f"), "changed")
    return d.select(key, kind.alias("difference")).where("difference is not null")


def normalized_error(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Mean squared error over the mean square of the actual vectors."""
    d = rows.select(F.explode(F.arrays_zip(F.col(predicted).alias("p"), F.col(actual).alias("a"))).alias("z"))
    return d.agg((F.avg((F.col("z.p") - F.col("z.a")) ** 2) / F.greatest(F.avg(F.col("z.a") ** 2), F.lit(1e-12))).alias("nmse"))


def largest(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The maximum of finite values; null where there is none."""
    return rows.groupBy(*by).agg(F.max(F.when(finite(F.col(value).cast("double")), F.col(value))).alias("largest"))


def run_name(model: Column, method: Column, seed: Column) -> Column:
    return F.concat(model, F.lit("_"), method, F.lit("_seed"), seed.cast("string"))


def run_status(jobs: DataFrame, complete: DataFrame, latest_: DataFrame, logged: DataFrame, marks: DataFrame, steps: int, tasks: int) -> DataFrame:
    """Where each expected run (model, method, seed) stands, from what it has left behind.

    complete: run, complete, final_step, tasks_done, test_ppl; latest_: run, checkpoint_step; logged: run, step; marks: run,
    evaluated, warm, started, tasks_done, test_ppl. Absent rows are null. `original` runs have no steps.
    """
    d = jobs.withColumn("run", run_name(F.col("model"), F.col("method"), F.col("seed")))
    report = complete.select("run", "complete", "final_step", F.col("tasks_done").alias("__t"), F.col("test_ppl").alias("__p"))
    d = d.join(report, "run", "left").join(latest_.select("run", "checkpoint_step"), "run", "left").join(logged.select("run", F.col("step").alias("__s")), "run", "left").join(marks, "run", "left")
    step = F.coalesce("final_step", F.greatest(F.coalesce("__s", F.lit(0)), F.coalesce("checkpoint_step", F.lit(0))))
    total = F.when(F.col("method") == "original", 0).otherwise(steps)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    d = d.withColumns({"step": step.cast("long"), "total_steps": total.cast("long")})
    at = F.when(yes("complete"), "complete").when(yes("evaluated"), "tasks/finalization").when((F.col("step") >= F.col("total_steps")) & (F.col("method") != "original"), "final evaluation")
    at = at.when(F.col("step") > 0, "training").when(yes("warm"), "warm-start").when(yes("started"), "initialization/evaluation").otherwise("pending")
    done = F.coalesce(F.col("__t"), F.col("tasks_done"), F.lit(0)).cast("long")
    return d.select("run", "step", "total_steps", "checkpoint_step", done.alias("tasks_done"), F.lit(tasks).cast("long").alias("tasks_total"), F.coalesce("__p", "test_ppl").alias("test_ppl"), at.alias("stage"))


def completed(status: DataFrame) -> DataFrame:
    return status.agg(F.count_if(F.col("stage") == "complete").alias("completed"), F.count("*").alias("runs"))


def recovery(curve: DataFrame, references: DataFrame, budgets: DataFrame, by: list[str]) -> DataFrame:
    """Each run's curve against its own reference: first crossing in tokens, censoring, how far it was seen, and the area of
    positive excess.

    curve: by, step, nll, indices; references: by, reference, indices; budgets: by, final_step, input_tokens. Curves with
    other indices than their reference, and budgets that are no positive whole number of tokens per step, are errors.
    """
    per = F.col("input_tokens") / F.col("final_step")
    runs = guarded(budgets.select(*by, per.alias("per")), (F.col("per") > 0) & (F.col("per") == F.floor("per")), "a budget is no whole number of tokens a step")
    d = runs.join(references.select(*by, "reference", F.col("indices").alias("__i")), by).join(curve, by, "left")
    d = guarded(d, F.col("indices").isNull() | (F.col("indices") == F.col("__i")), "a curve has other validation indices than its reference")
    d = d.withColumn("tokens", (F.col("step") * F.col("per")).cast("long"))
    w = Window.partitionBy(*by).orderBy("step")
    d = d.withColumn("__e", F.greatest(F.lit(0.0), F.col("nll") - F.col("reference")))
    d = d.withColumns({"__pe": F.lag("__e").over(w), "__pt": F.lag("tokens").over(w)})
    first = F.min(F.when(F.col("nll") <= F.col("reference"), F.col("tokens")))
    return d.groupBy(*by).agg(
        F.first("reference").alias("reference"),
        first.alias("first_tokens"),
        F.when(F.count("step") > 0, first.isNull()).alias("right_censored"),
        F.coalesce(F.max("tokens"), F.lit(0)).alias("observed_tokens"),
        F.sum((F.col("tokens") - F.col("__pt")) * (F.col("__e") + F.col("__pe")) / 2).alias("excess_auc"),
    )


def contrasts(blocks: DataFrame, method: str, first: str, keys: list[str], value: str) -> DataFrame:
    """keys, delta, contrast: the differences of one method to every other one on the same rows, by one join. A row of one side
    only is an error."""
    others = blocks.where(F.col(method) != first)
    ours = blocks.where(F.col(method) == first).select(*keys, F.col(value).alias("__a")).join(others.select(method).distinct())  # a few methods
    d = ours.join(others.select(*keys, method, F.col(value).alias("__b")), [*keys, method], "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    delta = F.when(both, F.col("__a") - F.col("__b")).otherwise(F.raise_error(F.lit("the sides have different rows")).cast("double"))
    return d.select(*keys, delta.alias("delta"), F.concat(F.lit(f"{first} - "), F.col(method)).alias("contrast"))


def contrast_summary(deltas: DataFrame, seed: str) -> DataFrame:
    d = deltas.groupBy("contrast").agg(F.count_distinct(seed).alias("paired_seeds"), F.avg("delta").alias("mean"))
    return d.withColumn("ratio", F.exp("mean"))
