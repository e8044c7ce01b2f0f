"""Expert tables: probe coordinates, dispatch, gradient energies, stability of clusterings, plans and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expect import expect, finite, guarded, unique
from .grouping import greedy_copies, largest_remainder
from .moments import vector_moments
from .pack import sample


def block_of(position: Column, length: int) -> Column:
    return F.floor(position / F.lit(length)).cast("long")


def offset_in_block(position: Column, length: int) -> Column:
    return F.pmod(position, F.lit(length)).cast("long")


def in_windows(probes: DataFrame, windows: DataFrame, position: str, start: str, length: int) -> DataFrame:
    """Probes within windows of one length, with `local`, their place there.

    A window covers at most two cells of its length, so the range join is an equi-join on cells and a filter.
    """
    cells = F.sequence(block_of(F.col(start), length), block_of(F.col(start) + (length - 1), length))
    w = windows.withColumn("__cell", F.explode(cells))
    d = probes.withColumn("__cell", block_of(F.col(position), length)).join(w, "__cell").drop("__cell")
    local = F.col(position) - F.col(start)
    return d.where((local >= 0) & (local < length)).withColumn("local", local.cast("long"))


def conditional_probability(assigned: DataFrame, by: list[str], probability: str) -> DataFrame:
    """How often each expert was called and its mean probability when it was."""
    return assigned.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(probability).alias("mass"), F.avg(probability).alias("a"))


def routing_totals(assigned: DataFrame, tokens: DataFrame, by: list[str], top: int, shared: DataFrame | None = None) -> DataFrame:
    """Calls against tokens times top; groups without a call count too. shared: the calls of shared experts, a row each (by), of
    the groups that have one, which must be one for each token; they are counted apart."""
    got = assigned.groupBy(*by).agg(F.count("*").alias("calls"))
    want = tokens.groupBy(*by).agg((F.count("*") * top).alias("expected"))
    out = want.join(got, by, "left").select(*by, F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), "expected").withColumn("exact", F.col("calls") == F.col("expected"))
    if shared is None:
        return out
    out = out.join(shared.groupBy(*by).agg(F.count("*").alias("shared_calls")), by, "left")
    return out.withColumn("exact", F.col("exact") & F.coalesce(F.col("shared_calls") == F.col("expected") / top, F.lit(True)))


def dispatch(chosen: DataFrame, outputs: DataFrame, token: str, expert: str, weight: str, output: str, renormalize: bool = False) -> DataFrame:
    """Weighted sums of the outputs of each token's experts; a token has as many rows as experts were chosen for it."""
    rows = chosen.join(outputs, [token, expert])
    one = F.struct(F.col(expert).alias("e"), F.col(weight).cast("double").alias("w"), F.col(output).cast("array<double>").alias("o"))
    d = rows.groupBy(token).agg(F.array_sort(F.collect_list(one)).alias("__r"))
    d = d.withColumn("__t", F.aggregate("__r", F.lit(0.0), lambda s, x: s + x["w"]) if renormalize else F.lit(1.0))
    zero = F.transform(F.get("__r", F.lit(0))["o"], lambda x: F.lit(0.0))
    mixed = F.aggregate("__r", zero, lambda s, x: F.zip_with(s, x["o"], lambda a, b: a + b * x["w"] / F.col("__t")))
    return d.select(token, mixed.alias("mixed"))


def mean_gradient_energy(gradients: DataFrame, by: list[str], vector: str) -> DataFrame:
    """The squared norm of the mean vector (not the mean of squared norms)."""
    d = gradients.select(*by, F.posexplode(vector).alias("dim", "x")).groupBy(*by, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return d.groupBy(*by).agg(F.sum(F.col("m") * F.col("m")).alias("energy"))


def adjusted_rand_by(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Adjusted Rand indices of many pairs of labellings; fewer than two rows or a degenerate case give 1."""
    two = lambda n: n * (n - 1) / 2
    cell = pairs.groupBy(*by, a, b).agg(F.count("*").cast("double").alias("n"))
    side = lambda c, name: cell.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two(F.col("n"))).alias(name))
    d = cell.groupBy(*by).agg(F.sum(two(F.col("n"))).alias("ij"), F.sum("n").alias("n")).join(side(a, "i"), by).join(side(b, "j"), by)
    expected = F.col("i") * F.col("j") / F.nullif(two(F.col("n")), F.lit(0.0))
    top = (F.col("i") + F.col("j")) / 2 - expected
    return d.select(*by, F.when((F.col("n") < 2) | (F.abs(top) < 1e-12), 1.0).otherwise((F.col("ij") - expected) / top).alias("adjusted_rand"))


def seed_stability(labels: DataFrame, seed: str, key: str, label: str) -> DataFrame:
    """The adjusted Rand index of every pair of seeds. A key's labels, one per seed, meet in one row, so nothing is joined."""
    d = labels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(seed).alias("s"), F.col(label).alias("l")))).alias("__l"))
    later = lambda x, i: F.transform(F.slice("__l", i + 2, F.size("__l")), lambda y: F.struct(x["s"].alias("seed_a"), y["s"].alias("seed_b"), x["l"].alias("a"), y["l"].alias("b")))
    pairs = d.select(F.explode(F.flatten(F.transform("__l", later))).alias("p")).select("p.*")
    return adjusted_rand_by(pairs, ["seed_a", "seed_b"], "a", "b")


def reallocation(clusters: DataFrame, budget: int, by: list[str], cluster: str, traffic: str, size: str) -> DataFrame:
    """How many of `budget` seats move when they are shared by traffic instead of size."""
    t = largest_remainder(clusters, budget, by, cluster, traffic).select(*by, cluster, F.col("seats").alias("__t"))
    s = largest_remainder(clusters, budget, by, cluster, size).select(*by, cluster, F.col("seats").alias("__s"))
    return t.join(s, [*by, cluster]).groupBy(*by).agg((F.sum(F.abs(F.col("__t") - F.col("__s"))) / 2).cast("long").alias("reallocated"))


def two_level_summary(metrics: DataFrame, by: list[str], seed: str, value: str) -> DataFrame:
    """The mean over all rows, and the sample deviation of the seeds' means; nulls are skipped."""
    per = metrics.groupBy(*by, seed).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    return per.groupBy(*by).agg(F.count("*").alias("seeds"), (F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.stddev_samp(mean).alias("sd"))


def variant_plans(runs: DataFrame, plans: DataFrame, variants: dict[str, str], single: tuple[str, ...] = ()) -> DataFrame:
    """The plan of each run (method, seed): that of its method's variant and its seed; methods in `single` take the
    variant's first seed. A run whose plan is missing keeps nulls."""
    names = runs.sparkSession.createDataFrame([(m, v, m in single) for m, v in variants.items()], "method string, variant string, single boolean")
    first = plans.groupBy("variant").agg(F.min("seed").alias("__first"))
    d = runs.join(F.broadcast(names), "method").join(first, "variant", "left")  # as many names as the dictionary has
    d = d.withColumn("plan_seed", F.when(F.col("single"), F.col("__first")).otherwise(F.col("seed"))).drop("single", "__first")
    return d.join(plans.withColumnRenamed("seed", "plan_seed"), ["variant", "plan_seed"], "left")


def train_order(rows: DataFrame, key: str, need: int, seed: int) -> DataFrame:
    """The first `need` rows of a seeded permutation, with `pos` from 0."""
    return sample(rows, key, need, seed).withColumn("pos", (F.row_number().over(Window.orderBy("draw", key)) - 1).cast("long"))


def micro_batches(ordered: DataFrame, size: int, value: str) -> DataFrame:
    """Steps of `size` consecutive positions, with the mean of a value."""
    return ordered.groupBy(block_of(F.col("pos"), size).alias("step")).agg(F.count("*").alias("rows"), F.avg(value).alias("mean"))


def progress(blocks: DataFrame, by: list[str], order: str, value: str, seconds: str) -> DataFrame:
    """The mean so far, its perplexity, and the time that is left if it goes on at the same pace."""
    upto, whole = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    d = blocks.withColumns({"done": F.count("*").over(upto), "all": F.count("*").over(whole), "mean": F.avg(value).over(upto), "elapsed": F.sum(seconds).over(upto)})
    return d.select(*by, order, "done", "mean", "elapsed", (F.col("elapsed") * (F.col("all") - F.col("done")) / F.col("done")).alias("left"))


def merge_manifests(parts: DataFrame, source: str) -> DataFrame:
    """Rows of many manifests, if all name the same source; otherwise an error."""
    one = parts.agg(F.min(source).alias("__lo"), F.max(source).alias("__hi"))
    same = F.when(F.col("__lo") == F.col("__hi"), F.lit(True)).otherwise(F.raise_error(F.lit("the manifests name different sources")).cast("boolean"))
    return parts.join(F.broadcast(one)).where(same).drop("__lo", "__hi")  # one row


def flatten_samples(rows: DataFrame, key: str, samples: str) -> DataFrame:
    """One row per example of a map from subtasks to lists of examples: key, subtask, position, example."""
    d = rows.select(key, F.explode(samples).alias("subtask", "__e"))
    return d.select(key, "subtask", F.posexplode("__e").alias("position", "example"))


def preparation_costs(models: DataFrame, reports: dict[str, DataFrame], key: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """Seconds of each report (key, seconds) by model; a report in `optional` that is missing counts as 0."""
    d = models
    for name, r in reports.items():
        d = d.join(r.select(key, F.col("seconds").alias(name)), key, "left")
    return d.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in optional}) if optional else d


def parameter_counts(c: dict[str, Column]) -> tuple[Column, Column]:
    """Parameters of a decoder with gated experts before its growth, and those that the new experts add.

    c: width, layers, experts, new_experts, expert_width, shared_width (0: none), kv_width, vocabulary, tied (boolean).
    An expert has three matrices; attention has four, of which two are narrow; a router scores each expert; a layer has
    two norms and, with a shared expert, one gate.
    """
    d, expert = c["width"], 3 * c["width"] * c["expert_width"]
    attention, norms, router = 2 * d * (d + c["kv_width"]), 2 * d, c["experts"] * d
    shared = F.when(c["shared_width"] > 0, 3 * d * c["shared_width"] + d).otherwise(0)
    embedding = c["vocabulary"] * d * F.when(c["tied"], 1).otherwise(2)
    layer = c["experts"] * expert + shared + attention + norms + router
    return c["layers"] * layer + embedding, c["layers"] * c["new_experts"] * expert


def descriptor(assigned: DataFrame, hidden: DataFrame, experts: DataFrame, by: list[str], expert: str, probability: str, vector: str) -> DataFrame:
    """What is known of each expert: count, observed, mean vector mu, population deviations sigma, and a, its mean
    probability when it was called. Experts (by, expert) without a call are an error, since their group cannot be planned.

    assigned: by, expert and the probability of each call; hidden: by, expert and the vector of each call.
    """
    keys = [*by, expert]
    calls = assigned.groupBy(*keys).agg(F.count("*").alias("count"), F.avg(probability).alias("a"))
    m = vector_moments(hidden, keys, vector)
    row = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("dim", c))), lambda x: x[c]).alias(c)
    vectors = m.groupBy(*keys).agg(row("mu"), row("sigma"))
    d = experts.select(*keys).join(calls, keys, "left").join(vectors, keys, "left").withColumn("count", F.coalesce("count", F.lit(0)))
    d = d.withColumn("observed", F.col("count") > 0)
    return guarded(d, F.col("observed"), "an expert was never called")


def check_descriptor(d: DataFrame, totals: DataFrame, by: list[str], width: int) -> DataFrame:
    """d, if every row has vectors of `width` finite components, deviations of 0 or more and a between 0 and 1 + 1e-6, and if
    the counts of each group add up to `expected` of totals."""
    good = lambda v: (F.size(v) == width) & F.forall(v, finite)
    sums = d.groupBy(*by).agg(F.sum("count").alias("__n")).join(totals, by, "full_outer")
    expect(sums, total=F.col("__n") == F.col("expected"))
    return expect(d, observed=F.col("observed") == (F.col("count") > 0), mu=good(F.col("mu")), sigma=good(F.col("sigma")) & F.forall("sigma", lambda x: x >= 0), a=F.col("a").between(0, 1 + 1e-6))


def check_probes(probes: DataFrame, partition: DataFrame, by: list[str], length: int) -> DataFrame:
    """probes (by, block_id, token_pos), if they are distinct, lie within blocks of `length` and in blocks of the partition."""
    unique(probes, *by, "block_id", "token_pos")
    inside = probes.join(partition.select(*by, "block_id").distinct().withColumn("__in", F.lit(True)), [*by, "block_id"], "left")
    expect(inside, partition=F.col("__in"), position=(F.col("token_pos") >= 0) & (F.col("token_pos") < length))
    return probes


def scored_plans(plans: DataFrame, scores: DataFrame, layer: str, budget: int, expert: str, score: str) -> DataFrame:
    """The parents of each layer of the plans by that layer's scores, each at most three times; a layer without scores, or
    with too few experts for the budget, is an error."""
    chosen = greedy_copies(scores, budget, [layer], expert, score)
    d = plans.select(layer).join(chosen, layer, "left")
    d = d.withColumn("__n", F.count("parent").over(Window.partitionBy(layer)))
    return guarded(d, F.col("__n") == budget, "a layer's scores do not fill the budget").drop("__n")


def inherited_labels(parents: DataFrame, labels: DataFrame, by: list[str], old: int) -> DataFrame:
    """Labels of all experts after a growth: old ones keep theirs, new ones, numbered from `old` in the order of their place,
    take their parent's. parents: by, place (from 1), parent; labels: by, expert, label."""
    new = parents.join(labels.withColumnRenamed("expert", "parent"), [*by, "parent"], "left")
    new = guarded(new, F.col("label").isNotNull(), "a parent has no label")
    return labels.select(*by, "expert", "label").union(new.select(*by, (F.lit(old - 1) + F.col("place")).alias("expert"), "label"))


def distinct_parents(parents: DataFrame, by: list[str]) -> DataFrame:
    return parents.groupBy(*by).agg(F.count("*").alias("new_experts"), F.count_distinct("parent").alias("unique_parents"))


def check_plan(parents: DataFrame, by: list[str], old: int, budget: int) -> DataFrame:
    """parents, if every group has `budget` of them, all between 0 and old - 1, at distinct places."""
    unique(parents, *by, "place")
    expect(parents, parent=F.col("parent").between(0, old - 1))
    expect(parents.groupBy(*by).agg(F.count("*").alias("n")), budget=F.col("n") == budget)
    return parents


def stability_summary(stability: DataFrame, by: list[str]) -> DataFrame:
    """The mean and the least adjusted Rand index over the pairs of seeds."""
    return stability.groupBy(*by).agg(F.avg("adjusted_rand").alias("seed_ari_mean"), F.min("adjusted_rand").alias("seed_ari_min"))


def plan_report(metrics: DataFrame, stability: DataFrame) -> DataFrame:
    """One row per method: layers, seeds, and means that skip nulls; the deviation is that of the seeds' mean ratios.

    metrics: method, seed, layer, ratio, null_mean, coverage, unique_parents; stability: method, layer, seed_ari_mean.
    """
    seeds = metrics.groupBy("method", "seed").agg(F.avg("ratio").alias("r")).groupBy("method").agg(F.stddev_samp("r").alias("ratio_seed_sd"), F.count("*").alias("plan_seeds"))
    means = metrics.groupBy("method").agg(F.count_distinct("layer").alias("layers"), *(F.avg(c).alias(f"{c}_mean") for c in ("ratio", "null_mean", "coverage", "unique_parents")))
    return means.join(seeds, "method").join(stability.groupBy("method").agg(F.avg("seed_ari_mean").alias("seed_ari_mean")), "method", "left")


GIB = 1 << 30


def resources(c: dict[str, Column], method: Column, warm: tuple[str, ...], keep_weights: Column) -> dict[str, Column]:
    """GiB of accelerator, host and disk that a run needs at most. c: base and extra parameters, layers, experts, all_experts,
    expert (parameters of one), width. The numbers are fixed allowances of the estimate."""
    base, extra = c["base"].cast("double"), c["extra"].cast("double")
    grown = method != "continue"
    train = F.when(grown, extra + c["layers"] * c["all_experts"] * c["width"]).otherwise(base)
    total = base + F.when(grown, extra).otherwise(0.0)
    scored = (c["layers"] * c["experts"] * c["expert"]).cast("double")
    load = 2 * base / GIB + 8
    kept = F.when(keep_weights, 2 * F.when(grown, extra).otherwise(total)).otherwise(0.0) + F.when(method.isin(*warm), 2 * extra).otherwise(0.0)
    case = lambda gradient, original, other: F.when(method == "gradient", gradient).when(method == "original", original).otherwise(other)
    return {
        "gpu_gib": case((2 * base + 2 * scored) / GIB + 12, 2 * base / GIB + 8, (2 * total + 2 * train) / GIB + 12),
        "cpu_gib": case(F.greatest(load, 4 * scored / GIB + 16), load, F.greatest(load, (4 * train + 4 * train / c["layers"]) / GIB + 16)),
        "disk_gib": case(F.lit(1.0), F.lit(2.0), (2.08 * 4 * train + kept) / GIB + 5),
    }
