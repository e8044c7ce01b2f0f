import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tarnmill.operators import experts


def test_windows_that_are_not_aligned(spark):
    probes = spark.createDataFrame([(p,) for p in range(30)], "p long")
    windows = spark.createDataFrame([(3,), (10,), (16,)], "start long")
    got = {tuple(r) for r in experts.in_windows(probes, windows, "p", "start", 8).collect()}
    assert got == {(p, s, p - s) for s in (3, 10, 16) for p in range(s, min(30, s + 8))}


def test_dispatch_by_hand(spark):
    chosen = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.6), (2, 1, 0.5)], "t long, e int, w double")
    outputs = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (2, 0, [9.0, 9.0]), (2, 1, [5.0, 6.0])], "t long, e int, o array<double>")
    plain = {r["t"]: r["mixed"] for r in experts.dispatch(chosen, outputs, "t", "e", "w", "o").collect()}
    assert plain[1] == pytest.approx([2.0, 2.8]) and plain[2] == pytest.approx([2.5, 3.0])
    full = {r["t"]: r["mixed"] for r in experts.dispatch(chosen, outputs, "t", "e", "w", "o", renormalize=True).collect()}
    assert full[1] == pytest.approx([2.5, 3.5]) and full[2] == pytest.approx([5.0, 6.0])


def test_stability(spark):
    rows = [(s, k, v) for s, labels in enumerate([[0, 0, 1, 1], [5, 5, 2, 2], [0, 0, 1, 2]]) for k, v in enumerate(labels)]
    got = experts.seed_stability(spark.createDataFrame(rows, "s int, k int, l int"), "s", "k", "l").collect()
    ari = {(r["seed_a"], r["seed_b"]): r["adjusted_rand"] for r in got}
    assert ari[0, 1] == 1.0 and ari[0, 2] == pytest.approx(0.571429, abs=1e-6) and set(ari) == {(0, 1), (0, 2), (1, 2)}


def test_reallocation(spark):
    c = spark.createDataFrame([("a", 0, 9.0, 1.0), ("a", 1, 1.0, 1.0)], "layer string, c int, t double, n double")
    assert [r["reallocated"] for r in experts.reallocation(c, 10, ["layer"], "c", "t", "n").collect()] == [4]


def test_manifests_must_agree(spark):
    one = spark.createDataFrame([("x", "h"), ("y", "h")], "task string, source string")
    assert experts.merge_manifests(one, "source").count() == 2
    with pytest.raises(PySparkException):
        experts.merge_manifests(one.withColumn("source", F.col("task")), "source").collect()


def test_costs_and_summaries(spark):
    models = spark.createDataFrame([("a",), ("b",)], "m string")
    full = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "m string, seconds double")
    got = experts.preparation_costs(models, {"load": full, "gradient": full.where("m = 'a'")}, "m", optional=("gradient",))
    assert {tuple(r) for r in got.collect()} == {("a", 1.0, 1.0), ("b", 2.0, 0.0)}
    rows = spark.createDataFrame([("g", 0, 1.0), ("g", 0, None), ("g", 1, 3.0), ("h", 0, None)], "by string, seed int, v double")
    s = {r["by"]: (r["mean"], r["sd"]) for r in experts.two_level_summary(rows, ["by"], "seed", "v").collect()}
    assert s["g"] == (2.0, pytest.approx(2**0.5)) and s["h"] == (None, None)


def test_descriptors_and_growth(spark):
    calls = spark.createDataFrame([(0, 0, 0.5, [1.0, 2.0]), (0, 0, 0.7, [3.0, 2.0]), (0, 1, 0.2, [5.0, 6.0])], "layer int, expert int, p double, x array<double>")
    ids = spark.createDataFrame([(0, 0), (0, 1)], "layer int, expert int")
    d = experts.descriptor(calls, calls, ids, ["layer"], "expert", "p", "x")
    got = {r["expert"]: r for r in d.collect()}
    assert got[0]["mu"] == [2.0, 2.0] and got[0]["sigma"] == [1.0, 0.0] and abs(got[0]["a"] - 0.6) < 1e-12 and got[1]["count"] == 1
    totals = spark.createDataFrame([(0, 3)], "layer int, expected long")
    experts.check_descriptor(d, totals, ["layer"], 2)
    for bad in ((d, totals, 3), (d.withColumn("a", F.lit(1.1)), totals, 2), (d, totals.withColumn("expected", F.lit(4)), 2)):
        with pytest.raises(ValueError):
            experts.check_descriptor(bad[0], bad[1], ["layer"], bad[2])
    with pytest.raises(Exception, match="never called"):
        experts.descriptor(calls, calls, ids.union(spark.createDataFrame([(0, 2)], "layer int, expert int")), ["layer"], "expert", "p", "x").collect()
    probes = spark.createDataFrame([("fit", 3, 0), ("fit", 3, 1)], "phase string, block_id long, token_pos long")
    part = spark.createDataFrame([("fit", 3), ("check", 4)], "phase string, block_id long")
    experts.check_probes(probes, part, ["phase"], 2)
    for bad in (probes.union(probes), probes.withColumn("phase", F.lit("check")), probes.withColumn("token_pos", F.col("token_pos") + 2)):
        with pytest.raises(ValueError):
            experts.check_probes(bad, part, ["phase"], 2)
    scores = spark.createDataFrame([(0, 0, 1.0), (0, 1, 5.0), (0, 2, 5.0)], "layer int, expert int, s double")
    layers = spark.createDataFrame([(0,)], "layer int")
    plan = experts.check_plan(experts.scored_plans(layers, scores, "layer", 7, "expert", "s"), ["layer"], 3, 7)
    assert [r["parent"] for r in plan.orderBy("place").collect()] == [1, 1, 1, 2, 2, 2, 0]
    for n, layer in ((10, layers), (7, layers.union(spark.createDataFrame([(1,)], "layer int")))):
        with pytest.raises(Exception, match="do not fill"):
            experts.scored_plans(layer, scores, "layer", n, "expert", "s").collect()
    labels = spark.createDataFrame([(0, e, e % 2) for e in range(3)], "layer int, expert int, label int")
    grown = {r["expert"]: r["label"] for r in experts.inherited_labels(plan, labels, ["layer"], 3).collect()}
    assert grown == {0: 0, 1: 1, 2: 0, 3: 1, 4: 1, 5: 1, 6: 0, 7: 0, 8: 0, 9: 0}
    assert tuple(experts.distinct_parents(plan, ["layer"]).first()) == (0, 7, 3)
