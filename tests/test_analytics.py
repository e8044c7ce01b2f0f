import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnmill.functions import numeric
from tarnmill.operators import grouping, moments, results, routing
from tarnmill.sources import npy, readers, writers
from tarnmill.streaming import ingest


def test_moments_and_projection(spark):
    x = np.random.default_rng(0).normal(size=(50, 6))
    df = spark.createDataFrame([(i % 3, i, v.tolist()) for i, v in enumerate(x)], "k int, i long, v array<double>")
    for r in moments.vector_moments(df, ["k"], "v").collect():
        own = x[np.arange(50) % 3 == r["k"], r["dim"]]
        assert math.isclose(r["mu"], own.mean(), abs_tol=1e-12) and math.isclose(r["sigma"], own.std(), abs_tol=1e-12)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    up, same = np.triu_indices(50, 1), (np.arange(50)[:, None] % 3 == np.arange(50)[None] % 3)
    got = moments.pair_distance_ratio(df, "k", "v").first()
    assert math.isclose(got["ratio"], d[up][same[up]].mean() / d[up].mean(), rel_tol=1e-9)
    c = x - x.mean(0)
    want = c / np.sqrt((c**2).sum(1).mean())
    assert np.allclose(np.array([r["scaled"] for r in moments.scaled(df, "v").orderBy("i").collect()]), want)
    m = np.random.default_rng(1).normal(size=(6, 3))
    mat = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "row int, weights array<double>")
    assert np.allclose(np.array([r["projected"] for r in moments.project(df, "v", mat).orderBy("i").collect()]), x @ m)


def test_routing(spark):
    counts = spark.createDataFrame([(0, 0, 4), (0, 1, 2), (0, 2, 2)], "layer int, expert int, calls long")
    r = routing.load_stats(counts, "layer", "expert", 4).first()
    assert np.allclose([r["cv"], r["entropy"], r["effective"], r["observed"]], [0.707107, 1.039721, 2.828427, 3], atol=1e-6)
    p = spark.createDataFrame([(0, e, 0.25) for e in range(4)], "layer int, expert int, mean_probability double")
    a = spark.createDataFrame([(0, e) for e in range(4)], "layer int, expert int")
    assert routing.balance(a, "layer", "expert", p, 4).first()["balance"] == 1.0
    t = spark.createDataFrame([(0, [0.4, 0.3, 0.2, 0.1], [0, 1]), (1, [0.4, 0.3, 0.2, 0.1], [0, 2])], "token long, p array<double>, selected array<int>")
    got = {r["token"]: r["refined"] for r in routing.refine(t, [0, 0, 1, 1], 0.2, 1.0, 5, 2).collect()}
    assert got[0] == [0, 1]
    assert set(got[1][:1]) <= {0, 1} and set(got[1][1:]) <= {2, 3}
    assert [r["refined"] for r in routing.refine(t, [0, 0, 1, 1], 0.2, 0.0, 5, 2).collect()] == [[0, 1], [0, 2]]
    top = spark.range(1).select(numeric.top_k(F.array(*map(F.lit, [1.0, 3.0, 3.0, 2.0])), 3)).first()[0]
    assert top == [1, 2, 3]


def test_apportionment_and_plans(spark):
    s = spark.createDataFrame([("g", 0, 5.0), ("g", 1, 3.0), ("g", 2, 2.0)], "g string, e int, s double")
    assert [r["seats"] for r in grouping.largest_remainder(s, 4, ["g"], "e", "s").orderBy("e").collect()] == [2, 1, 1]
    s = spark.createDataFrame([("g", 0, 1), ("g", 1, 5), ("g", 2, 5)], "g string, e int, s long")
    assert [r["parent"] for r in grouping.greedy_copies(s, 7, ["g"], "e", "s").orderBy("place").collect()] == [1, 1, 1, 2, 2, 2, 0]
    assert [r["parent"] for r in grouping.cycled_parents(s, 5, ["g"], "e", [F.col("s").desc(), F.col("e")]).orderBy("place").collect()] == [1, 2, 0, 1, 2]
    ab = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "a int, b int")
    assert math.isclose(grouping.adjusted_rand(ab, "a", "b").first()[0], 0.571429, abs_tol=1e-6)
    assert grouping.adjusted_rand(ab.limit(1), "a", "b").first()[0] == 1.0
    lab = spark.createDataFrame([(0, 2), (1, 2), (2, 0), (3, 1)], "i int, l int")
    assert [r["canonical"] for r in grouping.canonical_labels(lab, [], "i", "l").orderBy("i").collect()] == [0, 0, 1, 2]


def test_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (6, 2)) for c in ([0, 0], [5, 0], [0, 5])])
    labels = grouping.gram_kmeans(x @ x.T, 3, 1)
    assert labels.tolist() == [0] * 6 + [1] * 6 + [2] * 6
    line = np.array([[0.0], [1.0], [2.0], [10.0]])
    assert grouping.farthest_first(line @ line.T, [0, 1, 2, 3]) == [2, 3, 0, 1]
    with pytest.raises(ValueError):
        grouping.gram_kmeans(np.ones((4, 4)), 2, 0)
    df = spark.createDataFrame([(0, i, v.tolist(), i + 1, i // 6) for i, v in enumerate(x)], "layer int, e int, v array<double>, t long, l int")
    plan = grouping.group_plans(df, ["layer"], "e", "v", "t", 3, 9, 1).collect()
    assert sum(r["new_experts"] for r in plan) == 9 and all(set(r["parents"]) <= set(r["members"]) for r in plan)
    null = grouping.permutation_null(df, ["layer"], "e", "l", "v", 50, 1).first()
    assert null["ratio"] < null["null_q05"] < null["null_mean"] < null["null_q95"] and abs(null["null_mean"] - 1) < 0.1
    cov = grouping.nearest_parent_coverage(df, df.where("e in (0, 6, 12)"), "e", "v", "t").first()[0]
    d = ((x[:, None] - x[[0, 6, 12]][None]) ** 2).sum(2).min(1)
    assert math.isclose(cov, (d * np.arange(1, 19)).sum() / 171, rel_tol=1e-9)


def test_coverage_ratio_by_layer(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 9, 3)) + 5
    rows = [(g, e, x[g, e].tolist(), e + 1) for g in range(2) for e in range(9)] + [(2, e, [0.1, 0.7, 0.3], 1) for e in range(3)] + [(3, 0, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "layer int, e int, v array<double>, t long")
    got = {r["layer"]: (r["coverage"], r["ratio"]) for r in grouping.nearest_parent_coverage(df, df.where("e in (0, 4)"), "e", "v", "t", ["layer"]).collect()}
    assert got[2] == got[3] == (0.0, None)
    for g in range(2):
        d = ((x[g][:, None] - x[g][None]) ** 2).sum(2)
        near = (d[:, [0, 4]].min(1) * np.arange(1, 10)).sum() / 45
        assert np.allclose(got[g], (near, near / d[np.triu_indices(9, 1)].mean()))


def test_curves_and_summaries(spark):
    curve = spark.createDataFrame([("r", s * 8192, y) for s, y in ((0, 2.5), (512, 2.1), (1024, 1.9))], "run string, x long, y double")
    assert math.isclose(results.excess_auc(curve, ["run"], "x", "y", 2.0).first()["auc"], 1_468_006.4, rel_tol=1e-9)
    f = results.first_crossing(curve, ["run"], "x", "y", 2.0).first()
    assert (f["first"], f["right_censored"]) == (8_388_608, False)
    v = spark.createDataFrame([("a", 1.5), ("a", None), ("a", float("nan")), ("b", None), ("c", 1.0), ("c", 3.0)], "m string, v double")
    got = {r["m"]: (r["n"], r["mean"], r["sd"]) for r in results.mean_sd(v, ["m"], "v").collect()}
    assert got == {"a": (1, 1.5, None), "b": (0, None, None), "c": (2, 2.0, math.sqrt(2))}
    lr = spark.createDataFrame([(64,), (128,), (2112,), (4096,)], "s long").select(numeric.lr_multiplier(F.col("s"), 4096, 128)).collect()
    assert np.allclose([r[0] for r in lr], [0.5, 1, 0.55, 0.1])
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert sorted(r["delta"] for r in results.paired_delta(a, a.withColumn("v", F.col("v") + 1), ["k"], "v").collect()) == [-1, -1]
    with pytest.raises(Exception, match="different rows"):
        results.paired_delta(a, a.limit(1), ["k"], "v").collect()
    g = spark.createDataFrame([(s, b, float(s + b)) for s in range(3) for b in range(6)], "s int, b int, v double")
    ci = results.bootstrap(g, "s", "b", "v", 300, 1).first()
    assert ci["low"] < ci["mean"] < ci["high"] and math.isclose(ci["mean"], 3.5)
    m = results.manifest_diff(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, v string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "k string, v string"), "k", "v")
    assert sorted(tuple(r) for r in m.collect()) == [("b", "changed"), ("c", "missing"), ("d", "unexpected")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "id": "1"}\n\n{"text": "y"}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "b.jsonl").write_text('{"text": "x"}\nnot json\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "b.jsonl")).collect()
    assert [(r["line"], r["value"]) for r in readers.faulty_lines(spark, str(tmp_path / "b.jsonl"), ["text"]).collect()] == [(2, "not json")]
    for run, text in (("r1", '{"step": 1}\n{"step": 2}\n{"st'), ("r2", "")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "train.jsonl").write_text(text)
    got = {r["file"].split("/")[-2]: r["step"] for r in readers.last_steps(spark, f"{tmp_path}/r*/train.jsonl").collect()}
    assert got["r1"] == 2 and got.get("r2", 0) == 0
    for value in ({"a": 0}, {"a": {3, 1, 2}, "b": np.arange(2), "c": tmp_path}):
        writers.json_report(spark, value, f"{tmp_path}/x/r.json")
    assert json.loads((tmp_path / "x" / "r.json").read_text()) == {"a": [1, 2, 3], "b": [0, 1], "c": str(tmp_path)}
    with pytest.raises(ValueError):
        writers.json_report(spark, {"a": float("nan")}, f"{tmp_path}/n.json")
    assert readers.train_log(spark, f"{tmp_path}/absent.jsonl").collect() == []
    d = readers.file_digests(spark, str(tmp_path / "a.jsonl")).first()
    assert d["file"] == "a.jsonl" and len(d["sha256"]) == 64
    writers.csv_report(spark.createDataFrame([(1, 2)], "b int, a int"), str(tmp_path / "csv"), ["a", "b"])
    assert next((tmp_path / "csv").glob("*.csv")).read_text() == "a,b\n2,1\n"
    assert writers.tex_cell(None) == "--" and "pm" in writers.tex_cell(1.0, 0.5)
    writers.publish(spark.range(3), str(tmp_path / "stage"), str(tmp_path / "final"), lambda t: None)
    with pytest.raises(FileExistsError):
        writers.publish(spark.range(3), str(tmp_path / "stage"), str(tmp_path / "final"), lambda t: None)


def test_array_files_and_sources(spark, tmp_path):
    blocks = np.arange(12, dtype=np.int32).reshape(3, 4)
    writers.array_file(spark, blocks, f"{tmp_path}/t.npy")
    with pytest.raises(FileExistsError):
        writers.array_file(spark, blocks, f"{tmp_path}/t.npy")
    digest = hashlib.sha256((tmp_path / "t.npy").read_bytes()).hexdigest()
    first_two = npy.read_verified(spark, f"{tmp_path}/t.npy", 4, 12, digest).where("block_id < 2")
    assert [r["tokens"] for r in first_two.orderBy("block_id").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7]]
    for bad in (dict(size=3, ids=12, sha256=digest), dict(size=4, ids=11, sha256=digest), dict(size=4, ids=12, sha256="0" * 64)):
        with pytest.raises(Exception):
            npy.read_verified(spark, f"{tmp_path}/t.npy", **bad).collect()
    (tmp_path / "a.jsonl").write_text('{"text": "x"}\n')
    source = readers.describe_source(spark, [f"{tmp_path}/a.jsonl"])
    assert source["files"][0]["name"] == "a.jsonl" and readers.open_source(spark, source, [f"{tmp_path}/a.jsonl"]).count() == 1
    (tmp_path / "a.jsonl").write_text('{"text": "y"}\n')
    with pytest.raises(ValueError):
        readers.open_source(spark, source, [f"{tmp_path}/a.jsonl"])
    pinned = readers.describe_source(spark, dataset=f"{tmp_path}/set", revision="r1")
    with pytest.raises(FileNotFoundError):
        readers.open_source(spark, pinned)
    spark.createDataFrame([("x", "1", None)], readers.DOCUMENT).write.parquet(f"{tmp_path}/set/r1/train")
    assert readers.open_source(spark, pinned).count() == 1
    (tmp_path / "tree.json").write_text(json.dumps({"g": {"a": {"splits": {"test": {"rows": 3, "fingerprint": "f"}}}, "b": {"c": {"splits": {"test": {"rows": 1, "fingerprint": "h"}}}}}}))
    assert sorted(tuple(r) for r in readers.snapshot_tree(spark, f"{tmp_path}/tree.json").collect()) == [("g/a", "test", 3, "f"), ("g/b/c", "test", 1, "h")]
    model = tmp_path / "model"
    model.mkdir()
    with pytest.raises(Exception):
        readers.checkpoint_identity(spark, str(model))
    for name in ("config.json", "w.safetensors", "w.index.json", "tokenizer_config.json"):
        (model / name).write_text("{}")
    identity = readers.checkpoint_identity(spark, str(model))
    (model / "pytorch_model-1.bin").write_text("old")
    none = hashlib.sha256(b"{}").hexdigest()
    assert sorted((r["kind"], r["name"], r["bytes"], r["sha256"]) for r in identity.collect()) == [("config", "config.json", 2, none), ("index", "w.index.json", 2, none), ("weights", "w.safetensors", 2, None)]
    (model / "w.safetensors").unlink()
    assert [r["name"] for r in readers.checkpoint_identity(spark, str(model)).where("kind like '%weights'").collect()] == ["pytorch_model-1.bin"]
    with pytest.raises(ValueError, match="vocabulary"):
        readers.tokenizer_files(spark, str(model))
    (model / "tokenizer.json").write_text("{}")
    assert {r["name"] for r in readers.tokenizer_files(spark, str(model)).collect()} == {"tokenizer.json", "tokenizer_config.json"}
    d = spark.createDataFrame([("a", 1, "x"), ("a", 0, "y"), ("b", 0, "z")], "split string, k long, text string")
    one, two = (sorted(map(tuple, writers.digested_splits(x, f"{tmp_path}/{n}", "k").collect())) for n, x in (("p", d), ("q", d.orderBy("text").repartition(3))))
    assert one == two and [r[:2] for r in one] == [("a", 2), ("b", 1)]
    assert "click" in writers.interpretation("click", 3, 2000)


def test_run_tables(spark):
    jobs = spark.createDataFrame([("m", "x", 0), ("m", "x", 1), ("m", "original", 0), ("m", "x", 2)], "model string, method string, seed int")
    complete = spark.createDataFrame([("m_x_seed0", True, 8, 2, 3.5)], "run string, complete boolean, final_step long, tasks_done long, test_ppl double")
    saved, logged = spark.createDataFrame([("m_x_seed1", 4)], "run string, checkpoint_step long"), spark.createDataFrame([("m_x_seed1", 6)], "run string, step long")
    marks = spark.createDataFrame([("m_original_seed0", None, None, True, 1, None)], "run string, evaluated boolean, warm boolean, started boolean, tasks_done long, test_ppl double")
    status = results.run_status(jobs, complete, saved, logged, marks, 8, 2)
    got = {r["run"]: (r["step"], r["total_steps"], r["checkpoint_step"], r["tasks_done"], r["test_ppl"], r["stage"]) for r in status.collect()}
    assert got == {"m_x_seed0": (8, 8, None, 2, 3.5, "complete"), "m_x_seed1": (6, 8, 4, 0, None, "training"), "m_original_seed0": (0, 0, None, 1, None, "initialization/evaluation"), "m_x_seed2": (0, 8, None, 0, None, "pending")}
    assert tuple(results.completed(status).first()) == (1, 4)
    curve = spark.createDataFrame([("r", 512, 2.1, "i"), ("r", 0, 2.5, "i"), ("r", 1024, 1.9, "i")], "run string, step long, nll double, indices string")
    reference = spark.createDataFrame([("r", 2.0, "i"), ("s", 1.0, "i")], "run string, reference double, indices string")
    budget = spark.createDataFrame([("r", 10, 81_920), ("s", 10, 81_920)], "run string, final_step long, input_tokens long")
    got = {r["run"]: r for r in results.recovery(curve, reference, budget, ["run"]).collect()}
    assert got["r"]["first_tokens"] == 8_388_608 and got["r"]["right_censored"] is False and math.isclose(got["r"]["excess_auc"], 1_468_006.4, rel_tol=1e-9)
    assert (got["s"]["first_tokens"], got["s"]["right_censored"], got["s"]["observed_tokens"], got["s"]["excess_auc"]) == (None, None, 0, None)
    for c, b in ((curve.withColumn("indices", F.lit("j")), budget), (curve, budget.withColumn("input_tokens", F.lit(81_925)))):
        with pytest.raises(Exception):
            results.recovery(c, reference, b, ["run"]).collect()
    with pytest.raises(Exception, match="no multiple"):
        results.block_groups(spark.range(33).select(F.lit(1).alias("s"), F.col("id").alias("b"), F.lit(1.0).alias("v")), ["s"], "b", "v").collect()
    points = spark.createDataFrame([("g", i, i, [float(i), 0.0]) for i in range(4)], "g string, i int, label int, v array<double>")
    r = grouping.permutation_null(points, ["g"], "i", "label", "v", 10, 1).first()
    assert (r["ratio"], r["null_mean"], r["null_q05"]) == (None, None, None)  # no two rows share a label


def test_stream_equals_batch(spark, tmp_path):
    """The stream admits by text and by source_id what one pass over all rows admits."""
    from tarnmill.operators.corpus import candidates, two_key_dedup

    rows = [(i, f"t{i % 17}", f"s{i % 23}" if i % 3 else None) for i in range(60)]
    for k in range(4):
        spark.createDataFrame(rows[k * 15 : k * 15 + 15], "source_row long, text string, source_id string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    docs = spark.read.parquet(*(f"{tmp_path}/in{k}" for k in range(4)))
    for k in range(4):  # one run after another, as files arrive
        for f in (tmp_path / f"in{k}").glob("part*"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
        stream = ingest.document_stream(spark, f"{tmp_path}/in", docs.schema)
        ingest.ingest(stream, f"{tmp_path}/admitted", f"{tmp_path}/checkpoint").awaitTermination(120)
    got = sorted(r["source_row"] for r in ingest.admitted_rows(spark, f"{tmp_path}/admitted").collect())
    all_ = spark.createDataFrame(rows, docs.schema).withColumn("source_id", F.coalesce("source_id", F.lit("")))
    assert got == sorted(r["source_row"] for r in two_key_dedup(candidates(all_)).collect())
    full = ingest.within_quota(spark, f"{tmp_path}/admitted", ["n"], {"all": 3}, F.lit("all"), [F.lit(1)])
    assert sorted(r["source_row"] for r in full.collect()) == got[:3]
    twice = spark.createDataFrame([("r", 1, "a.json", 1.0), ("r", 1, "b.json", 2.0), ("s", 1, "a.json", 3.0)], "run string, step int, file string, y double")
    from tarnmill.sources import readers as sources

    assert sorted((r["run"], r["y"]) for r in sources.latest_reports(twice, ["run", "step"]).collect()) == [("r", 2.0), ("s", 3.0)]
    log = spark.createDataFrame([("r", 1, 10, 0), ("r", 2, 30, 1), ("r", 2, 20, 2)], "run string, step long, input_tokens long, line long")
    assert tuple(ingest.latest_progress(log, line="line").first()) == ("r", 2, 20)


def test_distance_table_over_tiles(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i % 2, i, v.tolist(), i % 3) for i, v in enumerate(x)], "g int, i int, v array<double>, l int")
    got = {(r["g"], r["a"], r["b"]): r["distance"] for r in grouping.distance_table(df, ["g"], "i", "v", tile=3).collect()}
    want = {(a % 2, a, b): ((x[a] - x[b]) ** 2).sum() for a in range(40) for b in range(a + 1, 40) if a % 2 == b % 2}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    table = grouping.distance_table(df, [], "i", "v", tile=7)
    assert table.count() == 780
    one = grouping.distance_ratio(table, df, [], "i", "l").first()
    same = [((x[a] - x[b]) ** 2).sum() for a in range(40) for b in range(a + 1, 40) if a % 3 == b % 3]
    assert math.isclose(one["within"], float(np.mean(same)), rel_tol=1e-9)
    dealt = grouping.permuted_labels(df, ["g"], "i", "l", 5, 3)
    for r in dealt.groupBy("g", "rep").agg(F.array_sort(F.collect_list("l")).alias("l"), F.count_distinct("i").alias("n")).collect():
        assert r["n"] == 20 and r["l"] == sorted(i % 3 for i in range(40) if i % 2 == r["g"])


def test_contrasts_need_the_same_rows(spark):
    rows = [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 0.5), ("b", 1, 1.0), ("c", 0, 3.0), ("c", 1, 1.0)]
    df = spark.createDataFrame(rows, "m string, k int, v double")
    got = sorted(tuple(r) for r in results.contrasts(df, "m", "a", ["k"], "v").select("contrast", "k", "delta").collect())
    assert got == [("a - b", 0, 0.5), ("a - b", 1, 1.0), ("a - c", 0, -2.0), ("a - c", 1, 1.0)]
    for bad in (df.where("not (m = 'a' and k = 1)"), df.where("not (m = 'c' and k = 1)")):
        with pytest.raises(Exception, match="different rows"):
            results.contrasts(bad, "m", "a", ["k"], "v").collect()
    for scores, budget in (([1.0, -1.0], 3), ([0.0, 0.0], 3), ([1.0, float("inf")], 3), ([1.0, 1.0], 0)):
        with pytest.raises(Exception, match="scores must|budget"):
            grouping.largest_remainder(spark.createDataFrame([("g", i, s) for i, s in enumerate(scores)], "g string, e int, s double"), budget, ["g"], "e", "s").collect()
