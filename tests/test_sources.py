"""Sources and sinks of any size: numbered JSON lines, .npy shards."""

import gzip
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnmill.operators.expect import ExpectationError
from tarnmill.sources import npy, readers, verified


def test_line_numbers_over_parts_of_files(spark, tmp_path):
    rng = random.Random(0)
    bad = {}
    for k in range(3):
        lines = []
        for i in range(1, 4001):
            kind = rng.randrange(400)
            value = {0: "[1, 2]", 1: '[{"text": "a"}, {"text": "b"}]', 2: '{"text": 5}', 3: '{"id": "x"}', 4: "3", 5: '{"text": "x"} {"text": "y"}', 6: '{"text": "cut', 7: "", 8: '{"text": null}', 9: '"text"'}.get(kind, json.dumps({"text": f"line {i} " * rng.randrange(1, 9), "id": i}))
            lines.append(value)
            if kind in (0, 1, 2, 3, 4, 5, 6, 8, 9):
                bad[f"f{k}", i] = "no JSON" if kind in (5, 6) else "no string text" if kind in (2, 3, 8) else "no JSON object"
        (tmp_path / f"f{k}.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "z.jsonl.gz").write_bytes(gzip.compress(b'{"text": "a"}\n\n{"text": 1}\n'))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {(r["file"].split("/")[-1].split(".")[0], r["line"]): r["fault"] for r in readers.faulty_lines(spark, str(tmp_path), ["text"]).collect()}
        assert got == bad | {("z", 3): "no string text"}
        every = readers.line_numbers(readers.text_lines(spark, f"{tmp_path}/f0.jsonl")).orderBy("line").collect()
        assert [r["value"] for r in every] == (tmp_path / "f0.jsonl").read_text().split("\n")[:-1]
        with pytest.raises(ValueError, match=f"f0.jsonl:{min(i for f, i in bad if f == 'f0')}"):
            readers.check_json_lines(spark, [f"{tmp_path}/f0.jsonl", f"{tmp_path}/f1.jsonl"])
        with pytest.raises(Exception, match="f0.jsonl, part from byte"):
            readers.json_lines(spark, f"{tmp_path}/f0.jsonl").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "good.jsonl").write_text('{"text": "a", "id": 7, "url": null}\n \t\n{"text": "", "more": [1]}\r\n')
    assert [tuple(r) for r in readers.check_json_lines(spark, f"{tmp_path}/good.jsonl").collect()] == [("a", "7", None), ("", None, None)]
    (tmp_path / "long.jsonl").write_text('{"text": "' + "x" * 5_000_000 + '"}\n' + " " * 300 + '{"text": "y"}\n' + " " * 300 + "\n")
    assert sorted(len(r["text"]) for r in readers.json_lines(spark, f"{tmp_path}/long.jsonl").collect()) == [1, 5_000_000]


def test_last_steps_of_long_logs(spark, tmp_path):
    for run, n in (("a", 3000), ("b", 5)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "train.jsonl").write_text("".join(json.dumps({"step": i, "more": "x" * 50}) + "\n" for i in range(n)) + '{"st' * (run == "a") + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        got = {r["file"].split("/")[-2]: r["step"] for r in readers.last_steps(spark, f"{tmp_path}/*/train.jsonl").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"a": 2999, "b": 4}


def test_npy_shards(spark, tmp_path):
    want = np.random.default_rng(0).integers(0, 1000, (500, 6)).astype(np.int32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(want)], "block_id long, tokens array<int>").repartition(5)
    out = f"{tmp_path}/blocks"
    npy.write_blocks(df, out, rows=64)
    listed = npy.shards(out)
    assert len(listed) >= 8 and sum(s["rows"] for s in listed) == 500
    assert (np.concatenate([np.load(f"{out}/{s['name']}") for s in listed]) == want).all()
    got = npy.read_verified(spark, out, 6, 1000)
    assert [(r["block_id"], r["tokens"]) for r in got.orderBy("block_id").collect()] == [(i, r.tolist()) for i, r in enumerate(want)]
    some = npy.read_blocks(spark, out, rows=16).where("block_id >= 100 AND block_id < 140")
    assert sorted(r["block_id"] for r in some.collect()) == list(range(100, 140))
    assert some.rdd.getNumPartitions() <= 5  # row ranges of 16, not all of the shards
    assert npy.read_blocks(spark, out).where("block_id > 900").count() == 0
    with pytest.raises(FileExistsError):
        npy.write_blocks(df, out)
    with pytest.raises(Exception, match="not below 999|negative"):
        npy.read_blocks(spark, out, ids=int(want.max())).collect()
    name = f"{out}/{listed[3]['name']}"
    content = open(name, "rb").read()
    open(name, "wb").write(content[:-4] + b"\x00\x00\x00\x00")
    with pytest.raises(npy.BlockFileError, match="not the files"):
        npy.read_verified(spark, out)
    open(name, "wb").write(content[:-8])
    with pytest.raises(Exception, match="ids in each of"):
        npy.read_blocks(spark, out).collect()


def test_npy_writer_refuses_gaps(spark, tmp_path):
    with pytest.raises(Exception, match="not 0 ... n - 1|without gaps"):
        npy.write_blocks(spark.createDataFrame([(0, [1]), (2, [1])], "block_id long, tokens array<int>"), f"{tmp_path}/b")
    npy.write_blocks(spark.createDataFrame([], "block_id long, tokens array<int>"), f"{tmp_path}/empty")
    assert npy.read_verified(spark, f"{tmp_path}/empty").collect() == []
    np.save(tmp_path / "one.npy", np.arange(12).reshape(3, 4))
    digest = hashlib.sha256((tmp_path / "one.npy").read_bytes()).hexdigest()
    assert npy.read_verified(spark, f"{tmp_path}/one.npy", 4, 12, digest).agg(F.sum(F.aggregate("tokens", F.lit(0), lambda a, x: a + x))).first()[0] == 66


def test_scans_behind_a_manifest(spark, tmp_path):
    df = spark.createDataFrame([(i % 2, i, [float(i), 1.0], 0.5) for i in range(8)], "layer int, e int, v array<double>, a double")
    out = f"{tmp_path}/p"
    df.write.partitionBy("layer").parquet(out)
    told = verified.record(spark, out)
    good = verified.whole_vectors({"v": 2}, ["v"], ["a"])
    assert sorted(tuple(r) for r in verified.scan(spark, out, good).select("layer", "e").collect()) == sorted((i % 2, i) for i in range(8))
    one = [n for n in told if n.startswith("layer=1")]
    assert {r["layer"] for r in verified.scan(spark, out, good, one).collect()} == {1}
    for bad in (verified.whole_vectors({"v": 3}), verified.whole_vectors({"v": 2}, shares=["e"])):
        with pytest.raises(Exception, match="finite components|no share"):
            verified.scan(spark, out, bad).collect()
    df.limit(1).coalesce(1).drop("layer").write.mode("append").parquet(f"{out}/layer=0")  # not in the manifest: not read
    assert verified.scan(spark, out, good).count() == 8
    file = tmp_path / "p" / one[0]
    content = file.read_bytes()
    file.write_bytes(content[:-9] + b"x" + content[-8:])
    with pytest.raises(ExpectationError, match="not the files"):
        verified.scan(spark, out)
    file.unlink()
    with pytest.raises(ExpectationError, match="missing"):
        verified.scan(spark, out, names=one)
