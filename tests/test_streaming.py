"""The key store, ingestion after failures, and progress logs on real streams."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from tarnmill.streaming import ingest
from tarnmill.streaming.keys import KeyStore


def keyed(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_key_store(spark, tmp_path):
    rng = random.Random(0)
    store, added = KeyStore(spark, f"file://{tmp_path}/keys", buckets=8), []
    for batch in range(7):
        asked = [f"k{rng.randrange(400)}" for _ in range(60)] + [f"new{batch}-{i}" for i in range(20)]
        before = set().union(*added)
        assert {r[0] for r in store.known(keyed(spark, asked), batch).collect()} == set(asked) & before
        fresh = sorted(set(asked) - before)
        store.add(keyed(spark, fresh), batch)
        added.append(set(fresh))
        if batch == 5:  # a repeated batch finds the store as it was before it, merged or not
            assert {r[0] for r in store.known(keyed(spark, asked), batch).collect()} == set(asked) & before
            store.add(keyed(spark, fresh), batch)
    assert store.before(7) == [(0, 3), (4, 5), (6, 6)]
    # Keys that nothing has added are kept out by the filters: of 3 segments of 8 buckets few are read.
    assert store.known(keyed(spark, ["never-1", "never-2"]), 7).collect() == [] and len(store.touched) <= 2
    one = sorted(added[6])[0]
    assert [r[0] for r in store.known(keyed(spark, [one]), 7).collect()] == [one] and len(store.touched) <= 2
    shutil.rmtree(tmp_path / "keys" / "filters-6-6")  # a torn write
    assert store.before(7) == [(0, 3), (4, 5)] and store.known(keyed(spark, [one]), 7).collect() == []


def test_repeated_batches_admit_nothing_twice(spark, tmp_path):
    """The checkpoint is lost, so all batches run again over what they had written."""
    rows = [(i, f"text {i % 40}", f"s{i % 31}" if i % 2 else None) for i in range(90)]
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], "source_row long, text string, source_id string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema

    def run():
        ingest.ingest(ingest.document_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/admitted", f"{tmp_path}/checkpoint").awaitTermination(200)
        return sorted(tuple(r) for r in ingest.admitted_rows(spark, f"{tmp_path}/admitted").select("source_row", "text_sha256").collect())

    first = run()
    shutil.rmtree(tmp_path / "checkpoint")
    assert run() == first


def test_lots_are_files_of_bounded_size(spark, tmp_path):
    """More rows make more files of the same size; the lots stay four, and the admitted rows those of one file each."""
    schema = "source_row long, text string, source_id string"
    for n in (0, 3, 200, 800):
        rows = spark.range(n).select(F.col("id").alias("source_row"), F.format_string("%0100d", F.col("id") % 150).alias("text"), F.lit(None).cast("string").alias("source_id"))
        each = ingest.write_lots(rows, f"{tmp_path}/in{n}", most=5000)
        files = [r["n"] for r in spark.read.parquet(f"{tmp_path}/in{n}").groupBy(F.input_file_name()).agg(F.sum(F.length("text")).alias("n")).collect()]
        assert sum(files) == 100 * n and max(files, default=0) <= 10_000 and len(files) <= 4 * each
    assert each >= 4
    ingest.ingest(ingest.document_stream(spark, f"{tmp_path}/in800", schema, each), f"{tmp_path}/admitted", f"{tmp_path}/checkpoint").awaitTermination(200)
    admitted = spark.read.schema(ingest.ADMITTED).parquet(f"{tmp_path}/admitted")
    assert admitted.select("text_sha256").distinct().count() == admitted.count() == 150 and admitted.select("batch").distinct().count() <= 4


def test_progress_on_a_stream(spark, tmp_path):
    """Lines arrive in files; a step is replayed, a line is torn, and the query starts again."""
    schema = "run string, step long, input_tokens long, line long"
    parts = [
        [("a", 1, 10, 1), ("a", 2, 20, 2), ("b", 1, 5, 1)],
        [("a", 2, 25, 3), ("a", None, None, 4)],
        [("a", 1, 99, 5), ("b", 2, 9, 2), ("a", 2, 21, 6)],
    ]

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
        ingest.watch_progress(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(200)
        return sorted(tuple(r) for r in ingest.watched_progress(spark, f"{tmp_path}/out").collect())

    want = [[("a", 2, 20), ("b", 1, 5)], [("a", 2, 25), ("b", 1, 5)], [("a", 2, 21), ("b", 2, 9)]]
    for part, told in zip(parts, want):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        assert run() == told
    assert run() == want[-1]
    everything = spark.read.parquet(f"{tmp_path}/log").where("step is not null")
    assert sorted(tuple(r) for r in ingest.latest_progress(everything, line="line").collect()) == want[-1]
    with pytest.raises(Exception):
        ingest.watched_progress(spark, f"{tmp_path}/nothing").collect()
    assert everything.where(F.col("run") == "b").count() == 2
