"""Registered queries of sources, sinks, streams and checks: what is written from a table is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric, text
from .operators import corpus, expect, results
from .plans.corpus_build import Recipe, raw_documents
from .sources import readers, writers
from .streaming import ingest

RECIPE = Recipe()


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _new(spark: SparkSession, name: str) -> str:
    return f"{corpus.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _r(col, digits=6):
    return F.round(col, digits)


def _runs(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.concat("event_type", F.lit("_seed"), F.pmod("user_id", F.lit(5)).cast("string")).alias("run"), "event_type", F.pmod("user_id", F.lit(5)).cast("int").alias("seed"), "event_id", F.col("value").cast("double").alias("value"))


def _logs(spark, d) -> str:
    """A folder of logs, one file a run (or part of one, where a run is large), its steps in order."""
    path = _new(spark, "logs")
    rows = _runs(spark, d).select("run", F.col("event_id").alias("step"), F.col("seed").cast("long").alias("input_tokens"), F.col("value").alias("train_nll"))
    rows.repartitionByRange("run", "step").sortWithinPartitions("run", "step").write.partitionBy("run").json(path)
    return path


def log_tails(spark, d):
    """The newest step among the last three lines of each run's logs."""
    steps = readers.last_steps(spark, f"{_logs(spark, d)}/run=*")
    return steps.groupBy(F.regexp_extract("file", "/run=([^/]*)/", 1).alias("run")).agg(F.max("step").alias("step"))


def log_sums(spark, d):
    """Whole logs, read strictly."""
    path = _logs(spark, d)
    whole = readers.train_log(spark, path)
    if readers.train_log(spark, f"{path}-absent").count():
        raise ValueError("an absent log has rows")
    return whole.agg(F.count("*").alias("lines"), F.sum("step").alias("steps"), F.sum("input_tokens").alias("tokens"), _r(F.sum("train_nll"), 3).alias("nll"))


def json_documents(spark, d):
    """Counts by event type, written as one JSON report twice (the second replaces the first) and read back."""
    path = f"{_new(spark, 'report')}.json"
    rows = _runs(spark, d).groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type").collect()  # a few types
    for k in (0, 1):
        writers.json_report(spark, {"version": k, "counts": [{"event_type": r["event_type"], "n": r["n"]} for r in rows]}, path)
    read = readers.json_document(spark, path, "version long, counts array<struct<event_type:string,n:long>>")
    return read.select("version", F.explode("counts").alias("c")).select("version", "c.event_type", "c.n")


def csv_round_trip(spark, d):
    """A summary by event type as CSV, its columns in the order asked for, and read back."""
    path = _new(spark, "csv")
    s = results.mean_sd(_runs(spark, d), ["event_type"], "value").select("event_type", "n", _r("mean").alias("mean"), _r("sd").alias("sd"))
    writers.csv_report(s, path, ["mean", "event_type", "sd", "n"])
    return spark.read.csv(path, header=True, schema="mean double, event_type string, sd double, n long")


def exclusion_reasons(spark, d):
    """Runs of users with an even number of events are complete; seeds 3 and 4 are not in the matrix."""
    runs = _runs(spark, d).groupBy("event_type", "seed").agg(F.count("*").alias("n"))
    expected = runs.select("event_type").distinct().join(spark.range(3).select(F.col("id").cast("int").alias("seed")))
    return results.excluded(runs, expected, ["event_type", "seed"], F.col("n") % 2 == 0).select("event_type", "seed", "reason")


def run_summary(spark, d):
    """Six seeds of each type are expected; mean and deviation of those that are there."""
    runs = _runs(spark, d).groupBy("event_type", "seed").agg(F.avg("value").alias("value"))
    expected = runs.select("event_type").distinct().join(spark.range(6).select(F.col("id").cast("int").alias("seed")))
    s = results.summary(expected, runs, ["event_type", "seed"], ["event_type"], "value")
    return s.select("event_type", "n", _r("mean").alias("mean"), _r("sd").alias("sd"), "expected")


def digest_formats(spark, d):
    """Digests of texts, cut by a character where doc_id is odd; paths made of urls."""
    h = F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise(F.left(F.sha2("text", 256), F.lit(63)))
    return _t(spark, d, "documents").select("doc_id", text.is_digest(h).alias("whole"))


def path_escapes(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.concat(F.when(F.col("page_id") % 3 == 0, "../").when(F.col("page_id") % 3 == 1, "/").otherwise(""), F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))
    return p.select("page_id", text.escapes_root(F.col("path")).alias("escapes"))


def whole_numbers(spark, d):
    """Values of events as numbers that a configuration may hold as floats."""
    return _t(spark, d, "events").select("event_id", numeric.is_whole(F.floor(F.col("value").cast("double")) / 2).alias("whole"))


def normalized_mse(spark, d):
    """Vectors rounded to one digit as predictions of the vectors."""
    e = _t(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("actual"))
    p = e.withColumn("predicted", F.transform("actual", lambda x: F.floor(x * 10) / 10))
    return results.normalized_error(p, "predicted", "actual").select(_r("nmse").alias("nmse"))


def checked_splits(spark, d):
    """First documents of each text by split, after the checks that splits share no text and that places are 0 ... n - 1."""
    c = corpus.first_of_each(corpus.candidates(_t(spark, d, "documents").select(F.col("doc_id").alias("source_row"), "text")), "text_sha256", "source_row")
    c = corpus.store(c.select("source_row", "text_sha256", corpus.split_of(F.col("text_sha256"), RECIPE.seed, RECIPE.blocks).alias("split")), "splits")
    expect.unique(c, "text_sha256")
    part = lambda s: c.where(F.col("split") == s)
    for a, b in (("train", "valid"), ("train", "test"), ("valid", "test")):
        expect.disjoint(part(a), part(b), "text_sha256")
    return c.groupBy("split").agg(F.count("*").alias("documents"))


def recovered_totals(spark, d):
    """Documents and tokens by split of an admission under the full quotas, found again in what was written."""
    full = Recipe(block_size=2048, blocks={"train": 16_384, "valid": 2_048, "test": 2_048})
    raw = raw_documents(_t(spark, d, "documents").select(F.col("doc_id").alias("source_row"), "text"), full)
    totals = raw.groupBy("split").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    corpus.check_recovered(raw, ["tokens"], totals)
    return totals.select("split", "documents", F.col("tokens").cast("long").alias("tokens"))


def stream_ingest(spark, d):
    """Documents that arrive in four lots of files, admitted batch by batch, with ids that repeat within a text only."""
    folder = _new(spark, "arriving")
    rows = _t(spark, d, "documents").where(text.not_blank(F.col("text"))).select(F.col("doc_id").alias("source_row"), "text", F.concat(F.lit("h"), F.left(F.sha2("text", 256), F.lit(20))).alias("source_id"))
    files = ingest.document_stream(spark, folder, "source_row long, text string, source_id string", ingest.write_lots(rows, folder))
    ingest.ingest(files, f"{folder}-admitted", f"{folder}-checkpoint").awaitTermination()
    return ingest.admitted_rows(spark, f"{folder}-admitted").select("text_sha256")


def stream_progress(spark, d):
    """Logs of runs that arrive in three files: the newest step of each run, with its tokens."""
    folder = _new(spark, "progress")
    rows = _runs(spark, d).select("run", F.col("event_id").alias("step"), (F.col("event_id") * 10 + F.col("seed")).alias("input_tokens"), F.col("event_id").alias("line"))
    rows.repartition(3, "step").write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    ingest.watch_progress(stream, f"{folder}-out", f"{folder}-checkpoint").awaitTermination()
    return ingest.watched_progress(spark, f"{folder}-out")


QUERIES = [
    log_tails, log_sums, json_documents, csv_round_trip, exclusion_reasons, run_summary, digest_formats, path_escapes, whole_numbers, normalized_mse, checked_splits, recovered_totals, stream_ingest,
    stream_progress,
]

_RUN = "runs AS (SELECT event_type || '_seed' || (user_id % 5)::VARCHAR AS run, event_type, (user_id % 5)::INTEGER AS seed, event_id, value::DOUBLE AS value FROM events)"


def oracle(cand: str, full: str) -> dict[str, str]:
    """cand and full: the CTEs of first documents (firsts, splits) and of those that are admitted under the full quotas (admitted)."""
    return {
        "log_tails": f"WITH {_RUN} SELECT run, max(event_id) AS step FROM runs GROUP BY run",
        "log_sums": f"WITH {_RUN} SELECT count(*)::BIGINT AS lines, sum(event_id)::BIGINT AS steps, sum(seed)::BIGINT AS tokens, round(sum(value), 3) AS nll FROM runs",
        "json_documents": f"WITH {_RUN} SELECT 1::BIGINT AS version, event_type, count(*)::BIGINT AS n FROM runs GROUP BY event_type",
        "csv_round_trip": f"WITH {_RUN} SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM runs GROUP BY event_type",
        "exclusion_reasons": f"WITH {_RUN} SELECT event_type, seed, CASE WHEN count(*) % 2 <> 0 THEN 'incomplete' WHEN seed > 2 THEN 'not in the matrix' END AS reason FROM runs GROUP BY event_type, seed",
        "run_summary": f"WITH {_RUN}, s AS (SELECT event_type, seed, avg(value) AS v FROM runs GROUP BY ALL) SELECT event_type, count(*)::BIGINT AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, 6::BIGINT AS expected FROM s GROUP BY event_type",
        "digest_formats": "SELECT doc_id, doc_id % 2 = 0 AS whole FROM documents",
        "path_escapes": r"SELECT page_id, page_id % 3 < 2 OR regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '(^|/)\.\.(/|$)|^/') AS escapes FROM pages",
        "whole_numbers": "SELECT event_id, coalesce(floor(value::DOUBLE) / 2 > 0 AND floor(value::DOUBLE) % 2 = 0, false) AS whole FROM events",
        "normalized_mse": "WITH x AS (SELECT unnest(embedding::DOUBLE[]) AS x FROM embeddings) SELECT round(avg((floor(x * 10) / 10 - x) ** 2) / greatest(avg(x ** 2), 1e-12), 6) AS nmse FROM x",
        "checked_splits": f"WITH {cand} SELECT split, count(*)::BIGINT AS documents FROM firsts GROUP BY split",
        "recovered_totals": f"WITH {full} SELECT split, count(*)::BIGINT AS documents, sum(tokens)::BIGINT AS tokens FROM admitted GROUP BY split",
        "stream_ingest": f"WITH {cand} SELECT text_sha256 FROM firsts",
        "stream_progress": f"WITH {_RUN} SELECT run, max(event_id) AS step, arg_max(event_id * 10 + seed, event_id) AS input_tokens FROM runs GROUP BY run",
    }
