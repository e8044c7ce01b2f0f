"""Incremental ingest with stateful deduplication, and progress logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.corpus import candidates, check_recovered, drop_stored, quota, store, two_key_dedup
from .keys import KeyStore

ADMITTED = T.StructType([T.StructField("source_row", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source_id", T.StringType()), T.StructField("text_sha256", T.StringType()), T.StructField("batch", T.LongType())])

#: Bytes of text in a file of write_lots().
FILE_BYTES = 64 << 20


def row_keys(rows: DataFrame) -> DataFrame:
    """The keys of rows: their texts' digests and their ids that are not empty."""
    return rows.select(F.concat(F.lit("t:"), "text_sha256").alias("key")).union(rows.where("source_id <> ''").select(F.concat(F.lit("i:"), "source_id")))


def ingest(stream: DataFrame, admitted: str, checkpoint: str):
    """Appends the rows of a stream that no admitted row has the text or the non-empty source_id of; rows of a batch are
    admitted in the order of source_row. stream: source_row long, text string, source_id string.

    Each batch is one Parquet folder, batch=<number>; a batch that is repeated after a failure overwrites what it had
    written, so every row is admitted once and a torn write leaves nothing behind. Keys of earlier rows are looked up in a
    KeyStore beside the rows (<admitted>-keys): a batch reads only the buckets that may hold its keys. Returns the started
    query; it ends when all input is read.
    """
    spark = stream.sparkSession
    seen = KeyStore(spark, f"{admitted}-keys")

    def commit(batch: DataFrame, number: int) -> None:
        rows = store(candidates(batch.withColumn("source_id", F.coalesce("source_id", F.lit("")))), "batch")
        known = seen.known(row_keys(rows), number)
        fresh = rows.join(known.select(F.substring("key", 3, 1 << 30).alias("text_sha256")).where("startswith(key, 't:')"), "text_sha256", "left_anti")
        fresh = fresh.join(known.select(F.substring("key", 3, 1 << 30).alias("source_id")).where("startswith(key, 'i:')"), "source_id", "left_anti")
        two_key_dedup(fresh).select("source_row", "text", "source_id", "text_sha256").write.mode("overwrite").parquet(f"{admitted}/batch={number}")
        seen.add(row_keys(spark.read.schema(ADMITTED).parquet(f"{admitted}/batch={number}")), number)
        drop_stored(rows, known)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admitted_rows(spark: SparkSession, admitted: str) -> DataFrame:
    """What was admitted so far, checked: no text and no source_id twice."""
    rows = spark.read.schema(ADMITTED).parquet(admitted).withColumn("split", F.lit("all"))
    return check_recovered(rows, [], rows.groupBy("split").agg(F.count("*").alias("documents"))).drop("split")


def within_quota(spark: SparkSession, admitted: str, counters: list[str], targets: dict[str, int], split, count) -> DataFrame:
    """Admitted rows until their split is full. split and count are columns of a row; count has one for each counter."""
    rows = spark.read.schema(ADMITTED).parquet(admitted).withColumn("split", split).withColumns(dict(zip(counters, count)))
    return quota(rows, counters, targets)


def document_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_lots(rows: DataFrame, folder: str, lots: int = 4, most: int = FILE_BYTES) -> int:
    """Writes rows as files of ranges of source_row that hold about `most` bytes of text each, and at least one for each lot. So
    more rows are more files, not larger ones, and no task writes or reads a whole lot. Returns the number of files of a lot."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows.repartitionByRange(lots * max(1, -(-size // (lots * most))), "source_row").write.parquet(folder)
    return max(1, -(-len(rows.sparkSession.read.schema(rows.schema).parquet(folder).inputFiles()) // lots))


def watch_progress(log: DataFrame, out: str, checkpoint: str, run: str = "run", line: str = "line"):
    """Keeps the last line of the newest step of each run of a stream of log lines (run, step, input_tokens, line; step is null
    in a torn line, which does not count). The state is one row a run; each batch writes the runs that it has changed as
    batch=<number> and overwrites them if it is repeated. Returns the started query; it ends when all input is read."""
    state = latest_progress(log.where("step IS NOT NULL"), run, line)
    commit = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    return state.writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watched_progress(spark: SparkSession, out: str, run: str = "run") -> DataFrame:
    """The newest state of each run that watch_progress() has written."""
    d = spark.read.parquet(out)
    return d.groupBy(run).agg(F.max_by(F.struct("step", "input_tokens"), "batch").alias("s")).select(run, "s.step", "s.input_tokens")


def latest_progress(log: DataFrame, run: str = "run", line: str | None = None) -> DataFrame:
    """The newest step of each run; a step that was replayed counts once, with the value of its last line. `line` orders the
    lines of a run (their numbers, or the time of their arrival); without it the larger value of a replayed step holds, so
    that the result does not depend on the order of the rows. Works on streams and tables."""
    order = F.struct("step", line) if line else F.struct("step", "input_tokens")
    return log.groupBy(run).agg(F.max("step").alias("step"), F.max_by("input_tokens", order).alias("input_tokens"))
