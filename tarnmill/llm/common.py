"""Helpers that the training-data operators share: tables in the shared folder, word arrays, components."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the control characters from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that is unset a temporary folder is made and set, and only if driver
    and executors are one process (as in tests): on a cluster an unset folder is an error."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tarnmill-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


#: The paths that materialize() has written for the run at hand and that nothing has deleted; None outside of runs.
_RUN: ContextVar[list[str] | None] = ContextVar("tarnmill-run", default=None)


class Run:
    """Collects the tables that are written while it is entered, of its own thread only, so that they can be deleted together:
    other runs and queries of the session keep theirs."""

    def __enter__(self) -> Run:
        self.paths: list[str] = []
        self._token = _RUN.set(self.paths)
        return self

    def __exit__(self, *_) -> None:
        _RUN.reset(self._token)

    def release(self, spark: SparkSession, *keep: DataFrame) -> None:
        """Deletes the run's tables, but for those to keep: for callers whose result is written."""
        stay = {getattr(df, "_tarnmill_path", None) for df in keep}
        for path in [p for p in self.paths if p not in stay]:
            _delete(spark, path)
            if path in self.paths:
                self.paths.remove(path)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back; this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (run := _RUN.get()) is not None:
        run.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnmill_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if (run := _RUN.get()) is not None and path in run:
        run.remove(path)


def sweep(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more, before the next step writes its
    own; Spark itself would do so at the driver's next collection of garbage. What planning and compiling have left in the driver
    goes back to the system with them. One process with small data can wait for that."""
    if spark.sparkContext.master.startswith("local["):
        return
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    trim()


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_tarnmill_path", None):
            _delete(df.sparkSession, path)


def bounded_sample(df: DataFrame, n: int, *keys: str, salt: int = 0) -> DataFrame:
    """At most n rows: those with the smallest hashes of their keys, of all rows.

    Rows whose hash cannot be among them are dropped by a threshold first (a fifth above the expected one), so that
    what tasks send on does not grow with their number.
    """
    total = df.count()
    h = F.xxhash64(*keys, F.lit(salt))
    if total > n:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, (1.2 * n + 100) / total)))
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), *keys).limit(n)


def words(text: Column) -> Column:
    """The words of a text as an array; null or empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


class WordHashes(dict):
    """64-bit hashes of byte words, remembered up to a bound."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def trim() -> None:
    """Gives memory that is free back to the system; a worker that is used again would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step; edges are (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    edges: (a long, b long), in any direction, with repeats and loops. Returns (node, root): every node that
    has an edge to another, with the smallest node that it reaches, as a written table. Edges stay distributed; a hub is joined by
    a sort-merge join whose large side Spark can split, and its minimum is combined before the shuffle.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = materialize(e, "edges")
    seen = None
    while True:
        nxt = materialize(_star(_star(e, True), False), "edges")
        release(e)
        e = nxt
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = materialize(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), "components")
    release(e)
    return out
