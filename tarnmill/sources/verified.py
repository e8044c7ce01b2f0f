"""Scans behind a manifest: files are read only after all of them were found to be those that were recorded."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expect import ExpectationError
from .readers import file_system
from .writers import json_report

MANIFEST = "manifest.json"


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a path: local or shared folders, hdfs, s3."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _digests(folder: str):
    def run(batches):
        for b in batches:
            out = []
            for name in b.column("name").to_pylist():
                system, at = system_of(f"{folder}/{name}" if name else folder)
                h = hashlib.sha256()
                if system.get_file_info(at).type == fs.FileType.File:
                    with system.open_input_stream(at) as f:
                        while piece := f.read(1 << 20):
                            h.update(piece)
                    out.append(h.hexdigest())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(out, pa.string())], ["name", "found"])

    return run


def stream_digests(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """name and digest (found, null for a missing file) of the files of a folder, a file in a task, read as a stream of any length."""
    d = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, min(len(names), 10_000)), "name")
    return d.mapInArrow(_digests(folder), "name string, found string")


def record(spark: SparkSession, folder: str) -> dict[str, str]:
    """Writes the manifest of the Parquet files of a folder: their names and digests."""
    at, system = file_system(spark, folder)
    found, names = system.listFiles(at, True), []
    base = str(system.makeQualified(at).toUri().getPath())
    while found.hasNext():
        path = str(found.next().getPath().toUri().getPath())
        if path.endswith(".parquet"):
            names.append(path[len(base) + 1 :])
    digests = {r["name"]: r["found"] for r in stream_digests(spark, folder, sorted(names)).collect()}  # a digest per file
    json_report(spark, {"complete": True, "files": digests}, f"{folder}/{MANIFEST}")
    return digests


def scan(spark: SparkSession, folder: str, check: Callable[[DataFrame], DataFrame] | None = None, names: list[str] | None = None) -> DataFrame:
    """The Parquet files that a folder's manifest lists (or those of `names`), after their digests were compared with it; no row
    leaves before. check: rules that rows must keep, applied while they are read. Files that the manifest does not list are not
    read."""
    told = json.loads(spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).first()[0])
    if not told.get("complete"):
        raise ExpectationError(f"{folder} is not complete")
    wanted = {n: d for n, d in told["files"].items() if names is None or n in names}
    got = {r["name"]: r["found"] for r in stream_digests(spark, folder, list(wanted)).collect()}
    if wrong := sorted(n for n, d in wanted.items() if got[n] != d):
        raise ExpectationError(f"{folder}: missing or not the files that were recorded: {wrong[:3]}")
    rows = spark.read.option("basePath", folder).parquet(*(f"{folder}/{n}" for n in wanted))
    return check(rows) if check else rows


def whole_vectors(vectors: dict[str, int], nonnegative: list[str] = (), shares: list[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """A check for scan(): the vectors have these lengths and finite components, some no negative ones; shares lie between 0 and
    1 + 1e-6."""
    from ..operators.expect import finite, guarded

    def check(rows: DataFrame) -> DataFrame:
        for name, size in vectors.items():
            rows = guarded(rows, (F.size(name) == size) & F.forall(name, finite), f"{name} has not {size} finite components")
        for name in nonnegative:
            rows = guarded(rows, F.forall(name, lambda x: x >= 0), f"{name} is negative")
        for name in shares:
            rows = guarded(rows, F.col(name).between(0, 1 + 1e-6), f"{name} is no share")
        return rows

    return check
