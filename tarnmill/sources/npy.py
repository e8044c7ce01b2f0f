"""Token blocks as two-dimensional integer .npy files: a Spark data source that reads them by ranges of rows and writes them as shards.

A folder of shards has a manifest, `_shards.json`: name, rows, first block_id and sha256 of each, in order. Readers take row
ranges, not files, as tasks; filters on block_id reach them. Paths are what pyarrow's file systems know: local or shared
folders, hdfs, s3.
"""

from __future__ import annotations

import ast
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from .verified import stream_digests, system_of

MANIFEST = "_shards.json"
#: Rows that a task reads, and rows that a shard has at most; the writer holds one shard.
TASK_ROWS, SHARD_ROWS, CHUNK_ROWS = 16_384, 4_096, 512
SCHEMA = "block_id long, tokens array<int>"


class BlockFileError(ValueError):
    """A file is not the blocks that it should be."""


def _header(stream) -> tuple[np.dtype, tuple[int, ...], int]:
    """dtype, shape and the position of the first value of a .npy file."""
    if stream.read(6) != b"\x93NUMPY":
        raise BlockFileError("no .npy file")
    major = stream.read(2)[0]
    wide = 2 if major == 1 else 4
    length = struct.unpack("<H" if wide == 2 else "<I", stream.read(wide))[0]
    told = ast.literal_eval(stream.read(length).decode("latin1"))
    if told["fortran_order"] or np.dtype(told["descr"]).kind not in "iu" or len(told["shape"]) != 2:
        raise BlockFileError("the file holds no rows of integers")
    return np.dtype(told["descr"]), tuple(told["shape"]), 8 + wide + length


@dataclass
class Rows(ds.InputPartition):
    """Rows low ... high - 1 of a file; `base` is the block_id of its first row."""

    file: str
    base: int
    low: int
    high: int


def shards(path: str) -> list[dict]:
    """The manifest of a folder, or the one file that path is: name, rows, first."""
    system, at = system_of(path)
    if system.get_file_info(at).type == fs.FileType.File:
        with system.open_input_file(at) as f:
            return [{"name": "", "rows": _header(f)[1][0], "first": 0}]
    with system.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())["shards"]


class _Reader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.ids = options["path"], int(options.get("size", 0)), int(options.get("ids", 0))
        self.step = int(options.get("rows", TASK_ROWS))
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters):
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("block_id",) and isinstance(f, ds.EqualTo | ds.GreaterThan | ds.GreaterThanOrEqual | ds.LessThan | ds.LessThanOrEqual):
                if isinstance(f, ds.EqualTo | ds.GreaterThan | ds.GreaterThanOrEqual):
                    self.low = max(self.low, value + isinstance(f, ds.GreaterThan))
                if isinstance(f, ds.EqualTo | ds.LessThan | ds.LessThanOrEqual):
                    self.high = min(self.high, value + (not isinstance(f, ds.LessThan)))
            yield f  # ranges only choose what is read; Spark filters again

    def partitions(self):
        out = []
        for s in shards(self.path):
            low, high = max(0, self.low - s["first"]), min(s["rows"], self.high - s["first"])
            name = f"{self.path}/{s['name']}" if s["name"] else self.path
            out += [Rows(name, s["first"], a, min(a + self.step, high)) for a in range(low, high, self.step)]
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part is None:  # no rows at all
            return
        system, at = system_of(part.file)
        with system.open_input_file(at) as f:
            dtype, (rows, size), start = _header(f)
            if self.size and size != self.size or f.size() != start + rows * size * dtype.itemsize or part.high > rows:
                raise BlockFileError(f"{part.file} has not {self.size or size} ids in each of {rows} rows")
            f.seek(start + part.low * size * dtype.itemsize)
            for a in range(part.low, part.high, CHUNK_ROWS):
                n = min(CHUNK_ROWS, part.high - a)
                values = np.frombuffer(f.read(n * size * dtype.itemsize), dtype)
                if len(values) and (values.min() < 0 or values.max() >= (self.ids or 1 << 31)):
                    raise BlockFileError(f"{part.file} holds ids that are negative or not below {self.ids or 1 << 31}")
                offsets = pa.array(np.arange(0, n * size + 1, size, dtype=np.int32) if size else np.zeros(n + 1, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n) + part.base), pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))], ["block_id", "tokens"])


@dataclass
class _Written(ds.WriterCommitMessage):
    shards: list[dict]


class _Writer(ds.DataSourceArrowWriter):
    """Each task writes shards of at most SHARD_ROWS rows; the manifest is written when all are there, so a folder without one
    is no result."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("rows", SHARD_ROWS))

    def write(self, iterator) -> _Written:
        system, at = system_of(self.path)
        done, ids, held = [], [], []

        def flush() -> None:
            low = ids[0]
            if ids != list(range(low, low + len(ids))):
                raise BlockFileError("block_id must be sorted within a task, without gaps")
            rows = np.stack(held)
            body = np.lib.format.magic(1, 0)
            told = repr({"descr": np.lib.format.dtype_to_descr(rows.dtype), "fortran_order": False, "shape": rows.shape}).encode()
            told += b" " * (-(len(body) + 2 + len(told) + 1) % 64) + b"\n"
            content = b"".join((body, struct.pack("<H", len(told)), told, rows.tobytes()))
            name = f"blocks-{low:012d}-{uuid.uuid4().hex}.npy"
            with system.open_output_stream(f"{at}/{name}") as f:
                f.write(content)
            done.append({"name": name, "rows": len(ids), "first": low, "size": rows.shape[1], "sha256": hashlib.sha256(content).hexdigest()})
            ids.clear()
            held.clear()

        for b in iterator:
            tokens = b.column("tokens")
            for i, block in enumerate(b.column("block_id").to_pylist()):
                ids.append(block)
                held.append(tokens[i].values.to_numpy().astype(np.int32))
                if len(ids) == self.most:
                    flush()
        if ids:
            flush()
        return _Written(done)

    def commit(self, messages) -> None:
        found = sorted((s for m in messages if m for s in m.shards), key=lambda s: s["first"])
        after = np.cumsum([0, *(s["rows"] for s in found)])
        if [s["first"] for s in found] != after[:-1].tolist() or len({s["size"] for s in found}) > 1:
            self.abort(messages)
            raise BlockFileError("the blocks are not 0 ... n - 1, all of one length")
        system, at = system_of(self.path)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{MANIFEST}") as f:
            f.write(json.dumps({"shards": found}).encode())

    def abort(self, messages) -> None:
        system, at = system_of(self.path)
        for s in (s for m in messages if m for s in m.shards):
            system.delete_file(f"{at}/{s['name']}")


class NpyBlocks(ds.DataSource):
    """Options: path; for reading size (of a row) and ids (all must be below), rows (of a task); for writing rows (of a shard)."""

    @classmethod
    def name(cls) -> str:
        return "npy_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(NpyBlocks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_blocks(blocks: DataFrame, path: str, rows: int = SHARD_ROWS) -> None:
    """Writes block_id (0 ... n - 1, each once) and tokens (all of one length) as shards; refuses a folder that is not empty."""
    system, at = system_of(path)
    if system.get_file_info(at).type != fs.FileType.NotFound and system.get_file_info(fs.FileSelector(at)):
        raise FileExistsError(path)
    system.create_dir(at, recursive=True)
    _registered(blocks.sparkSession)
    ordered = blocks.select(F.col("block_id").cast("long").alias("block_id"), F.col("tokens").cast("array<int>").alias("tokens")).repartitionByRange("block_id").sortWithinPartitions("block_id")
    ordered.write.format("npy_blocks").option("rows", rows).mode("append").save(path)


def read_blocks(spark: SparkSession, path: str, size: int = 0, ids: int = 0, rows: int = TASK_ROWS) -> DataFrame:
    """block_id and tokens of a .npy file or a folder of shards, by ranges of rows. size: the length that rows must have; ids:
    what all ids must be below (0: not looked at). A file that is shorter or longer than its header says is an error."""
    return _registered(spark).read.format("npy_blocks").option("size", size).option("ids", ids).option("rows", rows).load(path)


def read_verified(spark: SparkSession, path: str, size: int = 0, ids: int = 0, sha256: str | None = None) -> DataFrame:
    """read_blocks() after all files were found to have the digests of the manifest (of one file: sha256), before any row
    leaves."""
    told = {s["name"]: s.get("sha256", sha256) for s in shards(path)}
    got = {r["name"]: r["found"] for r in stream_digests(spark, path, list(told)).collect()}  # a digest per shard
    if wrong := sorted(n for n in told if got[n] != told[n]):
        raise BlockFileError(f"{path}: not the files that were recorded: {wrong[:3]}")
    return read_blocks(spark, path, size, ids)
