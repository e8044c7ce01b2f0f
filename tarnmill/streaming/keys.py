"""A store of keys that grows batch by batch and is looked up by buckets.

Keys are dealt to buckets by their hash. Each batch adds a segment: for every bucket a Parquet folder of its sorted keys, and a
Bloom filter. Segments of equal length are merged, so b batches leave at most log2(b) + 1 of them. A lookup asks the filters
of the buckets that its keys fall into, and reads only those (segment, bucket) folders whose filter lets a key pass; keys that are
new read almost nothing, however many batches there were. Segments are named by the batches that they hold, and what a merge has
replaced stays until the next batch begins: a batch that is repeated after a failure finds the store as it was before it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import drop_stored, store
from ..sources.readers import file_system

BUCKETS, BITS, HASHES = 64, 10, 7
KEYS = "bucket int, key string"


def _places(keys: list[str], bits: int) -> np.ndarray:
    """HASHES places of each key in a filter, by double hashing of its digest's two halves."""
    import hashlib

    raw = np.frombuffer(b"".join(hashlib.blake2b(k.encode(), digest_size=16).digest() for k in keys), np.uint64).reshape(-1, 2)
    return (raw[:, :1] + np.arange(HASHES, dtype=np.uint64) * (raw[:, 1:] | np.uint64(1))) % np.uint64(bits)


def _filter(t: pa.Table) -> pa.Table:
    """The Bloom filter of one bucket."""
    bits = max(64, -(-t.num_rows * BITS // 8) * 8)
    field_ = np.zeros(bits, bool)
    field_[_places(t.column("key").to_pylist(), bits).ravel()] = True
    return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(field_).tobytes()], pa.binary())})


def _passing(asked: pa.Table, filters: pa.Table) -> pa.Table:
    """The keys of one bucket that a segment's filter lets pass."""
    keys, out = asked.column("key").to_pylist(), {"segment": [], "bucket": [], "key": []}
    for segment, bits in zip(filters.column("segment").to_pylist(), filters.column("bits").to_pylist()):
        field_ = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for k in np.flatnonzero(field_[_places(keys, len(field_))].all(1)) if keys else ():
            out["segment"].append(segment)
            out["bucket"].append(asked.column("bucket")[int(k)].as_py())
            out["key"].append(keys[k])
    return pa.table({"segment": pa.array(out["segment"], pa.string()), "bucket": pa.array(out["bucket"], pa.int32()), "key": pa.array(out["key"], pa.string())})


@dataclass
class KeyStore:
    """The store in a folder. touched: the (segment, bucket) folders that the last lookup has read."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS
    touched: list[tuple[str, int]] = field(default_factory=list)

    def segments(self) -> list[tuple[int, int]]:
        """(first, last) batches of the segments that are whole."""
        at, fs = file_system(self.spark, self.root)
        if not fs.exists(at):
            return []
        names = [str(s.getPath().getName()) for s in fs.listStatus(at)]
        found = [tuple(map(int, m.groups())) for n in names if (m := re.fullmatch(r"filters-(\d+)-(\d+)", n))]
        return sorted(s for s in found if fs.exists(file_system(self.spark, f"{self.root}/filters-{s[0]}-{s[1]}/_SUCCESS")[0]))

    def before(self, batch: int) -> list[tuple[int, int]]:
        """The fewest segments that hold the batches 0 ... batch - 1, each once. Batches that have added nothing have none."""
        out, at = [], 0
        found = [s for s in self.segments() if s[1] < batch]
        while rest := [s for s in found if s[0] >= at]:
            first = min(s[0] for s in rest)
            out.append(max(s for s in rest if s[0] == first))
            at = out[-1][1] + 1
        return out

    def _with_buckets(self, keys: DataFrame) -> DataFrame:
        return keys.select(F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket"), "key").distinct()

    def known(self, keys: DataFrame, batch: int) -> DataFrame:
        """The keys (key string) that batches before this one have added."""
        self.touched = []
        held = self.before(batch)
        none = self.spark.createDataFrame([], "key string")
        if not held:
            return none
        filters = [self.spark.read.parquet(f"{self.root}/filters-{a}-{b}").withColumn("segment", F.lit(f"{a}-{b}")) for a, b in held]
        every = filters[0]
        for f in filters[1:]:
            every = every.unionByName(f)
        asked = self._with_buckets(keys)
        maybe = store(asked.groupBy("bucket").cogroup(every.groupBy("bucket")).applyInArrow(_passing, "segment string, bucket int, key string"), "maybe")
        self.touched = sorted(tuple(r) for r in maybe.select("segment", "bucket").distinct().collect())  # at most buckets x segments
        if not self.touched:
            drop_stored(maybe)
            return none
        paths = [f"{self.root}/keys-{s}/bucket={b}" for s, b in self.touched]
        rows = self.spark.read.schema("key string").parquet(*paths).join(maybe.select("key"), "key", "left_semi")
        found = store(rows.distinct(), "known")
        drop_stored(maybe)
        return found

    def _write(self, keys: DataFrame, first: int, last: int) -> None:
        name = f"{first}-{last}"
        keys.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/keys-{name}")
        written = self.spark.read.schema(KEYS).parquet(f"{self.root}/keys-{name}")
        written.groupBy("bucket").applyInArrow(_filter, "bucket int, bits binary").write.mode("overwrite").parquet(f"{self.root}/filters-{name}")

    def add(self, keys: DataFrame, batch: int) -> None:
        """Adds the keys of a batch, and merges segments of equal length. Whatever else holds this batch or later ones goes."""
        held = self.before(batch)
        for a, b in self.segments():
            if (a, b) not in held:
                self._drop(a, b)
        self._write(self._with_buckets(keys), batch, batch)
        first, last = batch, batch
        merged = []
        while held and held[-1][1] - held[-1][0] == last - first and held[-1][1] == first - 1:
            merged.append(held.pop())
            first = merged[-1][0]
        if merged:
            parts = [f"{self.root}/keys-{a}-{b}" for a, b in [*merged, (batch, batch)]]
            every = self.spark.read.schema(KEYS).parquet(parts[0])
            for p in parts[1:]:
                every = every.unionByName(self.spark.read.schema(KEYS).parquet(p))
            self._write(every, first, last)

    def _drop(self, first: int, last: int) -> None:
        for kind in ("filters", "keys"):  # without filters a segment is none
            at, fs = file_system(self.spark, f"{self.root}/{kind}-{first}-{last}")
            fs.delete(at, True)
