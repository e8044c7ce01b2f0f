"""Best-fit-decreasing packing of tokenized documents into windows of a fixed capacity.

Each document is tokenized whole and gets an end id; documents longer than the capacity are first cut into full
windows. The remaining pieces are dealt into shards of a bounded number of pieces (their count grows with the
data), and each shard is packed by best-fit decreasing: pieces go from the longest to the shortest, and a segment
tree indexed by remaining capacity finds the tightest open window in log2(capacity) steps. Only piece lengths and
checksums are shuffled, never text or ids.

The ids are those of the byte-level BPE file that `tokenizers` reads. They are computed by tiktoken's engine, which
is built from the vocabulary of that same file and is four times as fast; the engine is compared with `tokenizers`
on probe texts when it is loaded, and in the tests on whole tables.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, END, SHARD = 2048, 1, 20_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PROBES = ["", "Hello  world's 123 \n\n\t déjà vu, naïve 漢字 🙂 </s>  x", "<|endoftext|> a<|endoftext|>"]


@lru_cache(maxsize=1)
def encoder(path: str | None = None):
    """A function from a text to the ids that `tokenizers` gives it with the file at path."""
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    path = path or P.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    # Byte-level files write each byte as a visible character: printable ones as themselves, the rest from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    enc = tiktoken.Encoding("byte_bpe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    encode = lambda text: enc.encode_to_numpy(text, allowed_special="all")
    own = Tokenizer.from_file(path)
    for t in _PROBES:
        if own.encode(t, add_special_tokens=False).ids != encode(t).tolist():
            raise ValueError(f"the engines differ on {path}")
    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Full windows of a document of n ids and what remains, as (start, length)."""
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)]


def _pieces(capacity: int, end: int, path: str | None):
    def run(batches):
        encode = encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                rows += [(doc, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in cut(len(ids), capacity)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of counts."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, cap: int, by: int) -> None:
        k = cap + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, cap: int, window: int) -> None:
        if cap:
            self.at[cap].append(window)
            self._add(cap, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least capacity of need or more: (capacity, window)."""
        k = need + self.size
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        cap = k - self.size
        self._add(cap, -1)
        return cap, self.at[cap].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece."""
    open_, used = OpenWindows(capacity), 0
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        n = int(lengths[k])
        if found := open_.tightest(n):
            cap, w = found
        else:
            cap, w, used = capacity, used, used + 1
        window[k], offset[k] = w, capacity - cap
        open_.put(cap - n, w)
    return window, offset


def _pack(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        window, offset = best_fit_decreasing(t.column("length").to_numpy(), capacity)
        seq = t.column("shard")[0].as_py() * (1 << 32) + window
        out = t.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, shard: int = SHARD) -> DataFrame:
    """Packs documents into sequences; one row per piece.

    docs: doc_id long, text string; other columns are ignored. Returns doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id and offset. A null text is an empty one: its only id is the end. Repeated rows are
    packed as often as they occur; rows with a null doc_id are packed too. An empty table gives an empty result.
    Within a sequence the offsets are gapless from 0.
    """
    from .common import materialize

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(docs.mapInArrow(_pieces(capacity, end, tokenizer), PIECE), "pieces")
    shards = max(1, -(-pieces.count() // shard))
    # Repeated rows share all their values, so their place in the written table deals them out as well.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", F.col("_metadata.row_index")), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack(capacity), f"{PIECE}, sequence_id long, offset long")
