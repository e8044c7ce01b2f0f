"""A hierarchical Pitman-Yor language model, sampled by Gibbs and applied to whole texts.

Restaurants. The context of a token is the word before it (or the start of the text): a restaurant per word, of which
those with the same last two bytes share a parent, and all of these share the unigram restaurant, whose base is uniform
over the vocabulary and one unknown word. The suffix contexts are of a proven number (at most 65,793), so that their
customer and table totals are bounded vectors; the words, the word contexts with their totals, their counts and their
seating grow with the corpus and stay distributed.

Sampling. The seating and its Gibbs moves are those of seating.py; discounts and strengths of all levels are drawn before
every sweep. After the burn-in, predictive probabilities are averaged over the seatings of the remaining sweeps.

Data flow. Texts are tokenized once into batches (a written table: word numbers, the batch's distinct words). A batch
sends its distinct (word, word before) pairs with their training counts to buckets by the word's hash, one row for each
bucket that it has pairs for, so never more rows than pairs; all counts and tables of a word are in one bucket. Pairs are
written once; what a sweep changes is a table of its own. After a sweep each bucket sends one row per range of context
hashes with its customers and tables of those word contexts, and gets their sums over all buckets back. Buckets remember
where each batch's pairs stand; in the end they send each batch the probabilities of its pairs, and the batch adds up its
documents. A frequent word costs a pair per batch and context, not a row per token.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, sweep, trim
from .seating import DISCOUNTS, STRENGTHS, Seats, draw, restaurant_terms

START, CONTEXTS = 65536 + 256, 65536 + 257
#: Tokens of a batch and of a bucket.
BATCH, BUCKET = 750_000, 2_000_000
#: Discounts and strengths to begin with: the unigram restaurant, the suffix contexts, the word contexts.
DISCOUNT, STRENGTH = (0.55, 0.85, 0.85), (20.0, 5.0, 5.0)
BURN_IN, SAMPLES, FOLDS, HELD = 2, 3, 7, 2
_END = 0x9D3A7C51E2F04B86  # the end's hash; as a context, that of the start
#: Contexts are told apart by 48 bits of their hash, dishes by all 64.
_SHORT = np.uint64(16)

def _z(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; byte planes lie together, since most high bytes are 0."""
    out = []
    for a in arrays:
        flat = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize)
        out.append(np.array([flat.size], np.int64).tobytes())
        used = a.dtype.itemsize
        if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
            used = -(-int(a.max()).bit_length() // 8)
        out += [flat[:, k].tobytes() if k < used else bytes(len(flat)) for k in range(a.dtype.itemsize)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unz(blob: bytes, *kinds) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for k in kinds:
        n, size = int(np.frombuffer(data, np.int64, 1, at)[0]), np.dtype(k).itemsize
        planes = np.frombuffer(data, np.uint8, n, at + 8).reshape(size, -1)
        flat = np.zeros((n // size, size), np.uint8)
        for j in range(size):
            if planes[j].any():
                flat[:, j] = planes[j]
        out.append(flat.reshape(-1).view(k))
        at += 8 + n
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours, modulo the type; those of ordered numbers are small and compress better."""
    return np.diff(a, prepend=a.dtype.type(0))


def _sums(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)


def contexts_of(words) -> np.ndarray:
    """The suffix contexts of words: their last two bytes, or their only one."""
    flat, size = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
    last = np.cumsum(size) - 1
    return np.where(size > 1, flat[last - 1] * np.uint32(256), np.uint32(65536)) + flat[last]


def held_out(doc_id: int | None, folds: int = FOLDS, fold: int = HELD) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == fold


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so that words in the order of their hashes are in the order of their buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _keys(sizes: np.ndarray, flat: np.ndarray, end: int, h: np.ndarray, ctx: np.ndarray):
    """Where each document begins, for every token its (word, place of the word before as a context) as one number, and the
    words in the order of those places: that of suffixes, then hashes. The end, which is before no word, is the start."""
    order = np.lexsort((h >> _SHORT, ctx))
    place = np.empty(len(h), np.uint32)
    place[order] = np.arange(len(h), dtype=np.uint32)
    before = np.empty(len(flat), np.uint32)
    before[1:] = flat[:-1]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    before[starts] = end
    return starts, flat.astype(np.int64) << 32 | place[before], order


_CORPUS = "batch long, tokens long, train long, blob binary"
#: Documents (ids, null, held out, sizes), word numbers, hashes and suffixes of the words, and the end's number.
_BATCH = (np.int64, np.uint8, np.uint8, np.int64, np.uint32, np.uint64, np.uint32, np.int64)


def _split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, lower-cased, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    some = pc.greater(pc.binary_length(lists.flatten()), 0)  # white space at the ends of a text leaves empty words
    edge = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return lists.flatten().filter(some), np.diff(edge)


def _tokenize(batch: int):
    """Documents -> batches, with their words numbered in the order of their hashes."""

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        docs, sizes, tokens, total = [], [], [], 0

        def row():
            coded = pa.chunked_array(tokens).dictionary_encode().combine_chunks()
            words, size = coded.dictionary.cast(pa.binary()).to_pylist(), np.concatenate(sizes)
            n = len(words)
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
            ctx = contexts_of(words)
            # The end is one more word; as a context it is the start.
            h, ctx = np.append(h, np.uint64(_END)), np.append(ctx, np.uint32(START))
            order = np.argsort(h, kind="stable")
            rank = np.empty(n + 1, np.uint32)
            rank[order] = np.arange(n + 1, dtype=np.uint32)
            flat, end = np.empty(total, np.uint32), np.zeros(total, bool)
            end[np.cumsum(size) - 1] = True
            flat[end], flat[~end] = rank[n], rank[coded.indices.to_numpy()]
            ids = np.array([0 if d is None else d for d in docs], np.int64)
            null, held = np.array([d is None for d in docs], np.uint8), np.array([held_out(d) for d in docs], np.uint8)
            blob = _z(ids, null, held, size, flat, _steps(h[order]), ctx[order], np.array([rank[n]], np.int64))
            out = (part * (1 << 32) + made, len(flat), int(size[held == 0].sum()), blob)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["batch", "tokens", "train", "blob"])

        for b in batches:
            for at in range(0, b.num_rows, 64):
                words, size = _split(b.column(1).slice(at, 64))
                ids, edge, ends = b.column(0).slice(at, 64).to_pylist(), np.concatenate(([0], np.cumsum(size))), np.cumsum(size + 1)
                done = 0
                while done < len(ids):  # a batch ends with the document that fills it
                    before = ends[done - 1] if done else 0
                    stop = min(len(ids), int(np.searchsorted(ends, batch - total + before)) + 1)
                    docs += ids[done:stop]
                    sizes.append(size[done:stop] + 1)
                    tokens.append(words.slice(edge[done], edge[stop] - edge[done]))
                    total += int(ends[stop - 1] - before)
                    done = stop
                    if total >= batch:
                        yield row()
                        made += 1
                        docs, sizes, tokens, total = [], [], [], 0
                        trim()
        if docs:
            yield row()

    return run


#: Rows for buckets. kind 0: a bucket's pairs, 1: what a sweep changes, 2: totals of contexts, 3: where a batch's pairs stand.
PAIRS, TABLES, TOTALS, PLACES = range(4)
_ROWS = "bucket int, kind int, part long, blob binary"
_NAMES, _KINDS = ["bucket", "kind", "part", "blob"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _rows(rows: list[tuple], names=_NAMES, kinds=_KINDS) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


#: Words and their numbers of pairs, contexts (hashes, suffixes), the pairs' contexts and counts.
_PAIRS = (np.uint64, np.uint32, np.uint64, np.uint32, np.uint32, np.int64)


def _ask(buckets: int):
    """Batches -> what each sends to a bucket: its distinct words, their numbers of pairs, the contexts and training counts."""

    def run(batches):
        for b in batches:
            for name, blob in zip(b.column("batch").to_pylist(), b.column("blob")):
                _, _, held, size, flat, h, ctx, end = _unz(blob.as_py(), *_BATCH)
                h = _sums(h)
                _, key, order = _keys(size, flat, int(end[0]), h, ctx)
                both = np.sort(key << 1 | np.repeat(held, size).astype(np.int64))
                at = np.flatnonzero(np.concatenate(([True], (both[1:] >> 1) != (both[:-1] >> 1))))
                count = np.add.reduceat((both & 1) == 0, at, dtype=np.int64)
                pair = both[at] >> 1
                del both, key
                per = np.bincount(pair >> 32, minlength=len(h)).astype(np.uint32)
                pair = (pair & 0xFFFFFFFF).astype(np.uint32)
                edge = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
                pair_edge = np.concatenate(([0], np.cumsum(per, dtype=np.int64)))[edge]
                out = []
                for k in np.flatnonzero(edge[1:] > edge[:-1]):
                    w, p = slice(edge[k], edge[k + 1]), slice(pair_edge[k], pair_edge[k + 1])
                    seen, at = np.unique(pair[p], return_inverse=True)
                    out.append((int(k), PAIRS, name, _save(h[w], per[w], h[order[seen]] >> _SHORT, ctx[order[seen]], at.astype(np.uint32), count[p])))
                yield _rows(out)
                del pair, count, per, h, ctx, flat
                trim()

    return run


def _load(blob: bytes) -> list[np.ndarray]:
    h, per, before, suffix, at, count = _unz(blob, *_PAIRS)
    return [_sums(h), per, _sums(before), suffix, _sums(at), count]


def _save(words, per, before, suffix, at, count) -> bytes:
    return _z(_steps(words), per, _steps(before), suffix, _steps(at), count)


def _merge(t: pa.Table) -> pa.Table:
    """What all batches send to a bucket -> its words and pairs with their counts, contexts in the order of suffixes and
    hashes; and for each batch where its pairs and words stand among them, in its own order."""
    hs, pers, befores, suffixes, ats, counts, k = [], [], [], [], [], [], 0
    for blob in t.column("blob"):
        h, per, before, suffix, at, count = _load(blob.as_py())
        hs.append(h), pers.append(per), befores.append(before), suffixes.append(suffix), ats.append(at.astype(np.int64) + k), counts.append(count)
        k += len(before)
    edges, word_edges = (np.cumsum([0] + [len(x) for x in v]) for v in (ats, hs))
    words, own = np.unique(np.concatenate(hs), return_inverse=True)
    before, suffix = np.concatenate(befores), np.concatenate(suffixes)
    order = np.lexsort((before, suffix))
    new = np.concatenate(([True], (before[order[1:]] != before[order[:-1]]) | (suffix[order[1:]] != suffix[order[:-1]])))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    before, suffix = before[order[new]], suffix[order[new]]
    key = np.repeat(own, np.concatenate(pers)) << 32 | place[np.concatenate(ats)]
    del hs, pers, befores, suffixes, ats, place, order
    key, inv = np.unique(key, return_inverse=True)
    count = np.bincount(inv, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
    per, at = np.bincount(key >> 32, minlength=len(words)).astype(np.uint32), (key & 0xFFFFFFFF).astype(np.uint32)
    del key, counts
    rows = [(t.column("bucket")[0].as_py(), PAIRS, 0, _save(words, per, before, suffix, at, count))]
    for k, batch in enumerate(t.column("part").to_pylist()):
        pairs, ws = inv[edges[k] : edges[k + 1]], own[word_edges[k] : word_edges[k + 1]]
        rows.append((rows[0][0], PLACES, batch, _z(_steps(pairs.astype(np.uint32)), _steps(ws.astype(np.uint32)))))
    out = pa.Table.from_batches([_rows(rows)])
    del words, per, before, suffix, at, count, inv, own, rows
    trim()
    return out


class Bucket:
    """A bucket's pairs, and its dishes of each level: leaves, (word, suffix) and words."""

    def __init__(self, blob: bytes):
        self.words, per, self.before, self.suffix, self.at, self.count = _load(blob)
        self.order = np.argsort(self.before, kind="stable")
        word = np.repeat(np.arange(len(per)), per)
        key = word << 17 | self.suffix[self.at].astype(np.int64)
        new = np.concatenate(([True], key[1:] != key[:-1]))  # pairs are in the order of words and, as contexts are, of suffixes
        self.over = np.cumsum(new) - 1
        self.word, self.ctx = key[new] >> 17, key[new] & 0x1FFFF

    def seats(self, tables: list[np.ndarray], leaf: tuple, totals: tuple, hyper: tuple, vocabulary: int) -> Seats:
        (n1, m1), (n0, m0) = totals
        places = [np.zeros(len(self.words), np.int64), self.ctx, self.at.astype(np.int64)]
        return Seats(self.count, tables, [None, self.word, self.over], places, [n0, n1, leaf[0]], [m0, m1, leaf[1]], *hyper, vocabulary)


_STATE = f"{_ROWS}, idx array<int>, n array<long>, m array<long>, terms array<double>"
_STATE_NAMES = [*_NAMES, "idx", "n", "m", "terms"]
_STATE_KINDS = [*_KINDS, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
#: Places of the root's totals and of the vocabulary's size among those of the suffix contexts.
_ROOT, _SIZE = CONTEXTS, CONTEXTS + 1


def _put(bucket: int, b: Bucket, t: list[np.ndarray], mean: np.ndarray, terms: np.ndarray, buckets: int, more: bool) -> list[tuple]:
    """The rows that hold a bucket's seating: its tables with totals by suffix context, and (for a next sweep) its
    customers and tables of word contexts, one row for each range of their hashes."""
    c1 = np.bincount(b.over, t[2], minlength=len(t[1]))
    n, m = np.bincount(b.ctx, c1, minlength=CONTEXTS), np.bincount(b.ctx, t[1], minlength=CONTEXTS)
    hit = np.flatnonzero(n)
    idx = np.concatenate((hit, [_ROOT, _SIZE])).astype(np.int32)
    n, m = np.concatenate((n[hit], [t[1].sum(), (t[0] > 0).sum()])).astype(np.int64), np.concatenate((m[hit], [t[0].sum(), 0])).astype(np.int64)
    out = [(bucket, TABLES, 0, _z(t[2], t[1], t[0], mean), idx, n, m, terms.reshape(-1))]
    if more:
        h = b.before[b.order]
        n, m = (np.bincount(b.at, v, minlength=len(h)).astype(np.int64)[b.order] for v in (b.count, t[2]))
        edge = np.searchsorted(bucket_of(h << _SHORT, buckets), np.arange(buckets + 1))
        out += [(bucket, TOTALS, int(k), _z(_steps(h[edge[k] : edge[k + 1]]), n[edge[k] : edge[k + 1]], m[edge[k] : edge[k + 1]]), None, None, None, None) for k in np.flatnonzero(edge[1:] > edge[:-1])]
    return out


def _begin(buckets: int):
    """Pairs -> a seating with one table for every dish that has customers."""

    def run(batches):
        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob")):
                own = Bucket(blob.as_py())
                t2 = (own.count > 0).astype(np.int64)
                t1 = (np.bincount(own.over, t2, minlength=len(own.word)) > 0).astype(np.int64)
                t0 = (np.bincount(own.word, t1, minlength=len(own.words)) > 0).astype(np.int64)
                yield _rows(_put(bucket, own, [t0, t1, t2], np.zeros(len(t2), np.float32), np.zeros(0), buckets, True), _STATE_NAMES, _STATE_KINDS)
                del own, t2, t1, t0
                trim()

    return run


def _sum_contexts(t: pa.Table) -> pa.Table:
    """The sums over all buckets, for each bucket those of the contexts that it sent; and which of them it sent first."""
    sent = [_unz(blob.as_py(), np.uint64, np.int64, np.int64) for blob in t.column("blob")]
    _, first, inv = np.unique(np.concatenate([_sums(x[0]) for x in sent]), return_index=True, return_inverse=True)
    n, m = (np.bincount(inv, np.concatenate([x[k] for x in sent])).astype(np.int64)[inv] for k in (1, 2))
    own = np.zeros(len(inv), np.uint8)
    own[first] = 1
    edge = np.cumsum([0] + [len(x[0]) for x in sent])
    out = [_z(n[a:b], m[a:b], own[a:b]) for a, b in zip(edge[:-1], edge[1:])]
    return pa.table({"bucket": t.column("bucket"), "kind": t.column("kind"), "part": t.column("part"), "blob": pa.array(out, pa.binary())})


def _sweep(totals, hyper, vocabulary: int, seed: int, buckets: int, step: str, add: bool):
    """One sweep over a bucket: step is `seat`, `move` or `none`; add: also adds the predictions of the seating at hand."""

    def run(t: pa.Table) -> pa.Table:
        bucket, kind, blobs = t.column("bucket")[0].as_py(), np.array(t.column("kind").to_pylist()), t.column("blob")
        own = Bucket(blobs[int(np.flatnonzero(kind == PAIRS)[0])].as_py())
        t2, t1, t0, mean = _unz(blobs[int(np.flatnonzero(kind == TABLES)[0])].as_py(), np.int64, np.int64, np.int64, np.float32)
        part = t.column("part").to_pylist()
        got = [_unz(blobs[k].as_py(), np.int64, np.int64, np.uint8) for k in sorted(map(int, np.flatnonzero(kind == TOTALS)), key=part.__getitem__)]
        n, m, first = (np.empty(len(own.order), k) for k in (np.float64, np.float64, bool))
        for k, x in enumerate((n, m, first)):
            x[own.order] = np.concatenate([g[k] for g in got])
        seats = own.seats([t0, t1, t2], (n, m), totals, hyper, vocabulary)
        if add:
            mean = mean + seats.predict().astype(np.float32)
        rng = np.random.default_rng([seed, bucket])
        terms = np.zeros(0)
        if step == "seat":
            seats.seat_all(rng)
        elif step == "move":
            seats.sweep(rng)
        if step != "none":
            # What the next draw of discounts and strengths needs; the contexts' part is that of the sums that came in.
            by_d, by_s = restaurant_terms(n[first], m[first], hyper[0][2], hyper[1][2])
            terms = np.concatenate((by_d, seats.dish_terms().reshape(-1), by_s))
        out = _rows(_put(bucket, own, seats.t, mean, terms, buckets, step != "none"), _STATE_NAMES, _STATE_KINDS)
        del own, seats, t2, t1, t0, mean, got, n, m, first
        trim()
        return pa.Table.from_batches([out])

    return run


def totals_of(state: DataFrame):
    """Customers and tables of the suffix restaurants and the root as vectors of fixed lengths, the vocabulary's size, and
    the summed terms for discounts and strengths (of all dishes, and of the word contexts)."""
    own = state.where(F.col("kind") == TABLES)
    rows = own.select(F.explode(F.arrays_zip("idx", "n", "m")).alias("x")).groupBy("x.idx").agg(F.sum("x.n").alias("n"), F.sum("x.m").alias("m")).collect()
    n, m = np.zeros(CONTEXTS + 2), np.zeros(CONTEXTS + 2)
    for r in rows:
        n[r["idx"]], m[r["idx"]] = r["n"], r["m"]
    terms = np.zeros(4 * len(DISCOUNTS) + len(STRENGTHS))
    for r in own.select(F.posexplode("terms").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():
        terms[r["k"]] = r["x"]
    return ((n[:CONTEXTS], m[:CONTEXTS]), (n[_ROOT : _ROOT + 1], m[_ROOT : _ROOT + 1])), int(n[_SIZE]), terms


def _hyper(hyper, totals, terms: np.ndarray, rng):
    """Discounts and strengths of the three levels, each drawn given the others and the seating."""
    (n1, m1), (n0, m0) = totals
    (d0, d1, d2), (s0, s1, s2) = hyper
    size = len(DISCOUNTS)
    dishes = terms[size : 4 * size].reshape(3, size)
    of = [restaurant_terms(n0, m0, d0, s0), restaurant_terms(n1, m1, d1, s1), (terms[:size], terms[4 * size :])]
    return tuple(draw(of[k][0] + dishes[k], DISCOUNTS, rng) for k in range(3)), tuple(draw(of[k][1], STRENGTHS, rng) for k in range(3))


_ANSWERS = "batch long, bucket int, blob binary"


def _answer(samples: int):
    """A bucket's pairs and state, and where the batches' pairs stand -> for each batch P of its pairs and its words' counts."""

    def run(t: pa.Table) -> pa.Table:
        kind, blobs, batch, out = np.array(t.column("kind").to_pylist()), t.column("blob"), [], []
        words, per, *_, count = _load(blobs[int(np.flatnonzero(kind == PAIRS)[0])].as_py())
        mean = _unz(blobs[int(np.flatnonzero(kind == TABLES)[0])].as_py(), np.int64, np.int64, np.int64, np.float32)[3] / samples
        count = np.bincount(np.repeat(np.arange(len(words)), per), count, minlength=len(words)).astype(np.int64)
        for k in np.flatnonzero(kind == PLACES):
            pairs, ws = (_sums(x) for x in _unz(blobs[int(k)].as_py(), np.uint32, np.uint32))
            batch.append(t.column("part")[int(k)].as_py())
            out.append(_z(count[ws], mean[pairs].astype(np.float32)))
        bucket = t.column("bucket")[0].as_py()
        del words, per, mean, count
        trim()
        return pa.table({"batch": pa.array(batch, pa.int64()), "bucket": pa.array([bucket] * len(batch), pa.int32()), "blob": pa.array(out, pa.binary())})

    return run


def _add_up(n: int, vocabulary: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        ids, null, held, sizes, flat, h, ctx, end = _unz(left.column("blob")[0].as_py(), *_BATCH)
        starts, key, _ = _keys(sizes, flat, int(end[0]), _sums(h), ctx)
        answers = {k: _unz(b.as_py(), np.int64, np.float32) for k, b in zip(right.column("bucket").to_pylist(), right.column("blob"))}
        order = sorted(answers)
        count, logp = np.concatenate([answers[k][0] for k in order]), np.log10(np.concatenate([answers[k][1] for k in order]).astype(np.float64))
        _, inv = np.unique(key, return_inverse=True)
        c = count[key >> 32]
        cols = [
            pa.array(ids, pa.int64(), mask=null.astype(bool)),
            pa.array(held.astype(bool)),
            pa.array(sizes),
            pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
            pa.array(np.full(len(ids), n, np.int64)),
            pa.array(np.add.reduceat(np.log10((c + 1) / (n + vocabulary + 1)), starts)),
            pa.array(np.add.reduceat(logp[inv], starts)),
        ]
        del key, inv, c, count, logp, answers
        trim()
        return pa.table(cols, names=names)

    return run


def score(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, batch: int = BATCH, bucket: int = BUCKET, seed: int = 5) -> DataFrame:
    """log10 probabilities of whole texts under the model and under the add-one unigram base.

    docs: doc_id long, text string; other columns are ignored. Returns doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score, one row per input row. A null text is an empty one: its only token is the
    end. Rows with a null doc_id are scored, counted as held out and not learnt from. Repeated rows are learnt from
    and scored as often as they occur. Without training rows the probability of every token is that of the base's
    only word, 1. An empty table gives an empty result. burn_in (the first seating included) and samples are numbers of
    sweeps, one at least.
    """
    if burn_in < 1 or samples < 1:
        raise ValueError("burn_in and samples must be 1 or more")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    corpus = materialize(docs.mapInArrow(_tokenize(batch), _CORPUS), "lm-corpus")
    r = corpus.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("train"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    n, buckets = r["train"], max(1, -(-r["tokens"] // bucket))
    pairs = materialize(corpus.select("batch", "blob").mapInArrow(_ask(buckets), _ROWS).groupBy("bucket").applyInArrow(_merge, _ROWS), "lm-pairs")
    own = pairs.where(F.col("kind") == PAIRS)
    sweep(spark)
    state = materialize(own.mapInArrow(_begin(buckets), _STATE), "lm-state")
    hyper, rng, names = (DISCOUNT, STRENGTH), np.random.default_rng(seed), ["bucket", "kind", "part", "blob"]
    for k in range(burn_in + samples):
        totals, vocabulary, terms = totals_of(state)
        if k and vocabulary:
            hyper = _hyper(hyper, totals, terms, rng)
        step = "seat" if not k else "none" if k == burn_in + samples - 1 else "move"
        sums = state.where(F.col("kind") == TOTALS).select(*names).groupBy("part").applyInArrow(_sum_contexts, _ROWS)
        rows = own.union(state.where(F.col("kind") == TABLES).select(*names)).union(sums)
        nxt = materialize(rows.groupBy("bucket").applyInArrow(_sweep(totals, hyper, vocabulary, seed + k, buckets, step, k >= burn_in), _STATE), "lm-state")
        release(state)
        state = nxt
        del sums, rows, nxt
        sweep(spark)
    rows = pairs.union(state.select(*names))
    answers = materialize(rows.groupBy("bucket").applyInArrow(_answer(samples), _ANSWERS), "lm-answers")
    release(pairs, state)
    del rows
    sweep(spark)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return corpus.select("batch", "blob").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_add_up(n, vocabulary), schema)
