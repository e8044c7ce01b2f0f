"""Nearest neighbours by additive quantisation.

A vector is approximated by the sum of one codeword from each of M full-dimensional codebooks. The codebooks are
trained on the residuals of a bounded sample and then refitted together by least squares on that sample's beam-search
codes. Every row is encoded by beam search and stored with its codes, the norm of its approximation and that of the
rest. A search looks up inner products of the query with all codewords, adds M table entries per row, takes the best
rows of each block by that score and scores them exactly in double precision. Then it scores all other rows that could
still be among the nearest: those whose lookup score, with the norm of the rest as the bound of its error, reaches the
last of the best. The result is thus that of an exact search, also where many near copies have the same codes.

Queries and rows meet in blocks (query block x data block) of bounded size; each block keeps its best `top` rows
per query, and these are merged by rank. No part of it holds more than a block. A row is sent once for each block of
queries and a query once for each block of rows, so large blocks keep the shuffle small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, materialize

#: Codebooks, codewords in each, beam width, rows of the training sample, rows of each block that are scored exactly first.
BOOKS, WORDS, BEAM, SAMPLE, RERANK = 48, 64, 8, 16_384, 320
DATA_BLOCK, QUERY_BLOCK = 16_384, 16_384
#: Rows of a block that are scored at once after the first ones.
PIECE = 512


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes (n, M) that beam search finds for the rows of x."""
    n, m = len(x), len(books)
    codes = np.zeros((n, 1, m), np.uint8)
    rest, norms = x[:, None, :], (books**2).sum(2)
    for k in range(m):
        width = rest.shape[1]
        # Squared error after a codeword, without the part that is the same for all.
        err = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(n * width, -1) @ books[k].T).reshape(n, width, -1) + norms[k]
        err = err.reshape(n, -1)
        take = min(beam, err.shape[1])
        best = np.argpartition(err, take - 1, axis=1)[:, :take]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(err, best, 1), 1, kind="stable"), 1)
        old, word = best // books.shape[1], best % books.shape[1]
        codes = np.take_along_axis(codes, old[:, :, None], 1)
        codes[:, :, k] = word
        rest = np.take_along_axis(rest, old[:, :, None], 1) - books[k][word]
    return codes[:, 0]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[k][codes[:, k]] for k in range(len(books)))


def train(x: np.ndarray, books: int, words: int, beam: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Codebooks (M, words, d) from residual k-means, refitted by ridge least squares on their beam-search codes."""
    rng, words = np.random.default_rng(seed), max(1, min(words, len(x)))
    rest, out = x.copy(), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            near = ((c**2).sum(1)[None] - 2 * rest @ c.T).argmin(1)
            size = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            full = np.flatnonzero(size)
            c[full] = np.add.reduceat(rest[order], np.concatenate(([0], np.cumsum(size[full])[:-1])), axis=0) / size[full][:, None]
        near = ((c**2).sum(1)[None] - 2 * rest @ c.T).argmin(1)
        out.append(c)
        rest = rest - c[near]
    c = np.stack(out).astype(np.float32)
    codes = np.concatenate([encode(x[s : s + 1024], c, beam) for s in range(0, len(x), 1024)])
    flat = codes.astype(np.int64) + np.arange(books) * words
    gram, rhs = np.zeros((books * words, books * words)), np.zeros((books * words, x.shape[1]))
    for a in range(books):
        np.add.at(rhs, flat[:, a], x)
        for b in range(books):
            both = np.bincount(codes[:, a].astype(np.int64) * words + codes[:, b], minlength=words * words)
            gram[a * words : (a + 1) * words, b * words : (b + 1) * words] = both.reshape(words, words)
    prior = c.reshape(-1, x.shape[1])  # a codeword that is not used stays what it was
    gram[np.diag_indices(len(gram))] += 0.1
    return np.linalg.solve(gram, rhs + 0.1 * prior).reshape(c.shape).astype(np.float32)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _encoder(books: np.ndarray, beam: int):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), books.shape[2])
            codes = np.concatenate([encode(x[s : s + 512].astype(np.float32), books, beam) for s in range(0, len(x), 512)] or [np.zeros((0, len(books)), np.uint8)])
            near = decode(codes, books.astype(np.float64))
            norm, rest = (near**2).sum(1), np.sqrt(((x - near) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(norm), pa.array(rest)], names=["vec_id", "vec", "codes", "norm", "rest"])

    return run


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, added component by component in their order, as SQL adds them."""
    return np.add.accumulate(np.multiply(x.T, y.T, order="C"), axis=0)[-1]  # reduce() would add those of a single row by halves


def exact_scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """The measure in double precision, larger is nearer; equal rows get equal scores."""
    q = q[None]
    if metric == "ip":
        return _products(x, q)
    if metric == "l2":
        return -_products(x - q, x - q)
    return _products(x, q) / np.sqrt(_products(x, x)) / np.sqrt(_products(q, q))


def quick_scores(q: np.ndarray, x: np.ndarray, length: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The measure as the fastest sums give it, and how far the exact ones can be above. length: the norms of x."""
    slack, size = 1e-14 * x.shape[1], np.sqrt((q * q).sum())
    if metric == "l2":
        away = x - q
        score = -np.einsum("nd,nd->n", away, away)
        return score, -slack * score
    if metric == "ip":
        return x @ q, slack * size * length
    return x @ q / length / size, np.full(len(x), slack)


def bounds(dot: np.ndarray, slack: float, q: np.ndarray, length: np.ndarray, norm: np.ndarray, rest: np.ndarray, metric: str) -> np.ndarray:
    """What the exact scores cannot exceed. dot: the query's products with the approximations, wrong by slack at most;
    length: the rows' norms, norm: the approximations' squared ones, rest: the norms of their differences."""
    size = np.sqrt((q * q).sum())
    if metric == "l2":
        away = np.sqrt(np.maximum(size * size - 2 * (dot + slack) + norm, 0.0))
        return -(np.maximum(away - rest, 0.0) ** 2)
    most = dot + slack + size * rest
    return most if metric == "ip" else most / length / size


def _search(books: np.ndarray, metric: str, top: int, rerank: int):
    dim, m = books.shape[2], len(books)

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        out: list[list] = [[], [], []]
        if data.num_rows and queries.num_rows:
            data = data.sort_by("vec_id")
            ids, norm, rest = (data.column(c).to_numpy() for c in ("vec_id", "norm", "rest"))
            x = np.frombuffer(b"".join(data.column("vec").to_pylist()), np.float64).reshape(-1, dim)
            codes = np.frombuffer(b"".join(data.column("codes").to_pylist()), np.uint8).reshape(-1, m)
            qid = queries.column("query_id").to_numpy()
            q = np.frombuffer(b"".join(queries.column("vec").to_pylist()), np.float64).reshape(-1, dim)
            take, length = min(rerank, len(ids)), np.sqrt((x * x).sum(1))
            # Of sums in single precision, relative to the product of the norms.
            inexact = 4 * (dim + m) * float(np.finfo(np.float32).eps) * float(np.sqrt((books.astype(np.float64) ** 2).sum(2)).max(1).sum())
            for s in range(0, len(q), 64):
                lookup = books @ q[s : s + 64].astype(np.float32).T
                total = np.zeros((len(ids), lookup.shape[2]), np.float32)
                entry = np.empty_like(total)
                for k in range(m):
                    total += np.take(lookup[k], codes[:, k], axis=0, out=entry, mode="clip")
                dot = guess = np.ascontiguousarray(total.T)
                if metric == "l2":
                    guess = 2 * guess - norm.astype(np.float32)
                elif metric == "cosine":
                    guess = guess / np.sqrt(np.maximum(norm, 1e-30)).astype(np.float32)
                for k, row in enumerate(guess):
                    least = np.partition(row, len(row) - take)[len(row) - take]
                    more = np.flatnonzero(row > least)
                    pick = np.concatenate((more, np.flatnonzero(row == least)[: take - len(more)]))  # of equals, the smallest ids
                    pick = pick[ids[pick] != qid[s + k]]
                    score = exact_scores(q[s + k], x[pick], metric)
                    best = np.lexsort((ids[pick], -score))[:top]
                    pick, score = pick[best], score[best]
                    most = bounds(dot[k].astype(np.float64), inexact * np.sqrt((q[s + k] ** 2).sum()), q[s + k], length, norm, rest, metric)
                    last = score[-1] if len(pick) == top else -np.inf
                    more = np.flatnonzero((most >= last) & (ids != qid[s + k]))
                    more = np.setdiff1d(more, pick, assume_unique=True)
                    more = more[np.argsort(-most[more])]
                    for a in range(0, len(more), PIECE):
                        last = score[-1] if len(pick) == top else -np.inf
                        some = more[a : a + PIECE]
                        if most[some[0]] < last:
                            break
                        some = some[most[some] >= last]
                        near, above = quick_scores(q[s + k], x[some], length[some], metric)
                        some = some[near + above >= last]
                        if not len(some):
                            continue
                        pick = np.concatenate((pick, some))
                        score = np.concatenate((score, exact_scores(q[s + k], x[some], metric)))
                        best = np.lexsort((ids[pick], -score))[:top]
                        pick, score = pick[best], score[best]
                    out[0].append(np.full(len(pick), qid[s + k]))
                    out[1].append(ids[pick])
                    out[2].append(score)
        cat = [np.concatenate(v) if v else np.zeros(0) for v in out]
        return pa.table([pa.array(cat[0].astype(np.int64)), pa.array(cat[1].astype(np.int64)), pa.array(cat[2].astype(np.float64))], names=names)

    return run


def usable(v: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def build_index(vectors: DataFrame, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray] | None:
    """The written index (vec_id, vec, codes, norm, rest) and the codebooks; None if no vector is usable.

    vectors: vec_id long, embedding array; other columns are ignored. Null vectors, zero vectors, vectors with null
    or non-finite components, or with a null vec_id take no part. Shorter vectors count as if zeros followed them. Rows that
    repeat a vec_id count once, with the smallest vector.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    dim = rows.agg(F.max(F.size("embedding"))).first()[0]
    if dim is None:
        return None
    rows = rows.withColumn("embedding", F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("embedding"))))
    picked = bounded_sample(rows.select("vec_id", "embedding"), sample, "vec_id", salt=11).toArrow()
    x = _matrix(picked.column("embedding").combine_chunks(), dim).astype(np.float32)
    learnt = train(x, books, words, beam)
    index = rows.mapInArrow(_encoder(learnt, beam), "vec_id long, vec binary, codes binary, norm double, rest double")
    return materialize(index, "aq-index"), learnt


def search(index: DataFrame, books: np.ndarray, queries: DataFrame, top: int = 20, metric: str = "ip", rerank: int = RERANK) -> DataFrame:
    """The `top` nearest rows of the index for each query (query_id, vec): query_id, rank, vec_id, score.

    Nearest first by ip, l2 or cosine, ties to the smaller vec_id; a query never finds its own vec_id.
    """
    nd = max(1, -(-index.count() // DATA_BLOCK))
    nq = max(1, -(-queries.count() // QUERY_BLOCK))
    data = index.withColumn("bd", F.pmod(F.xxhash64("vec_id"), F.lit(nd)).cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    asked = queries.withColumn("bq", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn("bd", F.explode(F.sequence(F.lit(0), F.lit(nd - 1))))
    found = data.groupBy("bd", "bq").cogroup(asked.groupBy("bd", "bq")).applyInArrow(_search(books, metric, top, rerank), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, top: int = 20, metric: str = "ip", **fit) -> DataFrame:
    """Searches all rows for the nearest of each row whose vec_id is divisible by `every`. An empty table gives an empty result."""
    built = build_index(vectors, **fit)
    if built is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, books = built
    return search(index, books, index.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec"), top, metric)
