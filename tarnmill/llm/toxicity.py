"""Toxicity scores through noisy-channel deobfuscation.

1. A character trigram model is counted over the words of all documents (letters folded to a-z; 28 symbols, so its
   size is fixed).
2. Suspicious strings - letters mixed with digits or signs, letters repeated three times or more, letters set apart by
   spaces or signs - become lattices: a sign may stand for the letters that it imitates, a repeated letter or a
   separator may be noise. Viterbi decoding under the character model finds the likeliest clean string.
3. A word is judged by its character 4- and 5-grams, in the form written and in the form restored. The weight of a
   gram is a cautious log ratio of how many toxic and other documents hold it, from a bounded sample of labelled
   documents; a word weighs as much as its third heaviest gram, so that colliding hashes count for little.
4. A logistic model over the heaviest word and the sum of all gives the score. It is fitted on labelled documents
   that the weights were not taken from.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0. Only the text is an input of the score.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

SYMBOLS = 28  # 0: edge of a word, 1-26: a-z, 27: any other letter
BUCKETS = 1 << 20
#: A word weighs as much as its gram of this rank: a real marker has several heavy grams, a collision of hashes one.
RANK = 3
#: Labelled documents that are learnt from, at most.
SAMPLE = 20_000
FOLDS, HELD, CALIBRATION = 5, 0, 4
#: The letters that a sign or digit imitates.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "%": "o", "&": "a"}
SEPARATORS = set(".-_~*'`,:;/\\ ")
SIGN_COST, REPEAT_COST, SEPARATOR_COST = 1.5, 0.7, 0.5
#: A suspicious string holds a letter and a sign or digit, or a character three times running, or letters set apart by one sign.
_SIGN, _LETTER = re.compile(r"[0-9@$!|+(<*#%&]"), re.compile(r"[a-z]")
_ODD = re.compile(r"(.)\1\1|[a-z]([.\-_~*'`,:;/\\])[a-z]\2[a-z]", re.S)
_EDGES = re.compile(r"^[^a-z0-9@$!|(<*]+|[^a-z0-9@$|*]+$")
_LETTERS = re.compile(r"[^\W\d_]+")


def fold(token: str) -> str:
    if token.isascii():
        return token.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", token.lower()) if not unicodedata.combining(c))


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def symbols_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as symbols, each between edges (two before it, one after it), and the length of each such string."""
    data = np.frombuffer(("\x01\x01" + "\x01\x01\x01".join(words) + "\x01").encode("utf-32-le"), np.uint32)
    out = np.where((data >= 97) & (data <= 122), data - 96, 27)
    out[data == 1] = 0
    return out.astype(np.int64), np.fromiter((len(w) + 3 for w in words), np.int64, len(words))


def _count_trigrams(batches):
    counts = np.zeros(SYMBOLS**3, np.int64)
    for b in batches:
        seen: dict[str, int] = {}
        for text in b.column(0):
            for t in (text.as_py() or "").split():
                seen[t] = seen.get(t, 0) + 1
        pairs = [(w, n) for t, n in seen.items() for w in _LETTERS.findall(fold(t))]
        if pairs:
            s, size = symbols_of([w for w, _ in pairs])
            tri = s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:]
            own = np.repeat([n for _, n in pairs], size)[:-2]
            ok = (s[2:] > 0) | (s[1:-1] > 0)  # without the gaps between words
            counts += np.bincount(tri[ok], own[ok], minlength=SYMBOLS**3).astype(np.int64)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["gram", "n"])


def char_model(texts: DataFrame) -> np.ndarray:
    """log P(c | a, b) as an array [a, b, c], interpolated with its lower orders; a vector of fixed size."""
    rows = texts.select("text").mapInArrow(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    c = np.zeros(SYMBOLS**3)
    c[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    c = c.reshape((SYMBOLS,) * 3)
    uni = (c.sum((0, 1)) + 1) / (c.sum() + SYMBOLS)
    bi = (c.sum(0) + 10 * uni) / (c.sum(0).sum(1, keepdims=True) + 10)
    return np.log((c + 10 * bi) / (c.sum(2, keepdims=True) + 10))


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest clean string for a folded token of any length: Viterbi over the lattice of what its characters stand for."""
    # The best path to each pair of last symbols: its score and its letters, as a chain from the last one back.
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    last = ""
    for c in token:
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        steps: list[tuple[str, float]] = []
        if c.isalpha():
            steps.append((c, 0.0))
            if c == last:
                steps.append(("", REPEAT_COST))
        else:
            steps += [(x, SIGN_COST) for x in LEET.get(c, "")]
            if c in SEPARATORS or c not in LEET:
                steps.append(("", SEPARATOR_COST))
            elif c == last:
                steps.append(("", REPEAT_COST))
        for (a, b), (p, out) in paths.items():
            for letter, cost in steps:
                if letter:
                    s = symbol(letter)
                    key, q, o = (b, s), p - cost + model[a, b, s], (letter, out)
                else:
                    key, q, o = (a, b), p - cost, out
                if key not in nxt or q > nxt[key][0]:
                    nxt[key] = (q, o)
        paths, last = nxt, c
    _, chain = max(((p + model[a, b, 0], o) for (a, b), (p, o) in paths.items()), key=lambda x: x[0])
    letters = []
    while chain:
        letter, chain = chain
        letters.append(letter)
    return "".join(reversed(letters))


def restored(token: str, model: np.ndarray) -> list[str]:
    """The decoded forms of a folded token, if it is suspicious."""
    core = _EDGES.sub("", token)
    if len(core) < 3 or not _LETTER.search(core) or not (_SIGN.search(core) or _ODD.search(core)):
        return []
    word = decode(core, model)
    # The lattice keeps a run of letters if the model likes it; the collapsed form is a reading too.
    return [w for w in dict.fromkeys((word, re.sub(r"(.)\1+", r"\1", word))) if w]


def forms(token: str, model: np.ndarray) -> list[str]:
    t = fold(token)
    return [w for w in _LETTERS.findall(t) if len(w) > 1] + restored(t, model)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 4- and 5-grams of words with their edges, and the number of the word that each comes from."""
    data = np.frombuffer(("\x01" + "\x01\x01".join(words) + "\x01").encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    own, end = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size)
    out, at = [], []
    for n in (4, 5):
        h = np.full(max(0, len(data) - n + 1), n, np.uint64)
        for k in range(n):
            h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        ok = np.arange(len(h)) + n <= end[: len(h)]
        out.append((h[ok] >> np.uint64(20)) % np.uint64(BUCKETS))
        at.append(own[: len(h)][ok])
    return np.concatenate(out).astype(np.int64), np.concatenate(at)


class Reader:
    """Turns texts into token numbers, with what every distinct token reads as; memory is bounded by a batch."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def read(self, texts: list) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """(token number of each token, texts' ends, forms of each token); spelt-out letters are tokens of their own."""
        numbers: dict[str, int] = {}
        flat: list[int] = []
        ends = []
        for text in texts:
            tokens = (text or "").lower().split()
            flat += [numbers.setdefault(t, len(numbers)) for t in tokens]
            run: list[str] = []
            if sum(map(len, tokens)) < 3 * len(tokens) or any(len(a) == len(b) == len(c) == 1 for a, b, c in zip(tokens, tokens[1:], tokens[2:])):
                for t in [*tokens, ""]:
                    if len(t) == 1:
                        run.append(t)
                    else:
                        if len(run) > 2:
                            flat.append(numbers.setdefault(" ".join(run), len(numbers)))
                        run = []
            ends.append(len(flat))
        read = []
        for t in numbers:
            if " " in t:
                word = decode(fold(t), self.model)
                read.append(list(dict.fromkeys(w for w in (word, re.sub(r"(.)\1+", r"\1", word)) if w)))
            else:
                read.append(forms(t, self.model))
        return np.array(flat, np.int64), np.array(ends, np.int64), read


def _token_grams(read: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of all forms, the form that each comes from, and the token of each form."""
    words = [w for ws in read for w in ws]
    own = np.repeat(np.arange(len(read)), [len(ws) for ws in read])
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), own
    return *grams_of(words), own


def _token_weights(read: list[list[str]], weights: np.ndarray) -> np.ndarray:
    grams, form, own = _token_grams(read)
    w = weights[grams]
    some = np.flatnonzero(w)
    some = some[np.lexsort((w[some], form[some]))]
    f = form[some]
    last = np.flatnonzero(np.append(f[1:] != f[:-1], True)) if len(f) else np.zeros(0, np.int64)
    at = last - (RANK - 1)
    ok = at >= 0
    ok[ok] = f[at[ok]] == f[last[ok]]
    out = np.zeros(len(read) + 1)
    np.maximum.at(out, own[f[last[ok]]], w[some[at[ok]]])
    return out


def _gram_documents(model: np.ndarray):
    """In how many toxic and other documents each gram occurs, of those that weights are taken from."""

    def run(batches):
        reader, counts, n = Reader(model), np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            texts, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
            flat, ends, read = reader.read(texts)
            grams, form, own = _token_grams(read)
            order = np.argsort(own[form], kind="stable")
            grams, token = grams[order], own[form][order]
            edge = np.searchsorted(token, np.arange(len(read) + 1))
            for s, e, y in zip([0, *ends], ends, labels):
                use = np.unique(flat[s:e])
                got = np.unique(np.concatenate([grams[edge[t] : edge[t + 1]] for t in use])) if len(use) else use
                counts[y][got] += 1
                n[y] += 1
        at = np.flatnonzero(counts.any(0))
        idx = np.append(at, -1)
        yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(np.append(counts[1][at], n[1])), pa.array(np.append(counts[0][at], n[0]))], names=["gram", "toxic", "other"])

    return run


def _features(model: np.ndarray, weights: np.ndarray, carry: list[str]):
    """Adds `heaviest` and `weight` to the columns to carry; the text is the last column."""

    def run(batches):
        reader = Reader(model)
        for b in batches:
            flat, ends, read = reader.read(b.column(b.num_columns - 1).to_pylist())
            w = np.append(_token_weights(read, weights)[flat], 0.0)
            starts = np.concatenate(([0], ends[:-1]))
            full = ends > starts
            heaviest, total = np.zeros(len(ends)), np.zeros(len(ends))
            if full.any():
                heaviest[full] = np.maximum.reduceat(w, starts[full])
                total[full] = np.add.reduceat(w[:-1], starts[full])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(carry))), pa.array(heaviest), pa.array(np.log1p(total))], names=[*carry, "heaviest", "weight"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30, sample_weight: np.ndarray | None = None) -> np.ndarray:
    """Newton's method with a ridge on all but the intercept, which is the first coefficient."""
    x = np.column_stack([np.ones(len(x)), x])
    sample_weight = np.ones(len(x)) if sample_weight is None else sample_weight
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = sample_weight * p * (1 - p)
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(pen), x.T @ (sample_weight * (y - p)) - pen * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def gram_weights(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Cautious log ratios: toxic counts less one and a half standard errors against other counts plus one; never below 0."""
    low = np.maximum(toxic - 1.5 * np.sqrt(toxic), 0) / max(n_toxic, 1)
    high = (other + 1) / (n_other + 1)
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(low / high), 0.0)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    docs: doc_id long, text string; labels: doc_id long, toxic int; other columns are ignored. A null text is an
    empty one and gets the score of a text without toxic words. Rows with a null doc_id are scored and count as held
    out; labels with a null doc_id or a null label are not learnt from, and of repeated labels the largest holds.
    Repeated rows are scored as often as they occur. Without labels of both kinds every score is the prior (0.5
    without any); if the calibration fold alone lacks a kind, the score is calibrated on all labelled rows that may be
    learnt from. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold_of = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    model = char_model(docs)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = bounded_sample(known.withColumn("fold", fold_of).where(F.col("fold") != HELD), sample, "doc_id")
    learnt = docs.join(F.broadcast(known), "doc_id")  # at most `sample` rows of three numbers
    rows = learnt.where(F.col("fold") != CALIBRATION).select("text", F.least(F.col("toxic"), F.lit(1)).alias("toxic")).mapInArrow(_gram_documents(model), "gram long, toxic long, other long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow()
    gram, toxic, other = (rows.column(c).to_numpy() for c in ("gram", "toxic", "other"))
    n1, n0 = int(toxic[gram < 0].sum()), int(other[gram < 0].sum())
    t, o = np.zeros(BUCKETS), np.zeros(BUCKETS)
    t[gram[gram >= 0]], o[gram[gram >= 0]] = toxic[gram >= 0], other[gram >= 0]
    weights = gram_weights(t, o, n1, n0)
    counts = known.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") > 0).alias("k")).first()

    def fitted(rows: DataFrame) -> np.ndarray | None:
        feats = rows.select("toxic", "text").mapInArrow(_features(model, weights, ["toxic"]), "toxic int, heaviest double, weight double")
        feats = feats.orderBy(F.xxhash64("toxic", "heaviest", "weight"), "toxic").limit(sample).toArrow()  # a repeated doc_id brings all of its rows
        x, y = np.column_stack([feats.column("heaviest").to_numpy(), feats.column("weight").to_numpy()]), np.minimum(feats.column("toxic").to_numpy(), 1).astype(float)
        return fit_logistic(x, y, 0.1) if len(np.unique(y)) > 1 else None

    w = None
    if 0 < counts["k"] < counts["n"]:
        w = fitted(learnt.where(F.col("fold") == CALIBRATION))
        w = fitted(learnt) if w is None else w
    if w is None:
        w = np.array([30 * np.sign(2 * counts["k"] - counts["n"]) if counts["k"] in (0, counts["n"]) else np.log(counts["k"] / (counts["n"] - counts["k"])), 0.0, 0.0])
    z = F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("heaviest") + F.lit(float(w[2])) * F.col("weight")
    out = docs.select("doc_id", "text").mapInArrow(_features(model, weights, ["doc_id"]), "doc_id long, heaviest double, weight double")
    out = out.withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", F.coalesce(fold_of == HELD, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
