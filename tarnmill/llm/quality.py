"""A quality classifier by co-training.

Two views of a document: its text content (24 statistics of the whole text) and its page metadata (source, language
and stated length). Each view has an additive logistic model over quantile bins or hashed categories. In each round a
view labels the documents of an unlabelled pool that it is most confident about, and hands these pseudo-labels to the
other view, which learns from them beside the true labels. After the rounds each view is calibrated on labelled rows
that neither was trained on, and the calibrated log odds are combined by a logistic model fitted on yet others.

The pool is all documents that are not among the labelled rows that are learnt from: their features are written once, and
in each round every task keeps its most confident ones, so that only as many rows as are handed over reach the driver.
Only labelled rows are bounded: at most `labelled` (those with the smallest hashes of their doc_id) are learnt from. All
documents are scored, from their whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, materialize, release
from .toxicity import fit_logistic

LABELLED, ROUNDS, TAKE, SURE = 12_000, 5, 400, 0.9
#: crc32(doc_id as text) mod 10: the folds that are never learnt from, that of the calibration, and that of the combination.
FOLDS, HELD, CALIBRATION, BLEND = 10, (0, 5), 1, 6
BINS, SLOTS = 12, 64
#: Fixed ranges of byte values that are counted.
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_JUNK = [ord(c) for c in "#*$%&|<>"]
N_TEXT = 24


def text_features(text: str | None) -> list[float]:
    """24 statistics of a whole text; all are 0 without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * N_TEXT
    size, sizes = len(raw), np.fromiter(map(len, words), np.int64, n)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    low = [w.lower() for w in words]
    kinds: dict[bytes, int] = {}
    for w in low:
        kinds[w] = kinds.get(w, 0) + 1
    pairs = set(zip(low, low[1:]))
    p = byte[byte > 0] / size
    share = lambda x: float(x) / size
    return [
        np.log1p(n), float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())),
        share(byte[_UPPER].sum()), share(byte[_LOWER].sum()), share(byte[_DIGIT].sum()), share(byte[128:].sum()),
        share(byte[_JUNK].sum()), share(byte[33]), share(byte[46]), share(byte[44]), share(byte[63]), share(byte[124]),
        share(byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()), share(byte[10] + byte[9] + byte[32]),
        len(kinds) / n, max(kinds.values()) / n, sum(a == b for a, b in zip(low, low[1:])) / n, len(pairs) / max(1, n - 1),
        1 - len(set(lines)) / len(lines), np.log1p(size / len(lines)), float(-(p * np.log(p)).sum()), float((sizes <= 3).mean()),
    ]


def metadata_features(source: str | None, lang: str | None, n_chars: int | None) -> tuple[int, int, float]:
    """Slots of the source and the language (null: slot 0) and the log of the stated length (null: -1)."""
    slot = lambda x: 0 if x is None else 1 + xxhash.xxh3_64_intdigest(str(x).encode("utf-8", "surrogatepass")) % (SLOTS - 1)
    return slot(source), slot(lang), -1.0 if n_chars is None else float(np.log1p(max(0, n_chars)))


@dataclass
class Additive:
    """A logistic model over quantile bins of numbers and over categories."""

    edges: list[np.ndarray] = field(default_factory=list)
    slots: list[int] = field(default_factory=list)
    w: np.ndarray | None = None

    def design(self, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
        cols = [np.eye(len(e) + 1)[np.searchsorted(e, num[:, k], side="right")] for k, e in enumerate(self.edges)]
        return np.hstack(cols + [np.eye(n)[cat[:, k]] for k, n in enumerate(self.slots)])

    def fit(self, num: np.ndarray, cat: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Additive:
        if not self.edges and not self.slots:
            self.edges = [np.unique(np.quantile(num[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(num.shape[1])]
            # The tails matter most for quality.
            self.edges = [np.unique(np.concatenate((e, np.quantile(num[:, k], [0.01, 0.03, 0.97, 0.99])))) for k, e in enumerate(self.edges)]
            self.slots = [SLOTS] * cat.shape[1]
        self.w = fit_logistic(self.design(num, cat), y, ridge=1.0, sample_weight=weight)
        return self

    def logit(self, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
        return self.w[0] + self.design(num, cat) @ self.w[1:]


@dataclass
class CoTrained:
    text: Additive
    meta: Additive
    platt: list[np.ndarray]
    blend: np.ndarray

    def scores(self, num: np.ndarray, mcat: np.ndarray, mnum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of both views and of their combination."""
        none = np.zeros((len(num), 0), np.int64)
        z = [p[0] + p[1] * v for p, v in zip(self.platt, (self.text.logit(num, none), self.meta.logit(mnum, mcat)))]
        both = self.blend[0] + self.blend[1] * z[0] + self.blend[2] * z[1]
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (*z, both))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def co_train(num, cat, length, y, fold, confident, rounds: int = ROUNDS, take: int = TAKE) -> CoTrained | None:
    """Fits both views on labelled rows (y: 1 or 0). confident(text, meta, most): for each view and each label, 0 and 1, the
    rows of the pool that the view gives that label with most confidence: (row, num, cat, length), the surest first, at most
    `most` of them."""
    none = lambda x: np.zeros((len(x), 0), np.int64)
    own, cal, mix = np.flatnonzero((fold != CALIBRATION) & (fold != BLEND)), np.flatnonzero(fold == CALIBRATION), np.flatnonzero(fold == BLEND)
    if len(own) < 20 or min(len(cal), len(mix)) < 5 or min(len(np.unique(y[k])) for k in (own, cal, mix)) < 2:
        return None
    text, meta, base = Additive(), Additive(), y[own].mean()
    given: list[dict[int, tuple]] = [{}, {}]  # what each view learns from, labelled by the other: (label, num, cat, length) by row
    for r in range(rounds + 1):
        for model, extra in zip((text, meta), given):
            rows = list(extra.values())
            join = lambda a, k: np.concatenate([a[own], *([np.array([x[k] for x in rows])] if rows else [])])
            n, c, m, labels = join(num, 1), join(cat, 2), join(length, 3), np.concatenate((y[own], [x[0] for x in rows])).astype(float)
            model.fit(*((n, none(n)) if model is text else (m, c)), labels, np.concatenate((np.ones(len(own)), np.full(len(rows), 0.5))))
        if r == rounds:
            break
        most = [max(1, round(take * (base if label else 1 - base))) for label in (0, 1)]
        found = confident(text, meta, max(most) + max(map(len, given)))
        for view in (0, 1):
            for label in (0, 1):
                new = [x for x in found[view][label] if x[0] not in given[1 - view]][: most[label]]
                given[1 - view].update({x[0]: (label, *x[1:]) for x in new})
    z = lambda k: (text.logit(num[k], none(k)), meta.logit(length[k], cat[k]))
    platt = [fit_logistic(v[:, None], y[cal].astype(float), 0.1) for v in z(cal)]
    both = np.column_stack([p[0] + p[1] * v for p, v in zip(platt, z(mix))])
    return CoTrained(text, meta, platt, fit_logistic(both, y[mix].astype(float), 0.1))


_META = ["source", "lang", "n_chars"]


def _arrays(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of a batch with the columns text, source, lang, n_chars."""
    num = np.array([text_features(t.as_py()) for t in b.column("text")], np.float64).reshape(-1, N_TEXT)
    meta = [metadata_features(*r) for r in zip(*(b.column(c).to_pylist() for c in _META))]
    cat = np.array([m[:2] for m in meta], np.int64).reshape(-1, 2)
    return num, cat, np.array([m[2] for m in meta], np.float64).reshape(-1, 1)


_FEATURES = "row long, y int, fold int, num array<double>, source long, lang long, length double"


def _extract(batches):
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for b in batches:
        num, cat, length = _arrays(b)
        rows = pa.array(np.arange(row, row + b.num_rows))
        row += b.num_rows
        yield pa.RecordBatch.from_arrays([rows, b.column("y"), b.column("fold"), pa.array(list(num), pa.list_(pa.float64())), pa.array(cat[:, 0]), pa.array(cat[:, 1]), pa.array(length[:, 0])], names=[x.split()[0] for x in _FEATURES.split(", ")])


def _unpack(t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """num, cat and length of a batch or table of features."""
    num = t.column("num")
    num = num.combine_chunks() if isinstance(t, pa.Table) else num
    return num.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_TEXT), np.column_stack([t.column("source").to_numpy(), t.column("lang").to_numpy()]), t.column("length").to_numpy()[:, None]


def _surest(text: Additive, meta: Additive, most: int, sure: float):
    """Of each task the rows that each view is most sure of, for each label; ties by the features' hash."""

    def run(batches):
        best: dict[tuple[int, int], tuple[np.ndarray, list]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            num, cat, length = _unpack(b)
            tie = b.column("tie").to_numpy()
            for view, z in enumerate((text.logit(num, np.zeros((len(num), 0), np.int64)), meta.logit(length, cat))):
                p = np.round(sigmoid(z), 9)
                for label, conf in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero(conf >= sure)
                    at = at[np.lexsort((tie[at], -conf[at]))[:most]]
                    kept = best.setdefault((view, label), [])
                    kept.append(b.take(pa.array(at)).append_column("conf", pa.array(conf[at])))
                    if len(kept) > 8:
                        t = pa.Table.from_batches(kept).sort_by([("conf", "descending"), ("tie", "ascending")]).slice(0, most)
                        best[view, label] = t.to_batches()
        for (view, label), kept in best.items():
            t = pa.Table.from_batches(kept).sort_by([("conf", "descending"), ("tie", "ascending")]).slice(0, most)
            for b in t.append_column("view", pa.array([view] * len(t), pa.int32())).append_column("label", pa.array([label] * len(t), pa.int32())).to_batches():
                yield b

    return run


def confident_rows(pool: DataFrame, sure: float = SURE):
    """The function that co_train() asks for the rows of a pool of features that a view is sure of."""
    pool = pool.select("row", "num", "source", "lang", "length", F.xxhash64("num", "source", "lang", "length").alias("tie"))
    schema = "row long, num array<double>, source long, lang long, length double, tie long, conf double, view int, label int"

    def confident(text: Additive, meta: Additive, most: int):
        w = Window.partitionBy("view", "label").orderBy(F.col("conf").desc(), "tie", "row")
        got = pool.mapInArrow(_surest(text, meta, most, sure), schema).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).toArrow()
        got = got.sort_by("k")
        out = [[[], []], [[], []]]
        if got.num_rows:
            num, cat, length = _unpack(got)
            for i, (row, view, label) in enumerate(zip(got.column("row").to_pylist(), got.column("view").to_pylist(), got.column("label").to_pylist())):
                out[view][label].append((row, num[i], cat[i], length[i]))
        return out

    return confident


def _apply(model: CoTrained | None, prior: float, carry: list[str]):
    def run(batches):
        for b in batches:
            if model:
                text, meta, both = model.scores(*_arrays(b))
            else:
                text = meta = both = np.full(b.num_rows, prior)
            kept = [b.column(f"out_{k}") for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(text), pa.array(meta), pa.array(both)], names=[*carry, "text_score", "metadata_score", "quality_score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[CoTrained | None, float]:
    """The model and the share of good labels; None where the labels do not suffice for a fit."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int").alias("fold")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.least(F.max(F.col("quality").cast("int")), F.lit(1)).alias("y"))
    known = bounded_sample(known.select("doc_id", "y", fold).where(~F.col("fold").isin(*HELD)), labelled, "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))
    rows = rows.join(F.broadcast(known), "doc_id", "left").withColumns({"y": F.coalesce("y", F.lit(-1)), "fold": F.coalesce("fold", F.lit(-1))})  # at most `labelled` rows of three numbers
    features = materialize(rows.select("y", "fold", "text", *_META).mapInArrow(_extract, _FEATURES), "quality-features")
    # A repeated doc_id brings its rows; of more than `labelled` rows those with the smallest hashes are learnt from.
    got = features.where("y >= 0").orderBy(F.xxhash64("num", "source", "lang", "length"), "row").limit(labelled).toArrow()
    y = got.column("y").to_numpy()
    if not len(y):
        release(features)
        return None, 0.5
    num, cat, length = _unpack(got)
    # The order of the rows is that of the tasks; sorted, so that the same rows always give the same model.
    key = np.lexsort([*num.T, length[:, 0], y])
    model = co_train(num[key], cat[key], length[key], y[key], got.column("fold").to_numpy()[key], confident_rows(features.where("y < 0")))
    release(features)
    return model, float(y.mean())


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, carry: list[str] | None = None, **bounds) -> DataFrame:
    """Scores every document; returns the columns to carry (doc_id), text_score, metadata_score, quality_score and kept.

    docs: doc_id long, text string, source string, lang string, n_chars long; labels: doc_id long, quality int; other
    columns are ignored. Null texts are empty ones, all of whose statistics are 0; null metadata have a slot of their
    own. Rows with a null doc_id are scored but not learnt from; of repeated labels the largest holds; repeated rows
    are scored as often as they occur. Where fewer than 20 labels (5 for the calibration and 5 for the combination), or
    labels of one kind only, are at hand, every score is the share of good labels (0.5 without any). Labels of the
    held-out fold (crc32 of doc_id mod 5 is 0) are never learnt from. An empty table gives an empty result. A document is kept if its score reaches the threshold.
    """
    model, prior = fit(docs, labels, **bounds)
    carry = carry or ["doc_id"]
    kinds = dict(docs.dtypes)
    view = docs.select(*(F.col(c).alias(f"out_{k}") for k, c in enumerate(carry)), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    out = view.mapInArrow(_apply(model, prior, carry), f"{schema}, text_score double, metadata_score double, quality_score double")
    return out.withColumn("kept", F.col("quality_score") >= threshold)
