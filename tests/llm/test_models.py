import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import frame, rows, sentence

from tarnmill.llm import ann, lm, mixing, quality, rules, seating, toxicity


def test_language_model(spark):
    data = rows(3, 120)
    got = lm.score(frame(spark, data), batch=1500, bucket=900).collect()
    tok = [(r[1] or "").encode().lower().split() + [None] for r in data]
    held = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in data]
    c = Counter(w for t, h in zip(tok, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t, h in zip(data, tok, held)), key=repr)
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in got), key=repr) == want
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    assert all(r["score"] < 0 for r in got)
    assert lm.score(frame(spark, [])).collect() == []
    none = lm.score(frame(spark, [(None, "a b", "en", "a", 1)])).collect()
    assert none[0]["score"] == 0 and none[0]["train_tokens"] == 0


def test_words_are_those_of_bytes():
    """Arrow's words are those of lower-cased bytes, split at ASCII white space, also in slices; contexts are their last bytes."""
    rng = random.Random(1)
    parts = ["a", "B", " ", "\t", "\x0b", "\x0c", "\r", "\n", "\x1c", "\x85", "\xa0", "É", "ß", "日", "\x00", "zz", "İ", " "]
    texts = [None, "", " ", "\n\t "] + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)]
    want = [(t or "").encode().lower().split() for t in texts]
    for start, n in ((0, 0), (0, 2), (0, 304), (7, 64), (200, 104)):
        words, size = lm._split(pa.array(texts).slice(start, n))
        some = want[start : start + n]
        assert words.cast(pa.binary()).to_pylist() == [w for ws in some for w in ws] and size.tolist() == [len(ws) for ws in some]
    words = sorted({w for ws in want for w in ws})
    assert lm.contexts_of(words).tolist() == [w[-2] * 256 + w[-1] if len(w) > 1 else 65536 + w[0] for w in words]


def test_language_model_learns_from_whole_words(spark):
    """All words end alike, so only the whole word before tells which one follows."""
    rng = random.Random(4)
    after = list(range(60))
    rng.shuffle(after)
    data = []
    for i in range(150):
        k, words = rng.randrange(60), []
        for _ in range(40):
            words.append(f"w{k}xx")
            k = after[k]
        data.append((i, " ".join(words), "en", "a", 1))
    got = [r for r in lm.score(frame(spark, data), batch=1500, bucket=900).collect() if r["held_out"]]
    assert got and sum(r["score"] for r in got) > 0.5 * sum(r["base_score"] for r in got)


def _tiny():
    """Two leaf restaurants, each under a suffix context of its own, that share the root; two dishes."""
    ups, places = [None, np.array([0, 1, 0, 1]), np.arange(4)], [np.zeros(2, int), np.array([0, 0, 1, 1]), np.array([0, 0, 1, 1])]
    return np.array([3, 1, 2, 2]), ups, places, (0.5, 0.6, 0.7), (1.0, 2.0, 1.5)


def test_gibbs_against_all_seatings():
    """The averaged predictions are those of the sum over all table counts, weighted by their exact probabilities."""
    c2, ups, places, d, s = _tiny()
    stirling = [seating.log_stirling(10, x) for x in d]
    rise = lambda a, step, n: sum(math.log(a + i * step) for i in range(int(n)))
    total, want = 0.0, np.zeros(4)
    for t2 in itertools.product(*(range(1, x + 1) for x in c2)):
        c1 = np.bincount(ups[2], t2, minlength=4).astype(int)
        for t1 in itertools.product(*(range(1, x + 1) for x in c1)):
            c0 = np.bincount(ups[1], t1, minlength=2).astype(int)
            for t0 in itertools.product(*(range(1, x + 1) for x in c0)):
                log, p = -sum(t0) * math.log(3), 1 / 3
                for k, (c, t) in enumerate(((c0, t0), (c1, t1), (c2, t2))):
                    t = np.array(t)
                    n, m = np.bincount(places[k], c), np.bincount(places[k], t)
                    log += stirling[k][c, t].sum() + sum(rise(s[k], d[k], y) - rise(s[k], 1, x) for x, y in zip(n, m))
                    p = (c - d[k] * t + (s[k] + d[k] * m[places[k]]) * (p[ups[k]] if k else p)) / (s[k] + n[places[k]])
                total, want = total + math.exp(log), want + math.exp(log) * p
    x, rng = seating.Seats(c2, [np.ones(2, int), np.ones(4, int), np.ones(4, int)], ups, places, [[4.0], [2.0, 2.0], [4.0, 4.0]], [[2.0], [2.0, 2.0], [2.0, 2.0]], d, s, 2), np.random.default_rng(0)
    x.seat_all(rng)
    draws = []
    for _ in range(4000):
        x.sweep(rng, 1, 8)
        draws.append(x.predict())
    assert np.abs(np.mean(draws[100:], 0) - want / total).max() < 0.005
    for k in range(3):  # the totals stay those of the dishes
        assert np.allclose(x.n[k], np.bincount(places[k], x.c[k])) and np.allclose(x.m[k], np.bincount(places[k], x.t[k]))


def test_a_sweep_moves_whole_parties():
    """What one sweep leaves of a party of 400 does not depend on how it sat before: at one table, or each at their own."""
    ups, places = [None, np.array([0]), np.array([0])], [np.array([0])] * 3
    ends = []
    for t in (1, 400):
        drawn = []
        for seed in range(150):
            x = seating.Seats([400], [[1], [1], [t]], ups, places, [[1.0], [float(t)], [400.0]], [[1.0], [1.0], [float(t)]], (0.5, 0.5, 0.5), (1.0, 1.0, 1.0), 9)
            x.sweep(np.random.default_rng(seed))
            drawn.append(int(x.t[2][0]))
        ends.append(drawn)
    s = seating.log_stirling(400, 0.5)
    k = np.arange(1, 401)
    rise = lambda a, d: np.cumsum(np.log(a + d * np.arange(400)))
    log = s[400, 1:] + rise(1.0, 0.5) + s[k, 1] - rise(1.0, 1.0)
    p = np.exp(log - log.max())
    mean = (p * k).sum() / p.sum()
    sd = np.sqrt((p * k * k).sum() / p.sum() - mean**2)
    assert all(abs(np.mean(d) - mean) < 4 * sd / np.sqrt(150) for d in ends)


def test_predictions_add_up():
    """P(. | context) sums to 1 over the vocabulary and the unknown word, also with large parties."""
    rng = np.random.default_rng(0)
    word, ctx = np.repeat(np.arange(30), 4), np.tile(np.array([5, 261, 7, lm.START]), 30)
    c2 = rng.integers(0, 3000, 120)
    t2 = np.minimum(c2, 1)
    ups, places = [None, word, np.arange(120)], [np.zeros(30, int), ctx, np.tile(np.arange(4), 30)]
    t0 = (np.bincount(word, t2) > 0).astype(int)
    n, m = [[t2.sum()], np.bincount(ctx, t2, minlength=lm.CONTEXTS), np.bincount(places[2], c2)], [[t0.sum()], np.bincount(ctx, t2, minlength=lm.CONTEXTS), np.bincount(places[2], t2)]
    x = seating.Seats(c2, [t0, t2, t2], ups, places, n, m, lm.DISCOUNT, lm.STRENGTH, 30)
    x.seat_all(rng)
    for _ in range(3):
        x.sweep(rng)
    assert all(((t <= c) & ((t > 0) == (c > 0))).all() for c, t in zip(x.c, x.t))
    p, d, s = x.predict(), x.d, x.s
    u0 = (s[0] + d[0] * x.m[0][0]) / 31 / (s[0] + x.n[0][0])
    for k, c in enumerate((5, 261, 7, lm.START)):
        u1 = (s[1] + d[1] * x.m[1][c]) * u0 / (s[1] + x.n[1][c])
        assert abs(p[places[2] == k].sum() + (s[2] + d[2] * x.m[2][k]) * u1 / (s[2] + x.n[2][k]) - 1) < 1e-9


def test_stirling_numbers():
    s, d = seating.log_stirling(4, 0.5), 0.5
    assert np.allclose(np.exp(s[3, 1:4]), [(1 - d) * (2 - d), 3 * (1 - d), 1])
    for d in (0.3, 0.8):  # beyond the table's edge they go on
        s = seating.log_stirling(4000, d, 400)
        c, t = np.array([200, 2000, 4000, 4000, 3999, 3000, 5, 1500]), np.array([2, 5, 50, 150, 390, 380, 5, 1])
        assert np.abs(seating.log_s(c, t, d) - s[c, t]).max() < 0.6
        want = np.exp(s[c - 1, t - 1] - s[c, t])
        assert np.abs(seating.alone(c, t, d) - want).max() < 1e-3


def _bisected(c, t, d):
    """The saddle point's position by 70 halvings, as it was found before."""
    lo, hi = np.full(len(c), -2000.0), np.full(len(c), -1e-12)
    for _ in range(70):
        mid = (lo + hi) / 2
        low = np.log(-np.expm1(mid)) + (d - 1) * mid + np.log(d) - np.log(-np.expm1(d * mid)) < np.log(c / t)
        hi, lo = np.where(low, mid, hi), np.where(low, lo, mid)
    y, m = (lo + hi) / 2, c / t
    var = m * (1 - np.expm1(y) * (1 - d) * np.exp(-y) - m)
    return t * np.log(-np.expm1(d * y) / d) - c * np.log(-np.expm1(y)) - 0.5 * np.log(2 * np.pi * t * var)


def test_a_saddle_point_takes_few_evaluations(monkeypatch):
    """Its place is found in a few evaluations, not by halvings, and is the same; these made two thirds of a sweep's work."""

    class Counted:
        seen = 0

        def __getattr__(self, name):
            return getattr(np, name)

        def expm1(self, x):
            Counted.seen += np.size(x)
            return np.expm1(x)

    rng = np.random.default_rng(0)
    t = np.exp(rng.uniform(np.log(17), np.log(1e6), 2000)).astype(np.int64)
    c = t + 1 + (t * np.exp(rng.uniform(-14, 6, 2000))).astype(np.int64)
    for d in seating.DISCOUNTS:
        d = float(d)
        seating._log_coefficient(c[:1], t[:1], d)
        with monkeypatch.context() as patch:
            patch.setattr(seating, "np", Counted())
            got = seating._log_coefficient(c, t, d)
        assert np.allclose(got, _bisected(c, t, d), rtol=1e-9, atol=1e-6)
    assert Counted.seen <= 8 * len(c) * len(seating.DISCOUNTS)


def test_steps_of_stirling_numbers():
    """What a table and a customer more add, inside the tables, at their edges and beyond them."""
    for d in (0.3, 0.8):
        s = seating.log_stirling(1400, d, 230)
        c, t = (x.ravel() for x in np.meshgrid([2, 3, 40, 1000, 1023, 1024, 1025, 1399], [1, 2, 3, 30, 191, 192, 193, 220]))
        c, t = c[t < c], t[t < c]
        assert np.abs(seating.one_more_table(c, t, d) - (s[c, t + 1] - s[c, t])).max() < 0.01
        assert np.abs(seating.one_more_customer(c, t, d) - (s[c + 1, t] - s[c, t])).max() < 0.01


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(600 + k, x[3].tolist()) for k in range(40)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None, *[1.0] * 15]), (704, [1.0]), (None, [1.0] * 16), (5, x[5].tolist())]
    df = spark.createDataFrame([(*r, "v", 1) for r in data], "vec_id long, embedding array<float>, vec string, bd int")
    # Row 704 is shorter than the others and counts as if zeros followed it: only null, zero and non-finite vectors are left out.
    ids = np.array(sorted({r[0] for r in data if r[0] is not None and (r[0] < 700 or r[0] == 704)}))
    m = np.stack([np.resize(np.append(np.array(dict(data)[i], np.float32), np.zeros(16, np.float32)), 16) for i in ids]).astype(np.float64)
    for metric in ("ip", "l2", "cosine"):
        got, hit, n = {}, 0, 0
        for r in ann.nearest(df, metric=metric, books=8, words=64).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert set(got) == {int(i) for i in ids if i % 20 == 0}
        for q, found in got.items():
            s = ann.exact_scores(m[ids == q][0], m, metric)
            order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
            assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
            assert all(abs(s[ids == v][0] - x) < 1e-12 for v, x in found)
            hit, n = hit + len({int(ids[k]) for k in order} & {v for v, _ in found}), n + 20
        assert hit / n >= 0.9
    assert ann.nearest(df.where("vec_id = 700")).collect() == []


def test_neighbours_among_near_copies(spark):
    """A third of the rows differ so little that their codes are the same; the nearest are found all the same."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3600, 16))
    x[::3] = x[0] + 0.003 * rng.normal(size=(1200, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for metric in ("ip", "l2", "cosine"):
        got = {}
        for r in ann.nearest(df, every=90, metric=metric, books=8, words=64).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert len(got) == 40
        for q, found in got.items():
            s = ann.exact_scores(x[q], x, metric)
            assert found == [k for k in np.lexsort((np.arange(len(x)), -s)) if k != q][:20]


def test_toxicity_and_obfuscation(spark):
    rng = random.Random(1)
    bad = ["idiot", "moron", "loser"]
    data, labels = [], []
    for i in range(400):
        words = sentence(rng, 40).split()
        if i % 4 == 0:
            words[5:5] = [rng.choice(bad), rng.choice(bad)]
        data.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, int(i % 4 == 0)))
    hard = ["you 1d10t", "what an i d i o t now", "such a m0r0n", "loooosssser", "l.o.s.e.r", "IDIOT!!"]
    data += [(1000 + k, sentence(rng, 30) + " " + h + " " + sentence(rng, 30), "en", "a", 1) for k, h in enumerate(hard)]
    data += [(2000, None, "en", "a", 1), (2001, "", "en", "a", 1), (None, "idiot moron", "en", "a", 1), (2002, sentence(rng, 5000), "en", "a", 1)]
    lab = spark.createDataFrame([(*x, "s") for x in labels] + [(None, 1, "s"), (7, None, "s"), (8, 1, "s")], "doc_id long, toxic int, score string")
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, data), lab).collect()}
    assert len(got) == len(data)
    assert all(got[1000 + k]["predicted"] == 1 for k in range(len(hard)))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [got[i]["held_out"] for i in held] == [True] * len(held)
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in held)
    assert got[2000]["predicted"] == got[2001]["predicted"] == got[2002]["predicted"] == 0 and 0 <= got[2000]["score"] <= 1
    none = toxicity.score(frame(spark, data[:3]), lab.where("doc_id < 0")).collect()
    assert [r["score"] for r in none] == [0.5] * 3
    assert toxicity.score(frame(spark, []), lab).collect() == []
    clean = toxicity.score(frame(spark, data[1:4]), lab.where("toxic = 0")).collect()  # labels of one kind: the prior
    assert [r["predicted"] for r in clean] == [0] * 3


def test_decoding_is_the_best_path():
    """Against all readings of a string; and a string of any length is one lattice."""
    rng = np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.ones(28), (28, 28)))

    def readings(token):
        out, last = [("", 0.0)], ""
        for c in token:
            steps = [(c, 0.0)] + [("", toxicity.REPEAT_COST)] * (c == last) if c.isalpha() else [(x, toxicity.SIGN_COST) for x in toxicity.LEET.get(c, "")]
            if not c.isalpha():
                steps += [("", toxicity.SEPARATOR_COST)] if c in toxicity.SEPARATORS or c not in toxicity.LEET else [("", toxicity.REPEAT_COST)] * (c == last)
            out, last = [(w + x, p - cost) for w, p in out for x, cost in steps], c
        return out

    def value(word, p):
        s = [0, 0, *map(toxicity.symbol, word), 0]
        return p + sum(model[a, b, c] for a, b, c in zip(s, s[1:], s[2:]))

    for token in ("1d10t", "h*ll0", "aaab*c", "l.0.s.3r", "x--y!!z"):
        best = max(value(w, p) for w, p in readings(token))
        got = toxicity.decode(token, model)
        assert abs(max(value(w, p) for w, p in readings(token) if w == got) - best) < 1e-9
    long = toxicity.decode("z1" * 3000 + "m", model)
    assert set(long) <= set("zilm") and len(long) == 6001


def test_quality_co_training(spark):
    rng = random.Random(2)
    data, labels = [], []
    for i in range(600):
        t, good = sentence(rng, rng.randrange(20, 80)), i % 5 != 0
        t = t if good else rng.choice([t.upper().replace(" ", "!! "), " ".join(f"{w}&&&" for w in t.split()), " ".join([t.split()[0]] * 60)])
        data.append((i, t, "en", rng.choice("ab") if good else rng.choice("bc"), len(t)))
        if i % 2:
            labels.append((i, int(good)))
    lab = spark.createDataFrame([(*x, "k") for x in labels] + [(None, 1, "k"), (9, None, "k")], "doc_id long, quality int, kept string")
    data += [(5000, None, None, None, None), (None, "x", "en", "a", 1), (0, data[0][1], "en", "a", 1)]
    got = quality.classify(frame(spark, data), lab).collect()
    assert len(got) == len(data)
    right = [r["kept"] == (r["doc_id"] % 5 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 600]
    assert sum(right) / len(right) > 0.97
    again = quality.classify(frame(spark, data), lab).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    few = quality.classify(frame(spark, data[:4]), lab.limit(3)).collect()
    assert len(few) == 4
    assert quality.classify(frame(spark, []), lab).collect() == []


def test_co_training_against_one_table(spark):
    """The distributed pool hands over the rows that sorting the whole pool would."""
    rng = np.random.default_rng(5)
    n = 700
    y = (rng.random(n) < 0.6).astype(int)
    num, length = rng.normal(size=(n, quality.N_TEXT)) + y[:, None] * 0.7, rng.normal(size=(n, 1)) + y[:, None]
    cat = np.column_stack([rng.integers(0, 5, n) + 3 * y, rng.integers(0, 3, n)])
    num[600:650], cat[600:650], length[600:650] = num[600], cat[600], length[600]  # ties
    pool, own, fold = np.arange(200, n), np.arange(200), rng.choice([1, 2, 3, 4, 6, 7], n)
    data = [(int(k), -1, -1, num[k].tolist(), int(cat[k, 0]), int(cat[k, 1]), float(length[k, 0])) for k in pool]
    df = spark.createDataFrame(data, quality._FEATURES).repartition(5)
    tie = {r["row"]: r["t"] for r in df.selectExpr("row", "xxhash64(num, source, lang, length) as t").collect()}

    def brute(text, meta, most):
        out = []
        for z in (text.logit(num[pool], np.zeros((len(pool), 0), np.int64)), meta.logit(length[pool], cat[pool])):
            p = np.round(quality.sigmoid(z), 9)
            rank = lambda conf: [(int(pool[i]), num[pool[i]], cat[pool[i]], length[pool[i]]) for i in sorted(range(len(pool)), key=lambda i: (-conf[i], tie[int(pool[i])], pool[i])) if conf[i] >= quality.SURE][:most]  # noqa: E731, B023
            out.append([rank(1 - p), rank(p)])
        return out

    a, b = (quality.co_train(num[own], cat[own], length[own], y[own], fold[own], f, rounds=3, take=40) for f in (brute, quality.confident_rows(df)))
    assert np.allclose(a.text.w, b.text.w) and np.allclose(a.meta.w, b.meta.w) and np.allclose(a.blend, b.blend)
    alone = quality.co_train(num[own], cat[own], length[own], y[own], fold[own], brute, rounds=0)
    assert not np.allclose(alone.text.w, a.text.w)


def brute_counts(t):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
    lines = [x for x in (t or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    at, cov = {}, set()
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    for v in at.values():
        if len(v) > 1:
            cov |= {j for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cov)


def test_rules(spark):
    rng = random.Random(5)
    data = rows(7, 300) + [(7000 + k, " ".join(f"{w}$$$" for w in sentence(rng, 60).split()), "en", "a", 1) for k in range(5)]
    got = rules.judge(frame(spark, data)).collect()
    want = sorted(((r[0], *brute_counts(r[1])) for r in data), key=repr)
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert not any(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 7000)
    clean = [r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and not r["base_failed"]]
    assert sum(clean) / len(clean) > 0.99
    assert rules.judge(frame(spark, [])).collect() == []


def _fit(x, weight, scale):
    """Mean and Cholesky factor of weighted rows."""
    m = (x * weight[:, None]).sum(0) / weight.sum()
    cov = scale * ((x * weight[:, None]).T @ x / weight.sum() - np.outer(m, m))
    return m, np.linalg.cholesky(np.diag(np.maximum(np.diag(cov), 0)) + np.tril(cov, -1) + np.tril(cov, -1).T + np.diag([v * v for v in rules.STATS.values()]))


def _away(x, fit):
    z = np.linalg.solve(fit[1], (x - fit[0]).T)
    return (z * z).sum(0)


def test_determinants_against_numpy(spark):
    """The verdicts of three groups, one of them of five documents, by the same steps in NumPy."""
    rng, n = np.random.default_rng(1), {("len", "sa"): 400, ("len", "sb"): 5, ("lde", "sa"): 150}
    x = {g: rng.normal(size=(k, rules.P)) @ np.diag(rng.uniform(0.5, 2, rules.P)) + rng.normal(size=rules.P) for g, k in n.items()}
    for v in x.values():
        v[::7] += 9
    schema = "key struct<lang:string,source:string>, " + ", ".join(f"x{i} double" for i in range(rules.P))
    numbers = spark.createDataFrame([((*g,), *map(float, r)) for g, v in x.items() for r in v], schema)
    scale = rules.H / rules.chi2_cdf(rules.chi2_quantile(rules.H, rules.P), rules.P + 2)
    keys = list(x)

    def pooled(weights, scale):
        out = {}
        for g in keys:
            lang = [h for h in keys if h[0] == g[0]]
            mass = lambda hs: sum(weights[h].sum() for h in hs)
            total = {h: weights[h] * ((h == g) + rules.POOL[0] / mass(lang) * (h in lang) + rules.POOL[1] / mass(keys)) for h in keys}
            out[g] = _fit(np.concatenate([x[h] for h in keys]), np.concatenate([total[h] for h in keys]), scale)
        return out

    def nearest(fits):
        weights = {}
        for g in keys:
            bins = np.floor(32 * np.log2(_away(x[g], fits[g]) + 1e-6))
            weights[g] = np.array([(bins < b).sum() < rules.H * len(bins) for b in bins]).astype(float)
        return weights

    def columns(df):
        rows = {tuple(r["key"]): r for r in df.collect()}
        return {g: (np.array([rows[g][f"m{i}"] for i in range(rules.P)]), np.array([[rows[g][f"l{i}{j}"] if j <= i else 0.0 for j in range(rules.P)] for i in range(rules.P)])) for g in keys}

    first = columns(rules._start(numbers))
    for g in keys:
        assert np.abs(first[g][0] - np.sort(x[g], 0)[(len(x[g]) + 1) // 2 - 1]).max() < 0.01
    results = []
    for start, want in ((rules._start(numbers), first), (rules._moments(numbers), pooled({g: np.ones(len(x[g])) for g in keys}, 1.0))):
        for _ in range(2):
            start, want = rules.materialize(rules._concentrate(numbers, start, rules.H, scale)), pooled(nearest(want), scale)
        got = columns(start)
        assert all(np.allclose(got[g][k], want[g][k]) for g in keys for k in (0, 1))
        results.append((start, want))
    best = columns(rules._smallest(results[0][0].union(results[1][0])))
    for g in keys:
        a, b = (r[1][g] for r in results)
        want = a if round(np.log(np.diag(a[1])).sum(), 9) <= round(np.log(np.diag(b[1])).sum(), 9) else b
        assert np.allclose(best[g][1], want[1])
    cut = rules.chi2_quantile(1 - 0.001, rules.P)
    assert all(_away(x[g], best[g])[::7].min() > cut for g in keys[::2])  # outliers do not hide each other
    assert abs(rules.chi2_quantile(0.95, 7) - 14.0671) < 1e-3


def test_mixing(spark):
    rng = random.Random(3)
    vocab = {"en": ["the", "of", "and", "with"], "de": ["der", "und", "mit", "von"], "fr": ["le", "et", "avec", "de"]}
    data = []
    for i in range(300):
        lang = "en" if i % 6 < 4 else "de" if i % 6 == 4 else "fr"
        data.append((i, " ".join(rng.choice(vocab[lang]) + rng.choice(["", "x"]) for _ in range(rng.randrange(5, 60))), lang, "a", 1))
    data += [(400, None, None, None, None), (401, "", "en", "a", 1), (None, "the of", None, "a", 1), (3, data[3][1], "en", "a", 1)]
    lab = spark.createDataFrame([(i, "r") for i in range(300) if i % 5] + [(None, "r")], "doc_id long, rate string")
    goal = {"en": 1.0, "de": 1.0, "fr": 2.0}
    got = mixing.mix(frame(spark, data), lab, goal).collect()
    assert len(got) == len(data) and all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in got)
    n = np.array([r["n_tokens"] for r in got], float)
    p, r = np.array([x["posteriors"] for x in got]), np.array([x["rate"] for x in got])
    assert np.allclose(p.sum(1), 1)
    have = (n[:, None] * p * r[:, None]).sum(0)
    assert np.allclose(have / have.sum(), [0.25, 0.25, 0.5], atol=1e-3)  # de, en, fr
    assert abs(have.sum() / n.sum() - 1) < 1e-3
    now, step = np.ones(len(n)), None  # the same projected gradient in NumPy
    base = (n[:, None] * p).sum(0)
    for _ in range(200):
        step = ((n[:, None] * p * now[:, None]).sum(0) - np.array([0.25, 0.25, 0.5]) * n.sum()) / base
        now = np.maximum(0, now - p @ step)
    assert np.allclose(now, r, atol=1e-4)
    assert {x["rate"] for x in mixing.mix(frame(spark, data[:5]), lab.where("doc_id < 0")).collect()} == {1.0}
    assert mixing.mix(frame(spark, []), lab).collect() == []


def test_concentration_plans_hold_their_sums_once(spark):
    """The moments of a step are written before they are read for groups, languages and all: what is planned behind them has no
    window and no row of the statistics left."""
    schema = "key struct<lang:string,source:string>, " + ", ".join(f"x{i} double" for i in range(rules.P))
    numbers = spark.createDataFrame([(("len", "sa"), *(float(k * i % 7) for i in range(rules.P))) for k in range(20)], schema)
    fit = rules.materialize(rules._moments(numbers))
    for df in (rules._moments(numbers), rules._concentrate(numbers, fit, rules.H, 1.0)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "LogicalRDD" not in plan and plan.count("Aggregate") <= 2
