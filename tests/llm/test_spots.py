"""Spot signatures, their comparison and the similarity join against plain Python."""

import hashlib
import random
import re

from helpers import frame, rows
from pyspark.sql import functions as F

from tarnmill.llm import spots

FOLD = str.maketrans(spots.UPPER, spots.LOWER)


def signatures(text):
    words = [w for w in re.split(spots.BETWEEN, text.translate(FOLD)) if w]
    found, last = set(), spots.TOP
    content = [(w, i) for i, w in enumerate(words) if w not in spots.ANCHORS]
    for k, (w, i) in enumerate(content):
        anchor = words[i - 1] if i else spots.TOP
        if i == 0 or anchor in spots.ANCHORS:
            found.add(" ".join([anchor + spots.MARK + w, *[x for x, _ in content[k + 1 : k + 2]]]))
    if not content and text:
        found = {"".join(w + "\x01" for w in words) or text}
    return sorted({hashlib.md5(s.encode()).hexdigest()[: spots.DIGITS] for s in found})


def likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    data = rows() + [(500, "The of and", "en", "a", 1), (501, "!!! …", "en", "a", 1), (502, "ÉCOLE de l’été — The END.\nthe", "fr", "a", 1), (503, "x", "en", "a", 1)]
    got = spots.fingerprints(frame(spark, data)).collect()
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for r, nxt in zip(order, order[1:] + order[:1]):
        text, other = r[1] or "", nxt[1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        s, e, o = signatures(text), signatures(edited), signatures(other)
        want.setdefault(r[0], []).append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(s), "".join(e), likeness(s, e), likeness(s, o), len(s)))
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(x) for xs in want.values() for x in xs)


def test_one_and_none(spark):
    one = spots.fingerprints(frame(spark, [(1, "the cat sat on the mat", "en", "a", 1)])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert spots.fingerprints(frame(spark, [])).collect() == []
    assert spots.similar(frame(spark, [])).collect() == []


def test_similar_equals_all_pairs(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["the", "of", "and", "to"]) + " " + rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(3, 60))) for _ in range(12)]
    data = []
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["x", "the", "yy", "zzz"])
        data.append((i, " ".join(words), "en", "a", 1))
    data += [(500, None, "en", "a", 1), (501, "", "en", "a", 1), (None, base[0], "en", "a", 1)]
    sets = [(r[0], frozenset(signatures(r[1] or ""))) for r in data]
    for least in (0.8, 0.5):
        got = sorted((tuple(r) for r in spots.similar(frame(spark, data), least).collect()), key=repr)
        want = []
        for i, (d, s) in enumerate(sets):
            links = sum(len(s & t) / len(s | t) >= least for j, (_, t) in enumerate(sets) if j != i and s | t)
            same = [x for x, t in sets if t == s and x is not None]
            want.append((d, "".join(sorted(s)), min(same) if s else None, links))
        assert got == sorted(want, key=repr)


def test_pruned_likeness(spark):
    pairs = [(["a"], ["a", "b", "c"]), ([], []), (["a"], []), (["a", "b"], ["b", "c"])]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(spots.likeness(F.col("a"), F.col("b"))).collect()] == [1 / 3, 1.0, 0.0, 1 / 3]
    assert [r[0] for r in df.select(spots.likeness(F.col("a"), F.col("b"), 0.5)).collect()] == [0.0, 1.0, 0.0, 1 / 3]
