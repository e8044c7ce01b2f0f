"""One-edit pairs and forms against all pairs; damaged words against a loop."""

import random
import re
import zlib
from collections import Counter

from helpers import frame, rows

from tarnmill.llm import variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(words):
    """Rows of group_variants() for a dict of counts."""
    best = {}
    found = {w: [x for x in words if near(w, x)] for w in words}
    for w, xs in found.items():
        top = min(xs, key=lambda x: (-words[x], x), default=None)
        best[w] = top if top is not None and words[top] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while best[root] is not None:
            root = best[root]
        out.append((w, best[w], root, words[w], len(found[w]), words.get(best[w])))
    return sorted(out)


def grouped(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(tuple(r) for r in variants.group_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_pairs_of_random_words(spark):
    rng = random.Random(3)
    words = {}
    for letters, most, n in (("ab", 9, 400), ("abcdefgé", 6, 300), ("ÿxyz", 5, 200)):
        for _ in range(n):
            words["".join(rng.choice(letters) for _ in range(rng.randrange(1, most)))] = rng.choice([1, 2, 3, 4, 4, 9, 20, 40, 100])
    assert grouped(spark, words) == sorted(brute(words), key=lambda r: r[0])


def test_long_words_and_chains(spark):
    base = "ab" * 40_000
    words = {base: 8, base + "c": 4, base[:500] + "x" + base[501:]: 20, base[:-1]: 2, "z" * 60_000: 1, "z" * 60_001: 1}
    words |= {"chain" + "x" * k: 3 * 2**k for k in range(12)}
    assert grouped(spark, words) == sorted(brute(words), key=lambda r: r[0])


def damaged(data):
    out = Counter()
    for doc_id, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def test_whole_documents(spark):
    rng = random.Random(5)
    data = [r[:2] for r in rows()] + [(1000 + i, " ".join(rng.choice(["Straße", "ÉCOLE", "école", "naïve-wörter", "tests", "testx", "x÷y×zzz", "colour", "color"]) for _ in range(200))) for i in range(20)]
    got = variants.variants(frame(spark, [(*r, "en", "a", None) for r in data])).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == brute(damaged(data))


def test_empty(spark):
    assert variants.variants(frame(spark, [])).collect() == []
