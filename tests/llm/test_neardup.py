import random

import pytest
from helpers import frame, rows, sentence

from tarnmill.llm.common import components
from tarnmill.llm.neardup import deduplicated, near_duplicates


def sets(data, size):
    out = []
    for i, t, *_ in data:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def brute(data, size, percent):
    """(doc_id, n_shingles, component_id, kept) of each row by comparing all pairs."""
    s = sets(data, size)
    par = list(range(len(data)))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if data[a][0] is not None and data[b][0] is not None and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                par[root(a)] = root(b)
    least = {}
    for k, r in enumerate(data):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return sorted(((r[0], len(s[k]), None if r[0] is None else least[root(k)], r[0] is not None and r[0] == least[root(k)]) for k, r in enumerate(data)), key=repr)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, size, percent):
    data = rows()
    got = near_duplicates(frame(spark, data), size, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(data, size, percent)


@pytest.mark.parametrize(("rounds", "crowd"), [(0, 64), (1, 64), (3, 64), (0, 4), (1, 4), (3, 4)])
def test_chains_and_groups(spark, monkeypatch, rounds, crowd):
    """Copies of copies that are linked through others only; the same links with any number of rounds of leaders and whatever
    counts as a crowd."""
    monkeypatch.setattr("tarnmill.llm.neardup.CROWD", crowd)
    rng = random.Random(4)
    base = sentence(rng, 150).split()
    data = [(0, " ".join(base), "en", "a", 1)]
    for k in range(1, 90):
        w = list(base) if k % 3 else data[-1][1].split()
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        data.append((k, " ".join(w), "en", "a", 1))
    got = sorted((tuple(r) for r in near_duplicates(frame(spark, data), 3, 85, rounds=rounds).collect()), key=repr)
    assert got == brute(data, 3, 85)


def test_large_group_of_near_copies(spark):
    """Twenty thousand edits of one text: compared with leaders, not with each other."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(20_000):
        w = list(base)
        w[rng.randrange(3, 57)] = f"x{k}"
        texts.append((k, " ".join(w), "en", "a", 1))
    got = near_duplicates(frame(spark, texts + [(30_000, " ".join(base), "en", "a", 1)]), 3, 85)
    assert got.where("component_id = 0").count() == 20_001


def test_rows_that_stay(spark):
    """One row of each component, whole; rows are told apart by themselves and not by their doc_id."""
    a, b = sentence(random.Random(1), 60), sentence(random.Random(2), 60)
    data = [(1, a, "en", "s", 1), (5, a, "de", "s", 2), (5, b, "en", "t", 3), (None, b, "fr", "s", 4), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (7, None, "en", "s", 6), (8, "", "en", "s", 7), (7, None, "en", "s", 6)]
    docs = frame(spark, data)
    got = deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got.collect()) == [(0, 5), (1, 1), (5, 3), (7, 6), (7, 6), (8, 7)]
    assert deduplicated(docs.where("doc_id = 99")).collect() == []


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    par = {}
    for a, b in edges:
        x, y = a, b
        while par.setdefault(x, x) != x:
            x = par[x]
        while par.setdefault(y, y) != y:
            y = par[y]
        par[max(x, y)] = min(x, y)

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}
