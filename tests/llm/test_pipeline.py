import re

import corpus_pipeline as cp
import pytest
from helpers import frame, rows
from pyspark.sql import functions as F


def _folder(spark, tmp_path, data):
    frame(spark, data).select(*cp.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 7 != 0), 0) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    data = rows(11, 300)
    data = [(i, t.upper().replace(" ", "!! ") if i is not None and i < 300 and i % 7 == 0 else t, *rest) for i, t, *rest in data]
    d = _folder(spark, tmp_path, data)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == cp.COLUMNS, name
        docs = cp.materialize(out, "test")
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids
        ids = left
    assert not ids & {i for i in range(0, 300, 7)} and len(ids) > 100
    out = cp.run(spark, d)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == ids


def test_empty_corpus(spark, tmp_path):
    assert cp.run(spark, _folder(spark, tmp_path, [])).collect() == []


def test_near_copies_and_repeated_rows(spark, tmp_path):
    """Verdicts belong to rows: a rejected row does not come back with another one of its doc_id."""
    long = " ".join(f"w{i}" for i in range(60))
    data = [(4, long, "en", "s", 1), (4, long, "en", "s", 1), (2, long, "en", "s", 1), (7, long + " end", "en", "s", 1), (9, "another text", "en", "s", 1), (9, long, None, None, None), (None, "no id at all", "en", "s", 1), (None, long, "en", "s", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near_dedup(spark, docs, str(tmp_path))
    assert sorted(tuple(r)[:2] for r in got.where("doc_id is not null").collect()) == [(2, long), (9, "another text")]
    assert [r["text"] for r in got.where("doc_id is null").collect()] == ["no id at all"]
    assert cp.near_dedup(spark, docs.where("doc_id = 2"), str(tmp_path)).count() == 1


def test_rules_judge_rows(spark, tmp_path):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    data = [(1, good, "en", "s", 1), (1, bad, "en", "s", 1), (None, good, "en", "s", 1), (None, bad, "en", "s", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(repr, (tuple(r)[:2] for r in cp.quality_rules(spark, docs, str(tmp_path)).collect()))) == sorted(map(repr, [(1, good), (None, good)]))


def test_rows_equal_brute_force(spark, tmp_path):
    """run() against the stages by hand: verdicts of the classifier and the rules by document, near copies by all pairs, copies by
    their rates, and the ids of every copy tiled by its pieces."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from tarnmill.llm import mixing, packing, quality, rules

    public_tokenizers = pytest.importorskip("public_tokenizers")
    data = [(i, t.upper().replace(" ", "!! ") if i is not None and i < 300 and i % 7 == 0 else t, *rest) for i, t, *rest in rows(5, 300)]
    seen, unique = set(), []
    for r in data:  # one row for each doc_id, so that verdicts can be looked up
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            unique.append(r)
    d = _folder(spark, tmp_path, unique)
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    text = {r[0]: r[1] or "" for r in unique}
    kept = {r["doc_id"] for r in quality.classify(docs, labels).collect() if r["kept"]}
    left = docs.where(F.col("doc_id").isin(*kept))
    kept = {r["doc_id"] for r in rules.judge(left).collect() if r["kept"]}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())

    sets = {i: shingles(text[i]) for i in kept}
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {i for i in kept if find(i) == i}
    left = docs.where(F.col("doc_id").isin(*kept))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(left, labels).collect()}
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, n in copies.items():
        if n:
            want[i] = [*encoder.encode(text[i], add_special_tokens=False).ids, 1]
    got = cp.run(spark, d).collect()
    assert {r["doc_id"] for r in got} == set(want)
    spans: dict = {}
    for r in got:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        for k in range(r["start"], r["start"] + r["length"]):
            spans.setdefault(r["doc_id"], {}).setdefault(k, 0)
            spans[r["doc_id"]][k] += 1
    for i, ids in want.items():
        assert spans[i] == dict.fromkeys(range(len(ids)), copies[i])
    taken: dict = {}
    for r in got:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in taken.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= packing.CAPACITY
