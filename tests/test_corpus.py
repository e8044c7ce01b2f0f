import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tarnmill.functions import text
from tarnmill.operators import corpus, pack
from tarnmill.operators.expect import ExpectationError, covers, disjoint, expect, unique
from tarnmill.plans.corpus_build import Recipe, check, packed, raw_documents

ROW = "source_row long, text_sha256 string, source_id string, tokens long"


def sequential(rows, targets, splits):
    """Rows one by one: the definition."""
    texts, ids, total, kept = set(), set(), dict.fromkeys(targets, 0), []
    for row, digest, ident, tokens in sorted(rows):
        if all(total[k] >= targets[k] for k in targets):
            break
        if digest in texts or ident and ident in ids:
            continue
        s = splits[digest]
        if total[s] >= targets[s]:
            continue
        texts.add(digest)
        ids.add(ident)
        total[s] += tokens
        kept.append(row)
    return kept


def digest(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def test_two_keys_by_hand(spark):
    rows = [(1, "A", "id1", 1), (2, "B", "id1", 1), (3, "B", "id2", 1)]
    got = corpus.two_key_dedup(spark.createDataFrame(rows, ROW)).collect()
    assert sorted(r["source_row"] for r in got) == [1, 3]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_admission_equals_the_sequential_model(spark, seed):
    rng = random.Random(seed)
    blocks, targets = {"train": 6, "valid": 2, "test": 2}, {"train": 60, "valid": 15, "test": 15}
    rows = [(i, digest(rng.randrange(45)), rng.choice(["", "", *(f"i{k}" for k in range(20))]), rng.randrange(1, 6)) for i in range(90)]
    df = spark.createDataFrame(rows, ROW)
    splits = {r["text_sha256"]: r["s"] for r in df.select("text_sha256", corpus.split_of(F.col("text_sha256"), 17, blocks).alias("s")).collect()}
    for d, s in splits.items():
        k = int(hashlib.sha256(f"17:{d}".encode()).hexdigest(), 16) % 10
        assert s == ("train" if k < 6 else "valid" if k < 8 else "test")
    got = corpus.admit(df, ["tokens"], targets, 17, blocks).select("source_row").collect()
    assert sorted(r[0] for r in got) == sequential(rows, targets, splits)


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_ranges_equal_the_sequential_model(spark, seed):
    """Rows with gaps in their numbers, read in ranges of a few; later ranges are not read once all splits are full."""
    rng = random.Random(seed)
    blocks, targets = {"train": 6, "valid": 2, "test": 2}, {"train": 60, "valid": 15, "test": 15}
    numbers = sorted(rng.sample(range(200), 90)) + list(range(5000, 5040))
    rows = [(i, digest(rng.randrange(60)), rng.choice(["", "", *(f"i{k}" for k in range(40))]), rng.randrange(1, 6)) for i in numbers]
    df = spark.createDataFrame(rows, ROW)
    splits = {r["text_sha256"]: r["s"] for r in df.select("text_sha256", corpus.split_of(F.col("text_sha256"), 17, blocks).alias("s")).collect()}
    got, ranges = corpus.admit_ranges(df, lambda d: d, ["tokens"], targets, 17, blocks, first=20)
    assert sorted(r["source_row"] for r in got.select("source_row").collect()) == sequential(rows, targets, splits)
    total, before = dict.fromkeys(targets, 0), {r["source_row"]: r["before_tokens"] for r in got.collect()}
    for i, d, _, n in rows:
        if i in before:
            assert before[i] == total[splits[d]]
            total[splits[d]] += n
    last = max(r["high"] for r in ranges.collect())
    assert sum(r["scanned"] for r in ranges.collect()) == sum(i < last for i in numbers)
    capped, _ = corpus.admit_ranges(df, lambda d: d, ["tokens"], targets, 17, blocks, first=20, most_rows=50)
    assert sorted(r["source_row"] for r in capped.select("source_row").collect()) == sequential([r for r in rows if r[0] < 50], targets, splits)
    with pytest.raises(ExpectationError, match="before the quotas"):
        corpus.admit_ranges(df, lambda d: d, ["tokens"], targets, 17, blocks, most_rows=30, strict=True)


def test_reading_stops(spark, tmp_path):
    from tarnmill.plans.corpus_build import scan_documents

    spark.createDataFrame([(i, f"w{i} x y z") for i in range(9000)], "source_row long, text string").repartitionByRange(9, "source_row").write.parquet(f"{tmp_path}/d")
    recipe = Recipe(block_size=10, blocks={"train": 20, "valid": 2, "test": 2})
    raw, ranges = scan_documents(spark.read.parquet(f"{tmp_path}/d"), recipe)
    assert [tuple(r) for r in ranges.collect()] == [(0, 1024, 1024)] and raw.agg(F.sum("tokens")).first()[0] >= 240
    assert scan_documents(spark.read.parquet(f"{tmp_path}/d"), recipe, most_rows=0)[0].count() == 0
    assert raw_documents(spark.createDataFrame([], "source_row long, text string"), recipe).count() == 0


def test_running_sum_over_chunks(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.randrange(9)) for i in range(200)]
    got = corpus.running_sum(spark.createDataFrame(rows, "r long, s string, v long"), ["v"], "r", "s", chunk=16).collect()
    total = {"a": 0, "b": 0}
    want = {}
    for i, s, v in rows:
        want[i] = total[s]
        total[s] += v
    assert {r["r"]: r["before_v"] for r in got} == want


def test_two_counters_must_both_fill(spark):
    rows = [(0, "train", 5, 1), (1, "train", 5, 1), (2, "train", 5, 1)]
    got = corpus.quota(spark.createDataFrame(rows, "source_row long, split string, a long, b long"), ["a", "b"], {"train": 2}).collect()
    assert sorted(r["source_row"] for r in got) == [0, 1]


def test_spans_by_hand(spark):
    rows = [(0, "train", 5), (1, "train", 4), (2, "train", 6)]
    got = pack.spans(spark.createDataFrame(rows, "source_row long, split string, tokens long"), {"train": 12}).orderBy("source_row").collect()
    assert [(r["token_start"], r["token_end"], r["document_tail_truncated"]) for r in got] == [(0, 5, False), (5, 9, False), (9, 12, True)]


def test_blocks_hold_the_tokens_in_order(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 40)))) for i in range(120)]
    recipe = Recipe(block_size=16, blocks={"train": 8, "valid": 1, "test": 1})
    raw = raw_documents(spark.createDataFrame(docs, "source_row long, text string"), recipe)
    spans, blocks = packed(raw, recipe)
    check(blocks, recipe)
    whole = {}
    for r in spans.orderBy("source_row").collect():
        t = [*r["text"].split(), "<eos>"][: r["token_end"] - r["token_start"]]
        whole.setdefault(r["split"], []).extend(t)
    got = {}
    for r in blocks.orderBy("block_id").collect():
        got.setdefault(r["split"], []).extend(r["tokens"])
    assert got == whole


def test_unmet_quotas_are_found(spark):
    recipe = Recipe(block_size=64, blocks={"train": 8, "valid": 1, "test": 1})
    _, blocks = packed(raw_documents(spark.createDataFrame([(0, "a b"), (1, "c d")], "source_row long, text string"), recipe), recipe)
    with pytest.raises(ExpectationError):
        check(blocks, recipe)


def test_blank_and_missing_texts(spark):
    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    df = spark.createDataFrame([(0, spaces), (1, ""), (2, "x"), (3, "​")], "source_row long, text string")
    assert sorted(r["source_row"] for r in corpus.candidates(df).collect()) == [2, 3]
    with pytest.raises(Exception, match="no text"):
        corpus.candidates(spark.createDataFrame([(0, None)], "source_row long, text string")).collect()


def test_identifiers_and_digests(spark):
    df = spark.createDataFrame([(0, "0" * 64), (5, "x"), (None, None)], "i long, d string")
    got = df.select(text.identifier(F.col("i"), True).alias("i"), text.is_digest(F.col("d")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("", True), ("5", False), ("", False)]
    h = digest("q")
    for m in (2, 97, 2**31 - 1):
        assert spark.range(1).select(text.digest_modulo(F.lit(h), m)).first()[0] == int(h, 16) % m
    paths = spark.createDataFrame([("a/b",), ("/a",), ("a/../b",), ("a..b",)], "p string").select(text.escapes_root(F.col("p"))).collect()
    assert [r[0] for r in paths] == [False, True, True, False]
    assert spark.range(1).select(text.list_digest(F.array(F.lit(1), F.lit(2)))).first()[0] == digest("[1, 2]")
    assert text.canonical_digest({"b": 1, "a": "ü"}) == digest('{"a": "ü", "b": 1}')


def test_expectations(spark):
    df = spark.createDataFrame([(0,), (1,), (1,)], "k long")
    with pytest.raises(ExpectationError):
        unique(df, "k")
    with pytest.raises(ExpectationError):
        expect(df, small=F.col("k") < 1)
    with pytest.raises(ExpectationError):
        disjoint(df, df, "k")
    with pytest.raises(ExpectationError):
        covers(spark.range(1, 4).withColumnRenamed("id", "k"), "k", 3)
    covers(spark.range(3).withColumnRenamed("id", "k"), "k", 3)


def test_full_quota_packs_every_document(spark, tmp_path):
    """More tokens than the 25,600 of the small recipe: none is dropped."""
    from tarnmill import queries

    rows = [(i, " ".join(f"w{i}" for _ in range(99))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = queries.queries()
    assert q["full_quota_admission"](spark, str(tmp_path)).count() == 400
    assert sum(r["token_end"] - r["token_start"] for r in q["full_pack_spans"](spark, str(tmp_path)).collect()) == 40_000
    assert sum(r["tokens"] for r in q["full_pack_blocks"](spark, str(tmp_path)).collect()) == 40_000


def test_chains_of_any_length(spark):
    """Each row shares its text with the one before it and its id with the one after it, or the other way round."""
    rows = [(i, f"t{(i + 1) // 2}", f"s{i // 2}") for i in range(400)]
    df = spark.createDataFrame(rows, "source_row long, text_sha256 string, source_id string")
    assert sorted(r[0] for r in corpus.two_key_dedup(df).select("source_row").collect()) == list(range(0, 400, 2))


def test_counters_and_recovery(spark):
    from tarnmill.plans.corpus_build import report

    recipe = Recipe(block_size=6, blocks={"train": 2, "valid": 1, "test": 1})
    texts = [f"w{i} x y" for i in range(30)]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts[:5] + [texts[0], " ", texts[1]] + texts[5:])]
    docs = spark.createDataFrame(rows, "source_row long, text string, source_id string")
    raw = raw_documents(docs, recipe)
    got = {r["split"]: r for r in report(docs, raw, recipe, ["tokens"]).collect()}
    kept = {r["source_row"]: r for r in raw.collect()}
    fill = {k: min((x for x in kept if kept[x]["split"] == k and sum(kept[y]["tokens"] for y in kept if y <= x and kept[y]["split"] == k) >= v), default=None) for k, v in recipe.targets.items()}
    stop = max(fill.values()) if None not in fill.values() else len(rows) - 1
    for k, r in got.items():
        assert r["fill_row"] == fill[k] and r["documents"] == sum(x["split"] == k for x in kept.values()) and r["rows_read"] == stop + 1
        assert r["empty_skipped"] == sum(i <= stop and not t.strip() for i, t, _ in rows)
        assert r["duplicates_skipped"] == sum(i <= stop and any(j < i and j in kept and t == u for j, u, _ in rows) for i, t, _ in rows)
    counts = raw.groupBy("split").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    corpus.check_recovered(raw, ["tokens"], counts)
    for bad in (raw.union(raw.limit(1)), raw.where(F.col("source_row") != min(kept))):
        with pytest.raises(ExpectationError):
            corpus.check_recovered(bad, ["tokens"], counts)


def test_local_shuffle_stays_local(spark):
    d = corpus.local_shuffle(spark.range(500).withColumnRenamed("id", "source_row"), "source_row", 40, 3).orderBy("draw", "source_row").collect()
    assert max(abs(r["source_row"] - k) for k, r in enumerate(d)) < 40 and [r["source_row"] for r in d] != list(range(500))


def test_tokenizer_files(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tarnmill.functions.tokenizers import Characters, FileTokenizer, HashedWords

    docs = spark.createDataFrame([(0, "Hello  world's 123"), (1, "déjà vu")], "source_row long, text string")
    file = FileTokenizer(tokenizers.path("byte_bpe_50k.json"), 1, 60_000)
    for t in (file, HashedWords(), Characters()):
        for r in docs.select(t.ids(F.col("text")).alias("ids"), t.count(F.col("text")).alias("n")).collect():
            assert len(r["ids"]) == r["n"] and all(0 <= i < t.size for i in r["ids"])
    with pytest.raises(Exception, match="gives ids"):
        docs.select(FileTokenizer(file.path, 1, 100).ids(F.col("text"))).collect()


def test_command_line(spark, tmp_path):
    from tarnmill import __main__ as cli

    spark.createDataFrame([(i, f"w{i} x y z", f"s{i}") for i in range(200)], "source_row long, text string, source_id string").write.parquet(f"{tmp_path}/docs")
    size = ["--block-size", "10", "--train", "8", "--valid", "1", "--test", "1", "--calibration", "3"]
    cli.main(["build", "--source", f"{tmp_path}/docs", "--output", f"{tmp_path}/out", *size])
    cli.main(["check", "--output", f"{tmp_path}/out", *size])
    assert spark.read.parquet(f"{tmp_path}/out/train").count() == 8 and (tmp_path / "out" / "report.json").exists()
    with pytest.raises(ExpectationError, match="before the quotas"):
        cli.main(["build", "--source", f"{tmp_path}/docs", "--output", f"{tmp_path}/short", "--max-documents", "5", *size])
    with pytest.raises(SystemExit):
        cli.main(["build", "--source", "x", "--output", "y", "--train", "0"])


def test_interrupted_publishing_goes_on(spark, tmp_path, monkeypatch):
    from tarnmill.operators import pack as packing
    from tarnmill.plans import corpus_build

    recipe = Recipe(block_size=10, blocks={"train": 8, "valid": 1, "test": 1}, calibration=3)
    docs = spark.createDataFrame([(i, f"w{i} x y z", f"s{i}") for i in range(200)], "source_row long, text string, source_id string")
    out = f"{tmp_path}/out"

    def killed(*a):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(packing, "calibration", killed)
        with pytest.raises(KeyboardInterrupt):
            corpus_build.prepare(docs, recipe, out)
    building = tmp_path / "out.building"
    times = {f: f.stat().st_mtime_ns for f in building.rglob("*.parquet")}
    assert len(times) >= 4 and not (building / "calibration.json").exists()
    with pytest.raises(ValueError, match="another recipe"):
        corpus_build.prepare(docs, Recipe(seed=18, block_size=10, blocks=recipe.blocks, calibration=3), out)
    with monkeypatch.context() as m:
        m.setattr(corpus_build, "packed", killed)  # finished parts are not made again
        got = corpus_build.prepare(docs, recipe, out)
    assert got["train"]["rows"] == 8 and got["documents"]["tokens"] == 100 and got["calibration"]["rows"] == 3
    assert {f: (tmp_path / "out" / f.relative_to(building)).stat().st_mtime_ns for f in times} == times
    drawn = {r["block_id"]: r["tokens"] for r in spark.read.parquet(f"{out}/calibration").collect()}
    assert drawn.items() <= {r["block_id"]: r["tokens"] for r in spark.read.parquet(f"{out}/train").collect()}.items()
    with pytest.raises(FileExistsError):
        corpus_build.prepare(docs, recipe, out)
    with pytest.raises(ExpectationError, match="train: blocks"):
        corpus_build.prepare(docs.limit(5), recipe, f"{tmp_path}/few")
