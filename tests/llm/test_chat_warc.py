import hashlib
import random

from pyspark.sql import functions as F

from tarnmill.llm import chat, warc

CONV = "conv_id long, turn long, role string, text string, ts int, f0 string, ok0 int"


def test_round_trip_of_hard_texts(spark):
    rng = random.Random(0)
    bits = ["[INST]", "[/INST]", "</s>", "\\", "<", "/s>", "ok", "\n", " ", "é", "[", "<\\/s>", "\\\\", "$1"]
    data = [(c, t, rng.choice(["user", "assistant", "system", "a</s>b", ""]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))) for c in range(60) for t in range(rng.randrange(1, 6))]
    data += [(None, 0, None, None), (500, None, "user", "x"), (500, 1, "assistant", None), (501, 0, "assistant", "y" * 100_000), (502, 3, "user", "twice"), (502, 3, "user", "twice")]
    df = spark.createDataFrame([(*r, 1, "f", 0) for r in data], CONV)
    out = chat.format_conversations(df)
    want = {}
    for c, t, role, text in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    rows = out.collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in rows} == want
    for r in rows:
        loss = "".join(r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"])
        if r["level"] == 0:
            assert loss == "".join(x for role, x in want[r["conv_id"]] if role == "assistant")
    for r in chat.digests(out).collect():
        turns = want[r["conv_id"]]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"], r["n_turns"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(turns))
    assert chat.format_conversations(df.where("conv_id = -1")).collect() == []


def test_archives(spark):
    rng = random.Random(0)
    body = ["<p>" + "".join(rng.choice("abcdef \r\n") for _ in range(300)) + "</p>" for _ in range(20)]
    data = [(i, f"http://x/{i}\r\nEvil: %0A", body[i % 20] if i < 60 else f"short {i % 3}") for i in range(80)]
    data += [(None, None, body[0]), (90, "u", None), (91, "u", ""), (92, "u", "é" * 50), (93, "u", "é" * 50), (94, "u", "WARC/1.1\r\n\r\n" * 20), (5, "again", body[5])]
    df = spark.createDataFrame([(*r, 1, "d") for r in data], "page_id long, url string, html string, first int, digest string")
    archives = warc.write_archives(df, archive_bytes=4000)
    for r in archives.collect():
        assert int.from_bytes(bytes(r["content"][:4]), "little") == warc.MAGIC
    got = warc.read_archives(archives).collect()
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h in data:
        b = (h or "").encode()
        copies = sum((x[2] or "") == (h or "") for x in data)
        visit = len(b) >= 100 and copies > 1 and first[h] != i
        want.append((i, u, len(b), hashlib.sha256(b).hexdigest(), "revisit" if visit else "response", first[h] if visit else None, None if visit else b))
    assert sorted([tuple(r) if r["payload"] is None else (*tuple(r)[:6], bytes(r["payload"])) for r in got], key=repr) == sorted(want, key=repr)
    empty = warc.write_archives(df.where("page_id = -1"))
    assert warc.read_archives(empty).collect() == []


def test_null_urls_survive(spark):
    df = spark.createDataFrame([(1, None, "x")], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(df)).select(F.col("url")).collect()[0][0] is None


def test_archives_as_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", f"<p>page {i % 7}</p>" * 40) for i in range(60)], "page_id long, url string, html string")
    archives = warc.write_archives(df, archive_bytes=300)
    out = f"file://{tmp_path}/archives"
    for _ in range(2):  # a second time gives the same files
        names = {r["archive"] for r in warc.export_archives(archives, out).collect()}
    assert names == {p.name for p in (tmp_path / "archives").iterdir() if not p.name.startswith(".")}
    (tmp_path / "archives" / "x.warc.zst.1.part").write_bytes(b"torn")
    own = warc.read_archives(archives).collect()
    assert len(own) == 60 and sorted(map(repr, warc.read_archives(warc.open_files(spark, out)).collect())) == sorted(map(repr, own))
    warc.export_archives(archives.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(warc.open_files(spark, f"file://{tmp_path}/none")).collect() == []
