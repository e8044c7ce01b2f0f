import zlib

import numpy as np
import public_tokenizers
from helpers import frame, rows
from tokenizers import Tokenizer

from tarnmill.llm.packing import best_fit_decreasing, encoder, pack


def test_ids_equal_the_tokenizer(spark):
    own, enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoder()
    for t in [r[1] or "" for r in rows()] + ["<|endoftext|>", " \n\n  x", "日本語 🙂🙂", "a" * 3000]:
        assert own.encode(t, add_special_tokens=False).ids == enc(t).tolist()


def test_every_id_once_and_gapless(spark):
    data = rows()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pack(frame(spark, data), capacity=256, shard=20).collect()
    want = {}
    for r in data:
        ids = np.array([*own.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 256):
            key = (r[0], s, min(256, len(ids) - s), zlib.crc32(ids[s : s + 256].tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
    have = {}
    for r in got:
        have[tuple(r)[:5]] = have.get(tuple(r)[:5], 0) + 1
    assert have == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 256
    assert pack(frame(spark, [])).collect() == []


def test_best_fit_is_the_tightest():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 65, 400)
    window, offset = best_fit_decreasing(n, 64)
    free, want = [], []
    for k in np.argsort(-n, kind="stable"):  # the plain search
        fits = [c for c in free if c >= n[k]]
        if fits:
            c = min(fits)
            free.remove(c)
        else:
            c = 64
        free.append(c - n[k])
        want.append(64 - c)
    assert [int(offset[k]) for k in np.argsort(-n, kind="stable")] == want
    assert np.bincount(window, n).max() <= 64 and len(np.unique(window)) == len(free)
