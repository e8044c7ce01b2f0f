"""Conversation repair against a search over all edits, in whole conversations and cut into pieces."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from tarnmill.llm import repair

CONV = "conv_id long, turn long, role string, text string, piece long, codes string, audit string"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, turns) by shortest paths over (cost, audit), of (role, text, fault)."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, audit, i, roles, turns = heapq.heappop(heap)
        state = roles[-1:] or "-"
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, turns
        if (i, state) in seen:
            continue
        seen.add((i, state))
        nexts = {"-": "su", "s": "u", "u": "a", "a": "u"}[state]
        for role in nexts.replace("s", ""):
            name = {"u": "user", "a": "assistant"}[role]
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + role, (*turns, (name, ""))))
            if i < len(rows) and rows[i][2] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + 3 + 3 * (rows[i][2] == "truncated"), audit + "R", i + 1, roles + role, (*turns, (name, rows[i][1]))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, turns))
            if rows[i][2] not in ("blank", "duplicate") and rows[i][0][:1] in nexts and rows[i][0]:
                heapq.heappush(heap, (cost + 3 * (rows[i][2] == "truncated"), audit + "K", i + 1, roles + rows[i][0][0], (*turns, (rows[i][0], rows[i][1]))))


def damaged(rows):
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h:
            row = (c, t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            yield from [row] * (1 + (h == 3))


def brute(data):
    """Rows of repair_damaged()."""
    out = []
    convs = {r[0]: [] for r in data}
    for r in damaged(data):
        convs[r[0]].append(r)
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, seen = [], set()
        for _, _, role, text in rows:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit, turns = cheapest([(r[2], r[3], f) for r, f in zip(rows, faults)])
        known = [r[1] for r in rows if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()
        out.append((c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest))
    return out


def data(seed=0, convs=150, most=14):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Well!", "", "  \t", "a?\n", "…", "Long text. " * 50, "Ü.", "x\r\n.", " ", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"]
    out = [(c, rng.choice([t, t, t, 2 * t, None, 0]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Turn {rng.random()}.") for c in range(convs) for t in range(rng.randrange(1, most))]
    out += [(None, 1, "user", "null conversation"), (None, None, "assistant", "y."), (7000, 3, "user", "z" * 200_000 + ".")]
    out += [(9000, t, rng.choice(roles[:5]), rng.choice(texts) if rng.random() < 0.2 else f"{t}.") for t in range(400)]
    dropped = next(t for t in range(1000) if zlib.crc32(f"8000:{t}".encode()) % 20 == 0)
    return [*out, (8000, dropped, "user", "gone."), out[0], out[0]]


@pytest.mark.parametrize("segment", [3, 4096])
def test_equals_search(spark, segment):
    rows = data()
    df = spark.createDataFrame([(*r, 5, "x", "y") for r in rows], CONV)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, "7" if segment == 3 else "10000")
    try:
        got = sorted([tuple(r) for r in repair.repair_damaged(df, segment).collect()], key=repr)
    finally:
        spark.conf.unset(conf)
    assert got == sorted(brute(rows), key=repr)


def test_turns_read_back(spark):
    rows = data(1, 40)
    df = spark.createDataFrame([(*r, 5, "x", "y") for r in rows], CONV)
    out = {}
    for r in repair.repaired_turns(repair.damage(df)).orderBy("piece", "position").collect():
        out.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c, *_, digest in brute(rows):
        assert hashlib.sha256("\n".join(out.get(c, [])).encode()).hexdigest() == digest


def test_empty(spark):
    assert repair.repair_damaged(spark.createDataFrame([], CONV)).collect() == []
    assert repair.repair(spark.createDataFrame([], CONV)).collect() == []


def test_costs_over_pieces_of_any_length():
    rng = np.random.default_rng(0)
    lengths = [0, 1, 5, 16, 17, 40, 300]
    codes = [bytes(rng.choice([1, 2, 3, 0, 6, 10, 14, 15], n).astype(np.uint8)) for n in lengths]
    cost = repair.costs(repair._tensor(codes), np.broadcast_to(repair.END, (len(codes), 4)))
    letters, state = repair.trace(repair._tensor(codes), cost, np.zeros(len(codes), int))
    names = {0: "x", 1: "system", 2: "user", 3: "assistant"}
    for j, c in enumerate(codes):
        want = cheapest([(names[b & 3], str(i), [None, "blank", "duplicate", "truncated"][b >> 2]) for i, b in enumerate(c)])
        assert cost[0, j, 0] == want[0]
        assert letters[:, j][letters[:, j] > 0].tobytes().decode() + "I" * (int(repair.END[state[j]]) // 3) == want[1]
