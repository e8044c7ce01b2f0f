r"""Conversation structure repair by a time-major tensor of edit costs.

A conversation's roles should read `(s?(ua)+)?` by their initials. Edits: K keeps a row, R gives it the role user or
assistant, D deletes it, I inserts an empty turn of user or assistant. Blank and duplicate rows must go; a truncated row that
stays costs extra. What may follow is one of four states: at the start, after the system's turn, after the user's, after the
assistant's; so the role of an insertion or a new role follows from the state.

Rows are sorted over the cluster and cut into pieces of at most SEGMENT turns, which are written. Tasks take pieces in
batches, bucket them by length and update the costs of all of a bucket's pieces turn by turn, from the last to the first:
costs[turn, piece, state], kept for the trace, which again advances all pieces at once. A conversation that lies in several
pieces (long ones, or at the edge of a task) is joined by its pieces' 4 x 4 cost matrices: 16 numbers for each SEGMENT turns.
No step holds a long conversation's texts; what is sequential by its nature, the digest of the repaired text, is a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SEGMENT = 4096
SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an insertion or a new role leads, the initial's code that Keep needs to lead from a state to another, and costs at a
#: conversation's end.
TURN = np.array([USER, USER, ASSISTANT, USER])
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
FAR = np.int64(1) << 40
NAMES = {USER: "user", ASSISTANT: "assistant"}
PIECE = (
    "conv_id long, piece long, n int, codes binary, roles array<string>, texts array<string>, first string, last string, blank long, duplicate long, truncated long, illegal long, "
    "turns long, turn_first long, turn_last long, low long, high long, matrix array<long>"
)
DONE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _kept(codes: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state that Keep leads to, or -1. Codes: 0 another initial, 1 s, 2 u, 3 a."""
    out = np.full(np.broadcast_shapes(codes.shape, state.shape), -1)
    out = np.where((codes == SYSTEM) & (state == START), SYSTEM, out)
    out = np.where((codes == USER) & (state != USER), USER, out)
    return np.where((codes == ASSISTANT) & (state == USER), ASSISTANT, out)


def _close(v: np.ndarray) -> np.ndarray:
    """Costs when turns may be inserted first; states are axis 1."""
    out = v.copy()
    out[:, USER] = np.minimum(v[:, USER], INSERT + v[:, ASSISTANT])
    out[:, ASSISTANT] = np.minimum(v[:, ASSISTANT], INSERT + v[:, USER])
    out[:, START] = np.minimum(v[:, START], INSERT + out[:, USER])
    out[:, SYSTEM] = np.minimum(v[:, SYSTEM], INSERT + out[:, USER])
    return out


def _options(codes: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of D, K and R at a turn, of all pieces and states; after: [piece, state, ...] costs behind the turn."""
    fault, initial = codes >> 2, codes & 3
    extra = (slice(None), None) + (None,) * (after.ndim - 2)
    stay = np.where((fault == 1) | (fault == 2), FAR, np.where(fault == 3, TRUNCATED, 0))[extra]
    to = _kept(initial[:, None], np.arange(4)[None, :])
    keep = np.take_along_axis(after, np.maximum(to, 0).reshape(to.shape + (1,) * (after.ndim - 2)), 1)
    keep = np.where((to < 0).reshape(to.shape + (1,) * (after.ndim - 2)), FAR, KEEP + stay + keep)
    return DELETE + after, keep, REROLE + stay + after[:, TURN]


def _tensor(codes: list[bytes]) -> np.ndarray:
    """Codes as [turn, piece], 255 behind a piece's end."""
    out = np.full((max(map(len, codes), default=0), len(codes)), 255, np.uint8)
    for i, c in enumerate(codes):
        out[: len(c), i] = np.frombuffer(c, np.uint8)
    return out


def costs(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[turn, piece, state, ...]: the cheapest costs from a turn on; end: those behind the last turn."""
    out = np.empty((len(codes) + 1, *end.shape), np.int64)
    out[-1] = end
    for t in range(len(codes) - 1, -1, -1):
        after = out[t + 1]
        best = _close(np.minimum(np.minimum(*(o := _options(codes[t], after))[:2]), o[2]))
        gone = (codes[t] == 255).reshape((-1,) + (1,) * (end.ndim - 1))
        out[t] = np.where(gone, after, np.minimum(best, FAR))
    return out


def trace(codes: np.ndarray, cost: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest edits from the given states, of equals the one whose letters are least: ([slot, piece] letters with
    zeros between them, states at the end). At most two turns are inserted before a row."""
    letters, rows, state = np.zeros((len(codes) * 3, codes.shape[1]), np.uint8), np.arange(codes.shape[1]), state.copy()
    for t in range(len(codes)):
        open_, after = codes[t] != 255, cost[t + 1]
        delete, keep, rerole = _options(codes[t], after)
        kept = _kept(codes[t] & 3, np.arange(4)[:, None]).T
        for slot in range(3):
            now = cost[t, rows, state]
            can_delete = delete[rows, state] == now
            can_insert = INSERT + cost[t, rows, TURN[state]] == now
            can_keep = keep[rows, state] == now
            letter = np.where(can_delete, ord("D"), np.where(can_insert, ord("I"), np.where(can_keep, ord("K"), ord("R"))))
            letters[3 * t + slot] = np.where(open_, letter, 0)
            moved = np.where(can_delete, state, np.where(~can_insert & can_keep, kept[rows, state], TURN[state]))
            state = np.where(open_, moved, state)
            open_ = open_ & ~can_delete & can_insert
        if open_.any():
            raise RuntimeError("more than two insertions before a turn")
    return letters, state


def _buckets(lengths: list[int]) -> Iterator[np.ndarray]:
    """Indices of pieces of like length: equal up to 16 turns, within an eighth beyond."""
    n = np.asarray(lengths)
    step = np.maximum(1, 1 << np.maximum(0, np.floor(np.log2(np.maximum(n, 1))).astype(int) - 3))
    key = -(-n // step) * step
    for k in np.unique(key):
        yield np.flatnonzero(key == k)


def _rows(rows: DataFrame) -> DataFrame:
    """Rows with their codes, sorted over the cluster. The earliest turn of each role and text is found by a minimum that is
    combined before its shuffle."""
    space = F.lit(" ")
    r = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"))
    r = r.withColumn("digest", F.sha2("text", 256))
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    first = r.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(order).alias("first"))
    r = r.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(end == "", 1).when(~order.eqNullSafe(F.col("first")), 2).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.position(F.substring("role", 1, 1), F.lit("sua"))
    r = r.select("conv_id", "turn", "role", "text", (fault * 4 + F.when(F.col("role") == "", 0).otherwise(initial)).cast("int").alias("code"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return r.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _pieces(df: pd.DataFrame, starts: np.ndarray, number: int) -> pd.DataFrame:
    """The pieces that begin at the given rows, the first at 0."""
    codes, ends = df.code.to_numpy(np.uint8), np.append(starts[1:], len(df))
    fault, initial = codes >> 2, df.role.str.slice(0, 1).to_numpy(object)
    inner = np.ones(len(df), bool)
    inner[starts] = False
    illegal = inner & ~np.isin(np.append([""], initial[:-1] + initial[1:]), ["su", "ua", "au"])
    known = df.turn.notna().to_numpy()
    turn = df.turn.fillna(0).to_numpy(np.int64)
    other = known & np.append([True], (turn[1:] != turn[:-1]) | ~known[:-1] | ~inner[1:])
    total = lambda flags: np.add.reduceat(flags.astype(np.int64), starts)
    some = known[ends - 1]  # nulls come first
    first_known = np.minimum(starts + total(~known), len(df) - 1)
    roles, texts, blob = df.role.tolist(), df.text.tolist(), codes.tobytes()
    spans = list(zip(starts.tolist(), ends.tolist()))
    matrices, unit = [None] * len(spans), np.where(np.eye(4, dtype=bool), 0, FAR)
    cut = [blob[x:y] for x, y in spans]
    for at in _buckets([len(c) for c in cut]):
        for i, m in zip(at, costs(_tensor([cut[j] for j in at]), np.broadcast_to(unit, (len(at), 4, 4)))[0]):
            matrices[i] = m.reshape(-1).tolist()
    high, low = pd.array(turn[ends - 1], "Int64"), pd.array(turn[first_known], "Int64")
    high[~some], low[~some] = pd.NA, pd.NA
    return pd.DataFrame(
        {
            "conv_id": df.conv_id.array[starts], "piece": number + np.arange(len(starts)), "n": ends - starts, "codes": cut, "roles": [roles[x:y] for x, y in spans], "texts": [texts[x:y] for x, y in spans],
            "first": initial[starts], "last": initial[ends - 1], "blank": total(fault == 1), "duplicate": total(fault == 2), "truncated": total(fault == 3), "illegal": total(illegal), "turns": total(other),
            "turn_first": df.turn.array[starts], "turn_last": df.turn.array[ends - 1], "low": low, "high": high, "matrix": matrices,
        }
    )


def _changes(column: pd.Series) -> np.ndarray:
    """Whether a row's value differs from that of the row before; the first one's does."""
    known, value = column.notna().to_numpy(), column.fillna(0 if column.dtype == "Int64" else "").to_numpy()
    return np.append([True], (known[1:] != known[:-1]) | (value[1:] != value[:-1]))


def _cut(batches: Iterator[pd.DataFrame], segment: int) -> Iterator[pd.DataFrame]:
    """Sorted rows to pieces. A row equal to the one before is a duplicate too. The last piece waits for the next batch."""
    number, rest = TaskContext.get().partitionId() << 32, None
    for df in batches:
        if not len(df):
            continue
        df = df.assign(conv_id=df.conv_id.astype("Int64"), turn=df.turn.astype("Int64"), old=False)
        df = df if rest is None else pd.concat([rest, df], ignore_index=True)
        conv = _changes(df.conv_id)
        same = ~(conv | _changes(df.turn) | _changes(df.role) | _changes(df.text))
        code = df.code.to_numpy().copy()
        twice = same & (code >> 2 != 1)
        code[twice] = code[twice] & 3 | 8
        df = df.assign(code=code)
        if df.old.iloc[0]:  # the last row of a full piece, only there to be compared
            df, conv = df.iloc[1:].reset_index(drop=True), conv[1:].copy()
            conv[0] = True
        at = np.arange(len(df))
        starts = np.flatnonzero((at - np.maximum.accumulate(np.where(conv, at, 0))) % segment == 0)
        last = starts[-1] if len(df) - starts[-1] < segment else len(df)
        if last:
            yield _pieces(df.iloc[:last], starts[starts < last], number)
            number += int((starts < last).sum())
        rest = df.iloc[last:] if last < len(df) else df.iloc[-1:].assign(old=True)
    if rest is not None and not rest.old.iloc[0]:
        yield _pieces(rest.reset_index(drop=True), np.array([0]), number)


def _behind(df: pd.DataFrame) -> pd.DataFrame:
    """Costs behind each piece of one conversation, by its pieces' matrices from the last to the first."""
    df = df.sort_values("piece", ignore_index=True)
    v, out = END, []
    for m in reversed(df.matrix.tolist()):
        out.append(v.tolist())
        v = _close((np.asarray(m).reshape(4, 4) + v).min(1)[None])[0]
    return df[["conv_id", "piece"]].assign(behind=out[::-1], final=[0] * (len(df) - 1) + [1])


def _ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each piece and each state at its start: the state at its end."""
    for df in batches:
        ends = [None] * len(df)
        for at in _buckets([len(c) for c in df.codes]):
            codes = _tensor([df.codes.iloc[i] for i in at for _ in range(4)])
            _, state = trace(codes, costs(codes, np.repeat(np.array([df.behind.iloc[i] for i in at]), 4, 0)), np.tile(np.arange(4), len(at)))
            for i, s in zip(at, state.reshape(-1, 4)):
                ends[i] = s.tolist()
        yield df[["conv_id", "piece", "behind", "final"]].assign(ends=ends)


def _entered(df: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each piece of one conversation."""
    df = df.sort_values("piece", ignore_index=True)
    state, out = START, []
    for e in df.ends:
        out.append(state)
        state = e[state]
    return df[["conv_id", "piece", "behind", "final"]].assign(entered=out)


def _edited(audit: bytes, state: int, roles: list, texts: list) -> tuple[list[tuple[str, str]], int]:
    """Repaired turns of a piece and the state behind them."""
    turns, at = [], 0
    for e in audit:
        if e == 68:  # D
            at += 1
            continue
        role, text = NAMES[int(TURN[state])], ""
        if e != 73:  # I
            role, text, at = roles[at] if e == 75 else role, texts[at], at + 1
        state = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ASSISTANT
        turns.append((role, text))
    return turns, state


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces with their edits and repaired turns. behind, final and entered are null where the piece is a conversation."""
    for df in batches:
        whole = df.entered.isna()
        entered = df.entered.fillna(START).to_numpy(int)
        behind = np.array([END if b is None else b for b in df.behind.where(~whole, None)])
        last = df.final.fillna(1).to_numpy(int)
        audits, spent, turned = [None] * len(df), np.zeros(len(df), np.int64), [None] * len(df)
        for at in _buckets(df.n.tolist()):
            codes = _tensor([df.codes.iloc[i] for i in at])
            cost = costs(codes, behind[at])
            letters, state = trace(codes, cost, entered[at])
            for j, i in enumerate(at):
                audits[i] = letters[:, j][letters[:, j] > 0].tobytes() + b"I" * (int(END[state[j]]) // INSERT if last[i] else 0)
                turned[i], s = _edited(audits[i], int(entered[i]), df.roles.iloc[i], df.texts.iloc[i])
                spent[i] = cost[0, j, entered[i]] - (0 if last[i] else behind[i][state[j]])
        kept = ["conv_id", "piece", "first", "last", "blank", "duplicate", "truncated", "illegal", "turns", "turn_first", "turn_last", "low", "high"]
        yield df[kept].assign(cost=spent, audit=[a.decode() for a in audits], new_roles=[[r for r, _ in t] for t in turned], new_texts=[[x for _, x in t] for t in turned])


SLICE = "conv_id long, piece long, first string, last string, blank long, duplicate long, truncated long, illegal long, turns long, turn_first long, turn_last long, low long, high long, cost long, audit string, new_roles array<string>, new_texts array<string>"
COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces in order to conversations; of the texts only the running digest is kept."""
    now: dict | None = None

    def close(c: dict) -> dict:
        gaps = c["high"] - c["low"] + 1 - c["turns"] if c["low"] is not None else 0
        return {"conv_id": c["conv_id"], "gaps": gaps, **{k: c[k] for k in COUNTS}, "audit": b"".join(c["audit"]).decode(), "repaired_sha256": c["hash"].hexdigest()}

    for df in batches:
        out = []
        for r in df.astype({k: "Int64" for k in ("conv_id", "turn_first", "turn_last", "low", "high")}).astype(object).itertuples(index=False):
            conv, low = (None if pd.isna(r.conv_id) else int(r.conv_id)), (None if pd.isna(r.low) else int(r.low))
            if now is None or now["conv_id"] != conv:
                if now is not None:
                    out.append(close(now))
                now = {"conv_id": conv, "low": None, "high": None, "turns": 0, "audit": [], "hash": hashlib.sha256(), "some": False, "last": None, "turn_last": None, **dict.fromkeys(COUNTS, 0)}
            for k in COUNTS:
                now[k] += int(getattr(r, k))
            if now["last"] is not None and now["last"] + r.first not in ("su", "ua", "au"):
                now["illegal"] += 1
            now["last"] = r.last
            if low is not None:
                known = None if pd.isna(r.turn_first) else int(r.turn_first)
                now["turns"] += int(r.turns) - (known is not None and known == now["turn_last"])
                now["low"] = low if now["low"] is None else min(now["low"], low)
                now["high"] = int(r.high) if now["high"] is None else max(now["high"], int(r.high))
                now["turn_last"] = int(r.turn_last)
            now["audit"].append(r.audit.encode())
            for role, text in zip(r.new_roles, r.new_texts):
                now["hash"].update((("\n" if now["some"] else "") + f"{role}:{text}").encode())
                now["some"] = True
        if out:
            yield pd.DataFrame(out).astype({"conv_id": "Int64"})
    if now is not None:
        yield pd.DataFrame([close(now)]).astype({"conv_id": "Int64"})


def repaired_pieces(rows: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Two tables of repaired pieces (SLICE): conversations of one piece, and pieces of those that have several."""
    pieces = materialize(_rows(rows).mapInPandas(lambda batches: _cut(batches, segment), PIECE), "conversation-pieces")
    slim = pieces.select("conv_id", "piece", "matrix", F.lit(1).alias("one"))
    several = slim.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("k")).where("k > 1")
    cut = slim.join(several, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "piece", "matrix")
    behind = cut.groupBy("conv_id").applyInPandas(_behind, "conv_id long, piece long, behind array<long>, final int")
    ways = behind.join(pieces.select(F.col("piece").alias("p"), "codes"), F.col("piece") == F.col("p")).drop("p").mapInPandas(_ways, "conv_id long, piece long, behind array<long>, final int, ends array<int>")
    entered = materialize(ways.groupBy("conv_id").applyInPandas(_entered, "conv_id long, piece long, behind array<long>, final int, entered int"), "conversation-bounds")
    known = pieces.join(entered.select(F.col("piece").alias("p"), "behind", "final", "entered"), F.col("piece") == F.col("p"), "left").drop("p")
    long_ = known.where("entered IS NOT NULL").mapInPandas(_repaired, SLICE)
    return known.where("entered IS NULL").mapInPandas(_repaired, SLICE), long_


def repaired_turns(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The repaired conversations' rows: conv_id, piece, position (in the piece, from 0), role, text."""
    whole, long_ = repaired_pieces(rows, segment)
    turns = F.arrays_zip(F.col("new_roles").alias("role"), F.col("new_texts").alias("text"))
    return whole.union(long_).select("conv_id", "piece", F.posexplode(turns).alias("position", "t")).select("conv_id", "piece", "position", "t.role", "t.text")


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: conv_id long, turn long, role string, text string; other columns are ignored. Rows are ordered by turn (nulls
    first), then role, then text. A null role or text is one space; rows with a null conv_id form one conversation; repeated
    rows are duplicates. An empty table gives no row. Texts of any length are looked at whole. repaired_sha256 is the digest
    of the repaired turns as `role:text`, joined by newlines.
    """
    whole, long_ = repaired_pieces(rows, segment)
    ordered = long_.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.mapInPandas(_sums, DONE).union(ordered.mapInPandas(_sums, DONE))


def damage(rows: DataFrame) -> DataFrame:
    """Faults planted by crc32(`conv_id:turn`) modulo 20: 0 drops a row, 1 empties its text, 2 takes its ends of sentences,
    3 repeats it, 4 makes it the user's. Nulls are one space."""
    space = F.lit(" ")
    r = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    r = r.withColumn("fault", F.crc32(key) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return r.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_damaged(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """repair() of damage(), with a row for every conv_id; a conversation without rows left has zeros and an empty audit."""
    ids = rows.select(F.col("conv_id").cast("long").alias("c")).distinct()
    done = repair(damage(rows), segment)
    out = ids.join(done, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("c").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: The same columns for the table `conversations`: costs from the last row to the first, then the edits, one a step.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS steps),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
keyed AS (
  SELECT ids.k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(c.conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS key
  FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id),
hashed AS (
  SELECT keyed.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: unicode(x)::BIGINT), lambda h, b: xor(h >> 8, steps[(xor(h, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS fault
  FROM keyed, crc),
left_rows AS (
  SELECT k, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE fault <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM left_rows),
judged AS (
  SELECT k, i, turn, role, text, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS was,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS f
  FROM placed),
sums AS (
  SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate,
    count(*) FILTER (WHERE f = 3) AS truncated, count(*) FILTER (WHERE was IS NOT NULL AND was || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY k),
costs AS (
  SELECT k, n + 1 AS i, [0, 6, 3, 0]::BIGINT[] AS v FROM sums
  UNION ALL
  SELECT k, i, [least(w0, 3 + least(w2, 3 + w3)), least(w1, 3 + least(w2, 3 + w3)), least(w2, 3 + w3), least(w3, 3 + w2)] FROM (
    SELECT k, i, least(4 + v[1], stay + CASE ini WHEN 's' THEN v[2] WHEN 'u' THEN v[3] ELSE 1000000000 END, 3 + stay + v[3]) AS w0,
      least(4 + v[2], stay + CASE ini WHEN 'u' THEN v[3] ELSE 1000000000 END, 3 + stay + v[3]) AS w1,
      least(4 + v[3], stay + CASE ini WHEN 'a' THEN v[4] ELSE 1000000000 END, 3 + stay + v[4]) AS w2,
      least(4 + v[4], stay + CASE ini WHEN 'u' THEN v[3] ELSE 1000000000 END, 3 + stay + v[3]) AS w3
    FROM (SELECT j.k, j.i, j.ini, c.v, CASE WHEN j.f IN (1, 2) THEN 1000000000 WHEN j.f = 3 THEN 3 ELSE 0 END AS stay FROM costs c JOIN judged j ON j.k = c.k AND j.i = c.i - 1))),
walk AS (
  SELECT k, 1::BIGINT AS i, 0 AS q, '' AS audit, NULL::VARCHAR AS turns FROM sums
  UNION ALL
  SELECT k, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN CASE ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE q WHEN 2 THEN 3 ELSE 2 END END, audit || e,
    CASE WHEN e = 'D' THEN turns ELSE coalesce(turns || chr(10), '') || CASE WHEN e = 'K' THEN role WHEN q = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END END
  FROM (
    SELECT w.*, j.role, j.text, j.ini,
      CASE WHEN j.k IS NOT NULL AND 4 + x.v[q + 1] = c.v[q + 1] THEN 'D' WHEN 3 + c.v[CASE q WHEN 2 THEN 4 ELSE 3 END] = c.v[q + 1] THEN 'I'
        WHEN j.f IN (0, 3) AND c.v[q + 1] = j.f + CASE WHEN ini = 's' AND q = 0 THEN x.v[2] WHEN ini = 'u' AND q <> 2 THEN x.v[3] WHEN ini = 'a' AND q = 2 THEN x.v[4] ELSE 1000000000 END THEN 'K' ELSE 'R' END AS e
    FROM walk w JOIN costs c ON c.k = w.k AND c.i = w.i LEFT JOIN costs x ON x.k = w.k AND x.i = w.i + 1 LEFT JOIN judged j ON j.k = w.k AND j.i = w.i
    WHERE NOT (j.k IS NULL AND c.v[q + 1] = 0))),
ends AS (SELECT k, arg_max(audit, length(audit)) AS audit, arg_max(coalesce(turns, ''), length(audit)) AS turns FROM walk GROUP BY k)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(turns, '')) AS repaired_sha256
FROM ids LEFT JOIN sums USING (k) LEFT JOIN costs ON costs.k = ids.k AND costs.i = 1 LEFT JOIN ends ON ends.k = ids.k
"""
