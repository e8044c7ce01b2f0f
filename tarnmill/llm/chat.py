r"""Chat formatting with a grammar round trip.

    conversation := turn*            turn := "[INST]" role "[/INST]" text "</s>"

A deterministic parser cuts the rendered text at every "</s>", takes the role up to the first "[/INST]" and undoes
escapes (a backslash and the character after it stand for that character). Texts are rendered as they are; if the
turns that are read back differ from the source, the turns that conflict by themselves are escaped, and if they still
differ, all turns are. Escaping doubles backslashes and breaks the control strings by a backslash after their first
character, so that none of them is left. Everything is DataFrame functions; a conversation is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "[INST]", "[/INST]", "</s>"


def _escape(x: Column) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for control in (OPEN, SEP, CLOSE):
        x = F.replace(x, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return x


def _unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def _turn(t: Column, escaped: bool) -> Column:
    role, text = (_escape(t["role"]), _escape(t["text"])) if escaped else (t["role"], t["text"])
    return F.concat(F.lit(OPEN), role, F.lit(SEP), text, F.lit(CLOSE))


def _segments(formatted: Column) -> Column:
    parts = F.split(formatted, r"</s>", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def _parse(formatted: Column) -> Column:
    """Turns as (role, text); a segment outside the grammar has a null role."""

    def one(s: Column) -> Column:
        at = F.locate(SEP, s, 1)
        good = F.startswith(s, F.lit(OPEN)) & (at > 0)
        role = F.when(good, _unescape(F.substring(s, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)))
        return F.struct(role.alias("role"), _unescape(F.substring(s, at + len(SEP), F.length(s))).alias("text"))

    return F.transform(_segments(formatted), one)


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns, formatted, loss_spans and level.

    rows: conv_id long, turn long, role string, text string; other columns are ignored. Turns are ordered by turn
    (nulls first), then role, then text; repeated rows are turns of their own. A null role or text is an empty one;
    rows with a null conv_id form one conversation. An empty table gives no row. loss_spans are (start, length) of
    the assistants' texts in `formatted`, in code points from 0; level says how much was escaped: 0 nothing, 1 the
    turns in conflict, 2 all turns. `turns` are read back from `formatted`.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    convs = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    source = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    convs = convs.select("conv_id", "ts", source.alias("source"), F.array_join(F.transform("ts", lambda t: _turn(t, False)), "").alias("f0"))
    convs = convs.withColumn("ok0", F.col("source").eqNullSafe(_parse(F.col("f0"))))

    def lone(t: Column) -> Column:
        return F.array(F.struct(t["role"].alias("role"), t["text"].alias("text"))).eqNullSafe(_parse(_turn(t, False)))

    some = F.array_join(F.transform("ts", lambda t: F.when(lone(t), _turn(t, False)).otherwise(_turn(t, True))), "")
    convs = convs.withColumn("f1", F.when(F.col("ok0"), F.col("f0")).otherwise(some))
    convs = convs.withColumn("ok1", F.col("ok0") | F.col("source").eqNullSafe(_parse(F.col("f1"))))
    every = F.array_join(F.transform("ts", lambda t: _turn(t, True)), "")
    convs = convs.withColumn("formatted", F.when(F.col("ok1"), F.col("f1")).otherwise(every))
    convs = convs.withColumn("turns", _parse(F.col("formatted"))).withColumn("segments", _segments(F.col("formatted")))
    whole = F.when(F.col("source").eqNullSafe(F.col("turns")), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")))
    # Where each segment's text begins and how long it is.
    begin = lambda s: F.locate(SEP, s, 1) + (len(SEP) - 1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<role:string,start:int,length:int>>").alias("spans"))
    placed = F.aggregate(
        F.arrays_zip(F.col("segments").alias("s"), F.col("turns").alias("t")),
        empty,
        lambda a, x: F.struct(
            (a["at"] + F.length(x["s"]) + len(CLOSE)).alias("at"),
            F.concat(a["spans"], F.array(F.struct(x["t"]["role"].alias("role"), (a["at"] + begin(x["s"])).alias("start"), (F.length(x["s"]) - begin(x["s"])).alias("length")))).alias("spans"),
        ),
    )
    loss = F.transform(F.filter(placed["spans"], lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    level = F.when(F.col("ok0"), 0).when(F.col("ok1"), 1).otherwise(2)
    return convs.select("conv_id", "turns", whole.alias("formatted"), loss.alias("loss_spans"), level.alias("level"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of what format_conversations() returns."""
    loss = F.array_join(F.transform("loss_spans", lambda s: _unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


#: The same columns for the table `conversations` and conversation -7.
SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
c AS (SELECT *, contains(role, '</s>') OR contains(text, '</s>') OR contains(role, '[/INST]')
    OR regexp_matches(role, '\\.', 's') OR regexp_matches(text, '\\.', 's') AS bad FROM t),
e AS (SELECT *, CASE WHEN bad THEN replace(replace(replace(replace(role, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>') ELSE role END AS r2,
    CASE WHEN bad THEN replace(replace(replace(replace(text, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>') ELSE text END AS t2 FROM c),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(17 + length(r2) + length(t2))::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
