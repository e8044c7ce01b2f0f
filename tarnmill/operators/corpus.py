"""Corpus building: blank filter, ordered two-key deduplication, hash splits, token quotas."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import digest_modulo, not_blank, text_digest, word_tokens
from .expect import ExpectationError, unique
from .graph import components

#: Rows of one chunk of a prefix sum.
CHUNK = 65_536


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a temporary one is made, but only if driver and executors are one
    process; on a cluster an unset folder is an error."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tarnmill-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """A checkpoint in the shared folder, as a written table."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tarnmill_path = path
    return out


def drop_stored(*tables: DataFrame | None) -> None:
    """Deletes tables that store() wrote and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_tarnmill_path", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def with_text(docs: DataFrame) -> DataFrame:
    """Non-blank rows; a null text is an error, not a row to skip.

    Both are one predicate: as two, the optimizer would drop the nulls that the second implies before the first sees them.
    """
    missing = F.raise_error(F.lit("a source row has no text")).cast("boolean")
    return docs.where(F.when(F.col("text").isNull(), missing).otherwise(not_blank(F.col("text"))))


def candidates(docs: DataFrame) -> DataFrame:
    """Non-blank rows with their digest."""
    return with_text(docs).withColumn("text_sha256", text_digest(F.col("text")))


def split_of(digest: Column, seed: int, blocks: dict[str, int]) -> Column:
    """The split whose range of block numbers holds sha256("seed:digest") modulo the sum of all blocks."""
    slot, low = digest_modulo(F.sha2(F.concat(F.lit(f"{seed}:"), digest), 256), sum(blocks.values())), 0
    out = F.lit(None).cast("string")
    ladder = None
    for name, n in blocks.items():
        low += n
        ladder = F.when(slot < low, name) if ladder is None else ladder.when(slot < low, name)
    return out if ladder is None else ladder


def first_of_each(docs: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order, by a minimum that is combined before the shuffle."""
    first = docs.groupBy(key).agg(F.min(order).alias(order))
    return docs.join(first, [key, order], "left_semi")


def running_sum(df: DataFrame, values: list[str], order: str, by: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Adds before_<value>: the sum over earlier rows of the same `by`, in the order of an integer column.

    Rows are summed in chunks of the order's range; a window runs over the chunks' totals and another within each
    chunk, so no task holds a whole split.
    """
    part = [by] if by else []
    d = df.withColumn("__chunk", F.floor(F.col(order) / chunk))
    sums = d.groupBy(*part, "__chunk").agg(*(F.sum(v).alias(f"__s_{v}") for v in values))
    over = Window.partitionBy(*part).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*part, "__chunk", *(F.coalesce(F.sum(f"__s_{v}").over(over), F.lit(0)).alias(f"__o_{v}") for v in values))
    within = Window.partitionBy(*part, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(sums, [*part, "__chunk"])
    return d.withColumns({f"before_{v}": F.col(f"__o_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}).drop("__chunk", *(f"__o_{v}" for v in values))


def _by_split(values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), F.col("split"))


def _totals_before(rows: DataFrame, counters: list[str], order: str, base: dict[str, dict[str, int]] | None) -> DataFrame:
    """Adds before_<counter>, with what earlier ranges have brought each split (base)."""
    d = running_sum(rows, counters, order, "split")
    return d.withColumns({f"before_{c}": F.col(f"before_{c}") + _by_split({k: v[c] for k, v in base.items()}) for c in counters}) if base else d


def quota(rows: DataFrame, counters: list[str], targets: dict[str, int], order: str = "source_row", base: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Rows that are admitted: before them, some tokenizer's total of their split is below the split's target."""
    d = _totals_before(rows, counters, order, base)
    least = F.least(*(F.col(f"before_{c}") for c in counters)) if len(counters) > 1 else F.col(f"before_{counters[0]}")
    return d.where(least < _by_split(targets))


def _in_turn(t: pa.Table) -> pa.Table:
    """The rows that are admitted of a cluster, one after another."""
    t, texts, ids, kept = t.sort_by("__order"), set(), set(), []
    for text, ident in zip(t.column("__text").to_pylist(), t.column("__id").to_pylist()):
        keep = text not in texts and (ident is None or ident not in ids)
        kept.append(keep)
        if keep:
            texts.add(text)
            ids.add(ident)
    return t.filter(pa.array(kept, pa.bool_())).select(["__order"])


def two_key_dedup(rows: DataFrame, order: str = "source_row", text: str = "text_sha256", ident: str = "source_id", rounds: int = 4) -> DataFrame:
    """First-come deduplication by two keys at once: a row is dropped if an *admitted* earlier row has its text or its
    non-empty id; dropped rows claim nothing.

    In each round a row is kept if it is the first undecided row of both of its keys, and undecided rows that share a
    key with a kept row are dropped. Almost all clusters settle in the first round. What a few rounds leave are clusters
    in which one decision hangs on the next; these are found as connected components of rows and keys, and each is decided
    in the order of its rows, whatever its length. The undecided rows are written to the shared folder between rounds.
    """
    slim = rows.select(F.col(order).alias("__order"), F.col(text).alias("__text"), F.when(F.col(ident) == "", None).otherwise(F.col(ident)).alias("__id"))
    undecided, kept = slim, None
    for _ in range(rounds):
        by_text = undecided.groupBy("__text").agg(F.min("__order").alias("__t"))
        by_id = undecided.where("__id is not null").groupBy("__id").agg(F.min("__order").alias("__i"))
        seen = undecided.join(by_text, "__text").join(by_id, "__id", "left")
        new = store(seen.where((F.col("__order") == F.col("__t")) & (F.col("__i").isNull() | (F.col("__order") == F.col("__i")))).select("__order", "__text", "__id"), "kept")
        kept = new.select("__order") if kept is None else kept.union(new.select("__order"))
        left = undecided.join(new.select("__text"), "__text", "left_anti").join(new.where("__id is not null").select("__id"), "__id", "left_anti")
        before, undecided = undecided, store(left.select("__order", "__text", "__id"), "undecided")
        drop_stored(before)
        if undecided.isEmpty():
            break
    else:
        same = lambda key: undecided.where(f"{key} is not null").groupBy(key).agg(F.min("__order").alias("b"))
        edges = [undecided.join(same(key), key).select(F.col("__order").alias("a"), "b") for key in ("__text", "__id")]
        cluster = components(edges[0].union(edges[1]), store)
        late = undecided.join(cluster.withColumnRenamed("node", "__order"), "__order").groupBy("root").applyInArrow(_in_turn, f"__order {dict(undecided.dtypes)['__order']}")
        kept = kept.union(store(late, "kept"))
    return rows.join(kept.withColumnRenamed("__order", order), order, "left_semi")


def admit(docs: DataFrame, counters: list[str], targets: dict[str, int], seed: int, blocks: dict[str, int], order: str = "source_row", base: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Deduplication by two keys together with quotas, as if rows came one by one.

    Rows after the row that fills their split are neither kept nor do they claim keys; so deduplication and quotas are
    repeated until the set of such rows is stable. A stable state is the sequential answer: the first row on which two rounds
    differ lies behind the first one before, so the rounds end. Needs text_sha256 and source_id; adds split and
    before_<counter>. base: what each split has already.
    """
    rows = docs.withColumn("split", split_of(F.col("text_sha256"), seed, blocks))
    twice = rows.where(F.col("source_id") != "").agg((F.count("*") - F.count_distinct("source_id")).alias("n")).first()["n"]
    if not twice:  # ids cannot conflict: one minimum and one running sum
        return quota(first_of_each(rows, "text_sha256", order), counters, targets, order, base)
    last: dict | None = None
    while True:
        live = rows if last is None else rows.where(reduce(lambda a, b: a & b, (~((F.col("split") == k) & (F.col(order) > v)) for k, v in last.items() if v is not None), F.lit(True)))
        kept = store(two_key_dedup(live, order), "deduplicated")
        filled = fill_rows(kept, counters, targets, order, base)
        if filled == last or last is None and not any(v is not None for v in filled.values()):
            return quota(kept, counters, targets, order, base)
        last = filled


def admit_ranges(
    docs: DataFrame, prepare: Callable[[DataFrame], DataFrame], counters: list[str], targets: dict[str, int], seed: int, blocks: dict[str, int],
    order: str = "source_row", first: int | None = None, most_rows: int | None = None, strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The rows of admit() over prepare(docs), read only as far as the quotas need.

    The source is read in ranges of the order's integers, which reach its scan as a filter. Each range is prepared (digests,
    token counts) and written; rows whose text or source_id an earlier range has admitted go, and the rest is admitted on top
    of the earlier totals. The next range is as long as the rows still needed by the yield so far, at most eight times the last. Reading stops
    when all splits are full, at most_rows, or at the end of the source; unless all are full, strict raises an error then.
    Only the totals of a split reach the driver. Returns the admitted rows, and the ranges: low, high and scanned, the rows
    that the scan has read.
    """
    spark, low, size = docs.sparkSession, 0, first or max(1024, sum(targets.values()) // 512)
    base = {k: dict.fromkeys(counters, 0) for k in targets}
    open_ = [k for k, goal in targets.items() if goal > 0]
    parts: list[DataFrame] = []
    ranges: list[tuple[int, int, int]] = []
    while open_ and (most_rows is None or low < most_rows):
        high = low + size if most_rows is None else min(low + size, most_rows)
        seen = Observation()
        part = docs.where((F.col(order) >= low) & (F.col(order) < high)).observe(seen, F.count(F.lit(1)).alias("rows"))
        ready = store(prepare(part), "range")
        ranges.append((low, high, int(seen.get["rows"])))
        if not ranges[-1][2]:  # a gap, or the end
            drop_stored(ready)
            ahead = docs.where(F.col(order) >= high).agg(F.min(order)).first()[0]
            if ahead is None:
                break
            low = ahead
            continue
        rows = ready.where(split_of(F.col("text_sha256"), seed, blocks).isin(*open_))
        if parts:
            old = reduce(DataFrame.unionByName, (p.select("text_sha256", "source_id") for p in parts))
            rows = rows.join(old.select("text_sha256"), "text_sha256", "left_anti").join(old.where("source_id <> ''").select("source_id"), "source_id", "left_anti")
        new = store(admit(rows, counters, targets, seed, blocks, order, base), "admitted")
        drop_stored(ready)
        parts.append(new)
        for r in new.groupBy("split").agg(*(F.sum(c).alias(c) for c in counters)).collect():  # a row per split
            for c in counters:
                base[r["split"]][c] += int(r[c])
        open_ = [k for k in open_ if min(base[k].values()) < targets[k]]
        low = high
        if open_:
            needed = [float("inf") if not base[k][c] else (targets[k] - base[k][c]) / base[k][c] for k in open_ for c in counters]
            size = int(min(8 * size, max(1024, 1.25 * max(needed) * sum(n for _, _, n in ranges))))
    if open_ and strict:
        raise ExpectationError(f"the source ended, or most_rows was reached, before the quotas: {base}")
    if not parts:
        parts = [admit(prepare(docs.where(F.lit(False))), counters, targets, seed, blocks, order)]
    return reduce(DataFrame.unionByName, parts), spark.createDataFrame(ranges, "low long, high long, scanned long")


def fill_rows(kept: DataFrame, counters: list[str], targets: dict[str, int], order: str = "source_row", base: dict[str, dict[str, int]] | None = None) -> dict[str, int | None]:
    """For each split the row at which all counters have reached the target, or None."""
    have = all(f"before_{c}" in kept.columns for c in counters)
    d = kept if have else _totals_before(kept, counters, order, base)
    after = [F.col(f"before_{c}") + F.col(c) for c in counters]
    least = F.least(*after) if len(after) > 1 else after[0]
    got = {r["split"]: r["row"] for r in d.groupBy("split").agg(F.min(F.when(least >= _by_split(targets), F.col(order))).alias("row")).collect()}
    return {k: got.get(k) for k in targets}


def stop_row(filled: dict[str, int | None]) -> int | None:
    """The row at which all splits are full and reading stops; None if it goes on to the end."""
    return None if any(v is None for v in filled.values()) else max(filled.values(), default=None)


def corpus_counters(docs: DataFrame, admitted: DataFrame, filled: dict[str, int | None], counters: list[str], order: str = "source_row") -> DataFrame:
    """One row per split: documents and totals of the counters, with rows read, blank rows and duplicates of the whole source.

    Rows after the stop row are not read. A duplicate shares its text, or its non-empty source_id, with an admitted row
    before it; a row that only finds its split full is none. docs: source_row, text and, if ids can repeat, source_id.
    """
    stop = stop_row(filled)
    read = docs if stop is None else docs.where(F.col(order) <= stop)
    if "source_id" not in read.columns:
        read = read.withColumn("source_id", F.lit(""))
    rows = read.select(order, F.coalesce(not_blank(F.col("text")), F.lit(False)).alias("__full"), text_digest(F.col("text")).alias("__text"), F.nullif("source_id", F.lit("")).alias("__id"))
    own = admitted.withColumn("source_id", F.lit("")) if "source_id" not in admitted.columns else admitted
    texts = own.groupBy(F.col("text_sha256").alias("__text")).agg(F.min(order).alias("__t"))
    ids = own.where("source_id <> ''").groupBy(F.col("source_id").alias("__id")).agg(F.min(order).alias("__i"))
    seen = rows.join(texts, "__text", "left").join(ids, "__id", "left")
    twice = F.col("__full") & ((F.col("__t") < F.col(order)) | F.coalesce(F.col("__i") < F.col(order), F.lit(False)))
    whole = seen.agg(F.count("*").alias("rows_read"), F.count_if(~F.col("__full")).alias("empty_skipped"), F.count_if(twice).alias("duplicates_skipped"))
    splits = admitted.sparkSession.createDataFrame([(k, v) for k, v in filled.items()], "split string, fill_row long")
    per = admitted.groupBy("split").agg(F.count("*").alias("documents"), *(F.sum(c).alias(c) for c in counters))
    out = splits.join(per, "split", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ["documents", *counters]})
    return out.join(F.broadcast(whole))  # one row


def check_recovered(raw: DataFrame, counters: list[str], committed: DataFrame) -> DataFrame:
    """What a restart finds written: an error if a text or a non-empty source_id occurs twice, or if documents and totals by
    split are not those that were committed (split, documents and the counters)."""
    for key in ("text_sha256", "source_id"):
        unique(raw.where(F.col(key) != ""), key)
    got = raw.groupBy("split").agg(F.count("*").alias("documents"), *(F.sum(c).alias(c) for c in counters)).where("documents > 0")
    want = committed.where("documents > 0")
    if got.select("split", "documents", *counters).exceptAll(want.select("split", "documents", *counters)).union(want.select("split", "documents", *counters).exceptAll(got.select("split", "documents", *counters))).limit(1).count():
        raise ExpectationError("the written rows are not those that were committed")
    return raw


def local_shuffle(rows: DataFrame, order: str, buffer: int, seed: int) -> DataFrame:
    """A seeded order in which no row comes more than `buffer` places late or early: adds `draw`, the row's number plus a
    digest below `buffer`; rows go by draw, then by their number. No buffer is kept, so no task sees more than its rows."""
    late = digest_modulo(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(order).cast("string")), 256), buffer)
    return rows.withColumn("draw", F.col(order) + late)


def token_counts(docs: DataFrame, name: str = "tokens") -> DataFrame:
    """Adds the number of tokens of the built-in tokenizer; the end token counts."""
    return docs.withColumn(name, F.size(word_tokens(F.col("text"))).cast("long"))
