"""Packing to an exact quota, calibration samples and partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from .corpus import running_sum


def spans(rows: DataFrame, targets: dict[str, int], tokens: str = "tokens", order: str = "source_row") -> DataFrame:
    """Token intervals of documents laid end to end in their order; the last is cut at the split's quota.

    Documents that would get no token have no span. Running sums that the rows bring (before_<tokens>) are used. Adds token_start, token_end and document_tail_truncated.
    """
    d = rows if f"before_{tokens}" in rows.columns else running_sum(rows, [tokens], order, "split")
    goal = F.element_at(F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v))]), F.col("split"))
    end = F.col(f"before_{tokens}") + F.col(tokens)
    d = d.where(F.col(f"before_{tokens}") < goal)
    return d.withColumns({"token_start": F.col(f"before_{tokens}"), "token_end": F.least(end, goal), "document_tail_truncated": end > goal}).drop(f"before_{tokens}")


def blocks(spanned: DataFrame, size: int, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """Blocks of `size` tokens: split, block_id, tokens (of a text as an array, by any tokenizer). Each document first cuts
    its own run into parts of blocks, so that a shuffled row is a part and not a token."""
    tok = F.slice(tokens(F.col("text")), F.lit(1), (F.col("token_end") - F.col("token_start")).cast("int"))
    first, last = F.floor(F.col("token_start") / size), F.floor((F.col("token_end") - 1) / size)
    d = spanned.withColumn("__t", tok).withColumn("block_id", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("token_start"), F.col("block_id") * size)
    high = F.least(F.col("token_end"), (F.col("block_id") + 1) * size)
    part = F.slice("__t", (low - F.col("token_start") + 1).cast("int"), (high - low).cast("int"))
    d = d.select("split", "block_id", low.alias("at"), part.alias("part"))
    return d.groupBy("split", "block_id").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p")).select("split", "block_id", F.flatten(F.transform("p", lambda x: x["part"])).alias("tokens"))


def hash_rank(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds `draw`, a digest that orders rows at random but always alike."""
    return df.withColumn("draw", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows without replacement: those with the smallest draws."""
    return hash_rank(df, key, seed).orderBy("draw", key).limit(n)


def fit_check(sampled: DataFrame, key: str, fraction: float, n: int) -> DataFrame:
    """Labels the first int(n * fraction) rows by draw `fit` and the rest `check`; n rows are a bounded sample."""
    rank = F.row_number().over(Window.orderBy("draw", key))
    return sampled.withColumn("phase", F.when(rank <= int(n * fraction), "fit").otherwise("check"))


def calibration(train: DataFrame, n: int, seed: int) -> DataFrame:
    """n blocks of the training split, drawn without replacement, with `pos`, their place in the order of block ids. The
    drawn ids are a bounded sample, so they are broadcast to the blocks."""
    drawn = sample(train.select("block_id"), "block_id", n, seed)
    drawn = drawn.withColumn("pos", (F.row_number().over(Window.orderBy("block_id")) - 1).cast("int")).drop("draw")
    return train.join(F.broadcast(drawn), "block_id")  # n numbers


def subset(blocks_: DataFrame, first: int, total: int) -> DataFrame:
    """The first blocks (0: all), labelled by whether they are a subset of `total`."""
    d = blocks_ if not first else blocks_.where(F.col("block_id") < first)
    return d.withColumn("subset", F.lit("all" if not first or first >= total else f"first {first}"))
