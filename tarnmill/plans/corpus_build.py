"""Documents to packed blocks: blank filter, deduplication, split, quota, spans, blocks, calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_digest
from ..functions.tokenizers import Tokenizer
from ..operators import corpus, pack
from ..operators.corpus import store
from ..operators.expect import expect, unique
from ..sources.writers import publish_parts


@dataclass(frozen=True)
class Recipe:
    """What identifies a corpus."""

    seed: int = 17
    block_size: int = 256
    blocks: dict[str, int] = field(default_factory=lambda: {"train": 80, "valid": 10, "test": 10})
    calibration: int = 16

    @property
    def targets(self) -> dict[str, int]:
        return {k: v * self.block_size for k, v in self.blocks.items()}

    @property
    def identity(self) -> str:
        return canonical_digest({"seed": self.seed, "block_size": self.block_size, "blocks": self.blocks, "calibration": self.calibration})


def scan_documents(docs: DataFrame, recipe: Recipe, tokenizers: list[Tokenizer] | None = None, **limits) -> tuple[DataFrame, DataFrame]:
    """Admitted documents and the ranges that were read for them. docs: source_row, text and, if ids can repeat, source_id.
    With tokenizers, a split is full when the counts of all of them (columns by their names) have reached its target. limits:
    first, most_rows and strict of corpus.admit_ranges()."""
    if "source_id" not in docs.columns:
        docs = docs.withColumn("source_id", F.lit(""))

    def prepare(part: DataFrame) -> DataFrame:
        rows = corpus.candidates(part)
        return rows.withColumns({t.name: t.count(F.col("text")) for t in tokenizers}) if tokenizers else corpus.token_counts(rows)

    counters = [t.name for t in tokenizers] if tokenizers else ["tokens"]
    return corpus.admit_ranges(docs, prepare, counters, recipe.targets, recipe.seed, recipe.blocks, **limits)


def raw_documents(docs: DataFrame, recipe: Recipe, tokenizers: list[Tokenizer] | None = None, **limits) -> DataFrame:
    """The admitted documents of scan_documents()."""
    return scan_documents(docs, recipe, tokenizers, **limits)[0]


def raw_records(raw: DataFrame, counters: list[str]) -> DataFrame:
    """The seven fields of a raw document; a missing url is an empty one."""
    url = F.coalesce(F.col("url"), F.lit("")) if "url" in raw.columns else F.lit("")
    counts = F.create_map(*[x for c in counters for x in (F.lit(c), F.col(c).cast("long"))])
    return raw.select("text", "text_sha256", "source_id", url.alias("url"), "source_row", "split", counts.alias("token_counts"))


def report(docs: DataFrame, raw: DataFrame, recipe: Recipe, counters: list[str]) -> DataFrame:
    """Documents and tokens by split, the row that filled it, and what was read and skipped up to the stop row."""
    return corpus.corpus_counters(docs, raw, corpus.fill_rows(raw, counters, recipe.targets), counters)


def packed(raw: DataFrame, recipe: Recipe) -> tuple[DataFrame, DataFrame]:
    """Spans and blocks."""
    spans = pack.spans(raw, recipe.targets)
    return spans, pack.blocks(spans, recipe.block_size)


def measured(split_rows: DataFrame, blocks: int, size: int, ids: int = 0):
    """A part of blocks for publish_parts(): as many blocks as the recipe wants, numbered 0 ... blocks - 1, all of one length and
    (of ids) all below `ids`; measured while they are written."""
    measures = {"low": F.min("block_id"), "high": F.max("block_id"), "total": F.sum("block_id"), "short": F.min(F.size("tokens")), "long": F.max(F.size("tokens"))}
    if ids:
        measures |= {"least": F.min(F.array_min("tokens")), "most": F.max(F.array_max("tokens"))}

    def rules(m: dict) -> dict[str, bool]:
        numbered = m["rows"] == blocks and (not blocks or (m["low"], m["high"], m["total"]) == (0, blocks - 1, blocks * (blocks - 1) // 2))
        return {"blocks": numbered, "length": not blocks or m["short"] == m["long"] == size, "ids": not ids or not blocks or (m["least"] >= 0 and m["most"] < ids)}

    return split_rows, measures, rules


def prepare(docs: DataFrame, recipe: Recipe, output: str, **limits) -> dict[str, dict]:
    """Builds a corpus and publishes it as one folder: blocks of each split, the documents that gave tokens, and a calibration
    subset of the training blocks. Counts, lengths and numbers are measured while parts are written; texts and ids are checked
    to occur once in all splits, and calibration blocks to equal the training blocks of their numbers. A run that was
    interrupted goes on with the parts that are missing."""
    spark, staging = docs.sparkSession, f"{output}.building"
    made: list[tuple[DataFrame, DataFrame]] = []

    def both() -> tuple[DataFrame, DataFrame]:
        if not made:
            made.append(packed(raw_documents(docs, recipe, **limits), recipe))
        return made[0]

    def documents():
        spans = both()[0].drop("text")
        for key in ("text_sha256", "source_id"):
            unique(spans.where(F.col(key) != ""), key)
        return spans, {"tokens": F.sum(F.col("token_end") - F.col("token_start"))}, lambda m: {"tokens": m["tokens"] == sum(recipe.targets.values())}

    def calibration():
        train = spark.read.parquet(f"{staging}/train")
        drawn = store(pack.calibration(train, recipe.calibration, recipe.seed), "calibration")
        other = drawn.join(train.select("block_id", F.col("tokens").alias("own")), "block_id", "left")
        expect(other, calibration=F.col("own").eqNullSafe(F.col("tokens")))
        return drawn, {"low": F.min("pos"), "high": F.max("pos")}, lambda m: {"blocks": m["rows"] == recipe.calibration and (m["low"], m["high"]) == (0, recipe.calibration - 1)}

    split = lambda name, n: lambda: measured(both()[1].where(F.col("split") == name).drop("split"), n, recipe.block_size)
    parts = {name: split(name, n) for name, n in recipe.blocks.items()} | {"documents": documents, "calibration": calibration}
    return publish_parts(parts, staging, output, recipe.identity, spark)


def check(blocks: DataFrame, recipe: Recipe) -> DataFrame:
    """Every split has exactly its blocks, all full."""
    per = blocks.groupBy("split").agg(F.count("*").alias("n"), F.min(F.size("tokens")).alias("lo"), F.max(F.size("tokens")).alias("hi"))
    want = F.element_at(F.create_map(*[x for k, v in recipe.blocks.items() for x in (F.lit(k), F.lit(v))]), F.col("split"))
    return expect(per, blocks=F.col("n") == want, size=(F.col("lo") == recipe.block_size) & (F.col("hi") == recipe.block_size))
