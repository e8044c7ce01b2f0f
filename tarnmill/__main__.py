"""Command line: `python -m tarnmill build` packs documents, `check` verifies a packed corpus, `status` counts finished runs."""

from __future__ import annotations

import argparse
import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import results
from .operators.expect import expect
from .plans.corpus_build import Recipe, check, prepare
from .sources import readers, writers


def _positive(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def _recipe(a) -> Recipe:
    return Recipe(a.seed, a.block_size, {"train": a.train, "valid": a.valid, "test": a.test}, a.calibration)


def build(spark: SparkSession, a) -> None:
    """Reads documents (source_row, text, source_id) from Parquet, as far as the quotas need, and publishes blocks by split,
    documents and a calibration subset; goes on where an interrupted run has stopped."""
    recipe = _recipe(a)
    made = prepare(spark.read.parquet(a.source), recipe, a.output, most_rows=a.max_documents or None, strict=True)
    writers.json_report(spark, {"recipe": recipe.identity, "parts": made}, f"{a.output}/report.json")


def verify(spark: SparkSession, a) -> None:
    """Counts and lengths of all blocks, and the calibration blocks against their training blocks."""
    recipe = _recipe(a)
    whole = [spark.read.parquet(f"{a.output}/{s}").withColumn("split", F.lit(s)) for s in recipe.blocks]
    check(reduce(DataFrame.unionByName, whole), recipe)
    drawn = spark.read.parquet(f"{a.output}/calibration").join(whole[0].select("block_id", F.col("tokens").alias("own")), "block_id", "left")
    expect(drawn, calibration=F.col("own").eqNullSafe(F.col("tokens")))


def status(spark: SparkSession, a) -> None:
    d = readers.reports(spark, f"{a.output}/*/complete.json", "complete boolean")
    r = results.completed(d.withColumn("stage", F.when(F.col("complete"), "complete"))).first()
    logging.getLogger("tarnmill").info("%s of %s reports are complete", r["completed"], r["runs"])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tarnmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, run in (("build", build), ("check", verify), ("status", status)):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        s.add_argument("--output", required=True)
        if name != "status":
            s.add_argument("--seed", type=int, default=17)
            for key, n in (("block-size", 2048), ("train", 16_384), ("valid", 2_048), ("test", 2_048)):
                s.add_argument(f"--{key}", type=_positive, default=n)
            s.add_argument("--calibration", type=_positive, default=512)
        if name == "build":
            s.add_argument("--source", required=True)
            s.add_argument("--max-documents", type=int, default=0)
    a = p.parse_args(argv)
    logging.basicConfig(format="%(asctime)s %(message)s", level=logging.INFO)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
