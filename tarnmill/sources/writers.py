"""Writers. Tables go through Spark's commit protocol; small reports are written to one file and renamed."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.expect import ExpectationError
from .readers import exists, file_system


def split_json_lines(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("errorifexists").partitionBy(by).json(path)


def packed(df: DataFrame, path: str) -> None:
    """Refuses to write over what is there."""
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def publish(df: DataFrame, staging: str, target: str, check) -> None:
    """Writes to a staging folder, checks what was written, and renames it to the target."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(staging)
    check(spark.read.parquet(staging))
    jvm = spark.sparkContext._jvm
    source, to = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(target)
    fs = source.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(to) or not fs.rename(source, to):
        raise FileExistsError(target)


def publish_parts(parts: dict[str, Callable[[], tuple[DataFrame, dict[str, Column], Callable[[dict], dict[str, bool]]]]], staging: str, target: str, identity: str, spark: SparkSession) -> dict[str, dict]:
    """Writes named parts into a staging folder, each with measurements of the same pass, and puts the folder in its place when all
    are there. Returns the parts' measurements.

    parts: for each name a function that gives its rows, what to measure (aggregates), and the rules that the measured values must
    keep. A part that is finished has a report beside it; a run that was interrupted goes on with the parts that have none, if
    identity (of the recipe) is that of the run before. A part that breaks a rule has no report, so it is written again.
    """
    if exists(spark, target):
        raise FileExistsError(target)
    mark = f"{staging}/identity.json"
    if exists(spark, mark):
        if json.loads(spark.read.text(mark, wholetext=True).first()[0]) != identity:
            raise ValueError(f"{staging} holds an interrupted run of another recipe")
    elif exists(spark, staging):
        raise FileExistsError(staging)
    else:
        json_report(spark, identity, mark)
    reports = {}
    for name, part in parts.items():
        done = f"{staging}/{name}.json"
        if not exists(spark, done):
            rows, measures, rules = part()
            seen = Observation()
            rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in measures.items())).write.mode("overwrite").parquet(f"{staging}/{name}")
            got = {k: int(v) if v is not None else None for k, v in seen.get.items()}
            if broken := [k for k, holds in rules(got).items() if not holds]:
                raise ExpectationError(f"{name}: {', '.join(broken)} broken by {got}")
            json_report(spark, got, done)
        reports[name] = json.loads(spark.read.text(done, wholetext=True).first()[0])
    source, system = file_system(spark, staging)
    to, _ = file_system(spark, target)
    if not system.rename(source, to):
        raise OSError(f"{target} could not be put in its place")
    return reports


def csv_report(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One file with a header and the columns in the given order; for reports, not for data."""
    df.select(*(columns or df.columns)).coalesce(1).write.mode("errorifexists").csv(path, header=True)


def _replace(spark: SparkSession, path: str, content: bytes, overwrite: bool) -> None:
    """Writes a small file beside its place and renames it over it in one step, through Hadoop's file systems: at any moment
    the place holds the old content or the new one."""
    to, fs = file_system(spark, path)
    beside, _ = file_system(spark, f"{path}.building")
    if fs.exists(to) and not overwrite:
        raise FileExistsError(path)
    out = fs.create(beside, True)
    out.write(bytearray(content))
    out.hsync()
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    choice = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(choice, 1)
    how[0] = choice.OVERWRITE if overwrite else choice.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    context.rename(fs.makeQualified(beside), fs.makeQualified(to), how)


def jsonable(value):
    """Arrays as lists, sets sorted, and anything else that JSON does not know as its text."""
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, set | frozenset):
        return sorted(jsonable(v) for v in value)
    if isinstance(value, list | tuple):
        return [jsonable(v) for v in value]
    if hasattr(value, "tolist"):
        return jsonable(value.tolist())
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def json_report(spark: SparkSession, value, path: str) -> None:
    """One JSON file, whole or not at all; NaN and infinity are errors."""
    _replace(spark, path, json.dumps(jsonable(value), ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False).encode(), True)


def array_file(spark: SparkSession, array, path: str) -> None:
    """One .npy file, whole or not at all; refuses to write over what is there."""
    import io

    import numpy as np

    buffer = io.BytesIO()
    np.save(buffer, array, allow_pickle=False)
    _replace(spark, path, buffer.getvalue(), False)


def digested_splits(df: DataFrame, path: str, order: str, by: str = "split") -> DataFrame:
    """Writes JSON lines by split and returns by, rows and a digest of each split's rows in their order, for a manifest.

    Rows are digested one by one; the digest of a split is that of their digests in order, by chunks, so no task needs a
    split's texts at once.
    """
    split_json_lines(df, path, by)
    line = F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != by])), 256)
    chunk = F.floor(F.col(order) / 65_536)
    ordered = lambda key, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ""), 256)
    d = df.select(by, F.col(order).alias("__o"), chunk.alias("__c"), line.alias("__d"))
    parts = d.groupBy(by, "__c").agg(F.count("*").alias("n"), ordered("__o", "__d").alias("__h"))
    return parts.groupBy(by).agg(F.sum("n").alias("rows"), ordered("__c", "__h").alias("sha256"))


def tex_cell(mean: float | None, sd: float | None = None, digits: int = 2) -> str:
    if mean is None:
        return "--"
    return f"${mean:.{digits}f}$" if sd is None else f"${mean:.{digits}f} \\pm {sd:.{digits}f}$"


def tex_table(rows: list[dict], columns: list[str], complete: bool = True) -> str:
    """A LaTeX table of a short report; says so if runs are missing."""
    head = [] if complete else ["% INCOMPLETE: some runs are missing"]
    body = [" & ".join(r[c] if isinstance(r[c], str) else tex_cell(r[c]) for c in columns) + r" \\" for r in rows]
    return "\n".join([*head, r"\begin{tabular}{" + "l" * len(columns) + "}", " & ".join(columns) + r" \\", r"\hline", *body, r"\end{tabular}", ""])


def interpretation(first: str, replicates: int, repeats: int) -> str:
    """What a reader of the tables must know."""
    return "\n".join([
        f"Differences are {first} less the other method; negative ones favour {first}.",
        f"Intervals resample {replicates} seeds and groups of blocks {repeats} times; they describe these runs and are not corrected for many comparisons.",
        "Recovery counts input tokens only; preparation and warm-start costs are listed apart.",
        "A run that is missing is no run that failed; tables that lack runs say so.",
        "",
    ])
