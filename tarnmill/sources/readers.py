"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import not_blank
from ..operators.expect import expect

DOCUMENT = T.StructType([T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("url", T.StringType())])
TRAIN_LOG = T.StructType([T.StructField("step", T.LongType()), T.StructField("input_tokens", T.LongType()), T.StructField("train_nll", T.DoubleType()), T.StructField("grad_norm", T.DoubleType()), T.StructField("train_seconds", T.DoubleType()), T.StructField("peak_allocated_gib", T.DoubleType())])


#: Characters beyond which a line is too long for a variant; its members' types are then read from its text.
LONG_LINE = 4_000_000


def text_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines of text files, gzipped by suffix: file, start (of the part of the file that a task reads), at (a number that grows
    by one from line to line of a part) and value."""
    d = spark.read.text(paths)
    return d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")


def _parts(lines: DataFrame) -> DataFrame:
    """One row per part of a file: its first line's `at`, its lines, and how many lines of the file come before it: a
    prefix sum over a file's parts, which are as few as its blocks."""
    parts = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    over = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum("lines").over(over), F.lit(0)))


def line_numbers(lines: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Adds `line`, the number in its file from 1, to the rows of text_lines() (or to some of them, `of`). Files of any size
    are read in parts; only the counts of the parts are summed in order."""
    return (lines if of is None else of).join(_parts(lines).select("file", "start", "first", "before"), ["file", "start"]).withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1).drop("first", "before")


def line_fault(value: Column, strings: list[str]) -> Column:
    """What is wrong with a line of a strict JSON file, null if nothing is: no JSON, no object, or a member that is to be a
    string and is none (or is missing). A blank line is right.

    Spark's parser stops at the end of a first value. Within brackets and within braces alike, nothing can follow it.
    """
    listed, held = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"k":'), value, F.lit("}")))
    kind = lambda v: F.schema_of_variant(v)
    parsed = F.try_variant_get(listed, "$[0]", "variant")
    wrong = F.when(listed.isNull() | held.isNull(), "no JSON").when(~F.startswith(kind(parsed), F.lit("OBJECT")), "no JSON object")
    for name in strings:
        member = F.try_variant_get(parsed, f"$.{name}", "variant")
        wrong = wrong.when(member.isNull() | (kind(member) != "STRING"), f"no string {name}")
    keys = F.json_object_keys(value)
    long_ = F.when(keys.isNull() | ~F.endswith(F.rtrim(value), F.lit("}")), "no JSON object")
    for name in strings:
        long_ = long_.when(~F.array_contains(keys, name), f"no string {name}")
    return F.when(not_blank(value), F.when(F.length(value) > LONG_LINE, long_).otherwise(wrong))


def json_lines(spark: SparkSession, paths: list[str] | str, schema: T.StructType = DOCUMENT, strings: list[str] | None = None) -> DataFrame:
    """JSON lines, gzipped by suffix; blank lines are skipped. A line that holds no JSON object (an array of objects, say), or
    whose members in `strings` (text, if the schema has it) are no strings, is an error that names its file and part;
    check_json_lines() names its number."""
    strings = ["text"] * ("text" in schema.names) if strings is None else strings
    d = text_lines(spark, paths)
    fault = line_fault(F.col("value"), strings)
    where = F.concat(fault, F.lit(" at "), "file", F.lit(", part from byte "), F.col("start").cast("string"))
    right = F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(where).cast("boolean"))
    return d.where(right & not_blank(F.col("value"))).select(F.from_json("value", schema).alias("r")).select("r.*")


def faulty_lines(spark: SparkSession, paths: list[str] | str, strings: list[str]) -> DataFrame:
    """file, line, fault and value of the lines that are errors to json_lines()."""
    lines = text_lines(spark, paths)
    bad = lines.withColumn("fault", line_fault(F.col("value"), strings)).where("fault IS NOT NULL")
    return line_numbers(lines, bad).select("file", "line", "fault", "value")


def check_json_lines(spark: SparkSession, paths: list[str] | str, schema: T.StructType = DOCUMENT, strings: list[str] | None = None) -> DataFrame:
    """json_lines() after a pass over all lines whose error names the first faulty ones as path:line."""
    strings = ["text"] * ("text" in schema.names) if strings is None else strings
    if bad := faulty_lines(spark, paths, strings).orderBy("file", "line").limit(3).collect():
        raise ValueError("; ".join(f"{r['fault']} at {r['file']}:{r['line']}" for r in bad))
    return json_lines(spark, paths, schema, strings)


def json_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def reports(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """JSON reports of many runs, with the run's folder and the file's name."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    d = spark.read.schema(schema).option("multiLine", True).json(pattern)
    return d.withColumns({"run": F.element_at(parts, -2), "file": F.element_at(parts, -1)})


def latest_reports(reports_: DataFrame, by: list[str]) -> DataFrame:
    """One report for each `by` (run and step, say): of several, that of the last file by name."""
    others = [c for c in reports_.columns if c not in by]
    return reports_.groupBy(*by).agg(F.max_by(F.struct(*others), F.col("file")).alias("r")).select(*by, *(F.col(f"r.{c}").alias(c) for c in others))


def last_steps(spark: SparkSession, pattern: str, lines: int = 3) -> DataFrame:
    """The newest step among the last lines of each log that are not blank; a torn line does not count; 0 without any.

    Spark keeps the last lines of each task before it sends any, so logs of any size are read in parts.
    """
    rows = text_lines(spark, pattern)
    newest = Window.partitionBy("file").orderBy(F.col("start").desc(), F.col("at").desc())
    near = rows.where(F.col("value").rlike(r"\S")).withColumn("back", F.row_number().over(newest)).where(F.col("back") <= lines)
    tails = near.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("back", "value"))).alias("tail"))
    steps = F.filter(F.transform("tail", lambda x: F.get_json_object(x["value"], "$.step").cast("long")), lambda s: s.isNotNull())
    found = tails.select("file", F.get(steps, F.lit(0)).alias("step"))
    files = rows.select("file").distinct()
    return files.join(found, "file", "left").select("file", F.coalesce("step", F.lit(0)).cast("long").alias("step"))


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """Name, size and sha256 of files that fit into a row."""
    d = spark.read.format("binaryFile").load(pattern)
    return d.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def block_range(blocks: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows of a contiguous range of blocks; the range reaches the Parquet scan."""
    return blocks.where((F.col("block_id") >= start) & (F.col("block_id") < stop))


def with_default(keys: DataFrame, values: DataFrame, on: list[str], **defaults) -> DataFrame:
    """values for all keys, with defaults where there are none."""
    return keys.join(values, on, "left").withColumns({k: F.coalesce(k, F.lit(v)) for k, v in defaults.items()})


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path; they reach every store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = file_system(spark, path)
    return fs.exists(at)


def train_log(spark: SparkSession, path: str) -> DataFrame:
    """A whole log, strictly; an absent one is empty."""
    return json_lines(spark, path, TRAIN_LOG) if exists(spark, path) else spark.createDataFrame([], TRAIN_LOG)


def describe_source(spark: SparkSession, files: list[str] | None = None, dataset: str | None = None, revision: str | None = None, split: str = "train") -> dict:
    """What identifies a source: name, size and digest of JSONL files, or a dataset's pinned revision and split."""
    if files:
        rows = file_digests(spark, files).orderBy("file").collect()  # one row per file
        return {"kind": "jsonl", "files": [{"name": r["file"], "bytes": r["length"], "sha256": r["sha256"]} for r in rows]}
    if not dataset or not revision:
        raise ValueError("a dataset needs a pinned revision")
    return {"kind": "snapshot", "dataset": dataset, "revision": revision, "split": split}


def open_source(spark: SparkSession, source: dict, paths: list[str] | None = None, schema: T.StructType = DOCUMENT) -> DataFrame:
    """The rows of a described source (of JSONL files also their paths); files that have changed, and revisions that are not
    at hand, are errors."""
    if source["kind"] == "snapshot":
        path = f"{source['dataset']}/{source['revision']}/{source['split']}"
        if not exists(spark, path):
            raise FileNotFoundError(f"the snapshot {path} is not at hand")
        return spark.read.schema(schema).parquet(path)
    if not paths or describe_source(spark, paths)["files"] != source["files"]:
        raise ValueError("the files are not those that were described")
    return json_lines(spark, paths, schema)


def snapshot_tree(spark: SparkSession, path: str) -> DataFrame:
    """task, split, rows, fingerprint of a JSON tree of tasks of any depth; a leaf has splits. Names are joined by slashes."""
    import json

    found: list[tuple] = []

    def walk(node: dict, name: str) -> None:
        if "splits" in node:
            found.extend((name, k, int(v["rows"]), str(v["fingerprint"])) for k, v in sorted(node["splits"].items()))
        for k, v in sorted(node.items()):
            if k != "splits" and isinstance(v, dict):
                walk(v, f"{name}/{k}" if name else k)

    walk(json.loads(spark.read.text(path, wholetext=True).first()[0]), "")  # a report of a few tasks
    return spark.createDataFrame(found, "task string, split string, rows long, fingerprint string")


# The names of a model folder's files by their kind, as patterns; a tokenizer's configuration, its vocabularies
# (one of them must be there) and what may go with them.
FILE_KINDS = {
    "config": r"config\.json",
    "index": r".*\.index\.json",
    "weights": r".*\.safetensors",
    "old weights": r"pytorch_model.*\.bin",
    "tokenizer": r"tokenizer_config\.json",
    "vocabulary": r"tokenizer\.json|tokenizer\.model|vocab\.json|vocab\.txt|spiece\.model",
    "tokenizer part": r"merges\.txt|special_tokens_map\.json|added_tokens\.json",
}


def model_files(spark: SparkSession, folder: str, kinds: list[str], digests: list[str]) -> DataFrame:
    """kind, name, bytes, modified and sha256 of a model folder's files of some kinds; only files of the kinds in `digests` are
    read, the others have no sha256."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.coalesce(*(F.when(name.rlike(f"^(?:{FILE_KINDS[k]})$"), k) for k in kinds))
    listed = lambda chosen: spark.read.format("binaryFile").load(folder).withColumn("kind", kind).where(F.col("kind").isin(*chosen))
    told = ["kind", name.alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")]
    rest = [k for k in kinds if k not in digests]
    out = listed(digests).select(*told, F.sha2("content", 256).alias("sha256"))
    return out.union(listed(rest).select(*told, F.lit(None).cast("string").alias("sha256"))) if rest else out


def checkpoint_identity(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of model_files() that tell a checkpoint: its weights by name, size and time, configuration and indices by digest.
    Weights of the old kind count only where there are no others; a folder without weights is an error."""
    files = model_files(spark, folder, ["config", "index", "weights", "old weights"], ["config", "index"])
    newest = Window.partitionBy(F.startswith("kind", F.lit("old")) | (F.col("kind") == "weights"))
    heaviest = F.max(F.col("kind")).over(newest)  # "weights" sorts behind "old weights"
    kept = files.withColumn("best", heaviest).where(~F.col("kind").endswith("weights") | (F.col("kind") == F.col("best"))).drop("best")
    expect(kept.agg(F.count_if(F.col("kind").endswith("weights")).alias("n")), weights=F.col("n") > 0)
    return kept


def tokenizer_files(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of model_files() of a tokenizer; without its configuration or any vocabulary it is not whole, an error."""
    kinds = ["tokenizer", "vocabulary", "tokenizer part"]
    files = model_files(spark, folder, kinds, kinds)
    expect(files.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds[:2])), configuration=F.col("tokenizer") > 0, vocabulary=F.col("vocabulary") > 0)
    return files
