"""Registered queries of the corpus and experiment operators, with the SQL of each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import queries_io
from .functions import numeric, text, tokenizers
from .operators import corpus, experts, grouping, moments, pack, results, routing
from .plans.corpus_build import Recipe, packed, prepare, raw_documents, raw_records, report
from .sources import npy, readers, verified, writers

RECIPE = Recipe()
#: The reference's 20,480 blocks of 2,048 tokens, 41.9 million in all.
FULL = Recipe(block_size=2048, blocks={"train": 16_384, "valid": 2_048, "test": 2_048}, calibration=512)
DIM = 64  # the components of an embedding stand for router logits


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("source_row"), "text")


def _r(col, digits=6):
    return F.round(col, digits)


# Corpus


def blank_filter(spark, d):
    return corpus.with_text(_docs(spark, d)).select("source_row", F.length("text").cast("long").alias("chars"))


def source_identifier(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.identifier(F.col("doc_id"), numeric=True).alias("source_id"))


def exact_dedup(spark, d):
    return corpus.first_of_each(corpus.candidates(_docs(spark, d)), "text_sha256", "source_row").select("source_row", "text_sha256")


def hash_split(spark, d):
    c = corpus.candidates(_docs(spark, d))
    return c.select("source_row", corpus.split_of(F.col("text_sha256"), RECIPE.seed, RECIPE.blocks).alias("split"))


def split_counts(spark, d):
    return hash_split(spark, d).groupBy("split").agg(F.count("*").alias("documents"))


def token_counts(spark, d):
    return corpus.token_counts(_docs(spark, d)).select("source_row", "tokens")


def two_key_dedup(spark, d):
    """Documents, benchmark items and conversation turns with ids that repeat across the three."""
    docs = _t(spark, d, "documents").select((F.col("doc_id") * 3).alias("source_row"), "text", F.concat(F.lit("i"), F.pmod("doc_id", F.lit(701)).cast("string")).alias("source_id"))
    bench = _t(spark, d, "benchmark").select((F.col("item_id") * 3 + 1).alias("source_row"), "text", F.concat(F.lit("i"), (F.col("item_id") * 7).cast("string")).alias("source_id"))
    turns = _t(spark, d, "conversations").select(((F.col("conv_id") * 64 + F.col("turn")) * 3 + 2).alias("source_row"), "text", F.lit("").alias("source_id"))
    rows = corpus.candidates(docs.union(bench).union(turns))
    return corpus.two_key_dedup(rows).select("source_row", "text_sha256", "source_id")


def quota_admission(spark, d):
    return raw_documents(_docs(spark, d), RECIPE).select("source_row", "split", "tokens", F.col("before_tokens").cast("long").alias("before_tokens"))


def pack_spans(spark, d):
    spans, _ = packed(raw_documents(_docs(spark, d), RECIPE), RECIPE)
    return spans.select("split", "source_row", F.col("token_start").cast("long").alias("token_start"), F.col("token_end").cast("long").alias("token_end"), "document_tail_truncated")


def pack_blocks(spark, d):
    _, blocks = packed(raw_documents(_docs(spark, d), RECIPE), RECIPE)
    return blocks.select("split", "block_id", F.size("tokens").cast("long").alias("tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("content_sha256"))


def corpus_counters(spark, d):
    """Documents and tokens by split, and what was read and skipped up to the row at which all splits were full."""
    docs = _docs(spark, d)
    r = report(docs, raw_documents(docs, RECIPE), RECIPE, ["tokens"])
    return r.select("split", "fill_row", "documents", F.col("tokens").cast("long").alias("tokens"), "rows_read", "empty_skipped", "duplicates_skipped")


TWO = [tokenizers.HashedWords(), tokenizers.Characters()]


def two_tokenizer_quota(spark, d):
    """A split is full when its words and its runs of four characters both reach the quota."""
    raw = raw_documents(_docs(spark, d), FULL, TWO)
    return raw.select("source_row", "split", "words", "characters", *(F.col(f"before_{c}").cast("long").alias(f"before_{c}") for c in ("words", "characters")))


def raw_document_fields(spark, d):
    docs = _docs(spark, d).withColumns({"source_id": text.identifier(F.col("source_row"), numeric=True), "url": F.concat(F.lit("doc/"), F.col("source_row").cast("string"))})
    r = raw_records(raw_documents(docs, FULL, TWO), ["words", "characters"])
    count = lambda k: F.element_at("token_counts", k).alias(k)
    return r.select("text_sha256", "source_id", "url", "source_row", "split", count("words"), count("characters"), F.length("text").cast("long").alias("chars"))


def packed_ids(spark, d):
    """Blocks of the ids of a pluggable tokenizer, packed by its own counts."""
    raw = raw_documents(_docs(spark, d), FULL, TWO[:1])
    b = pack.blocks(pack.spans(raw, FULL.targets, "words"), FULL.block_size, TWO[0].ids)
    id_ = F.explode("tokens").alias("id")
    return b.select("split", "block_id", id_).groupBy("split", "block_id").agg(F.count("*").alias("tokens"), F.min("id").alias("low"), F.max("id").alias("high"), F.sum("id").alias("total"))


def npy_block_scan(spark, d):
    """The full training blocks of ids, written as .npy shards, verified, and read by a range of blocks."""
    raw = raw_documents(_docs(spark, d), FULL, TWO[:1])
    b = pack.blocks(pack.spans(raw, FULL.targets, "words"), FULL.block_size, TWO[0].ids).where((F.col("split") == "train") & (F.size("tokens") == FULL.block_size))
    path = f"{corpus.shared_dir(spark)}/npy-{uuid.uuid4().hex}"
    npy.write_blocks(b, path)
    got = npy.read_verified(spark, path, FULL.block_size, TWO[0].size).where("block_id >= 2")
    return got.select("block_id", F.array_min("tokens").alias("low"), F.array_max("tokens").alias("high"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def json_line_numbers(spark, d):
    """Documents written as JSON lines by split and read back strictly, with the numbers of their lines; complete: a file's
    numbers are 1 to its number of lines."""
    path = f"{corpus.shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    c = corpus.candidates(_docs(spark, d)).select(corpus.split_of(F.col("text_sha256"), RECIPE.seed, RECIPE.blocks).alias("split"), F.col("source_row").alias("id"), "text")
    writers.split_json_lines(c, path)
    lines = readers.line_numbers(readers.text_lines(spark, f"{path}/split=*"))
    fault = readers.line_fault(F.col("value"), ["text"])
    read = lines.select("file", "line", F.when(fault.isNull(), F.from_json("value", readers.DOCUMENT)).alias("r"))
    whole = Window.partitionBy("file")
    read = read.withColumn("complete", (F.max("line").over(whole) == F.count("*").over(whole)) & (F.min("line").over(whole) == 1))
    return read.select(F.col("r.id").alias("id"), F.sha2("r.text", 256).alias("text_sha256"), "complete")


def _train_blocks(spark, d):
    return packed(raw_documents(_docs(spark, d), FULL), FULL)[1].where("split = 'train'")


def calibration_blocks(spark, d):
    """Sixteen training blocks by their drawn ids."""
    c = pack.calibration(_train_blocks(spark, d), 16, 3)
    return c.select("pos", "block_id", F.sha2(F.array_join("tokens", " "), 256).alias("content_sha256"))


def subset_blocks(spark, d):
    return pack.subset(_train_blocks(spark, d), 8, 16_384).select("block_id", "subset")


def local_shuffle(spark, d):
    return corpus.local_shuffle(_docs(spark, d), "source_row", 10_000, 17).select("source_row", "draw")


def source_description(spark, d):
    """Name, size and digest of two source files."""
    return readers.file_digests(spark, [f"{d}/nation.parquet", f"{d}/region.parquet"])


def full_quota_admission(spark, d):
    return raw_documents(_docs(spark, d), FULL).select("source_row", "split", "tokens", F.col("before_tokens").cast("long").alias("before_tokens"))


def capped_admission(spark, d):
    """The full quotas, but no more than 500 source rows are read (the feature: a cap on reading)."""
    raw = raw_documents(_docs(spark, d), FULL, most_rows=500)
    return raw.select("source_row", "split", "tokens", F.col("before_tokens").cast("long").alias("before_tokens"))


def full_pack_spans(spark, d):
    spans, _ = packed(raw_documents(_docs(spark, d), FULL), FULL)
    return spans.select("split", "source_row", F.col("token_start").cast("long").alias("token_start"), F.col("token_end").cast("long").alias("token_end"), "document_tail_truncated")


def full_pack_blocks(spark, d):
    """Of a split whose quota is not met, the last block can be shorter."""
    _, blocks = packed(raw_documents(_docs(spark, d), FULL), FULL)
    return blocks.select("split", "block_id", F.size("tokens").cast("long").alias("tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("content_sha256"))


def calibration_sample(spark, d):
    return pack.sample(_t(spark, d, "documents").select("doc_id"), "doc_id", 64, 3).select("doc_id", "draw")


def fit_check_partition(spark, d):
    s = pack.sample(_t(spark, d, "documents").select("doc_id"), "doc_id", 64, 3)
    return pack.fit_check(s, "doc_id", 0.75, 64).select("doc_id", "phase")


def list_digests(spark, d):
    g = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return g.select("conv_id", text.list_digest(F.col("turns")).alias("digest"))


# Vectors and routing


def vector_moments(spark, d):
    m = moments.vector_moments(_t(spark, d, "embeddings"), ["label"], "embedding")
    return m.select("label", "dim", "n", _r("mu").alias("mu"), _r("sigma").alias("sigma"))


def centroid_distance(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    c = moments.centroids(e, "label", "v")
    return e.join(c, "label").select("vec_id", _r(numeric.squared_distance(F.col("v"), F.col("centroid"))).alias("distance"))


def pair_distance_ratio(spark, d):
    return moments.pair_distance_ratio(_t(spark, d, "embeddings"), "label", "embedding").select(*(_r(c).alias(c) for c in ("within", "overall", "ratio")))


def energy_scaling(spark, d):
    s = moments.scaled(_t(spark, d, "embeddings"), "embedding")
    return s.select("vec_id", _r(numeric.array_sum(F.transform("scaled", lambda x: x * x)), 5).alias("energy"))


def _probabilities(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", "label", numeric.softmax(F.col("embedding").cast("array<double>")).alias("p"))


def softmax_prob(spark, d):
    return _probabilities(spark, d).select("vec_id", F.posexplode("p").alias("expert", "x")).select("vec_id", "expert", _r("x").alias("probability"))


def topk_per_row(spark, d):
    return routing.assignments(_probabilities(spark, d), "p", 2).select("vec_id", "expert", _r("probability").alias("probability"))


def _calls(spark, d):
    e = _t(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("layer"), F.pmod("user_id", F.lit(12)).cast("int").alias("expert")).agg(F.count("*").alias("calls"))


def routing_load_stats(spark, d):
    s = routing.load_stats(_calls(spark, d), "layer", "expert", 16)
    return s.select("layer", *(_r(c).alias(c) for c in ("cv", "entropy", "effective")), "observed")


def usage_shares(spark, d):
    s = routing.usage_shares(_calls(spark, d), "layer", "expert", 2)
    return s.select("layer", "expert", "calls", _r("share").alias("share"), _r("token_share").alias("token_share"))


def assignment_share(spark, d):
    return routing.new_share(_calls(spark, d), "layer", "expert", 8).select(_r("new_assignment_share").alias("new_assignment_share"))


def balance_index(spark, d):
    p = _probabilities(spark, d)
    a = routing.assignments(p, "p", 2)
    mean = p.select("label", F.posexplode("p").alias("expert", "x")).groupBy("label", "expert").agg(F.avg("x").alias("mean_probability"))
    return routing.balance(a, "label", "expert", mean, DIM).select("label", _r("balance").alias("balance"))


def confidence_refinement(spark, d):
    p = _probabilities(spark, d).withColumn("selected", numeric.top_k(F.col("p"), 2)).withColumnRenamed("vec_id", "token")
    r = routing.refine(p, [i // 4 for i in range(DIM)], 0.2, 0.5, 11, 2)
    return r.select("token", F.posexplode("refined").alias("slot", "expert"))


def random_projection(spark, d):
    m = spark.range(64).select(F.col("id").cast("int").alias("row"), F.array(*(text.digest_modulo(F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(j))), 256), 2001).cast("double") / 1000 - 1 for j in range(4))).alias("weights"))
    return moments.project(_t(spark, d, "embeddings"), "embedding", m).select("vec_id", F.posexplode("projected").alias("dim", "x")).select("vec_id", "dim", _r("x").alias("value"))


# Plans


def largest_remainder(spark, d):
    s = _calls(spark, d).withColumn("score", F.col("calls").cast("double"))
    return grouping.largest_remainder(s, 32, ["layer"], "expert", "score").select("layer", "expert", "seats")


def greedy_cap3(spark, d):
    return grouping.greedy_copies(_calls(spark, d), 20, ["layer"], "expert", "calls")


def traffic_cycle(spark, d):
    return grouping.cycled_parents(_calls(spark, d), 30, ["layer"], "expert", [F.col("calls").desc(), F.col("expert")])


def random_cycle(spark, d):
    s = _calls(spark, d).withColumn("draw", F.sha2(F.concat_ws(":", F.lit("5"), "layer", F.col("expert").cast("string")), 256))
    return grouping.cycled_parents(s, 30, ["layer"], "expert", [F.col("draw")])


def adjusted_rand(spark, d):
    e = _t(spark, d, "embeddings").select("label", F.pmod("vec_id", F.lit(7)).alias("other"))
    return grouping.adjusted_rand(e, "label", "other").select(_r("adjusted_rand", 9).alias("adjusted_rand"))


def canonical_labels(spark, d):
    return grouping.canonical_labels(_t(spark, d, "embeddings").select("vec_id", "label"), [], "vec_id", "label").select("vec_id", "canonical")


def _expert_points(spark, d):
    e = _t(spark, d, "embeddings").select((F.col("vec_id") % 5).cast("int").alias("layer"), (F.col("vec_id") % 60).cast("int").alias("expert"), "label", "embedding")
    g = moments.vector_moments(e, ["layer", "expert"], "embedding")
    return g.groupBy("layer", "expert").agg(F.max("n").alias("traffic"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "mu"))), lambda s: s["mu"]).alias("v"))


def group_plan(spark, d):
    return grouping.group_plans(_expert_points(spark, d), ["layer"], "expert", "v", "traffic", 3, 12, 1)


def permutation_null(spark, d):
    p = _expert_points(spark, d).withColumn("label", F.col("expert") % 3)
    n = grouping.permutation_null(p, ["layer"], "expert", "label", "v", 100, 2)
    return n.select("layer", *(_r(c).alias(c) for c in ("ratio", "null_mean", "null_q05", "null_q95")))


def distance_table(spark, d):
    return grouping.distance_table(_expert_points(spark, d), ["layer"], "expert", "v", 16).select("layer", "a", "b", _r("distance").alias("distance"))


def distance_ratio(spark, d):
    """Of each layer, with experts labelled by the parity of their traffic."""
    p = _expert_points(spark, d)
    r = grouping.distance_ratio(grouping.distance_table(p, ["layer"], "expert", "v"), p.withColumn("label", F.col("traffic") % 2), ["layer"], "expert", "label")
    return r.select("layer", *(_r(c).alias(c) for c in ("within", "overall", "ratio")))


def parent_coverage_ratio(spark, d):
    p = _expert_points(spark, d)
    c = grouping.nearest_parent_coverage(p, p.where("expert < 20"), "expert", "v", "traffic", ["layer"])
    return c.select("layer", _r("coverage").alias("coverage"), _r("ratio").alias("ratio"))


# Results


def _runs(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.col("event_type").alias("method"), F.pmod("user_id", F.lit(5)).cast("int").alias("seed"), (F.unix_timestamp("ts") / 86400).cast("long").alias("day"), "event_id", "value")


def method_summary(spark, d):
    runs = _runs(spark, d).groupBy("method", "seed").agg(F.avg("value").alias("value"))
    m = results.mean_sd(runs, ["method"], "value")
    return m.select("method", "n", _r("mean").alias("mean"), _r("sd").alias("sd"))


def completeness(spark, d):
    runs = _runs(spark, d)
    expected = results.matrix(runs.select("method").distinct(), spark.range(1).select(F.lit("a").alias("model")), spark.range(7).select(F.col("id").cast("int").alias("seed")))
    return results.completeness(expected, runs, ["method", "seed"]).select("method", "seed", "finished")


def task_average(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source")
    per = docs.join(_t(spark, d, "labels"), "doc_id", "left").groupBy("source", F.pmod("doc_id", F.lit(3)).alias("task")).agg(F.avg("quality").alias("score"))
    a = results.all_or_nothing(per, ["source"], "score", 3)
    return a.select("source", "measured", _r("average").alias("average"))


def _curve(spark, d):
    return _runs(spark, d).groupBy("method", "day").agg(F.avg("value").alias("y"))


def recovery_curve(spark, d):
    return _curve(spark, d).select("method", "day", _r("y").alias("y"))


def excess_auc(spark, d):
    return results.excess_auc(_curve(spark, d), ["method"], "day", "y", 50.0).select("method", _r("auc", 4).alias("auc"))


def first_crossing(spark, d):
    return results.first_crossing(_curve(spark, d), ["method"], "day", "y", 49.0)


def step_band(spark, d):
    p = _runs(spark, d).groupBy("method", "seed", "day").agg(F.avg("value").alias("y")).withColumn("x", F.col("day") * 1.0)
    b = results.step_band(p, ["method", "day"], "x", "y")
    return b.select("method", "day", _r("x").alias("x"), _r("y").alias("y"), _r("sd").alias("sd"))


def _blocks(spark, d):
    return _runs(spark, d).groupBy("method", "seed", F.pmod("event_id", F.lit(64)).alias("block_id")).agg(F.avg("value").alias("nll"))


def _grid(spark, d):
    """Sums of values by method, seed and block, zero where there is none, so that all runs have the same 64 blocks."""
    runs = _runs(spark, d)
    seeds, blocks = (spark.range(n).select(F.col("id").cast(kind).alias(name)) for n, kind, name in ((5, "int", "seed"), (64, "long", "block_id")))
    grid = runs.select("method").distinct().join(seeds).join(blocks)
    sums = runs.groupBy("method", "seed", F.pmod("event_id", F.lit(64)).alias("block_id")).agg(F.sum("value").alias("nll"))
    return grid.join(sums, ["method", "seed", "block_id"], "left").withColumn("nll", F.coalesce("nll", F.lit(0.0)))


def paired_delta(spark, d):
    c = results.contrasts(_grid(spark, d), "method", "click", ["seed", "block_id"], "nll")
    return c.select("contrast", "seed", "block_id", _r("delta").alias("delta"))


def contrast_summary(spark, d):
    c = results.contrasts(_grid(spark, d).withColumn("nll", F.col("nll") / 1000), "method", "click", ["seed", "block_id"], "nll")
    return results.contrast_summary(c, "seed").select("contrast", "paired_seeds", _r("mean").alias("mean"), _r("ratio").alias("ratio"))


def block_group_mean(spark, d):
    g = results.block_groups(_grid(spark, d), ["method", "seed"], "block_id", "nll", 32)
    return g.select("method", "seed", "block_group", "blocks", _r("mean").alias("mean"))


def bootstrap_ci(spark, d):
    """Intervals of the paired differences of each method to `click`: 2,000 repetitions over seeds and groups of 32 blocks."""
    c = results.contrasts(_grid(spark, d), "method", "click", ["seed", "block_id"], "nll")
    g = results.block_groups(c, ["contrast", "seed"], "block_id", "delta", 32)
    b = results.bootstrap(g, "seed", "block_group", "mean", 2000, 9, ["contrast"])
    return b.select("contrast", *(_r(c_).alias(c_) for c_ in ("mean", "low", "high")))


def largest_value(spark, d):
    return results.largest(_t(spark, d, "events"), ["event_type"], "value")


def _jobs(spark, d):
    return results.matrix(spark.range(1).select(F.lit("a").alias("model")), _runs(spark, d).select("method").distinct(), spark.range(6).select(F.col("id").cast("int").alias("seed")))


def run_status(spark, d):
    """Event types as methods: runs are complete, saved, logged and marked by how many events of some users they have."""
    n = _runs(spark, d).groupBy("method", "seed").agg(F.count("*").alias("n"), F.max("day").alias("last"), F.avg("value").alias("v"))
    n = n.withColumn("run", results.run_name(F.lit("a"), F.col("method"), F.col("seed")))
    complete = n.where("n % 3 = 0").select("run", F.lit(True).alias("complete"), F.lit(100).alias("final_step"), F.lit(4).alias("tasks_done"), _r("v").alias("test_ppl"))
    saved = n.where("n % 2 = 0").select("run", (F.col("n") % 90).alias("checkpoint_step"))
    logged = n.where("n % 5 < 3").select("run", (F.col("n") % 110).alias("step"))
    marks = n.select("run", (F.col("n") % 7 == 0).alias("evaluated"), (F.col("n") % 4 == 1).alias("warm"), F.lit(True).alias("started"), (F.col("n") % 4).alias("tasks_done"), F.lit(None).cast("double").alias("test_ppl"))
    return results.run_status(_jobs(spark, d), complete, saved, logged, marks, 100, 4)


def completed_runs(spark, d):
    return results.completed(run_status(spark, d))


def recovery_report(spark, d):
    """Days as steps, each method's curve against its own mean."""
    c = _curve(spark, d)
    first = c.agg(F.min("day").alias("m"))
    curve = c.join(F.broadcast(first)).select("method", (F.col("day") - F.col("m")).alias("step"), F.col("y").alias("nll"), F.lit("i").alias("indices"))  # one row
    means = _runs(spark, d).groupBy("method").agg(F.avg("value").alias("reference")).withColumn("indices", F.lit("i"))
    budgets = means.select("method", F.lit(10).alias("final_step"), F.lit(81_920).alias("input_tokens"))
    r = results.recovery(curve, means, budgets, ["method"])
    return r.select("method", _r("reference").alias("reference"), "first_tokens", "right_censored", "observed_tokens", _r("excess_auc", 2).alias("excess_auc"))


def quantile_band(spark, d):
    q = results.quantile_band(_t(spark, d, "events"), ["event_type"], "value")
    return q.select("event_type", *(_r(c).alias(c) for c in ("low", "median", "high")))


def latest_status(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return results.latest(e, ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


def run_stage(spark, d):
    c = F.col
    e = _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(c("event_type") == "purchase").alias("p"), F.count_if(c("event_type") == "error").alias("e"), F.count_if(c("event_type") == "signup").alias("s"))
    return e.select("user_id", results.stage(c("p") > 3, c("e") > 3, c("n"), F.lit(12), c("s") > 2, c("n") > 0).alias("stage"))


def manifest_diff(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"))
    return results.manifest_diff(o.where("k % 5 != 0"), o.where("k % 7 != 0").withColumn("v", F.when(F.col("k") % 11 == 0, "changed").otherwise(F.col("v"))), "k", "v")


def lr_schedule(spark, d):
    """Each event as a step of a run of 4,096 steps, 128 of them warm-up."""
    s = _t(spark, d, "events").select(F.col("event_id").alias("step")).distinct()
    return s.select("step", _r(numeric.lr_multiplier(F.col("step"), 4096, 128), 9).alias("multiplier"), _r(numeric.exploration(F.col("step"), 4096), 9).alias("exploration"))


def block_cross_entropy(spark, d):
    """Mean negative log probability of the label with the components as logits, and the perplexity."""
    e = _t(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("z"))
    n = e.select("label", numeric.cross_entropy(F.col("z"), F.col("label")).alias("nll")).groupBy("label").agg(F.avg("nll").alias("nll"))
    return n.select("label", _r("nll").alias("nll"), _r(F.exp("nll")).alias("ppl"))


# Expert tables and reports


def probe_windows(spark, d):
    """Events as positions, and a window of 16 from seven times each user's id on."""
    e = _t(spark, d, "events")
    windows = e.select((F.col("user_id") * 7).alias("start")).distinct()
    return experts.in_windows(e.select(F.col("event_id").alias("position")), windows, "position", "start", 16).select("position", "start", "local")


def probe_coordinates(spark, d):
    p = F.col("event_id")
    return _t(spark, d, "events").select("event_id", experts.block_of(p, 128).alias("block_id"), experts.offset_in_block(p, 128).alias("token_pos"))


def conditional_prob(spark, d):
    a = experts.conditional_probability(routing.assignments(_probabilities(spark, d), "p", 2), ["label", "expert"], "probability")
    return a.select("label", "expert", "calls", _r("mass", 5).alias("mass"), _r("a").alias("a"))


def routing_totals(spark, d):
    p = _probabilities(spark, d)
    return experts.routing_totals(routing.assignments(p, "p", 2), p, ["label"], 2)


def shared_expert_totals(spark, d):
    """The calls of routed experts, and those of a shared expert, which only labels of an even length have."""
    p = _probabilities(spark, d)
    even = p.where(F.length(F.col("label").cast("string")) % 2 == 0)
    return experts.routing_totals(routing.assignments(p, "p", 2), p, ["label"], 2, even.select("label"))


def expert_dispatch(spark, d):
    """Expert e of a vector puts out its four components from e on, the first after the last."""
    chosen = routing.assignments(_probabilities(spark, d), "p", 2).select("vec_id", "expert", "probability")
    v = F.col("embedding").cast("array<double>")
    each = F.explode(F.array(*(F.struct(F.lit(e).alias("expert"), F.array(*(F.element_at(v, (e + j) % DIM + 1) for j in range(4))).alias("output")) for e in range(DIM))))
    outputs = _t(spark, d, "embeddings").select("vec_id", each.alias("o")).select("vec_id", "o.expert", "o.output")
    m = experts.dispatch(chosen, outputs, "vec_id", "expert", "probability", "output", renormalize=True)
    return m.select("vec_id", F.posexplode("mixed").alias("dim", "x")).select("vec_id", "dim", _r("x").alias("value"))


def mean_gradient_energy(spark, d):
    return experts.mean_gradient_energy(_t(spark, d, "embeddings"), ["label"], "embedding").select("label", _r("energy").alias("energy"))


def seed_stability(spark, d):
    """Three labellings of the vectors as those of three seeds."""
    labels = F.array(F.col("label").cast("long"), F.pmod("vec_id", F.lit(7)), F.pmod(F.col("label") + F.col("vec_id"), F.lit(5)))
    rows = _t(spark, d, "embeddings").select("vec_id", F.posexplode(labels).alias("seed", "l"))
    return experts.seed_stability(rows, "seed", "vec_id", "l").select("seed_a", "seed_b", _r("adjusted_rand", 9).alias("adjusted_rand"))


def traffic_reallocation(spark, d):
    c = _calls(spark, d).groupBy("layer", F.pmod("expert", F.lit(5)).cast("int").alias("cluster")).agg(F.sum("calls").cast("double").alias("traffic"), F.count("*").cast("double").alias("size"))
    return experts.reallocation(c, 32, ["layer"], "cluster", "traffic", "size")


def plan_summary(spark, d):
    m = _runs(spark, d).groupBy("method", "seed", F.pmod("event_id", F.lit(3)).alias("layer")).agg(F.avg("value").alias("v"))
    s = experts.two_level_summary(m, ["method"], "seed", "v")
    return s.select("method", "seeds", _r("mean").alias("mean"), _r("sd").alias("sd"))


def plan_variants(spark, d):
    plans = _runs(spark, d).groupBy(F.col("method").alias("variant"), "seed").agg(F.count("*").alias("plan"))
    methods = {"grouped": "click", "grouped_warm": "click", "busiest": "view", "absent": "none"}
    runs = spark.createDataFrame([(m,) for m in methods], "method string").join(spark.range(6).select(F.col("id").cast("int").alias("seed")))
    return experts.variant_plans(runs, plans, methods, single=("busiest",)).select("method", "seed", "variant", "plan_seed", "plan")


def micro_batches(spark, d):
    order = experts.train_order(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 128, 5)
    return experts.micro_batches(order, 4, "n_chars").select("step", "rows", _r("mean").alias("mean"))


def evaluation_progress(spark, d):
    c = _runs(spark, d).groupBy("method", "day").agg(F.avg("value").alias("y"), F.count("*").cast("double").alias("seconds"))
    p = experts.progress(c, ["method"], "day", "y", "seconds")
    return p.select("method", "day", "done", _r("mean").alias("mean"), "elapsed", _r("left").alias("left"))


def merged_manifest(spark, d):
    parts = _t(spark, d, "documents").groupBy(F.col("lang").alias("task"), F.col("source").alias("split")).agg(F.count("*").alias("rows"), F.concat_ws("-", F.min("doc_id").cast("string"), F.max("doc_id").cast("string")).alias("fingerprint"))
    return experts.merge_manifests(parts.withColumn("definitions", F.sha2(F.lit("v1"), 256)), "definitions")


def flattened_samples(spark, d):
    c = _t(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    m = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "turns"))).alias("samples"))
    return experts.flatten_samples(m, "conv_id", "samples").select("conv_id", "subtask", "position", "example")


def preparation_costs(spark, d):
    """Users as models; sums of their values by event type as the seconds of three reports."""
    e = _t(spark, d, "events")
    of = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.sum("value").alias("seconds"))
    c = experts.preparation_costs(e.select("user_id").distinct(), {"calibration": of("view"), "grouping": of("click"), "gradient": of("error")}, "user_id", optional=("gradient",))
    return c.select("user_id", *(_r(n, 5).alias(n) for n in ("calibration", "grouping", "gradient")))


def parameter_counts(spark, d):
    """Models whose sizes follow from the parts' keys."""
    k = F.col("p_partkey")
    c = {"width": 64 * (1 + k % 16), "layers": 1 + k % 7, "experts": 8 * (1 + k % 8), "new_experts": 4 * (1 + k % 3), "expert_width": 32 * (1 + k % 5), "shared_width": 128 * (k % 2), "kv_width": 16 * (1 + k % 4), "vocabulary": 1000 + k % 500, "tied": k % 3 == 0}
    base, extra = experts.parameter_counts(c)
    return _t(spark, d, "part").select("p_partkey", base.cast("long").alias("base"), extra.cast("long").alias("extra"))


def expert_descriptor(spark, d):
    """Vectors as tokens that call two of 64 experts; experts that are called, by label as the layer."""
    p = _probabilities(spark, d).join(_t(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    calls = routing.assignments(p, "p", 2)
    x = experts.descriptor(calls, calls, calls.select("label", "expert").distinct(), ["label"], "expert", "probability", "embedding")
    experts.check_descriptor(x, p.groupBy("label").agg((2 * F.count("*")).alias("expected")), ["label"], 64)
    total = lambda c: _r(numeric.array_sum(F.col(c)), 5).alias(c)
    return x.select("label", "expert", "count", "observed", _r("a").alias("a"), total("mu"), total("sigma"))


def verified_scan(spark, d):
    """Descriptors of experts, written with a manifest by label, and read back behind it with their rules."""
    p = _probabilities(spark, d).join(_t(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    calls = routing.assignments(p, "p", 2)
    x = experts.descriptor(calls, calls, calls.select("label", "expert").distinct(), ["label"], "expert", "probability", "embedding")
    folder = f"{corpus.shared_dir(spark)}/descriptors-{uuid.uuid4().hex}"
    x.withColumn("part", F.col("label")).repartition("part").write.partitionBy("part").parquet(folder)
    verified.record(spark, folder)
    got = verified.scan(spark, folder, verified.whole_vectors({"mu": 64, "sigma": 64}, ["sigma"], ["a"]))
    total = lambda c: _r(numeric.array_sum(F.col(c)), 5).alias(c)
    return got.select("label", "expert", "count", "observed", _r("a").alias("a"), total("mu"), total("sigma"))


def published_corpus(spark, d):
    """The small recipe, published part by part with its measurements, and read back."""
    out = f"{corpus.shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    prepare(_docs(spark, d), RECIPE, out)
    parts = [spark.read.parquet(f"{out}/{k}").select(F.lit(k).alias("part"), "block_id", F.sha2(F.array_join("tokens", " "), 256).alias("content_sha256")) for k in ("train", "valid", "test", "calibration")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def scored_plans(spark, d):
    c = _calls(spark, d)
    return experts.scored_plans(c.select("layer").distinct(), c, "layer", 12, "expert", "calls")


def inherited_labels(spark, d):
    c = _calls(spark, d)
    parents = experts.check_plan(experts.scored_plans(c.select("layer").distinct(), c, "layer", 12, "expert", "calls"), ["layer"], 12, 12)
    return experts.inherited_labels(parents, c.select("layer", "expert", (F.col("expert") % 3).alias("label")), ["layer"], 12)


def distinct_parents(spark, d):
    return experts.distinct_parents(greedy_cap3(spark, d), ["layer"])


def seed_ari(spark, d):
    labels = F.array(F.col("label").cast("long"), F.pmod("vec_id", F.lit(7)), F.pmod(F.col("label") + F.col("vec_id"), F.lit(5)))
    s = experts.seed_stability(_t(spark, d, "embeddings").select("vec_id", F.posexplode(labels).alias("seed", "l")), "seed", "vec_id", "l")
    return experts.stability_summary(s.withColumn("layer", F.lit(0)), ["layer"]).select("layer", *(_r(c, 9).alias(c) for c in ("seed_ari_mean", "seed_ari_min")))


def plan_report(spark, d):
    g = _runs(spark, d).withColumn("layer", F.pmod("event_id", F.lit(3)))
    m = g.groupBy("method", "seed", "layer").agg(F.avg(F.when(F.col("seed") < 4, F.col("value"))).alias("ratio"), F.max("value").alias("null_mean"), F.min("value").alias("coverage"), F.count_distinct("day").alias("unique_parents"))
    s = g.where("method <> 'view'").groupBy("method", "layer").agg(F.avg("value").alias("seed_ari_mean"))
    r = experts.plan_report(m, s)
    return r.select("method", "layers", "plan_seeds", *(_r(c).alias(c) for c in ("ratio_mean", "null_mean_mean", "coverage_mean", "unique_parents_mean", "ratio_seed_sd", "seed_ari_mean")))


def resource_estimate(spark, d):
    k, sizes = F.col("p_partkey"), parameter_counts(spark, d)
    method = F.element_at(F.array(*map(F.lit, ("gradient", "original", "continue", "grouped", "warm"))), (k % 5 + 1).cast("int"))
    c = {"base": F.col("base"), "extra": F.col("extra"), "layers": 1 + k % 7, "experts": 8 * (1 + k % 8), "all_experts": 8 * (1 + k % 8) + 4 * (1 + k % 3), "expert": 3 * 64 * (1 + k % 16) * 32 * (1 + k % 5), "width": 64 * (1 + k % 16)}
    r = experts.resources(c, method, ("warm",), k % 2 == 0)
    return sizes.select("p_partkey", method.alias("method"), *(_r(v, 5).alias(n) for n, v in r.items()))


def causal_loss(spark, d):
    """Sixteen vectors make a block; each one's components are the logits of the next one's label."""
    e = _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("block"), F.pmod("vec_id", F.lit(16)).alias("pos"), F.col("embedding").cast("array<double>").alias("z"), F.col("label").alias("token"))
    return numeric.causal_loss(e, "block", "pos", "z", "token").select("block", "targets", _r("nll", 5).alias("nll"))


QUERIES = [
    blank_filter, source_identifier, exact_dedup, hash_split, split_counts, token_counts, two_key_dedup, quota_admission, pack_spans, pack_blocks, corpus_counters, calibration_sample,
    full_quota_admission, capped_admission, npy_block_scan, json_line_numbers, full_pack_spans, full_pack_blocks,
    fit_check_partition, list_digests, vector_moments, centroid_distance, pair_distance_ratio, energy_scaling, softmax_prob, topk_per_row, routing_load_stats, usage_shares, assignment_share,
    balance_index, confidence_refinement, random_projection, largest_remainder, greedy_cap3, traffic_cycle, random_cycle, adjusted_rand, canonical_labels, group_plan, permutation_null, distance_table, distance_ratio,
    parent_coverage_ratio, method_summary, completeness, task_average, recovery_curve, excess_auc, first_crossing, step_band, paired_delta, block_group_mean, bootstrap_ci, quantile_band,
    latest_status, run_stage, manifest_diff, lr_schedule, block_cross_entropy, probe_windows,
    probe_coordinates, conditional_prob, routing_totals, expert_dispatch, mean_gradient_energy, seed_stability, traffic_reallocation, plan_summary, plan_variants, micro_batches,
    evaluation_progress, merged_manifest, flattened_samples, preparation_costs, parameter_counts,
    two_tokenizer_quota, raw_document_fields, packed_ids, calibration_blocks, subset_blocks, local_shuffle, source_description, contrast_summary, largest_value, run_status, completed_runs,
    recovery_report, expert_descriptor, verified_scan, published_corpus, shared_expert_totals, scored_plans, inherited_labels, distinct_parents, seed_ari, plan_report, resource_estimate, causal_loss,
]


def queries() -> dict:
    return {f.__name__: f for f in [*QUERIES, *queries_io.QUERIES]}
