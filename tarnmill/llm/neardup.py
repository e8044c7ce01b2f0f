"""MinHash near-duplicate detection by an inverted join of signature coordinates.

Method. Every document becomes its set of 64-bit shingle hashes and a signature of K minima. Documents with
equal sets (by 128-bit digests) form one node, so that exact copies cost one row. Each node is posted under each
(coordinate, value) pair. A pair of nodes collides in as many postings as their signatures agree in; pairs with at
least T collisions are kept. Two classical prunings keep the counting small:

* prefix: a pair with T collisions shares a posting among the s - T + 1 rarest of the s postings that a node
  shares with anyone, so only these are merged, and a node with s < T is done;
* skip: postings of which all members stand in one component already are not merged at all, and members of a mixed
  posting that stand in its largest component are not paired with each other.

Components come from leaders first. A leader of a posting is its most central member (that with the largest sum of
posting lengths: the text that the others were edited from). Each node is compared with the leader that it collides with
most. In long postings that are still of several components, nodes outside the largest one are then compared with members
of it, drawn anew each time, while that links something. So a group of m near copies takes a few m comparisons. What is
left in different components is compared pair by pair where it collides T times, and in long postings where it also shares
one of the rarest shingles, of which a linked pair must share one. All links are confirmed on the full shingle sets, so signatures only ever propose. With K = 64
and T = 36 a pair at the similarity of 0.85 collides less than 36 times with a probability of about 1e-8.

Sizes: the sketch of a document has 64 integers. Pairs of one component are formed with leaders only. Texts that are
alike in signature but not similar enough are compared with all that they collide with, since any of them might link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, components, materialize, mix64, release, sweep

K, T = 64, 36
#: How often nodes are compared with leaders before the rest is compared pair by pair; after the first time only in postings
#: of more than CROWD members, and with AT_ONCE leaders each. This orders comparisons; it leaves none out.
ROUNDS, CROWD, AT_ONCE = 3, 64, 4
#: Keys (eight bytes each) that are broadcast at most, so that the texts that they pick need not be shuffled.
MOST_KEYS = 1_000_000
_rng = np.random.default_rng(20240817)
_XOR, _MUL = _rng.integers(0, 2**63, 256, np.uint64), _rng.integers(0, 2**63, 256, np.uint64) * 2 + 1


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; the whole sequence as one if it is shorter; empty without words."""
    w = hashes.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not len(w):
        return w
    take = min(size, len(w))
    h = np.full(len(w) - take + 1, take, np.uint64)
    for k in range(take):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - take + 1 + k])
    return np.unique(h)


def signature(h: np.ndarray, k: int) -> np.ndarray:
    """k minima of the set under k hash functions, 32 bits each."""
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 2048):
        x = (h[at : at + 2048, None] ^ _XOR[None, :k]) * _MUL[None, :k]
        out = np.minimum(out, (x >> np.uint64(32)).astype(np.uint32).min(0))
    return out.view(np.int32)


def node_of(h: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    import hashlib

    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _sketch(size: int, k: int):
    def run(batches):
        from pyspark import TaskContext

        hashes, row = WordHashes(), TaskContext.get().partitionId() << 33
        for b in batches:
            n, node, sig = [], [], []
            for text in b.column(1):
                h = shingle_set(text.as_py(), size, hashes)
                n.append(len(h))
                node.append(node_of(h) if len(h) else None)
                sig.append(signature(h, k) if len(h) else None)
            rows = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            cols = [rows, b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, *b.columns[2:]], names=["row", "doc_id", "n_shingles", "node", "sig", "own"][: 3 + b.num_columns])

    return run


def _sets(size: int):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            h = [shingle_set(t.as_py(), size, hashes) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x) if len(x) else None for x in h], pa.binary()), pa.array([x.tobytes() for x in h], pa.binary())], names=["node", "hashes"])

    return run


def _linked(inter, size_a, size_b, percent: int):
    """percent: 100 * intersection >= percent * union, in whole numbers."""
    return 100 * inter >= percent * (size_a + size_b - inter)


def _confirm(percent: int):
    """Pairs (a, b, ha, hb) -> those that are linked on their full sets."""

    def run(batches):
        for b in batches:
            x, y, keep = b.column(2), b.column(3), []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                inter = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(bool(_linked(inter, len(p), len(q), percent)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sketched(docs: DataFrame, shingle: int, k: int, own: list | None = None) -> DataFrame:
    """The written sketch: row (a number of its own), doc_id, n_shingles, node, sig and the columns to carry as `own`."""
    more = [] if own is None else [F.struct(*own).alias("own")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    schema = "row long, doc_id long, n_shingles long, node binary, sig array<int>"
    if more:
        schema += f", own {dict(docs.dtypes)['own']}"
    return materialize(docs.mapInArrow(_sketch(shingle, k), schema), "sketch")


def _few(keys: DataFrame) -> DataFrame:
    """Keys of eight bytes, to be broadcast if they have been counted and are at most MOST_KEYS."""
    return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked on their full sets."""
    left, right = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(_confirm(percent), "a long, b long")


def _with_component(nodes: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return nodes.withColumn("comp", F.col("id"))
    return nodes.join(comp.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")


def _told_apart(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """Adds the number of collisions to pairs (a, b)."""
    x, y = active.select(F.col("id").alias("a"), F.col("kvs").alias("x")), active.select(F.col("id").alias("b"), F.col("kvs").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("hits"))


def _led(active: DataFrame, t: int) -> DataFrame:
    """(a, b): each node with the leader that it collides with most, T times at least."""
    each = active.select("id", "central", F.explode("kvs").alias("kv"))
    heads = each.groupBy("kv").agg(F.max(F.struct("central", "id")).alias("h")).select("kv", F.col("h.id").alias("lead"))
    met = each.select("id", "kv").join(heads, "kv").where("id != lead").groupBy("id", "lead").agg(F.count("*").alias("hits"))
    best = met.groupBy("id").agg(F.max(F.struct("hits", "lead")).alias("b")).select(F.col("id").alias("a"), F.col("b.lead").alias("b"))
    return _told_apart(best, active).where(F.col("hits") >= t).select("a", "b")


def _crowded(active: DataFrame, comp: DataFrame | None, tested: DataFrame, t: int, number: int) -> DataFrame:
    """(a, b) for postings of more than CROWD members that are not all in one component: each node outside the posting's
    largest component with the members of it, one drawn from each posting, that it collides with most."""
    each = _with_component(active.select("id", F.explode("kvs").alias("kv")), comp)
    draw = F.max(F.struct(F.xxhash64("id", "kv", F.lit(number)).alias("x"), F.col("id"))).alias("h")
    per = each.groupBy("kv", "comp").agg(F.count("*").alias("c"), draw).groupBy("kv").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp", "h")).alias("m"))
    per = per.where((F.col("all") > CROWD) & (F.col("m.c") < F.col("all"))).select("kv", F.col("m.comp").alias("major"), F.col("m.h.id").alias("lead"))
    met = each.join(per, "kv").where("comp != major").groupBy(F.col("id").alias("a")).agg(F.collect_set("lead").alias("b"), F.count("*").alias("c"))
    met = met.where(F.col("c") >= t).select("a", F.explode("b").alias("b"))
    met = _told_apart(met.join(tested, ["a", "b"], "left_anti"), active).where(F.col("hits") >= t)
    return met.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.col("hits").desc(), "b"))).where(F.col("k") <= AT_ONCE).select("a", "b")


def _pairs(each: DataFrame, key: str, more) -> DataFrame:
    """(a, b) of different components that share a key, without pairs of the key's largest component. each: id, comp, key and
    other columns; more: a condition on columns with the suffixes _x and _y."""
    per = each.groupBy(key, "comp").agg(F.count("*").alias("c")).groupBy(key).agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps"))
    each = each.join(per.where("comps > 1").select(key, F.col("m.comp").alias("major")), key)
    x, y = (side.select(*(F.col(c).alias(f"{c}_{end}") for c in side.columns)) for side, end in ((each.where("comp != major"), "x"), (each, "y")))
    once = (F.col("comp_y") == F.col("major_y")) | (F.col("id_x") < F.col("id_y"))
    return x.join(y.hint("merge"), (F.col(f"{key}_x") == F.col(f"{key}_y")) & (F.col("comp_x") != F.col("comp_y")) & once & more).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))


def _alike(percent: int):
    """What the sizes of linked sets must satisfy."""
    return 100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")


def _across(active: DataFrame, comp: DataFrame | None, percent: int, t: int) -> DataFrame:
    """(a, b): all pairs of different components with T collisions, the rarest in a posting that is no crowd, each once; found
    by their prefixes."""
    small = active.select(F.explode("kvs").alias("kv")).groupBy("kv").agg(F.count("*").alias("c")).where(F.col("c") <= CROWD).select("kv")
    each = active.select("id", "n", "kvs", F.explode(F.slice("kvs", F.lit(1), F.size("kvs") - t + 1)).alias("kv")).join(small, "kv", "left_semi")
    common = F.array_intersect("kvs_x", "kvs_y")
    return _pairs(_with_component(each, comp), "kv", _alike(percent) & (F.size(common) >= t) & (F.get(common, F.lit(0)) == F.col("kv_x")))


def _spread(batches):
    """One row for each shingle of a set."""
    for b in batches:
        sets = [np.frombuffer(x.as_py(), np.int64) for x in b.column(2)]
        n = np.array([len(x) for x in sets], np.int64)
        for s in range(0, len(sets), 64):
            part, rep = n[s : s + 64], np.repeat(np.arange(s, min(s + 64, len(sets))), n[s : s + 64])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rep)), b.column(1).take(pa.array(rep)), pa.array(np.repeat(part, part)), pa.array(np.concatenate(sets[s : s + 64]))], names=["id", "comp", "n", "h"])


def _in_crowds(active: DataFrame, comp: DataFrame | None, sets: DataFrame, percent: int, t: int) -> DataFrame:
    """(a, b): pairs of different components that _across() leaves, those that collide T times in crowds: postings of more than
    CROWD members. So both have T such postings at least.

    A linked pair shares one of the n - ceil(n * percent / 100) + 1 rarest shingles of either set, and after the first that
    it shares, the rest of both sets suffices for the similarity. Shingles that one member has alone come first in this
    order, so members with too many edits of their own have nothing left to be paired by.
    """
    each = _with_component(active.select("id", F.explode("kvs").alias("kv")), comp)
    crowds = each.groupBy("kv").agg(F.count("*").alias("all"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where((F.col("all") > CROWD) & (F.col("lo") < F.col("hi")))
    members = each.join(crowds.select("kv"), "kv", "left_semi").groupBy("id", "comp").agg(F.count("*").alias("c")).where(F.col("c") >= t)
    spread = sets.join(members, "id").select("id", "comp", "hashes").mapInArrow(_spread, "id long, comp long, n long, h long")
    held = spread.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    own = spread.join(held, "h").groupBy("id", "comp").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("ps"))
    left = (F.size("ps") - F.floor((percent * F.col("n") + 99) / 100) + 1).cast("int")
    each = own.where(left > 0).select("id", "comp", "n", F.size("ps").alias("s"), F.posexplode(F.slice("ps", F.lit(1), left)).alias("k", "p"))
    each = each.select("id", "comp", "n", F.col("p.h").alias("h"), (F.col("s") - F.col("k")).alias("left"))  # this one and those after it
    enough = (100 + percent) * F.least("left_x", "left_y") >= percent * (F.col("n_x") + F.col("n_y"))
    return _pairs(each, "h", _alike(percent) & enough).distinct()


def _components_of(sketch: DataFrame, texts: DataFrame, key: str, shingle: int, percent: int, t: int, rounds: int) -> DataFrame:
    """node, first: for each node the struct (anonymous, doc_id, row) of the first row of its component, rows with a doc_id
    before those without; a written table. texts: text by key, a column of the sketch."""
    spark = sketch.sparkSession
    first = F.struct(F.col("doc_id").isNull().alias("anonymous"), F.col("doc_id"), F.col("row"))
    classes = sketch.where("node is not null").groupBy("node").agg(F.min(first).alias("first"), F.min("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("id", F.col("first.row")), "classes")

    # Postings, with the lengths of those that have two nodes or more.
    posted = classes.select("id", "n", F.posexplode("sig").alias("c", "v")).select("id", "n", (F.col("c").cast("long") * F.lit(1 << 32) + F.col("v")).alias("kv"))
    lengths = posted.groupBy("kv").agg(F.count("*").alias("df")).where("df > 1")
    shared = posted.join(lengths, "kv").groupBy("id").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "kv"))).alias("ps")).where(F.size("ps") >= t)
    active = materialize(shared.select("id", "n", F.transform("ps", lambda p: p["kv"]).alias("kvs"), F.aggregate("ps", F.lit(0).cast("long"), lambda s, p: s + p["df"]).alias("central")), "active")
    chosen = materialize(classes.join(active.select("id"), "id", "left_semi").select("id", "node", F.col(f"first.{key}").alias(key)), "chosen")
    del posted, lengths, shared
    sweep(spark)
    read = texts.join(_few(chosen.select(key).distinct()), key, "left_semi").select("text").mapInArrow(_sets(shingle), "node binary, hashes binary")
    sets = materialize(read.where("node is not null").join(chosen.select("node", "id"), "node").dropDuplicates(["id"]).select("id", "hashes"), "sets")
    del read
    sweep(spark)

    links, tested, comp, temporary = None, None, None, [classes, active, chosen, sets]
    for number in range(rounds):
        led = materialize(_crowded(active, comp, tested, t, number) if number else _led(active, t), "led")
        sweep(spark)
        new = materialize(_compared(led, sets, percent), "links")
        temporary += [led, new]
        tested = led if tested is None else tested.union(led)
        if new.isEmpty():
            break
        links = new if links is None else links.union(new)
        comp = components(links)
        temporary.append(comp)
        sweep(spark)
    new = materialize(_compared(_across(active, comp, percent, t), sets, percent), "links")
    sweep(spark)
    more = materialize(_compared(_in_crowds(active, comp, sets, percent, t), sets, percent), "links")
    sweep(spark)
    temporary += [new, more]
    new = new.union(more)
    if not new.isEmpty():
        comp = components(new if links is None else links.union(new))
        temporary.append(comp)
    if comp is None:
        out = classes.select("node", "first")
    else:
        moved = classes.select("id", "first").join(comp.select(F.col("node").alias("id"), "root"), "id")
        least = moved.groupBy("root").agg(F.min("first").alias("least"))
        out = classes.select("node", "id", "first").join(moved.select("id", "root").join(least, "root").select("id", "least"), "id", "left").select("node", F.coalesce("least", "first").alias("first"))
    # Written, so that joins with it read two plain shuffles and Spark can split that of a text with very many copies.
    out = materialize(out, "components")
    release(*temporary)
    sweep(spark)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = K, t: int = T, rounds: int = ROUNDS) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    docs: doc_id long, text string; other columns are ignored. Returns doc_id, n_shingles, component_id (the
    smallest doc_id reachable) and kept, one row per input row. Null and empty texts have no shingles and are
    linked with nothing. Rows with a null doc_id link nothing; they get a null component_id and kept is false.
    Repeated rows are copies of each other; if a doc_id is repeated, each of its rows keeps its own text. An
    empty table gives an empty result.
    """
    sketch = _sketched(docs, shingle, k)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _components_of(sketch.where("doc_id is not null"), texts, "doc_id", shingle, percent, t, rounds)
    out = sketch.select("doc_id", "n_shingles", "node").join(found.select("node", F.col("first.doc_id").alias("component_id")), "node", "left")
    cid = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(cid == F.col("doc_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = K, t: int = T, rounds: int = ROUNDS) -> DataFrame:
    """docs without near copies: of each component its first row stays, with all its columns.

    The first row is that with the smallest doc_id; rows without a doc_id come after all others and are documents like
    them. Rows that repeat a doc_id are judged by their own texts. Rows without shingles (null or empty texts) are no
    copies of each other and stay. An empty table stays empty.
    """
    sketch = _sketched(docs, shingle, k, docs.columns)
    texts = sketch.select("row", F.col("own")["text"].cast("string").alias("text"))
    found = _components_of(sketch.drop("own"), texts, "row", shingle, percent, t, rounds)
    gone = sketch.where("node is not null").select("row", "node").join(found.select("node", F.col("first.row").alias("stays")), "node").where("row != stays").select("row")
    gone = materialize(gone, "gone")
    release(found)
    return sketch.select("row", "own").join(_few(gone), "row", "left_anti").select(*(F.col("own")[c].alias(c) for c in docs.columns))
