r"""Grouping of spelling variants by an errata trie, merged along heavy paths.

The trie of all words is a table: its nodes are prefixes (their 64-bit hashes), its edges the characters that follow, its
sizes counts of words. At each node the child with most words is heavy, all others are light; a word that ends there is light
too. Each light subtree is merged into the heavy one with one character changed:

    replaced   prefix + a + rest   ->   prefix + h + rest      (h: the heavy child's character)
    skipped    prefix + a + rest   ->   prefix + rest
    skipped    prefix + a + rest   ->   prefix + h + a + rest  (of the heavy side: its h is left out)

Two words that part at a node differ by one edit exactly if they coincide at a terminal of its merged trie: a changed light
word with a word of the trie, or two light words that are replaced at the same place. Since a light child has at most half of its
parent's words, a word is changed at log2(words) places at most, whatever its length. All of this is joins and
counts; only the hashes of prefixes are computed in numpy, in time linear in a word's length.

That a node's character h is the heavy one only bounds the work: the pairs are complete for any choice, so hashes of prefixes that
collide do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, mix64, release

RUN = r"[A-Za-zÀ-ÿ]+"
#: Code points whose prefixes are hashed at a time, at least one word's.
CHUNK = 1 << 19
END = -1
STEP = "h1 long, h2 long, node long, at int, ch int"
#: Nodes of depth 0 and 1 hold much of all words and are few: one, and one for each letter of the alphabet of RUN.
SHALLOW = 1


def damaged_words(docs: DataFrame) -> DataFrame:
    """Every run of letters of whole texts, lower-cased, one in 97 with a code point missing; null texts have none, a null
    doc_id is an empty string."""
    runs = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0)))
    r = docs.select("doc_id", runs.alias("run")).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.translate("run", UPPER, LOWER).alias("run"))
    r = r.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run"))).withColumn("k", (F.col("h") % F.length("run")).cast("int"))
    cut = F.concat(F.expr("left(run, k)"), F.expr("substring(run, k + 2)"))
    return r.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, letters: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix of each word, with what follows it. The hash of a prefix is a sum over its characters, so all
    prefixes of all words are one running sum."""
    names = [f.split()[0] for f in STEP.split(", ")]
    for batch in batches:
        words, ids = batch.column("word").to_pylist(), [batch.column(c).to_numpy() for c in ("h1", "h2")]
        sizes = np.array([len(w) for w in words], np.int64)
        upto = np.cumsum(sizes)
        a = 0
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK, "right")))
            n = sizes[a:b] + 1
            starts = np.cumsum(n) - n
            ch = np.full(n.sum(), END, np.int32)
            inside = np.ones(len(ch), bool)
            inside[starts + n - 1] = False
            ch[inside] = np.frombuffer("".join(words[a:b]).encode("utf-32-le"), np.int32)
            at = np.arange(len(ch)) - np.repeat(starts, n)
            power = np.cumprod(np.append([1], np.full(n.max(), 0x9E3779B97F4A7C15)).astype(np.uint64), dtype=np.uint64)
            term = np.where(inside, mix64(ch.astype(np.uint64) + np.uint64(0xC2B2AE3D27D4EB4F)) * power[at], np.uint64(0))
            before = np.append([np.uint64(0)], np.cumsum(term, dtype=np.uint64)[:-1])
            node = mix64(before - np.repeat(before[starts], n) + at.astype(np.uint64)).view(np.int64)
            columns = [np.repeat(ids[0][a:b], n), np.repeat(ids[1][a:b], n), node, at.astype(np.int32), ch]
            for x in range(0, len(ch), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(c[x : x + CHUNK]) for c in columns], names)
            a = b


def _light(words: DataFrame) -> DataFrame:
    """(word, n, at, a, h): the places where a word lies in a light subtree; a is null where it ends."""
    ids = words.select("word", F.xxhash64("word").alias("h1"), F.xxhash64(F.lit(1), "word").alias("h2"))
    steps = ids.mapInArrow(_prefixes, STEP)
    edges = steps.groupBy("node", "ch").agg(F.count("*").alias("size"), F.min("at").alias("at"))
    heaviest = F.max_by(F.when(F.col("ch") != END, F.col("ch")), F.when(F.col("ch") != END, F.struct("size", -F.col("ch"))))
    heavy = edges.groupBy("node").agg(F.count("*").alias("children"), heaviest.alias("h"), F.min("at").alias("depth")).where("children > 1")
    heavy = materialize(heavy.select("node", "h", "depth"), "errata-heavy")
    # The shallow nodes are as few as the alphabet has letters, but each of them has many words.
    near_root = steps.where(F.col("at") <= SHALLOW).join(F.broadcast(heavy.where(F.col("depth") <= SHALLOW).select("node", "h")), "node")
    deeper = steps.where(F.col("at") > SHALLOW).join(heavy.select("node", "h"), "node")
    light = near_root.union(deeper.select(near_root.columns)).where("ch <> h").select("h1", "h2", "at", F.chr(F.col("h").cast("long")).alias("h"))
    known = words.select("word", "n", F.xxhash64("word").alias("h1"), F.xxhash64(F.lit(1), "word").alias("h2"))
    return light.join(known, ["h1", "h2"]).select("word", "n", "at", "h")


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of words that differ by one inserted, deleted or replaced code point, once: a, a_n, b, b_n.

    words: word string, n long; each word once and not null. An empty table gives no pair.
    """
    light = materialize(_light(words), "errata-light")
    head, tail, rest = F.expr("left(word, at)"), F.expr("substring(word, at + 2)"), F.expr("substring(word, at + 1)")
    # The last words of a word's light places end there, the others go on.
    here = light.withColumn("goes_on", F.length("word") > F.col("at"))
    replaced = here.where("goes_on").select("word", "n", "at", F.concat(head, F.col("h"), tail).alias("m"))
    skipped = here.where("goes_on AND substring(word, at + 1, 1) <> substring(word, at + 2, 1)").select("word", "n", F.concat(head, tail).alias("m"))
    widened = here.select("word", "n", F.concat(head, F.col("h"), rest).alias("m"))
    merged = replaced.select("word", "n", "m").union(skipped).union(widened)
    met = merged.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), F.col("m") == F.col("b")).select(F.col("word").alias("a"), F.col("n").alias("a_n"), "b", "b_n")
    # Light words that are replaced at one place: no more than the alphabet has letters.
    group = replaced.groupBy("m", "at").agg(F.collect_list(F.struct("word", "n")).alias("g")).where(F.size("g") > 1)
    one = group.select("g", F.explode("g").alias("x")).select("x", F.explode(F.expr("filter(g, y -> y.word > x.word)")).alias("y"))
    return met.union(one.select("x.word", "x.n", "y.word", "y.n"))


def group_variants(words: DataFrame) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    form: the near word of largest n (ties: the first in code-point order) if it occurs at least twice as often, else null;
    root: where forms lead in the end. As n doubles from form to form, a chain has at most 63 of them and six rounds of
    pointer doubling reach its end.
    """
    words = materialize(words.select("word", "n"), "variant-words")
    pairs = materialize(near_pairs(words), "variant-pairs")
    both = pairs.union(pairs.select("b", "b_n", "a", "a_n"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left").withColumn("taken", -F.col("best.less") >= 2 * F.col("n"))
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("taken"), F.col("best.form")).alias("form"), F.when(F.col("taken"), -F.col("best.less")).alias("form_n"))
    formed = materialize(formed, "variant-forms")
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        roots = materialize(roots, "variant-roots")
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(ahead, "root", "left_semi").isEmpty():
            break
        roots = roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    release(pairs)
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """group_variants() of the damaged words of documents (doc_id, text; other columns are ignored). An empty table gives no row."""
    return group_variants(vocabulary(damaged_words(docs))).select("word", "form", "root", "n", "n_near", "form_n")


#: The same columns: every word less each of its characters, joined.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS steps),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS bs FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(bs, lambda h, b: xor(h >> 8, steps[(xor(h, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN concat(left(run, (h % length(run))::INTEGER), substr(run, (h % length(run))::INTEGER + 2)) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gone AS (SELECT word, i, concat(left(word, i::INTEGER - 1), substr(word, i::INTEGER + 1)) AS part FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word AS a, b.word AS b FROM gone a JOIN gone b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT gone.word, w.word FROM gone JOIN w ON w.word = part
  UNION SELECT w.word, gone.word FROM gone JOIN w ON w.word = part),
best AS (
  SELECT a AS word, count(*) AS n_near, max(n) AS best_n, arg_min(b, (-n, b)) AS best FROM near JOIN w ON w.word = near.b GROUP BY a),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
