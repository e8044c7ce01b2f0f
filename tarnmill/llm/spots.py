r"""Document fingerprints by spot signatures.

Words are lower-cased and free of punctuation. Common words are anchors, all others content. An anchor and the CHAIN content
words that follow it (anchors between them are passed over) form a signature; of adjacent anchors the last one counts, and the
start of a text is an anchor too. A document's fingerprint is the set of its signatures, so it holds what a text says and little
of what surrounds it (menus and notices have few common words).

Two sets are compared by pruned Jaccard: sizes too far apart settle a pair before the sets are looked at. similar() compares
all documents: sets are partitioned by length, so that a set meets only its own and the next partition, and within them through
the rarest of its signatures. Everything is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# Frequent function words of four languages, the anchors.
ENGLISH = "a an the of to in on at by for from with as is are was were be been it its this that these and or but not has had he she they his her their which"
GERMAN = "der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war im von zu mit sich auf für als auch bei nach aus er sie es wie"
FRENCH = "le la les un une de du et ou mais ne pas est sont dans sur par pour avec que qui au aux ce cette ces il elle se sa son"
SPANISH = "el los las una unos del y o pero no es son en por para con que al su sus lo como más este esta"
ANCHORS = sorted({*ENGLISH.split(), *GERMAN.split(), *FRENCH.split(), *SPANISH.split()})

CHAIN = 2
#: Hexadecimal digits of a signature.
DIGITS = 12
MARK, TOP = "\x01", "^"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
LOWER = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
#: What separates words: all of ASCII but letters and digits, and the punctuation of Latin-1, of most scripts and of East Asia.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xBF -⁯　-〿]+"


def with_signatures(df: DataFrame, text: str, out: str, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Adds the sorted set of the signatures of a text that is not null. The last chains may be shorter. A text without content
    words has one signature, of its words or else of itself; an empty one has none.

    Each step is a column of its own that the next ones name twice or more, so that Spark evaluates it once.
    """
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda w: w != "")
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(anchors), F.concat(w, F.lit(MARK))).otherwise(F.concat(w, F.lit(" ")))), "")
    d = df.withColumn("__marked", marked)
    d = d.withColumn("__content", F.split(F.concat(F.lit(TOP + MARK), "__marked"), " "))  # each content word behind the anchors before it
    d = d.withColumn("__plain", F.transform("__content", lambda x: F.substring_index(x, MARK, -1)))
    zipped = F.arrays_zip(F.col("__content").alias("w0"), *[F.slice("__plain", F.lit(1 + k), F.size("__plain")).alias(f"w{k}") for k in range(1, chain)])
    spots = F.filter(zipped, lambda x: F.contains(x["w0"], F.lit(MARK)) & ~F.endswith(x["w0"], F.lit(MARK)))
    d = d.withColumn("__found", F.transform(spots, lambda x: F.left(F.md5(F.rtrim(F.concat_ws(" ", F.substring_index(x["w0"], MARK, -2), *[x[f"w{k}"] for k in range(1, chain)]))), F.lit(DIGITS))))
    rest = F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.array(F.left(F.md5(F.when(F.col("__marked") == "", F.col(text)).otherwise(F.col("__marked"))), F.lit(DIGITS))))
    return d.withColumn(out, F.when(F.size("__found") > 0, F.sort_array(F.array_distinct("__found"))).otherwise(rest)).drop("__marked", "__content", "__plain", "__found")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """The Jaccard coefficient of two sets; 0 without a look at the sets if their sizes alone keep it below the least wanted. Two
    empty sets are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(large == 0, 1.0).when((small == 0) | (small < least * large), 0.0).when(a == b, 1.0).otherwise(common / (small + large - common))


def length_partition(n: Column, least: float) -> Column:
    """Sets whose sizes allow a likeness of least lie in one partition or in neighbouring ones."""
    return F.floor(F.log(n) / math.log(1 / least) + 1e-9).cast("int")


def similar(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """All links of at least that likeness: doc_id, fingerprint, class_id, n_links.

    Documents with equal fingerprints are a class, named by its smallest doc_id and compared once; n_links counts the other
    documents linked to one, those of its class included. A null text is empty; documents without signatures are linked with
    nothing and have class_id null. Rows that repeat a doc_id count as documents of their own. A set meets others through the
    rarest of its signatures, as many as it can lack and still be alike; those are counted over all sets.
    """
    per_row = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "s").select("doc_id", F.array_join("s", "").alias("fingerprint"), "s")
    per_row = materialize(per_row, "spot-sets")
    classes = per_row.where(F.size("s") > 0).groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"), F.first("s").alias("s"))
    classes = materialize(classes.withColumn("key", F.md5("fingerprint")), "spot-classes")
    posts = classes.select("key", F.size("s").alias("n"), F.explode("s").alias("sig"))
    often = posts.groupBy("sig").agg(F.count("*").alias("often")).where("often > 1")
    # A signature that one set alone has links nothing, but it takes its place in the order.
    ranked = posts.join(often, "sig").select("key", "n", "sig", "often").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("often", "sig"))).alias("o"))
    lone = F.col("n") - F.size("o")
    reach = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int") + 1 - lone
    prefix = ranked.where(reach > 0).select("key", "n", length_partition(F.col("n"), least).alias("part"), F.explode(F.slice("o", F.lit(1), F.greatest(reach, F.lit(1)))).alias("x")).select("key", "n", "part", "x.sig")
    left = prefix.select(F.col("key").alias("a"), F.col("n").alias("an"), F.col("part").alias("a_part"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    met = left.join(prefix.select(F.col("key").alias("b"), F.col("n").alias("bn"), "sig", "part"), ["sig", "part"])
    once = (F.col("a_part") < F.col("part")) | (F.col("a") < F.col("b"))
    fits = F.least("an", "bn") >= F.lit(least) * F.greatest("an", "bn") - 1e-9
    pairs = met.where((F.col("a") != F.col("b")) & once & fits).select("a", "b").distinct()
    sets = classes.select("key", "s", "members")
    looked = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa"), F.col("members").alias("ma")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb"), F.col("members").alias("mb")), "b")
    links = looked.where(likeness(F.col("sa"), F.col("sb"), least - 1e-9) >= least)
    other = links.select(F.col("a").alias("key"), F.col("mb").alias("m")).union(links.select("b", "ma")).groupBy("key").agg(F.sum("m").alias("others"))
    counted = classes.join(other, "key", "left").select("fingerprint", "class_id", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return per_row.select("doc_id", "fingerprint").join(counted, "fingerprint", "left").select("doc_id", "fingerprint", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _ordered(docs: DataFrame) -> DataFrame:
    """Documents with `chunk`, a range of the order by descending doc_id (nulls last; equal ones by their text), and `guard`. The
    first row of each chunk stands behind the chunk before as well, as its guard, and the first of all behind the last; so
    each row finds its next one in its chunk. What the driver learns is the first key of each chunk."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The order as that of strings: nulls last, then falling doc_id, then the hash.
    falling = F.bitwise_not(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    key = F.concat(F.when(F.col("doc_id").isNull(), "1").otherwise("0"), F.lpad(F.hex(F.coalesce(falling, F.lit(0))), 16, "0"), F.lpad(F.hex(F.xxhash64("text")), 16, "0"))
    rows = rows.withColumn("k", key)
    pieces = 3 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # several to a task, so that tasks are alike
    firsts = rows.select("k").repartitionByRange(pieces, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    bounds = [r["k"] for r in firsts.orderBy("k").collect()]
    if not bounds:
        return rows.withColumns({"chunk": F.lit(0), "guard": F.lit(False)})
    # A row is compared with the first key of each run of about sqrt(pieces) ranges, then with those of its run.
    width = math.isqrt(len(bounds)) + 1
    runs = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads, inner = F.split(F.lit(",".join(r[0] for r in runs)), ","), F.split(F.lit("|".join(",".join(r) for r in runs)), "\\|")
    rows = rows.withColumn("run", F.size(F.filter(heads, lambda b: b <= F.col("k"))))  # from 1
    rows = rows.withColumn("own", F.split(F.element_at(inner, F.col("run")), ","))
    rows = rows.withColumns({"chunk": (F.col("run") - 1) * width + F.size(F.filter("own", lambda b: b <= F.col("k"))), "first": F.array_contains("own", F.col("k"))})
    before = F.when(F.col("chunk") == 1, len(bounds)).otherwise(F.col("chunk") - 1)
    own = F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("guard"))
    places = F.when(F.col("first"), F.array(own, F.struct(before.alias("chunk"), F.lit(True).alias("guard")))).otherwise(F.array(own))
    return rows.select("doc_id", "text", "k", F.explode(places).alias("place")).select("doc_id", "text", "k", "place.chunk", "place.guard")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures.

    docs: doc_id long, text string; other columns are ignored. The edited text has its last third (rounded down, in code points) replaced by
    as many code points from the start of the next document's text, or all of them if that is shorter. Next is the row
    behind in the order by descending doc_id; rows without a doc_id come last, rows with equal ones are ordered by a hash of their
    text, then by the text; the first row is next to the last. A null text is empty. A single document is its own next one. An
    empty table gives no row.
    """
    parts = with_signatures(_ordered(docs).repartition("chunk"), "text", "s")
    w = Window.partitionBy("chunk").orderBy("guard", "k", "text")
    seen = parts.withColumns({"next_text": F.lead("text").over(w), "next_s": F.lead("s").over(w)}).where("NOT guard")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = seen.withColumn("edited", F.concat(F.left(F.col("text"), n - third), F.left(F.col("next_text"), third)))
    edited = with_signatures(edited, "edited", "e")
    return edited.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.array_join("s", "").alias("fingerprint"), F.array_join("e", "").alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"), F.size("s").cast("long").alias("n_signatures"),
    )


#: The same columns for the table `documents`.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (
  SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST)) AS next_text,
    coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC NULLS LAST), first_value(doc_id) OVER (ORDER BY doc_id DESC NULLS LAST)) AS next_id FROM d),
e AS (SELECT *, concat(left(text, n - n // 3), left(next_text, n // 3)) AS edited FROM o),
sides AS (SELECT doc_id, 's' AS side, text FROM e UNION ALL SELECT doc_id, 'e', edited FROM e),
cut AS (
  SELECT doc_id, side, text, list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda w: w <> '') AS ws FROM sides),
words AS (SELECT doc_id, side, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, ws FROM cut),
content AS (
  SELECT doc_id, side, w, CASE WHEN i = 1 THEN '{TOP}' ELSE ws[i - 1] END AS before, i, lead(w) OVER (PARTITION BY doc_id, side ORDER BY i) AS after
  FROM words WHERE w NOT IN ({", ".join(repr(a) for a in ANCHORS)})),
spots AS (
  SELECT doc_id, side, left(md5(rtrim(concat(before, chr(1), w, ' ', coalesce(after, '')))), {DIGITS}) AS sig
  FROM content WHERE i = 1 OR before IN ({", ".join(repr(a) for a in ANCHORS)})),
grouped AS (SELECT doc_id, side, list_sort(list_distinct(list(sig))) AS s FROM spots GROUP BY doc_id, side),
sets AS (
  SELECT cut.doc_id, cut.side, CASE WHEN s IS NOT NULL THEN s WHEN text = '' THEN []
    ELSE [left(md5(CASE WHEN len(ws) = 0 THEN text ELSE array_to_string(list_transform(ws, lambda w: w || chr(1)), '') END), {DIGITS})] END AS s
  FROM cut LEFT JOIN grouped ON grouped.doc_id = cut.doc_id AND grouped.side = cut.side),
wide AS (
  SELECT e.doc_id, e.n, e.edited, a.s AS s, b.s AS t, c.s AS o, len(list_intersect(a.s, b.s)) AS ab, len(list_intersect(a.s, c.s)) AS ac
  FROM e JOIN sets a ON a.doc_id = e.doc_id AND a.side = 's' JOIN sets b ON b.doc_id = e.doc_id AND b.side = 'e' JOIN sets c ON c.doc_id = e.next_id AND c.side = 's')
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s, '') AS fingerprint, array_to_string(t, '') AS edited_fingerprint,
  CASE WHEN len(s) + len(t) = 0 THEN 1.0::DOUBLE ELSE ab::DOUBLE / (len(s) + len(t) - ab) END AS near_edited,
  CASE WHEN len(s) + len(o) = 0 THEN 1.0::DOUBLE ELSE ac::DOUBLE / (len(s) + len(o) - ac) END AS near_next, len(s)::BIGINT AS n_signatures
FROM wide
"""
