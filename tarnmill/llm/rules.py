"""Quality rules: plain counts and limits, then robust multivariate outliers by minimum covariance determinants.

All of it is DataFrame functions. The counts are made inside a row, so no word is shuffled: windows of eight words are
hashed by doubling (pairs, fours, eights), and only texts that hold a window twice sort them.

For each language and source the centre and scatter of seven transformed statistics are estimated by concentration
steps: each takes the three quarters of the documents that are nearest by Mahalanobis distance and computes their mean
and covariance. There are two starts, medians with quartile ranges and plain moments; of the two results a group takes
that with the smaller determinant. Distances are binned (32 bins per doubling), and a step is one aggregation by group
and bin with a partial sum before the shuffle, so a source with a third of all rows is no hot key. The covariance is
factored by Cholesky in unrolled column expressions. Documents whose distance exceeds a cutoff are rejected; the cutoff
is chi-square's quantile at a tail of `TAIL`.

Groups of all sizes are treated alike: to the moments of a group those of its language are added with the weight of
`POOL[0]` documents, and those of all documents with the weight of `POOL[1]`, so a small group leans on its language.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialize, release, sweep, words

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics in the vector, and the standard deviation that each has at least.
STATS = {"x0": 0.15, "x1": 0.05, "x2": 0.045, "x3": 0.25, "x4": 0.25, "x5": 0.15, "x6": 0.06}
P = len(STATS)
H, STEPS = 0.75, 4
#: The share of normally distributed documents that the cutoff rejects: next to none, since clean texts have heavier tails.
TAIL = 5e-7
#: Documents that the moments of a group's language, and those of all documents, count like.
POOL = (30.0, 10.0)


def chi2_cdf(x: float, df: int) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < p else (lo, mid)
    return lo


def _pairs(a: Column, gap: int) -> Column:
    """Hashes of each element with the one `gap` after it."""
    n = F.greatest(F.size(a) - gap, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + gap), n), lambda x, y: F.xxhash64(x, y))


def base_statistics(docs: DataFrame, extra: bool = False) -> DataFrame:
    """Adds the five base counts to the columns of docs; extra: also n_lines, n_upper and n_distinct."""
    own = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.withColumn("__t", text)
    d = d.withColumn("__h", F.transform(words(F.col("__t")), lambda w: F.xxhash64(w)))
    line = F.filter(F.split(F.col("__t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    left = lambda pattern: F.length(F.regexp_replace(F.col("__t"), pattern, "")).cast("long")
    n = F.size("__h").cast("long")
    cols = {"n_words": n, "word_chars": left(SPACE_CLASS), "n_symbols": left(r"[^#*$%&|<>]+")}
    d = d.withColumns(cols | {"__l": line, "__2": _pairs(F.col("__h"), 1)} | ({"n_upper": left(r"[^A-ZÀ-ÖØ-Þ]+"), "n_distinct": F.size(F.array_distinct("__h")).cast("long")} if extra else {}))
    d = d.withColumns({"n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"), "n_lines": F.size("__l").cast("long"), "__4": _pairs(F.col("__2"), 2)})
    d = d.withColumn("__8", _pairs(F.col("__4"), 4))
    twice = F.size(F.array_distinct("__8")) < F.size("__8")
    d = d.withColumn("__s", F.when(twice, F.array_sort(F.transform("__8", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    m = F.size("__s") - 1
    # Neighbours with the same hash are windows found twice; where they begin, in order.
    both = F.zip_with(F.slice("__s", F.lit(1), m), F.slice("__s", F.lit(2), m), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))
    d = d.withColumn("__p", F.when(F.col("__s").isNotNull(), at))
    reach = F.zip_with("__p", F.slice("__p", F.lit(2), F.size("__p")), lambda a, b: F.coalesce(F.least(F.lit(8), b - a), F.lit(8)))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))
    return d.select(*own, *BASE, *(["n_lines", "n_upper", "n_distinct"] if extra else []))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _statistics() -> dict[str, Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "x0": F.log1p("n_words"),
        "x1": F.log(chars / n),
        "x2": F.sqrt(F.col("n_symbols") / chars),
        "x3": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "x4": F.sqrt(F.col("n_repeat_words") / n),
        "x5": F.log1p("n_words") - F.log1p("n_distinct"),
        "x6": F.sqrt(F.col("n_upper") / chars),
    }


def _entry(i: int, j: int) -> str:
    return f"l{i}{j}"


def _distance(rows: DataFrame) -> Column:
    """The squared Mahalanobis distance by forward substitution with the factor's columns."""
    z: list[Column] = []
    for i in range(P):
        left = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            left = left - F.col(_entry(i, j)) * F.col(f"z{j}")
        rows = rows.withColumn(f"z{i}", left / F.col(_entry(i, i)))
        z.append(F.col(f"z{i}"))
    total = sum((x * x for x in z[1:]), z[0] * z[0])
    return rows.withColumn("d2", total).drop(*(f"z{i}" for i in range(P)))


_SUMS = [f"s{i}" for i in range(P)] + [f"s{i}{j}" for i in range(P) for j in range(i + 1)]


def _pooled(moments: DataFrame, pool: tuple[float, float]) -> DataFrame:
    """Adds the mean moments of the group's language and of all groups, with the weights of `pool`. moments: a written table,
    since it is read three times; the plan behind it would stand three times in this one."""
    if not any(pool):
        return moments
    mean = lambda c, name: (F.sum(c) / F.sum("n")).alias(f"{name}_{c}")
    own = moments.withColumn("g", F.col("key.lang"))
    langs, every = own.groupBy("g", "start").agg(*(mean(c, "l") for c in _SUMS)), own.groupBy("start").agg(*(mean(c, "a") for c in _SUMS))
    out = own.join(langs, ["g", "start"]).join(F.broadcast(every), "start")  # one row for each start
    more = {c: F.col(c) + pool[0] * F.col(f"l_{c}") + pool[1] * F.col(f"a_{c}") for c in _SUMS}
    return out.withColumns(more).withColumn("n", F.col("n") + sum(pool)).select(*moments.columns)


def _factor(moments: DataFrame, scale: float) -> DataFrame:
    """key, n, means and the Cholesky factor of scale * covariance plus the floors, from sums of products."""
    m = moments.select("key", "start", "n", "size", *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)), *(f"s{i}{j}" for i in range(P) for j in range(i + 1)))
    floors = [v * v for v in STATS.values()]
    for i in range(P):
        for j in range(i + 1):
            c = scale * (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
            for k in range(j):
                c = c - F.col(_entry(i, k)) * F.col(_entry(j, k))
            c = F.sqrt(F.greatest(c, F.lit(0.0)) + floors[i]) if i == j else c / F.col(_entry(j, j))
            m = m.withColumn(_entry(i, j), c)
    return m.select("key", "start", "size", *(f"m{i}" for i in range(P)), *(_entry(i, j) for i in range(P) for j in range(i + 1)))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each group from histograms of the statistics; as means and a diagonal factor."""
    stat = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(f"x{i}") * 128).cast("int").alias("bin")) for i in range(P))))
    bins = materialize(rows.select("key", stat.alias("s")).groupBy("key", "s.i", "s.bin").agg(F.count("*").alias("n")), "rule-bins")
    w = Window.partitionBy("key", "i")
    bins = bins.withColumn("below", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("below") >= q * F.col("all"), (F.col("bin") + 0.5) / 128))
    q = bins.groupBy("key", "i").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"), F.max("all").alias("size"))
    of = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    g = q.groupBy("key").agg(F.max("size").alias("size"), *(of("mid", i).alias(f"m{i}") for i in range(P)), *(of("lo", i).alias(f"q{i}") for i in range(P)), *(of("hi", i).alias(f"r{i}") for i in range(P)))
    floors = list(STATS.values())
    diag = lambda i: F.sqrt(((F.col(f"r{i}") - F.col(f"q{i}")) / 1.349) ** 2 + floors[i] ** 2)
    return g.select("key", F.lit(0).alias("start"), "size", *(f"m{i}" for i in range(P)), *((diag(i) if i == j else F.lit(0.0)).alias(_entry(i, j)) for i in range(P) for j in range(i + 1)))


def _products() -> list[Column]:
    return [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)]


def _moments(rows: DataFrame, pool: tuple[float, float] = POOL) -> DataFrame:
    """Plain means and covariances of each group."""
    sums = rows.groupBy("key").agg(F.count("*").cast("double").alias("n"), F.count("*").alias("size"), *_products())
    return _factor(_pooled(materialize(sums.withColumn("start", F.lit(1)), "rule-moments"), pool), 1.0)


def _concentrate(rows: DataFrame, fit: DataFrame, share: float, scale: float, pool: tuple[float, float] = POOL) -> DataFrame:
    """One concentration step of all starts: the moments of the nearest `share` of each group."""
    near = _distance(rows.join(fit.drop("size"), "key")).withColumn("bin", F.floor(32 * F.log2(F.col("d2") + 1e-6)).cast("int"))
    # Written, so that the sums are dealt out by group and bin: a window over groups would pull their shuffle to the group.
    bins = materialize(near.groupBy("key", "start", "bin").agg(F.count("*").alias("n"), *_products()), "rule-bins")
    w = Window.partitionBy("key", "start")
    bins = bins.withColumn("before", F.sum("n").over(w.orderBy("bin")) - F.col("n")).withColumn("size", F.sum("n").over(w))
    kept = bins.where(F.col("before") < share * F.col("size")).groupBy("key", "start").agg(F.sum("n").cast("double").alias("n"), F.max("size").alias("size"), *(F.sum(c).alias(c) for c in _SUMS))
    return _factor(_pooled(materialize(kept, "rule-moments"), pool), scale)


def _smallest(fits: DataFrame) -> DataFrame:
    """For each group that of its fits with the smallest determinant."""
    log = sum((F.log(_entry(i, i)) for i in range(1, P)), F.log(_entry(0, 0)))
    names = [c for c in fits.columns if c != "key"]
    best = fits.select("key", F.struct(F.round(log, 9).alias("d"), *names).alias("f")).groupBy("key").agg(F.min("f").alias("f"))
    return best.select("key", *(F.col(f"f.{c}").alias(c) for c in names if c != "start"))


def judge(docs: DataFrame, tail: float = TAIL, steps: int = STEPS, pool: tuple[float, float] = POOL, carry: list[str] | None = None) -> DataFrame:
    """The base counts, base_failed, the squared distance and kept for every document.

    docs: doc_id long, text string, lang string, source string; other columns are ignored unless carried. Returns
    doc_id (or the columns to carry), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    distance and kept. Null and empty texts have no words, no distance, and fail. Null languages and sources are groups
    of their own. Repeated rows are judged alike and count as often as they occur; null doc_ids change nothing. An empty
    table gives an empty result.
    """
    carry = carry or ["doc_id"]
    key = F.struct(F.concat(F.lit("l"), F.col("lang").cast("string")).alias("lang"), F.concat(F.lit("s"), F.col("source").cast("string")).alias("source"))
    key = F.struct(F.coalesce(key["lang"], F.lit("-")).alias("lang"), F.coalesce(key["source"], F.lit("-")).alias("source"))
    view = docs.select(*(F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)), F.col("text"), key.alias("key"))
    counted = base_statistics(view, extra=True)
    keep = [f"__c{k}" for k in range(len(carry))]
    stats = materialize(counted.withColumns(_statistics()).select(*keep, "key", *BASE, *STATS), "rule-statistics")
    sweep(docs.sparkSession)
    numbers = stats.where("n_words > 0").select("key", *STATS)
    # Group tables are written as few files, or their footers alone would make them look too large for a broadcast.
    files = max(1, -(-numbers.select("key").distinct().count() // 10_000))
    q = chi2_quantile(H, P)
    scale = H / chi2_cdf(q, P + 2)
    fit = materialize(_start(numbers).union(_moments(numbers, pool)).repartition(files), "rule-fit")
    for _ in range(steps):
        nxt = materialize(_concentrate(numbers, fit, H, scale, pool).repartition(files), "rule-fit")
        release(fit)
        fit = nxt
        sweep(docs.sparkSession)
    best = materialize(_smallest(fit).repartition(files), "rule-fit")
    release(fit)
    sweep(docs.sparkSession)
    out = _distance(stats.join(best, "key", "left"))
    bad, far = base_failed(), F.col("d2") > chi2_quantile(1 - tail, P)
    final = out.withColumn("base_failed", bad).withColumn("kept", ~bad & ~F.coalesce(far, F.lit(False)))
    return final.select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(carry)), *BASE, "base_failed", F.when(F.col("n_words") > 0, F.col("d2")).alias("distance"), "kept")
