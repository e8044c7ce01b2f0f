"""Assignments of tokens to experts: load, shares, balance, confidence-aware refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import top_k


def assignments(rows: DataFrame, probabilities: str, k: int) -> DataFrame:
    """One row per token and chosen expert, with the expert's probability."""
    return rows.withColumn("expert", F.explode(top_k(F.col(probabilities), k))).withColumn("probability", F.element_at(F.col(probabilities), F.col("expert") + 1))


def load_stats(counts: DataFrame, layer: str, expert: str, n_experts: int) -> DataFrame:
    """cv, entropy, effective and observed experts per layer; experts without a call count as zeros.

    The zeros are added by arithmetic: over n experts the mean is sum / n and the population variance sum of squares
    over n less its square.
    """
    one = counts.groupBy(layer, expert).agg(F.sum("calls").cast("double").alias("c")).where("c > 0")
    t = one.groupBy(layer).agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("q"), F.sum(F.col("c") * F.log("c")).alias("l"), F.count("*").alias("observed"))
    mean = F.col("t") / n_experts
    h = F.log("t") - F.col("l") / F.col("t")
    return t.select(layer, (F.sqrt(F.greatest(F.col("q") / n_experts - mean * mean, F.lit(0.0))) / mean).alias("cv"), h.alias("entropy"), F.exp(h).alias("effective"), "observed")


def usage_shares(counts: DataFrame, layer: str, expert: str, top: int) -> DataFrame:
    """Each expert's share of its layer's calls, and of its tokens (calls / top)."""
    one = counts.groupBy(layer, expert).agg(F.sum("calls").alias("calls"))
    total = one.groupBy(layer).agg(F.sum("calls").alias("all"))
    d = one.join(total, layer)
    return d.select(layer, expert, "calls", (F.col("calls") / F.col("all")).alias("share"), (F.col("calls") * top / F.col("all")).alias("token_share"))


def new_share(counts: DataFrame, layer: str, expert: str, old: int) -> DataFrame:
    """Mean over layers of the share of calls that go to experts numbered `old` or more."""
    per = counts.groupBy(layer).agg((F.sum(F.when(F.col(expert) >= old, F.col("calls")).otherwise(0)) / F.sum("calls")).alias("share"))
    return per.agg(F.avg("share").alias("new_assignment_share"))


def balance(assigned: DataFrame, layer: str, expert: str, probability: DataFrame, n_experts: int) -> DataFrame:
    """n * sum over experts of (share of assignments) * (mean probability), per layer; uniform routing gives 1.

    probability: layer, expert, mean_probability.
    """
    shares = usage_shares(assigned.groupBy(layer, expert).agg(F.count("*").alias("calls")), layer, expert, 1)
    return shares.join(probability, [layer, expert]).groupBy(layer).agg((n_experts * F.sum(F.col("share") * F.col("mean_probability"))).alias("balance"))


def draw(seed: int, key: Column, slot: int, which: int) -> Column:
    """A number in [0, 1) with 52 bits that depends on its arguments only, by a digest."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(f"{slot}:{which}")), 256)
    return F.conv(F.left(digest, F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def refine(rows: DataFrame, clusters: list[int], tau: float, exploration: float, seed: int, slots: int, key: str = "token", probabilities: str = "p", selected: str = "selected") -> DataFrame:
    """key, refined: confidence-aware refinement of the experts of a token, slot by slot.

    A slot is unsure if its expert's share of its cluster's probability leads the largest other share there by less than tau. An
    unsure slot is drawn anew with the probability `exploration`, in proportion to the probabilities, among the experts of its
    cluster that no other slot holds; so experts stay distinct and slots keep their clusters. A cluster whose free experts have no
    probability keeps the expert. Draws are those of draw(), 0 for the expert and 1 for whether to explore.

    A token is a row for each expert while it is refined; all windows are over a token, so rows are dealt out once.
    """
    labels = F.array(*(F.lit(c) for c in clusters))
    d = rows.select(key, F.col(selected).cast("array<int>").alias("__s"), F.posexplode(F.col(probabilities).cast("array<double>")).alias("__i", "__p"))
    d = d.withColumn("__c", F.get(labels, F.col("__i")))
    token = Window.partitionBy(key)
    upto = token.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    for slot in range(slots if exploration > 0 else 0):
        d = d.withColumn("__e", F.get("__s", F.lit(slot)))
        d = d.withColumn("__q", F.when(F.col("__c") == F.get(labels, F.col("__e")), F.col("__p")).otherwise(0.0))
        own = F.col("__i") == F.col("__e")
        d = d.withColumn("__w", F.when(own | ~F.array_contains("__s", F.col("__i")), F.col("__q")).otherwise(0.0))
        lead = F.max(F.when(own, F.col("__q"))).over(token) - F.coalesce(F.max(F.when(~own, F.col("__q"))).over(token), F.lit(0.0))
        d = d.withColumn("__unsure", lead / F.greatest(F.sum("__q").over(token), F.lit(1e-300)) < tau)
        d = d.withColumn("__goal", draw(seed, F.col(key), slot, 0) * F.sum("__w").over(token)).withColumn("__upto", F.sum("__w").over(upto))
        d = d.withColumn("__drawn", F.min(F.when(F.col("__upto") > F.col("__goal"), F.col("__i"))).over(token))
        change = F.col("__unsure") & (draw(seed, F.col(key), slot, 1) < exploration) & F.col("__drawn").isNotNull()
        d = d.withColumn("__s", F.when(change, F.transform("__s", lambda x, i: F.when(i == slot, F.col("__drawn")).otherwise(x))).otherwise(F.col("__s")))
    return d.where("__i = 0").select(key, F.col("__s").alias("refined"))
