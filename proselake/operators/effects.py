"""Ablation experiments: purity of a change, effect sizes of rules, weights and whether the data suffice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast


def purity(before: DataFrame, after: DataFrame, target: DataFrame) -> DataFrame:
    """Of findings counts ``variant, rule, n`` before and after, the drop of each variant's target rule over all drops."""
    both = before.withColumnRenamed("n", "a").join(after.withColumnRenamed("n", "b"), ["variant", "rule"], "full").fillna(0, ["a", "b"])
    own = both.join(target, "variant")
    drop = F.greatest(F.lit(0), F.col("a") - F.col("b"))
    gain = F.greatest(F.lit(0), F.col("b") - F.col("a"))
    out = own.groupBy("variant").agg(
        F.sum(F.when(F.col("rule") == F.col("target"), drop).otherwise(0)).alias("target_drop"),
        F.sum(F.when(F.col("rule") == F.col("target"), 0).otherwise(drop + gain)).alias("collateral"),
    )
    return out.withColumn("purity", F.coalesce(F.try_divide("target_drop", F.col("target_drop") + F.col("collateral")), F.lit(0.0)))


def deltas(scores: DataFrame) -> DataFrame:
    """Each variant's score below its base's: ``detector, base, variant, rule, delta`` of ``detector, base, variant, rule, score, ...``."""
    base = scores.where("variant = 'base'").select("detector", "base", F.col("score").alias("base_score"))
    other = scores.where("variant <> 'base'").join(base, ["detector", "base"])
    return other.withColumn("delta", F.col("base_score") - F.col("score"))


def effect_sizes(delta: DataFrame, least_purity: float = 0.6) -> DataFrame:
    """Mean, sample deviation, number and mean by change of each rule's deltas, impure variants left out, with a verdict."""
    kept = delta.where(F.col("purity") >= least_purity)
    out = kept.groupBy("detector", "rule").agg(
        F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("std"), F.count("*").alias("n"), F.avg(F.when(F.col("n_changes") > 0, F.col("delta") / F.col("n_changes"))).alias("per_change")
    )
    verdict = F.when(F.col("mean") <= 0.5, "none").when(F.col("mean") < 2, "weak").when(F.col("mean") < 5, "effective").otherwise("strong")
    return out.withColumn("verdict", verdict)


def effect_weights(effects: DataFrame) -> DataFrame:
    """Positive means scaled so that a detector's weights sum to the number of its rules, rounded to three places."""
    w = Window.partitionBy("detector")
    good = effects.where("mean > 0")
    return good.select("detector", "rule", F.bround(F.col("mean") / F.sum("mean").over(w) * F.count("*").over(w), 3).alias("weight"))


def sufficiency(delta: DataFrame, least: int = 5, thin: int = 3) -> DataFrame:
    """By detector: bases, all-rule variants, thin rules, and whether weights are final or a draft."""
    rules = delta.where("rule <> 'ALL'").groupBy("detector", "rule").agg(F.count("*").alias("n"))
    per = rules.groupBy("detector").agg(F.count("*").alias("rules"), F.count_if(F.col("n") < thin).alias("thin"))
    bases = delta.groupBy("detector").agg(F.count_distinct("base").alias("bases"), F.count_if(F.col("rule") == "ALL").alias("all_variants"))
    both = bases.join(per, "detector", "left").fillna(0)
    final = (F.col("bases") >= least) & (F.col("all_variants") >= least) & (F.col("thin") * 2 <= F.col("rules"))
    return both.withColumn("status", F.when(final, "final").otherwise("draft"))


def model_bench(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Mean drop, acceptance, lost and new facts and length ratio, tokens and cost of each model, best first."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    per = runs.groupBy("model").agg(mean("drop").alias("drop"), mean("accepted").alias("accept"), mean("lost").alias("lost"), mean("new").alias("new"), mean("ratio").alias("ratio"), F.sum("tokens").alias("tokens"))
    cost = F.col("tokens") * F.col("price_per_million") / 1_000_000
    return per.join(maybe_broadcast(prices), "model", "left").withColumn("cost", cost).orderBy(F.desc("drop"), "model")
