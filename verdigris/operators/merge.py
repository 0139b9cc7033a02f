"""Merging predictions of several scorers and reviewers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E


def last_per_key(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The last row per key wins."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def first_per_key(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """U4: the first row per key wins."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(F.asc(order))
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every left row must have its match; a missing one fails the job, naming the key."""
    marked = left.join(right.withColumn("hit_", F.lit(True)), key, "left")
    guard = F.when(F.col("hit_"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string"))).cast("boolean"))
    return marked.withColumn("hit_", guard).where("hit_").drop("hit_")


def join_with_position_fallback(preds: DataFrame, samples: DataFrame, key: str = "Index", position: str = "pos", value: str = "code") -> DataFrame:
    """Match by key, else by row position, else unmatched; `matched_by` tells which."""
    by_key = samples.select(F.col(key), F.col(value).alias("v_key"))
    by_pos = samples.select(F.col(position), F.col(value).alias("v_pos"))
    out = preds.join(by_key, key, "left").join(by_pos, position, "left")
    how = F.when(F.col("v_key").isNotNull(), "index").when(F.col("v_pos").isNotNull(), "position").otherwise("unmatched")
    return out.withColumn(value, F.coalesce("v_key", "v_pos")).withColumn("matched_by", how).drop("v_key", "v_pos")


def with_defaults(samples: DataFrame, results: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join; missing results take the defaults."""
    out = samples.join(results, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def override(small: DataFrame, review: DataFrame, key: str = "Index", review_pred: str = "ReviewPrediction") -> DataFrame:
    """A valid review (0 or 1) replaces a positive call; reviews of negatives are ignored."""
    out = small.join(review, key, "left")
    valid = F.trim(F.col(review_pred).cast("string")).isin("0", "1")
    r = F.when(valid, F.col(review_pred).cast("int"))
    return (
        out.withColumnRenamed("Prediction", "OriginalPrediction")
        .withColumn("FinalPrediction", F.when((F.col("OriginalPrediction") == 1) & r.isNotNull(), r).otherwise(F.col("OriginalPrediction")))
        .withColumn("DecisionSource", E.decision_source("OriginalPrediction", r))
    )


def gated_override(small: DataFrame, review: DataFrame, threshold: float, key: str = "Index", review_pred: str = "ReviewPrediction") -> DataFrame:
    """Confident small-model calls stand; the others take a valid review, else fall back to the small model."""
    conf = E.judged_confidence("Prediction", "Prob")
    valid = F.trim(F.col(review_pred).cast("string")).isin("0", "1")
    r = F.when(valid, F.col(review_pred).cast("int"))
    out = small.join(review, key, "left").withColumn("Confidence", conf)
    deferred = F.col("Confidence") < threshold
    return out.withColumn("FinalPrediction", F.when(deferred & r.isNotNull(), r).otherwise(F.col("Prediction"))).withColumn(
        "DecisionSource", F.when(~deferred, E.HIGH_CONFIDENCE).when(r.isNotNull(), E.LOW_OVERRIDE).otherwise(E.LOW_FALLBACK)
    )


def merge_two(a: DataFrame, b: DataFrame, how: str, key: str = "Index") -> DataFrame:
    """Union (either positive) or intersection (both) of two models; the greater probability either way."""
    j = a.select(key, "Label", F.col("Prediction").alias("pa"), F.col("Prob").alias("qa")).join(b.select(key, F.col("Prediction").alias("pb"), F.col("Prob").alias("qb")), key)
    pred = F.greatest("pa", "pb") if how == "union" else F.least("pa", "pb")
    return j.select(key, "Label", pred.alias("Prediction"), F.greatest("qa", "qb").alias("Prob"))


def key_differences(a: DataFrame, b: DataFrame, key: str = "Index") -> DataFrame:
    """Keys of one side only, with the side."""
    left = a.select(key).join(b.select(key), key, "left_anti").withColumn("side", F.lit("only_a"))
    return left.unionByName(b.select(key).join(a.select(key), key, "left_anti").withColumn("side", F.lit("only_b")))


def checked_merge(a: DataFrame, b: DataFrame, how: str, key: str = "Index") -> DataFrame:
    """J7 with its contract: equal key sets and equal labels, else the job fails."""
    both = a.select(key, F.col("Label").alias("la"), F.col("Prediction").alias("pa"), F.col("Prob").alias("qa")).join(
        b.select(key, F.col("Label").alias("lb"), F.col("Prediction").alias("pb"), F.col("Prob").alias("qb")), key, "full")
    bad = F.col("la").isNull() | F.col("lb").isNull() | (F.col("la") != F.col("lb"))
    guard = F.when(bad, F.raise_error(F.concat(F.lit("keys or labels differ at "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    pred = F.greatest("pa", "pb") if how == "union" else F.least("pa", "pb")
    return both.where(guard).select(key, F.col("la").alias("Label"), pred.alias("Prediction"), F.greatest("qa", "qb").alias("Prob"))


def backfill(merged: DataFrame, source: DataFrame, column: str, key: str = "Index") -> DataFrame:
    """Fills a null column from another table by key."""
    s = source.select(F.col(key), F.col(column).alias("fill_"))
    return merged.join(s, key, "left").withColumn(column, F.coalesce(column, "fill_")).drop("fill_")


def vote(models: dict[str, DataFrame], strategy: str, keys: str = "intersection", weights: dict[str, float] | None = None,
         threshold: float | None = None, key: str = "Index") -> DataFrame:
    """J8, A-30: any, majority, threshold or weighted vote of any number of models.

    Models are stacked and folded by one aggregation, not joined one by one. majority: over half of the
    votes present; threshold: at least `threshold` positive votes; weighted: the positive weight reaches
    `threshold`, by default half of all weights, absent models included.
    """
    weights = weights or {}
    long = reduce(DataFrame.unionByName, [df.select(key, "Label", F.lit(m).alias("m"), F.col("Prediction").alias("v"), F.lit(float(weights.get(m, 1.0))).alias("w")) for m, df in models.items()])
    agg = long.groupBy(key).agg(
        F.max("Label").alias("Label"), F.count("v").alias("TotalVotes"), F.sum("v").cast("long").alias("PositiveVotes"),
        F.round(F.sum(F.col("v") * F.col("w")), 6).alias("Score"),
        F.array_join(F.array_sort(F.collect_list("m")), ",").alias("PresentModels"),
        *[F.max(F.when(F.col("m") == m, F.col("v"))).alias(f"Vote_{m}") for m in models],
    )
    if keys == "intersection":
        agg = agg.where(F.col("TotalVotes") == len(models))
    total = sum(float(weights.get(m, 1.0)) for m in models)
    rule: dict[str, Column] = {
        "any": F.col("PositiveVotes") >= 1,
        "majority": F.col("PositiveVotes") * 2 > F.col("TotalVotes"),
        "threshold": F.col("PositiveVotes") >= F.lit(threshold or 1),
        "weighted": F.col("Score") >= F.lit(total / 2 if threshold is None else float(threshold)),
    }
    return agg.withColumn("EnsemblePrediction", rule[strategy].cast("int")).withColumn("Strategy", F.lit(strategy))


# Name -> (models, strategy, threshold, weights).
PRESETS = {
    "majority3": (("deepseek", "baidu", "llama"), "majority", None, None),
    "any3": (("deepseek", "baidu", "llama"), "any", None, None),
    "threshold2of3": (("deepseek", "baidu", "llama"), "threshold", 2, None),
    "all3": (("deepseek", "baidu", "llama"), "threshold", 3, None),
    "weighted3_balanced": (("deepseek", "baidu", "llama"), "weighted", 1.8, {"deepseek": 1.0, "baidu": 1.3, "llama": 0.9}),
    "weighted3_recall": (("deepseek", "baidu", "llama"), "weighted", 1.0, {"deepseek": 1.1, "baidu": 0.7, "llama": 1.2}),
    "majority4": (("deepseek", "baidu", "llama", "dscoder"), "majority", None, None),
    "any4": (("deepseek", "baidu", "llama", "dscoder"), "any", None, None),
    "threshold2of4": (("deepseek", "baidu", "llama", "dscoder"), "threshold", 2, None),
    "threshold3of4": (("deepseek", "baidu", "llama", "dscoder"), "threshold", 3, None),
}


def vote_preset(models: dict[str, DataFrame], preset: str, key: str = "Index") -> DataFrame:
    """Q6: a named vote over the keys that all its models have; a missing model is an error."""
    names, strategy, threshold, weights = PRESETS[preset]
    return vote({m: models[m] for m in names}, strategy, "intersection", weights, threshold, key).withColumn("Preset", F.lit(preset))


def majority_of_three(a, b, c) -> Column:
    """A-31: the call of two, null where a missing vote leaves a tie."""
    votes = F.filter(F.array(F.col(a), F.col(b), F.col(c)), lambda x: x.isNotNull())
    ones, n = F.size(F.filter(votes, lambda x: x == 1)), F.size(votes)
    return F.when(ones * 2 > n, 1).when(ones * 2 < n, 0)


def fold_chunks(df: DataFrame, group: str, order: str, pred: str, error: str) -> DataFrame:
    """A-32: one null leaves the group null, else the OR; the first error is kept; status ok or partial."""
    g = df.groupBy(group).agg(
        F.count("*").alias("n_chunks"), F.every(F.col(pred).isNotNull()).alias("all_"), F.max(pred).alias("any_"),
        F.min_by(error, F.when(F.col(error).isNotNull(), F.col(order))).alias("first_error"),
    )
    return g.select(group, "n_chunks", F.when(F.col("all_"), F.col("any_")).alias("prediction"), F.when(F.col("all_"), "ok").otherwise("partial").alias("status"), "first_error")


def resume(inputs: DataFrame, done: DataFrame, key: str, success: Column) -> DataFrame:
    """Inputs that no successful output covers."""
    return inputs.join(done.where(success).select(key).distinct(), key, "left_anti")
