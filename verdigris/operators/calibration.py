"""Calibration tables, threshold sweeps and correlation.

Bins come from a literal edge array, [lo, hi) with the last one closed, so a value on an edge falls where
the edge says, never where a division rounds. Sweeps are one histogram and a reverse running sum, not a
pass per threshold.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import confidence, safe_div
from .scans import select_ranks


def edges(lo: str, hi: str, step: str) -> list[float]:
    """Exact decimal edges as doubles."""
    a, b, s = Decimal(lo), Decimal(hi), Decimal(step)
    return [float(a + s * i) for i in range(int((b - a) / s) + 1)]


def at_or_above(x: Column, bounds: list[float]) -> Column:
    """How many bounds x reaches; 0 for null."""
    return F.coalesce(reduce(lambda a, b: a + b, [(x >= F.lit(b)).cast("int") for b in bounds], F.lit(0)), F.lit(0))


def bin_of(x: Column, bounds: list[float]) -> Column:
    """0-based bin, the last closed; null outside."""
    inside = at_or_above(x, bounds) - 1
    return F.when((x < bounds[0]) | (x > bounds[-1]), None).otherwise(F.least(inside, F.lit(len(bounds) - 2)))


def bins(bounds: list[float], spark) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))], "bin int, lo double, hi double")


def calibration(df: DataFrame, bounds: list[float], prob: str = "Prob", label: str = "Label", pred: str = "Prediction", use_confidence: bool = True) -> DataFrame:
    """A-11, A-12: per non-empty bin: count, ratio, accuracy, mean value and their gap; label and call rates."""
    v = confidence(prob) if use_confidence else F.col(prob)
    agg = df.withColumn("v_", v).withColumn("bin", bin_of(F.col("v_"), bounds)).where("bin is not null").groupBy("bin").agg(
        F.count("*").alias("count"), F.avg((F.col(label) == F.col(pred)).cast("double")).alias("acc_"), F.avg("v_").alias("avg_"),
        F.avg(F.col(label).cast("double")).alias("lab_"), F.avg(F.col(pred).cast("double")).alias("pred_"),
    )
    return calibration_table(agg)


def calibration_table(rows: DataFrame) -> DataFrame:
    """The table of A-11 from a row a bin: count, acc_, avg_, lab_ and pred_."""
    total = F.sum("count").over(Window.partitionBy())  # a row a bin
    return rows.select(
        "bin", "count", F.round(F.col("count") / total, 6).alias("ratio"), F.round("acc_", 6).alias("accuracy"), F.round("avg_", 6).alias("avg_value"),
        F.round(F.col("avg_") - F.col("acc_"), 6).alias("gap"), F.round("lab_", 6).alias("label_rate"), F.round("pred_", 6).alias("call_rate"),
    )


POSITIVE_EDGES = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0000001]  # fixed values


def positive_buckets(df: DataFrame, bounds: list[float] = POSITIVE_EDGES, prob: str = "Prob", label: str = "Label") -> DataFrame:
    """A-13: of the rows at or above the first edge, every bucket, empty ones too: tp, fp, precision, shares, and the gain fp * (1 - precision) of a review."""
    agg = df.withColumn("bin", bin_of(F.col(prob), bounds)).where("bin is not null").groupBy("bin").agg(F.count("*").alias("count"), F.count_if(F.col(label) == 1).alias("tp"), F.count_if(F.col(label) == 0).alias("fp"))
    full = bins(bounds, df.sparkSession).join(agg, "bin", "left").select("bin", "lo", "hi", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("count", "tp", "fp")])
    every = Window.partitionBy()  # a row per bucket
    precision = safe_div("tp", "count")
    return full.select(
        "bin", "lo", "hi", "count", "tp", "fp", F.round(precision, 6).alias("precision"),
        F.round(safe_div(F.col("fp"), F.sum("fp").over(every)), 6).alias("fp_share"), F.round(safe_div(F.col("tp"), F.sum("tp").over(every)), 6).alias("tp_share"),
        F.round(safe_div(F.col("count"), F.sum("count").over(every)), 6).alias("sample_share"), F.round(F.col("fp") * (1 - precision), 6).alias("gain"),
    )


def best_bucket(buckets: DataFrame, score: str = "gain") -> DataFrame:
    """A-14: the first bucket of the greatest and of the least score."""
    key = F.struct(F.col(score), -F.col("bin"))
    low = F.struct(F.col(score), F.col("bin"))
    return buckets.agg(F.max_by("bin", key).alias("best_bin"), F.round(F.max(score), 6).alias("best_score"), F.min_by("bin", low).alias("worst_bin"), F.round(F.min(score), 6).alias("worst_score"))


def sweep(df: DataFrame, steps: int = 100, prob: str = "Prob", label: str = "Label") -> DataFrame:
    """A-15: metrics of prob >= t for t = 0, 1/steps ... 1: a histogram, then reverse running sums over its few rows."""
    hist = df.groupBy(threshold_step(F.col(prob), steps).alias("b")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    return swept(hist, steps)


def threshold_step(x: Column, steps: int) -> Column:
    """The last of the thresholds 0, 1/steps ... 1 that x reaches, as a number from 0; -1 below all and for null."""
    # the step by arithmetic, put right by comparison with the steps beside it
    guess = F.floor(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * steps).cast("int")
    exact = F.when(x >= (guess + 1) / F.lit(float(steps)), guess + 1).when(x < guess / F.lit(float(steps)), guess - 1).otherwise(guess)
    return F.coalesce(F.greatest(F.least(exact, F.lit(steps)), F.lit(-1)), F.lit(-1))


def swept(hist: DataFrame, steps: int) -> DataFrame:
    """The sweep of A-15 from counts of labels 1 (p) and 0 (n) a step (b)."""
    ts = [i / steps for i in range(steps + 1)]
    grid = hist.sparkSession.createDataFrame(list(enumerate(ts)), "b int, threshold double")
    full = grid.join(hist, "b", "full").select("b", "threshold", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("n", F.lit(0)).alias("n"))
    down = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    cum = full.select("b", "threshold", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(every).alias("P"), F.sum("n").over(every).alias("N"))
    out = cum.where("threshold is not null").select("threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select("*", F.round(safe_div(tp, tp + fp), 6).alias("precision"), F.round(safe_div(tp, tp + fn), 6).alias("recall"), F.round(safe_div(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round(safe_div(fp, fp + tn), 6).alias("fpr"))


def best_thresholds(swept: DataFrame, max_fpr: float = 0.1) -> DataFrame:
    """The least threshold of the best F1, and of the best recall at an fpr of at most max_fpr."""
    ok = F.col("fpr") <= max_fpr
    return swept.agg(
        F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("best_f1_threshold"), F.max("f1").alias("best_f1"),
        F.max_by(F.when(ok, F.col("threshold")), F.when(ok, F.struct("recall", -F.col("threshold")))).alias("best_recall_threshold"), F.max(F.when(ok, F.col("recall"))).alias("best_recall"),
    )


def coverage(df: DataFrame, thresholds: list[float], prob: str = "Prob", label: str = "Label", pred: str = "Prediction") -> DataFrame:
    """A-16, A-17: per threshold, the rows at least that confident: count, coverage, accuracy, error rate."""
    v = confidence(prob)
    bucket = at_or_above(v, thresholds) - 1
    hist = df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == F.col(pred)).alias("ok"))
    grid = df.sparkSession.createDataFrame(list(enumerate(thresholds)), "b int, threshold double")
    full = grid.join(hist, "b", "full").select("b", "threshold", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ok", F.lit(0)).alias("ok"))
    down = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    cum = full.select("threshold", F.sum("n").over(down).alias("kept"), F.sum("ok").over(down).alias("correct"), F.sum("n").over(Window.partitionBy()).alias("all_"))
    return cum.where("threshold is not null").select("threshold", "kept", F.round(safe_div("kept", "all_"), 6).alias("coverage"), F.round(safe_div("correct", "kept"), 6).alias("accuracy"), F.round(1 - safe_div("correct", "kept"), 6).alias("error_rate"))


def correlation(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """A-18: Pearson's r, null where either side is constant; rows with a null on either side count for n alone."""
    s = df.select(a.cast("double").alias("x"), b.cast("double").alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = (F.when(both, F.col(c)) for c in ("x", "y"))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    s = s.agg(F.count("*").alias("n"), r.alias("r"), *[f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))])
    flat = (F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1"))
    return s.select("n", F.when(~flat, F.round("r", 6)).alias("pearson"))


def spread(df: DataFrame, value: Column) -> DataFrame:
    """A-19, A-20: mean, exact median, least and greatest; the median by rounds of selection."""
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    n = v.count()
    middle = select_ranks(v, F.col("v"), [(n + 1) // 2, n // 2 + 1]) if n else {}
    median = F.round(F.lit((middle[(n + 1) // 2] + middle[n // 2 + 1]) / 2), 6) if n else F.lit(None).cast("double")
    return v.agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), median.alias("median"), F.min("v").alias("least"), F.max("v").alias("greatest"))
