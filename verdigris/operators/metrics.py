"""Confusion-matrix metrics and their summaries: one conditional aggregation, then derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import safe_div

CELLS = ("tp", "tn", "fp", "fn", "total")
RATES = ("accuracy", "precision", "recall", "f1", "fpr")


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def cells(label: str = "Label", pred: str = "Prediction", where: Column | None = None, prefix: str = "") -> list[Column]:
    """The four counts and their total, of the rows that meet `where`."""
    y, p = F.col(label), F.col(pred)
    w = F.lit(True) if where is None else where
    conds = {"tp": (y == 1) & (p == 1), "tn": (y == 0) & (p == 0), "fp": (y == 0) & (p == 1), "fn": (y == 1) & (p == 0)}
    return [count_if(w & c).alias(prefix + k) for k, c in conds.items()] + [count_if(w & y.isin(0, 1) & p.isin(0, 1)).alias(prefix + "total")]


def rates(prefix: str = "", digits: int = 6) -> list[Column]:
    """accuracy, precision, recall, f1 and fpr from the cells; 0 where a denominator is 0."""
    tp, tn, fp, fn, total = (F.col(prefix + c) for c in CELLS)
    got = {"accuracy": safe_div(tp + tn, total), "precision": safe_div(tp, tp + fp), "recall": safe_div(tp, tp + fn), "f1": safe_div(2 * tp, 2 * tp + fp + fn), "fpr": safe_div(fp, fp + tn)}
    return [F.round(c, digits).alias(prefix + k) for k, c in got.items()]


def confusion(df: DataFrame, by: list[str] | None = None, label: str = "Label", pred: str = "Prediction", digits: int = 6) -> DataFrame:
    """A-1, A-6: counts and rates, overall or per group; map-side partial sums, one shuffle of a row per group and task."""
    return df.groupBy(*(by or [])).agg(*cells(label, pred)).select("*", *rates(digits=digits))


def before_after(df: DataFrame, before: str, after: str, reviewed: Column, label: str = "Label", digits: int = 6) -> DataFrame:
    """A-2: metrics on the reviewed rows before and after the review, in one pass."""
    agg = df.agg(*cells(label, before, reviewed, "before_"), *cells(label, after, reviewed, "after_"))
    return agg.select("*", *rates("before_", digits), *rates("after_", digits))


def grouped(df: DataFrame, keys: list[str], label: str = "Label", pred: str = "Prediction") -> DataFrame:
    """A-7: micro-averaged metrics by each key alone, (dimension, value) rows, in one pass by grouping sets."""
    g = df.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(*cells(label, pred), F.grouping_id().alias("gid_"))
    n = len(keys)
    dim, val = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        hit = F.col("gid_") == (2**n - 1) - 2 ** (n - 1 - i)
        dim, val = F.when(hit, k).otherwise(dim), F.when(hit, F.col(k).cast("string")).otherwise(val)
    return g.select(dim.alias("dimension"), val.alias("value"), *CELLS).select("*", *rates())


def overlap(df: DataFrame, a: str, b: str, label: str = "Label") -> DataFrame:
    """A-9, A-10: agreement of two models, set overlap of their positives, positives that only one finds."""
    x, y, lab = F.col(a), F.col(b), F.col(label)
    agg = df.agg(
        F.count("*").alias("n"),
        count_if(x == y).alias("same"), count_if(x != y).alias("different"),
        count_if((x == 1) & (y == 1)).alias("both_positive"), count_if((x == 0) & (y == 0)).alias("both_negative"),
        count_if((x == 1) & (y == 0)).alias("only_a"), count_if((x == 0) & (y == 1)).alias("only_b"),
        count_if((x == 1) | (y == 1)).alias("positive_union"),
        count_if((lab == 1) & (x == 0) & (y == 1)).alias("rescued_by_b"), count_if((lab == 1) & (x == 1) & (y == 0)).alias("rescued_by_a"),
    )
    return agg.withColumn("jaccard", F.round(safe_div("both_positive", "positive_union"), 6)).withColumn("agreement", F.round(safe_div("same", "n"), 6))


def macro_average(df: DataFrame, columns: list[str], by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """A-8: mean over datasets of already rounded rates."""
    return df.groupBy(*(by or [])).agg(*[F.round(F.avg(c), digits).alias(f"avg_{c}") for c in columns], F.count("*").alias("n_datasets"))


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """A-37: columns to (metric, value) rows."""
    return df.unpivot([F.col(c) for c in ids], [F.col(c).cast("double").alias(c) for c in columns], name, value)


def pivot(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A-36: a metric per row, a model per column; the columns are named, so no extra pass finds them."""
    return df.groupBy(row).pivot(column, columns).agg(F.first(value))


def weighted_mean(df: DataFrame, value: Column, weight: Column, by: list[str] | None = None) -> DataFrame:
    """A-34."""
    return df.groupBy(*(by or [])).agg(F.round(safe_div(F.sum(value * weight), F.sum(weight)), 6).alias("weighted_mean"))
