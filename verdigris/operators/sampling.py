"""Deterministic samples and splits.

Random order is the order of md5(seed::key), the same on every engine and cluster; ties cannot occur
on unique keys. Ranks come from `ranking`, so no class and no table is sorted in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import shuffle_key
from .ranking import rank_by_hash, rank_by_number

#: Hexadecimal digits of the shuffling hash by which rows are counted first, and the values they take.
DIGITS = 3
PREFIXES = 16**DIGITS


def _shuffled(df: DataFrame, by: list[str], key: str, seed: str) -> DataFrame:
    return rank_by_hash(df, by, shuffle_key(key, seed), key)


def _first(df: DataFrame, by: list[str], key: str, seed: str, keep: Column) -> DataFrame:
    """The first rows of each group in shuffled order: `keep` of them, a column over the groups' rows (by, size_).

    The first digits of the hash are counted by group, a histogram that says where each group's cut lies; rows before it
    are a filter, and only those with the very digits of a cut (one in PREFIXES) are ranked. No row is shuffled but those.
    """
    prefix = F.conv(F.substring("hash_", 1, DIGITS), 16, 10).cast("int")
    rows = df.withColumn("hash_", shuffle_key(key, seed)).withColumn("prefix_", prefix)
    names = [f"b{i}_" for i in range(len(by))]
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)])
    keeps = df.groupBy(*by).agg(F.count("*").alias("size_")).select(*by, keep.cast("long").alias("keep_")).select(*[F.col(c).alias(n) for c, n in zip(by, names)], "keep_")
    counts = rows.groupBy(*by, "prefix_").agg(F.count("*").alias("c_"))
    upto = F.sum("c_").over(Window.partitionBy(*by).orderBy("prefix_"))  # PREFIXES rows a group
    counts = counts.withColumn("upto_", upto).join(keeps, same)
    cuts = counts.where((F.col("upto_") >= F.col("keep_")) & (F.col("upto_") - F.col("c_") < F.col("keep_")))
    cuts = cuts.select(*names, F.col("prefix_").alias("cut_"), (F.col("keep_") - F.col("upto_") + F.col("c_")).alias("need_"))
    met = rows.join(cuts, same)  # a row a group
    before = met.where(F.col("prefix_") < F.col("cut_")).select(*df.columns)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("hash_", key))
    at = met.where(F.col("prefix_") == F.col("cut_")).withColumn("nth_", nth).where(F.col("nth_") <= F.col("need_"))
    return before.unionByName(at.select(*df.columns))


def _sum_of(c: Column, by: list[str] | None = None) -> Column:
    """Over the groups' rows."""
    return F.sum(c).over(Window.partitionBy(*(by or [])))


def _share(limit: int, n: Column) -> Column:
    """size_ while n rows are within the limit, else its share of it, rounded half to even."""
    return F.when(n <= limit, F.col("size_")).otherwise(F.bround(F.col("size_") * ((F.lit(float(limit)) + 0.1) / n)))


def _negatives(label: str, ratio: float, pos: Column) -> Column:
    """All of the positives, and round(pos / ratio - pos) of any other class."""
    return F.when(F.col(label) == 1, F.col("size_")).otherwise(F.least(F.col("size_"), F.bround(pos / F.lit(ratio) - pos)))


def _positives(label: str, by: list[str] | None = None) -> Column:
    return F.coalesce(_sum_of(F.when(F.col(label) == 1, F.col("size_")), by), F.lit(0))


def truncate(df: DataFrame, limit: int, label: str = "label", key: str = "index", seed: str = "42") -> DataFrame:
    """About `limit` rows, each class in its share (half-even rounding of count * (limit + 0.1) / n)."""
    return _first(df, [label], key, seed, _share(limit, _sum_of(F.col("size_"))))


def truncate_buckets(df: DataFrame, limit: int, bucket: str, label: str = "label", key: str = "index", seed: str = "42") -> DataFrame:
    """One ratio for all buckets, set by the largest."""
    n = df.groupBy(bucket).count().agg(F.max("count")).first()[0] or 0
    return _first(df, [bucket, label], key, seed, _share(limit, F.lit(n)))


def to_positive_ratio(df: DataFrame, ratio: float, label: str = "label", key: str = "index", seed: str = "42") -> DataFrame:
    """Z3: all positives, and round(pos / ratio - pos) negatives."""
    return _first(df, [label], key, seed, _negatives(label, ratio, _positives(label)))


def buckets_to_ratio(df: DataFrame, ratio: float, bucket: str, limit: int | None = None, label: str = "label", key: str = "index", seed: str = "42") -> DataFrame:
    """Z3 in each bucket by itself, and then, with a limit, Z1."""
    kept = _first(df, [bucket, label], key, seed, _negatives(label, ratio, _positives(label, [bucket])))
    return kept if limit is None else _first(kept, [bucket, label], key, seed, _share(limit, _sum_of(F.col("size_"), [bucket])))


def one_to_n(df: DataFrame, n: int, label: str = "label", key: str = "index", seed: str = "42") -> DataFrame:
    """N negatives per positive; fails where there are too few."""
    pos = _positives(label)
    neg = F.coalesce(_sum_of(F.when(F.col(label) == 0, F.col("size_"))), F.lit(0))
    ok = F.when(neg < pos * n, F.raise_error(F.lit("too few negatives")).cast("long")).otherwise(pos * n)
    return _first(df, [label], key, seed, F.when(F.col(label) == 1, F.col("size_") + ok * 0).otherwise(F.least(F.col("size_"), ok)))


def positional_split(df: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """The first 80 % train, the next 10 % validate, the rest test."""
    r = rank_by_number(df, by or [], order)
    i, n = F.col("rank_") - 1, F.col("size_")
    split = F.when(i < F.floor(n * F.lit(0.8)), "train").when(i < F.floor(n * F.lit(0.9)), "validate").otherwise("test")
    return r.select(*df.columns, split.alias("split"))


def stratified_folds(df: DataFrame, n: int, label: str = "label", key: str = "index", seed: str = "42") -> DataFrame:
    """Round-robin folds per class; every row is in one."""
    return _shuffled(df, [label], key, seed).select(*df.columns, F.pmod(F.col("rank_") - 1, F.lit(n)).cast("int").alias("fold"))


def head_fractions(df: DataFrame, bucket: str, fractions: dict, order: str) -> DataFrame:
    """The first floor(n * fraction) rows of each bucket."""
    f = F.create_map(*[F.lit(x) for kv in fractions.items() for x in kv])
    share = F.coalesce(F.try_element_at(f, F.col(bucket)), F.lit(0.0))
    return rank_by_number(df, [bucket], order).where(F.col("rank_") <= F.floor(F.col("size_") * share)).select(*df.columns)


def sample_percent(df: DataFrame, percent: float, key: str, seed: str = "10") -> DataFrame:
    """That share of the rows in shuffled order, by hash: a filter, so it costs one scan at any size."""
    h = F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("long")
    return df.where(h < int(percent * (1 << 32)))


def dense_index(df: DataFrame, order: str, by: list[str] | None = None, name: str = "index") -> DataFrame:
    """0-based numbers, per group where groups are given."""
    return rank_by_number(df, by or [], order).select(*df.columns, (F.col("rank_") - 1).alias(name))


def length_bucket(length: Column, bounds: list[int]) -> Column:
    """`lo-hi` of the half-open bucket, `hi-*` beyond the last."""
    out = F.lit(f"{bounds[-1]}-*")
    for lo, hi in reversed(list(zip(bounds, bounds[1:]))):
        out = F.when((length >= lo) & (length < hi), f"{lo}-{hi}").otherwise(out)
    return out
