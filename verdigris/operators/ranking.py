"""Exact global ranks without a global task.

Rows are cut into chunks that follow the order; each chunk is numbered by itself and shifted by the
sizes of the chunks before it, which is a table of a row per chunk. The result equals row_number()
over the whole order, but the largest sort is one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder

CHUNKS = 1024


def rank(df: DataFrame, by: list[str], order: list[Column], chunk: Column) -> DataFrame:
    """df plus rank_ (1-based, per `by`) and size_ (rows of the group). chunk must not decrease along the order."""
    cut = df.withColumn("chunk_", chunk)
    keys = [*by, "chunk_"]
    inside = cut.withColumn("local_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    sizes = cut.groupBy(*keys).agg(F.count("*").alias("n_"))
    group = Window.partitionBy(*by)  # a row per chunk
    before = group.orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"), F.sum("n_").over(group).alias("size_"))
    same = [F.col(k).eqNullSafe(F.col(f"k_{i}")) for i, k in enumerate(keys)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return inside.join(starts, cond).select(*df.columns, (F.col("start_") + F.col("local_")).alias("rank_"), "size_")


def rank_by_hash(df: DataFrame, by: list[str], hashed: Column, key: str) -> DataFrame:
    """In the order of a hexadecimal hash; its first digits are the chunk."""
    return rank(df.withColumn("hash_", hashed), by, [F.col("hash_"), F.col(key)], F.substring("hash_", 1, 3)).drop("hash_")


def bin_among(x: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at or below x, by binary search."""
    table, n = F.array(*map(F.lit, bounds)), len(bounds)

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = (s["lo"] < s["hi"]) & (F.element_at(table, F.least(mid + 1, F.lit(n))) <= x)
        return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(F.least(mid, s["hi"])).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, step, lambda s: s["lo"])


def rank_by_number(df: DataFrame, by: list[str], order: str, chunks: int = CHUNKS) -> DataFrame:
    """In the order of a number (nulls first), ties by a hash of the row; quantiles are the chunks.

    A value that fills several quantiles is split along the hash, so neither outliers nor a frequent value
    make a large chunk. The quantiles steer the chunks alone: the ranks are exact.
    """
    kinds = dict(df.dtypes)
    tie = F.xxhash64(*[F.col(c) for c in df.columns if "map<" not in kinds[c] and "variant" not in kinds[c]])
    wide = df.withColumn("tie_", tie)
    shares = [i / chunks for i in range(1, chunks)]
    found = wide.agg(F.percentile_approx(order, shares, 10 * chunks).alias("q")).first()["q"] or []
    bounds, heavy = sorted(set(found)), {a for a, b in zip(found, found[1:]) if a == b}
    chunk = F.lit(0) if not bounds else bin_among(F.col(order), bounds)
    # 0..63: parts of the frequent value that begins a chunk; 64: the values after it
    part = F.lit(64) if not heavy else F.when(F.col(order).isin(*heavy), F.shiftrightunsigned("tie_", 58).cast("int")).otherwise(64)
    whole = F.when(F.col(order).isNull(), F.lit(-1).cast("long")).otherwise(chunk.cast("long") * 65 + part)
    signed = F.col("tie_").bitwiseXOR(F.lit(-(1 << 63)))  # the hash in the order of its first bits
    return rank(wide, by, [F.col(order), signed], whole).drop("tie_")


def rank_by_value(df: DataFrame, order: str, tie: str, chunks: int = CHUNKS) -> DataFrame:
    """In the order of a number or time (nulls first), ties by another column; for orders whose values seldom repeat."""
    kind = df.schema[order].dataType
    found = df.agg(F.percentile_approx(order, [i / chunks for i in range(1, chunks)], 10 * chunks).alias("q")).first()["q"] or []
    bounds = [F.lit(b).cast(kind) for b in sorted(set(found))]
    chunk = F.lit(0) if not bounds else F.when(F.col(order).isNull(), -1).otherwise(bin_among(F.col(order), bounds))
    return rank(df, [], [F.col(order), F.col(tie)], chunk)


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df plus a 0-based number along the order of columns of any type; rows equal in it are numbered in any way.

    Rows are dealt to ranges of the order and stored with their range and place, so both passes see one and the same deal;
    a range's start is the number of rows before it, a row a range.
    """
    path = shared_folder(df.sparkSession, "numbered")
    width = 1 << 33  # of a partition's ids
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id_", F.monotonically_increasing_id())
    dealt.write.parquet(path)
    rows = df.sparkSession.read.schema(dealt.schema).parquet(path).withColumn("range_", F.floor(F.col("id_") / width))
    starts, at = [], 0
    for r in rows.groupBy("range_").count().orderBy("range_").collect():  # a row a partition
        starts.append((r["range_"], at))
        at += r["count"]
    starts = df.sparkSession.createDataFrame(starts, "range_ long, start_ long")
    return rows.join(F.broadcast(starts), "range_").select(*df.columns, (F.col("start_") + F.pmod(F.col("id_"), F.lit(width))).alias(name))
