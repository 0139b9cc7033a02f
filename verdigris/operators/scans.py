"""Running sums and maxima along a group's order, and exact order statistics, without a task that holds a group.

A scan has two levels: groups with a large share of all rows are cut into chunks at quantiles of their order; a chunk is
scanned by itself, and carries in what the chunks before it come to, a row each. Smaller groups are one chunk.
Order statistics are found by rounds that narrow a range of values, a fixed number of rows to the driver each.
"""

from __future__ import annotations

from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group of more rows than this and than one PARTS-th of the table is cut into chunks, PARTS of them; so at most PARTS groups are.
CHUNK_ROWS, PARTS = 1_000_000, 512
#: Values that a round of selection collects at most, and the quantiles it narrows by.
FEW, CUTS = 4_000, 256


def _same(by: list[str], other: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(by, other)], F.lit(True))


def _at_or_below(x: Column, table: Column) -> Column:
    """How many of an ascending array's elements are at or below x, by binary search."""

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        low = (s["lo"] < s["hi"]) & (F.element_at(table, F.least(mid + 1, F.size(table))) <= x)
        return F.struct(F.when(low, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(F.least(mid, s["hi"])).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(PARTS.bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.size(table).alias("hi")), step, lambda s: s["lo"])


def chunked(df: DataFrame, by: list[str], order: str, chunk_rows: int = CHUNK_ROWS, total: int | None = None) -> tuple[DataFrame, bool]:
    """df plus chunk_, which never falls along a group's order and is null outside large groups; whether there is a large one.

    order is a number, date or time; rows that agree in it share a chunk. total is a number of rows that df surely does not
    exceed, counted here if it isn't given. The bounds (a row a large group) are broadcast.
    """
    none = df.withColumn("chunk_", F.lit(None).cast("int"))
    total = df.count() if total is None else total
    if total <= chunk_rows:
        return none, False
    large = df.groupBy(*by).agg(F.count("*").alias("n_")).where(F.col("n_") > max(chunk_rows, total // PARTS))
    names = [f"b{i}_" for i in range(len(by))]
    large = large.select(*[F.col(c).alias(n) for c, n in zip(by, names)])
    rows = df.join(F.broadcast(large), _same(by, names), "left_semi")
    cuts = rows.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx(order, [i / PARTS for i in range(1, PARTS)], 10 * PARTS))).alias("cuts_"))
    cuts = cuts.select(*[F.col(c).alias(n) for c, n in zip(by, names)], "cuts_")
    found = cuts.collect()  # at most PARTS rows of PARTS numbers
    if not found:
        return none, False
    cuts = df.sparkSession.createDataFrame(found, cuts.schema)
    at = F.when(F.col("cuts_").isNotNull(), F.coalesce(_at_or_below(F.col(order), F.col("cuts_")), F.lit(-1)))  # a null comes first
    return df.join(F.broadcast(cuts), _same(by, names), "left").withColumn("chunk_", at).select(*df.columns, "chunk_"), True


def scan(df: DataFrame, by: list[str], order: list[str | Column], before: dict[str, tuple[str, Column]], totals: dict[str, Column] | None = None, chunk_rows: int = CHUNK_ROWS, total: int | None = None) -> DataFrame:
    """df plus, for each name in `before`, the "sum" or "max" of a column over the rows before it in its group, null for the
    first; and for each in `totals` the sum over its whole group.

    One shuffle of the rows. The first column of order is the name of a number, date or time.
    """
    totals = totals or {}
    agg = {"sum": F.sum, "max": F.max}
    rows, large = chunked(df, by, order[0], chunk_rows, total)
    part = Window.partitionBy(*by, "chunk_")
    up_to = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select("*", *[agg[op](c).over(up_to).alias(n) for n, (op, c) in before.items()], *[F.sum(c).over(part).alias(n) for n, c in totals.items()])
    if not large:
        return inside.drop("chunk_")
    sums = rows.where(F.col("chunk_").isNotNull()).groupBy(*by, "chunk_").agg(*[agg[op](c).alias(n) for n, (op, c) in before.items()], *[F.sum(c).alias(n) for n, c in totals.items()])
    names = [f"b{i}_" for i in range(len(by))]
    group = Window.partitionBy(*by)  # a row a chunk
    chunks = group.orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *[F.col(c).alias(n) for c, n in zip(by, names)], F.col("chunk_").alias("c_"),
        *[agg[op](n).over(chunks).alias(f"{n}_in_") for n, (op, _) in before.items()], *[F.sum(n).over(group).alias(f"{n}_in_") for n in totals],
    )
    both = inside.join(F.broadcast(carried), _same(by, names) & (F.col("chunk_") == F.col("c_")), "left")  # at most PARTS * (PARTS + 1) rows

    def combined(n: str, op: str) -> Column:
        a, b = F.col(f"{n}_in_"), F.col(n)
        return F.greatest(a, b) if op == "max" else F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(a + b)

    out = [combined(n, op).alias(n) for n, (op, _) in before.items()] + [F.coalesce(F.col(f"{n}_in_"), F.col(n)).alias(n) for n in totals]
    return both.select(*[c for c in df.columns if c not in before and c not in totals], *out)


def select_ranks(df: DataFrame, value: Column, ranks: list[int]) -> dict[int, object]:
    """The values at 1-based ranks of the order of a column's values (nulls have none).

    Each round takes quantiles of the open range that holds a rank, counts the values at and between them, and either
    meets the rank at a quantile or goes on between two of them; the last FEW values are collected.
    """
    v = df.select(value.alias("v")).where("v is not null")
    open_: dict[tuple, list[int]] = {(None, None, 0): sorted(set(ranks))}
    out: dict[int, object] = {}
    while open_:
        (lo, hi, below), wanted = open_.popitem()
        rows = v
        for bound, keep in ((lo, lambda b: F.col("v") > b), (hi, lambda b: F.col("v") < b)):
            if bound is not None:
                rows = rows.where(keep(F.lit(bound)))
        n, cuts = rows.agg(F.count("*"), F.percentile_approx("v", [i / CUTS for i in range(CUTS + 1)], 40 * CUTS)).first()
        if n <= FEW:
            for x, c in sorted(rows.groupBy("v").count().collect()):
                out |= {r: x for r in wanted if below < r <= below + c}
                below += c
            continue
        cuts = sorted(set(cuts))
        table = F.array(*[F.lit(c) for c in cuts])
        at = _at_or_below(F.col("v"), table)
        counts = {(r["at"], r["on"]): r["n"] for r in rows.groupBy(at.alias("at"), (F.element_at(table, F.greatest(at, F.lit(1))) == F.col("v")).alias("on")).agg(F.count("*").alias("n")).collect()}
        for i in range(len(cuts) + 1):
            for on in (True, False) if i else (False,):
                c = counts.get((i, on), 0)
                inside = [r for r in wanted if below < r <= below + c]
                if inside and on:
                    out |= dict.fromkeys(inside, cuts[i - 1])
                elif inside:
                    open_[cuts[i - 1] if i else lo, cuts[i] if i < len(cuts) else hi, below] = inside
                below += c
    return out


def quantiles(df: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """A-20: share and quantile, exact at any size: between the two values around a share's place, in proportion; null without values."""
    value = value.cast("double")
    n = df.agg(F.count(value)).first()[0]
    places = {s: s * (n - 1) for s in shares}
    got = select_ranks(df, value, [r for p in places.values() for r in (floor(p) + 1, min(floor(p) + 2, n))]) if n else {}
    rows = []
    for s, p in places.items():
        if n:
            a, b = got[floor(p) + 1], got[min(floor(p) + 2, n)]
            rows.append((float(s), float(a if a == b or p == floor(p) else a + (b - a) * (p - floor(p)))))
        else:
            rows.append((float(s), None))
    return df.sparkSession.createDataFrame(rows, "share double, quantile double")
