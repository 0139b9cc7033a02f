"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks of `block_docs`. Block b of a source of weight w is released at slot
floor(b/w) and due at ceil((b+1)/w); each slot takes, among the released blocks, the one with the earliest
deadline. Weights are exact fractions, so before any source runs out, each source's blocks among the first t
slots differ from t*w by less than one, however long the table. When a source has run out its slots stay
empty and close up (beyond four slots a block, later ones are given to who is released); the others keep
their proportions. The schedule has one row per block and comes from the driver, which takes a heap step a slot;
blocks grow with the table, so that their number stays bounded.

Every row gets a place, a null source is a source of its own. Rows are numbered within a source by hash,
in salted chunks, so a source that holds a third of all rows is spread over many tasks. Repeated rows get
neighbouring places; empty tables give empty results. Extra columns pass through; added names start with
`mix_` and replace columns of those names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Schedules and source lists of up to this many rows are broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 1_000_000


def shares(sizes: dict, q: int, temperature: float, weights: dict | None) -> dict:
    """Exact weights as integers of one common sum: given weights, else rows ** temperature.

    Sources without a given weight have 1/q of the given ones' sum.
    """
    if weights:
        raw = {s: None if weights.get(s) is None else Fraction(repr(float(weights[s]))) for s in sizes}
        if any(v is not None and v < 0 for v in raw.values()):
            raise ValueError("a weight is negative")
        least = (sum(v for v in raw.values() if v) or Fraction(1)) / q
        raw = {s: least if v is None else v for s, v in raw.items()}
    else:
        raw = {s: Fraction(repr(float(n) ** temperature)) for s, n in sizes.items()}
    unit = lcm(*(v.denominator for v in raw.values()))
    return {s: int(v * unit) for s, v in raw.items()}


def schedule_pieces(parts: list[int], blocks: list[int], rows: int) -> Iterator[list[list[int]]]:
    """Columns stream, block, slot, release, deadline of every block, in slot order: earliest deadline first; `rows` a piece."""
    first = [s for s, p in enumerate(parts) if p]
    turn = [first, [s for s, p in enumerate(parts) if not p]]  # weight 0: afterwards, alike
    out: list[list[int]] = [[], [], [], [], []]
    start = 0
    for streams in turn:
        part = {s: parts[s] or 1 for s in streams}
        q, total, done = sum(part.values()), sum(blocks[s] for s in streams), 0
        waiting = [(0, s, 0) for s in streams]
        ready: list[tuple[int, int, int, int]] = []
        t = steps = 0
        while done < total:
            while waiting and waiting[0][0] <= t:
                release, s, b = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(b + 1) * q // part[s]), s, b, release))
            if not ready:
                t = waiting[0][0]
                continue
            deadline, s, b, release = heapq.heappop(ready)
            if b < blocks[s]:
                for column, x in zip(out, (s, b, start + t, start + release, start + deadline)):
                    column.append(x)
                done += 1
                if len(out[0]) >= rows:
                    yield out
                    out = [[], [], [], [], []]
            elif steps > 4 * total:
                continue  # a stream that has run out leaves its slot to the next
            if b + 1 < blocks[s] or steps <= 4 * total:
                heapq.heappush(waiting, ((b + 1) * q // part[s], s, b + 1))
            t += 1
            steps += 1
        start += t
    yield out


def schedule(parts: list[int], blocks: list[int]) -> list[list[int]]:
    """schedule_pieces in one piece."""
    return next(schedule_pieces(parts, blocks, sum(blocks) + 1))


def number_rows(df: DataFrame, stream: str, ties: list[Column], chunk_rows: int, rows: int) -> DataFrame:
    """0-based `mix_nth` within each stream, dense, in hash order; no task handles more than a chunk or so."""
    chunks = max(1, -(-rows // chunk_rows))
    h = F.when(ties[0].isNull(), F.xxhash64(*ties)).otherwise(F.xxhash64(ties[0]))  # of the key, so whichever other columns there are
    df = df.withColumn("mix_hash", h).withColumn("mix_chunk", F.pmod(F.col("mix_hash"), F.lit(chunks)))
    w = Window.partitionBy(stream, "mix_chunk").orderBy("mix_hash", *ties)
    local = df.withColumn("mix_local", F.row_number().over(w))
    before = Window.partitionBy(stream).orderBy("mix_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(stream, "mix_chunk").count().withColumn("mix_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return local.join(starts, [stream, "mix_chunk"]).withColumn("mix_nth", F.col("mix_start") + F.col("mix_local") - 1).drop("mix_hash", "mix_chunk", "mix_local", "mix_start")


def stored_schedule(spark: SparkSession, parts: list[int], blocks: list[int]) -> DataFrame:
    """The schedule as a table; the driver holds a piece of BROADCAST_ROWS at a time, further ones go to the shared folder."""
    schema = pa.schema([("mix_stream", pa.int32()), *((f"mix_{n}", pa.int64()) for n in ("block", "slot", "release", "deadline", "position"))])
    path, at = common.shared_dir(spark, "schedule"), 0
    for columns in schedule_pieces(parts, blocks, BROADCAST_ROWS):
        n = len(columns[0])
        piece = spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, range(at, at + n)], schema)], schema=schema))
        if sum(blocks) <= BROADCAST_ROWS:
            return piece
        piece.write.mode("append").parquet(path)
        at += n
    return spark.read.schema(piece.schema).parquet(path)


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", weights: dict | None = None, temperature: float = 0.5,
        block_docs: int = 16, most_blocks: int = 1 << 20, q: int = 1000, max_streams: int | None = None, chunk_rows: int = 2_000) -> DataFrame:
    """docs plus mix_block, mix_slot, mix_release, mix_deadline, mix_position and mix_order.

    mix_slot is the schedule's slot, mix_position the block's place once empty slots are closed up,
    mix_order the row's place (position * block_docs + place in the block). weights: {source: weight},
    scaled to sum to one; sources without one get the least share, 1/q. Blocks grow beyond block_docs where the table would
    have more than most_blocks of them, so the driver's schedule has at most most_blocks rows and one a source.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    added = ("block", "slot", "release", "deadline", "position", "order")
    found = docs.groupBy(F.col(source).alias("s")).count().orderBy(F.desc("count"), "s").collect()
    if not found:
        return docs.select("*", *[F.lit(None).cast("long").alias(f"mix_{n}") for n in added])
    sizes = {r["s"]: r["count"] for r in found}
    rows = sum(sizes.values())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    # one stream a source; if max_streams is given, those beyond share the last, with the sum of their weights
    top = {r["s"] for r in found[:max_streams]}
    stream = {s: i for i, s in enumerate(n for n in names if n in top)}
    stream |= {s: len(top) for s in names if s not in top}
    part = shares(sizes, q, temperature, weights)
    held, parts = [0] * (1 + max(stream.values())), [0] * (1 + max(stream.values()))
    for s, i in stream.items():
        held[i] += sizes[s]
        parts[i] += part[s]
    block_docs = max(block_docs, -(-rows // most_blocks))
    blocks = [-(-n // block_docs) for n in held]

    def small(df: DataFrame, n: int) -> DataFrame:
        return F.broadcast(df) if n <= BROADCAST_ROWS else df

    named = spark.createDataFrame([(s, i) for s, i in stream.items()], f"mix_source {docs.schema[source].dataType.simpleString()}, mix_stream int")
    docs_in = docs.join(small(named, len(names)), F.col(source).eqNullSafe(F.col("mix_source"))).drop("mix_source")
    ties = [F.col(key), *[F.xxhash64(F.col(c)) for c, t in docs.dtypes if c != key and "map<" not in t and "variant" not in t]]
    numbered = number_rows(docs_in, "mix_stream", ties, chunk_rows, rows).withColumn("mix_block", F.floor(F.col("mix_nth") / F.lit(block_docs)))

    out = numbered.join(small(stored_schedule(spark, parts, blocks), sum(blocks)), ["mix_stream", "mix_block"])
    out = out.withColumn("mix_order", F.col("mix_position") * block_docs + F.pmod(F.col("mix_nth"), F.lit(block_docs)))
    return out.select(*docs.columns, *[F.col(f"mix_{n}").cast("long").alias(f"mix_{n}") for n in added])


def in_mixed_order(docs: DataFrame, source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """docs in the mixed order, range-partitioned, with its own columns only, whatever their names."""
    nested = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.struct(*docs.columns).alias("row"))
    return mix(nested, "source", "key", **options).orderBy("mix_order").select("row.*")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents").select("doc_id", "source"))
