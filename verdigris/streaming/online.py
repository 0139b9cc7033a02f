"""Streams: online confusion counts, windowed rates, keyed upserts per micro-batch, resumable ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import CELLS, cells, rates
from ..sources.deltas import KeyedTable


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def running_confusion(stream: DataFrame, label: str = "Label", pred: str = "Prediction") -> DataFrame:
    """M2: tp, tn, fp, fn and the rates so far, in complete mode; the state is one row."""
    return stream.groupBy().agg(*cells(label, pred)).select("*", *rates())


def tallies(stream: DataFrame, keys: list[str], sample: str, ts: str, late: str = "1 hour", idle_seconds: int = 7200, shards: int = 16, label: str = "Label", pred: str = "Prediction") -> DataFrame:
    """M2: running confusion counts per dataset, in append mode.

    A sample that comes again, as from a replayed file, is recognised by its keys and id until the watermark has passed its first
    time; rows later than the watermark are left out. A dataset is counted in `shards` parts, so a hot one is many tasks'
    work. A part's state ends when no row has come for idle_seconds of event time, so both states are bounded by
    what arrives within `late` and idle_seconds. Each batch gives the counts so far of the parts it touched:
    part (keys, shard, since as JSON), the cells, n (which grows with every row), and whether the part has ended.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    once = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, sample])
    kinds = dict(stream.dtypes)
    y, p = F.col(label), F.col(pred)
    flags = [((y == a) & (p == b)).cast("long").alias(c) for c, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))]
    total = (y.isin(0, 1) & p.isin(0, 1)).cast("long").alias("total")
    counted = once.select(*keys, F.pmod(F.xxhash64(sample), F.lit(shards)).cast("int").alias("shard"), F.col(ts).alias("at"), *[F.coalesce(f, F.lit(0)).alias(c) for f, c in zip([*flags, total], CELLS)])
    names = [*CELLS, "n"]

    def tally(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        since, *counts = state.get if state.exists else (None, *[0] * len(names))
        if state.hasTimedOut:
            state.remove()
            ended = True
        else:
            ended, last = False, 0
            for b in batches:
                times = b["at"].astype("datetime64[ms]").astype("int64")
                since = int(times.min()) if since is None else min(since, int(times.min()))
                last = max(last, int(times.max()))
                for i, c in enumerate(CELLS):
                    counts[i] += int(b[c].sum())
                counts[-1] += len(b)
            state.update((since, *counts))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_seconds * 1000)
        yield pd.DataFrame([[*key, since, *counts, ended]], columns=[*keys, "shard", "since", *names, "ended"])

    longs = ", ".join(f"{c} long" for c in names)
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", shard int, since long, {longs}, ended boolean"
    got = counted.groupBy(*keys, "shard").applyInPandasWithState(tally, out, f"since long, {longs}", "append", GroupStateTimeout.EventTimeTimeout)
    return got.select(F.to_json(F.struct(*keys, "shard", "since")).alias("part"), *keys, *names, "ended")


def tally_rates(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Cells and rates of each dataset from the newest counts of its parts (as a KeyedTable of tallies() by part and n holds them)."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in CELLS]).select("*", *rates())


def windowed(stream: DataFrame, ts: str, width: str, late: str | None, keys: list[str], value: str) -> DataFrame:
    """An extension: counts and sums per event-time window. In append mode a window comes out once, when the watermark has
    passed its end, and rows later than the watermark are left out. Without `late`, for complete mode: every window and every
    row, whenever it comes; rows without a time have a window of their own, whose start is null."""
    if late is not None:
        return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")
    at = F.coalesce(F.col(ts), F.timestamp_seconds(F.lit(0)))  # window() leaves nulls out
    counted = stream.groupBy(F.window(at, width).alias("w"), F.col(ts).isNotNull().alias("timed_"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(F.when(F.col("timed_"), F.col("w.start")).alias("start"), *keys, "n", "total")


def upsert_batches(stream: DataFrame, table: KeyedTable, checkpoint: str, compact_every: int = 8):
    """K8, K9: each micro-batch becomes a delta of the table; a repeated batch changes nothing, a killed one is not seen."""

    def write(batch: DataFrame, epoch: int) -> None:
        table.upsert(batch, epoch)
        if (epoch + 1) % compact_every == 0:
            table.compact()
            table.expire()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(stream) -> list[dict]:
    """Rows and rows per second of each finished micro-batch of a running or ended query."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "read_per_second": p.get("inputRowsPerSecond") or 0.0, "done_per_second": p.get("processedRowsPerSecond") or 0.0} for p in stream.recentProgress]


def by_key_range(df: DataFrame, key: str, width: int, path: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """A table in micro-batches of `width` keys, each written to its own folder; a range whose folder is whole is not done again.

    Ranges without rows are skipped. Returns the number of ranges done by this call.
    """
    from ..sources.sinks import exists

    spark, n = df.sparkSession, 0
    for r in df.where(F.col(key).isNotNull()).select(F.floor(F.col(key) / width).alias("r")).distinct().orderBy("r").toLocalIterator():
        folder = f"{path}/range={r['r']}"
        if exists(spark, f"{folder}/_SUCCESS"):
            continue
        part = df.where((F.col(key) >= r["r"] * width) & (F.col(key) < (r["r"] + 1) * width))  # pushed down to the scan
        work(part).write.mode("overwrite").parquet(folder)
        n += 1
    return n
