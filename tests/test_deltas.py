"""Keyed tables of a base and deltas: bytes by batch, dead writers, repeats, compaction, old versions."""

import os

import pytest
from pyspark.sql import functions as F

from verdigris.sources.deltas import KeyedTable
from verdigris.streaming import online

SCHEMA = "k long, v string, at long"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", "at", buckets=4)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)


def test_empty_table_and_empty_batches(spark, table):
    assert table.read().collect() == [] and table.versions() == []
    table.upsert(spark.createDataFrame([], SCHEMA))
    assert table.read().collect() == [] and table.compact()["number"] == 0
    table.expire()
    assert table.read().schema == spark.createDataFrame([], SCHEMA).schema


def test_equals_a_dict(spark, table):
    import random

    rng, want = random.Random(2), {}
    for batch in range(7):
        part = [(rng.choice([None, *range(30)]), f"{batch}-{i}", rng.randrange(5)) for i in range(20)]
        part = list({(k, at): (k, v, at) for k, v, at in part}.values())  # a version of a key once a batch
        table.upsert(spark.createDataFrame(part, SCHEMA), batch)
        for k, v, at in part:
            if k not in want or at >= want[k][2]:
                want[k] = (k, v, at)
        if batch % 3 == 2:
            table.compact(layers=2)
        assert rows(table.read()) == sorted(want.values(), key=repr)
    before = rows(table.read(table.versions()[-2]))
    table.expire()
    assert len(table.versions()) == 2 and rows(table.read(table.versions()[0])) == before
    table.compact(layers=1)
    assert rows(table.read()) == sorted(want.values(), key=repr)
    assert max(sum(b == x for _, x, _ in table.manifest()["layers"]) for b in range(4)) == 1


def test_a_batch_writes_what_it_holds_and_a_repeat_nothing(spark, table):
    table.upsert(spark.range(200_000).select(F.col("id").alias("k"), F.uuid().alias("v"), F.lit(0).cast("long").alias("at")), 0)
    whole = size(table.path)
    table.upsert(spark.createDataFrame([(5, "new", 1)], SCHEMA), 1)
    assert size(table.path) - whole < whole / 100
    manifest = table.manifest()
    assert table.upsert(spark.createDataFrame([(5, "other", 9)], SCHEMA), 1) == manifest
    assert [r["v"] for r in table.read().where("k = 5").collect()] == ["new"]


def test_a_dead_writer_is_not_seen_and_swept(spark, table):
    table.upsert(spark.createDataFrame([(1, "a", 0)], SCHEMA))
    broken = spark.createDataFrame([(1, "b", 1), (2, "c", 1)], SCHEMA).withColumn("v", F.when(F.col("k") == 2, F.raise_error("killed")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        table.upsert(broken)
    table._write(spark.createDataFrame([(1, "lost", 7, 1)], SCHEMA + ", age_ long"), 1)  # died before its commit
    assert rows(table.read()) == [(1, "a", 0)]
    table.expire()
    assert len(os.listdir(f"{table.path}/data")) == 1 and rows(table.read()) == [(1, "a", 0)]


def test_two_writers_of_one_version(spark, table):
    now = table.manifest()
    table.upsert(spark.createDataFrame([(1, "a", 0)], SCHEMA))
    with pytest.raises(FileExistsError):
        table._commit(now, None, [])
    assert rows(table.read()) == [(1, "a", 0)]


def test_stream_upserts_with_a_replayed_batch(spark, tmp_path, table):
    for i in range(4):
        spark.createDataFrame([(k, f"{i}", i) for k in range(i, i + 3)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = online.file_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1)
    online.upsert_batches(stream, table, str(tmp_path / "state"), compact_every=3).awaitTermination()
    want = [(0, "0", 0), (1, "1", 1), (2, "2", 2), (3, "3", 3), (4, "3", 3), (5, "3", 3)]
    assert rows(table.read()) == want
    table.upsert(spark.createDataFrame([(0, "again", 9)], SCHEMA), 2)  # an epoch the table has
    assert rows(table.read()) == want
