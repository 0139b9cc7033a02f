"""Queries of the third round's findings on tables with odd rows, against their SQL."""

import random

import duckdb
import pytest

from verdigris.plans import library

REG = library()

#: The SQL of the range queries sorts twice by (s, e), which leaves the order of equal rows open, and takes each sort's own order:
#: so DuckDB gives other rows from run to run. Here the second sort keeps the first's order.
OPEN, KEPT = "ORDER BY s, e ROWS UNBOUNDED", "ORDER BY s, e, b NULLS FIRST ROWS UNBOUNDED"


def rows(cols, data):
    return sorted((tuple(r[c] for c in sorted(cols)) for r in data), key=repr)


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL."""
    duck = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = REG.QUERIES[name](spark, str(folder)).toArrow(), duck.sql(REG.ORACLES[name].replace(OPEN, KEPT)).to_arrow_table()
    return rows(got.column_names, got.to_pylist()), rows(want.column_names, want.to_pylist())


def odd_lines(spark):
    """Copies, null keys and quantities, ends before starts, fractions; small groups, so that some have nothing else."""
    rng = random.Random(11)
    some = lambda *x: rng.choice(x)
    lines = [(some(None, *range(60)), some(None, *range(25)), some(None, None, -3.0, -4.0, 2.5, 3.5, 0.0, 1.0, 4.0)) for _ in range(400)]
    lines += [(some(None, 100), some(None, *range(300)), some(None, -4.0, 0.0, 4.0)) for _ in range(300)]
    return spark.createDataFrame(lines * 2 + lines[:100], "l_suppkey long, l_partkey long, l_quantity double")


@pytest.mark.parametrize("name", ["u7_merge_ranges_array", "u7_range_islands"])
def test_ranges_of_odd_rows(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, lineitem=odd_lines(spark))
    assert got == want
    assert any(None in r for r in want)


def test_every_window_is_counted(spark, tmp_path):
    """Open windows, rows far behind the newest, rows without a time, type or value."""
    events = [(t, k, v) for t in (None, 1_700_000_000, 1_700_003_700, 1_600_000_000, 1_700_010_000) for k in ("a", None) for v in (1.5, None)]
    df = spark.createDataFrame(events * 3, "t long, event_type string, value double").selectExpr("CAST(timestamp_seconds(t) AS timestamp_ntz) AS ts", "event_type", "value")
    got, want = against_sql(spark, tmp_path, "m2_windowed_counts", events=df)
    assert got == want and len(got) == 10 and sum(r[1] for r in got) == 60


def test_complete_windows_keep_late_batches(spark, tmp_path):
    from pyspark.sql import functions as F
    from verdigris.plans.storage import _run
    from verdigris.streaming import online

    for seconds in ([10, 90_000], [20, 3700], [None, 30]):  # a file and so a batch each
        spark.createDataFrame([(s, "k", 1) for s in seconds], "s long, k string, v int").select(F.timestamp_seconds("s").alias("ts"), "k", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = online.windowed(online.file_stream(spark, str(tmp_path / "in"), "ts timestamp, k string, v int", files_per_trigger=1), "ts", "1 hour", None, ["k"], "v")
    got = _run(stream, str(tmp_path / "out"), "complete").collect()
    assert {r["start"] and int(r["start"].timestamp()): (r["n"], r["total"]) for r in got} == {0: (3, 3), 3600: (1, 1), 90_000: (1, 1), None: (1, 1)}


@pytest.mark.parametrize("held", [None, 0])
def test_node_features_shuffle_no_vectors(spark, tmp_path, monkeypatch, held):
    """A node with most rows, tokens without a vector, null tokens, nulls in vectors and for them, two vectors of one token."""
    from verdigris.operators import similarity

    if held is not None:
        monkeypatch.setattr(similarity, "HELD_BYTES", held)
    rng = random.Random(5)
    lines = [(rng.choice((7, rng.randrange(40))), rng.randrange(1, 4), rng.choice((None, *range(2300))), rng.choice("ANR")) for _ in range(1500)]
    vectors = [(i, None if i % 50 == 3 else [None if (i + d) % 90 == 0 else rng.uniform(-1, 1) for d in range(64)]) for i in (*range(0, 1000, 2), *range(0, 1000, 100))]
    got, want = against_sql(
        spark, tmp_path, "g1_node_features",
        lineitem=spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string"),
        embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<float>"),
    )
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(a[3:] == pytest.approx(b[3:], abs=2e-4) for a, b in zip(got, want))
    plan = REG.QUERIES["g1_node_features"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # a row for each of a vector's numbers
