"""Scans, order statistics, sketches, skewed joins, incremental metrics, stateful streams and nested records, against plain loops."""

import json
import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from verdigris.operators import calibration as C
from verdigris.operators import chunks as K
from verdigris.operators import incremental, metrics, ranking, scans, sketches
from verdigris.operators import relational as Q
from verdigris.operators import tables as L
from verdigris.sources import readers as S
from verdigris.sources.deltas import KeyedTable
from verdigris.streaming import online


def plan(df):
    return df._jdf.queryExecution().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- scans ----------------------------------------------------------------------------------


def test_scan_of_one_group_and_of_many(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else None if rng.random() < 0.1 else f"g{rng.randrange(40)}", i, rng.choice([None, *range(-9, 9)])) for i in rng.sample(range(10**6), 3000)]
    df = spark.createDataFrame(data, "g string, o long, v long")
    v = F.col("v")
    for by in (["g"], []):
        want, seen = [], {}
        for g, o, x in sorted(data, key=lambda r: r[1]):
            s, m, _ = seen.get(g if by else 0, (None, None, 0))
            want.append((g, o, x, s, m))
            if x is not None:
                s, m = (s or 0) + x, x if m is None else max(m, x)
            seen[g if by else 0] = (s, m, 0)
        want = [(*w, seen[w[0] if by else 0][0]) for w in want]
        for chunk_rows in (10**6, 100):
            got = scans.scan(df, by, ["o"], {"s": ("sum", v), "m": ("max", v)}, {"t": v}, chunk_rows=chunk_rows)
            assert rows(got.select("g", "o", "v", "s", "m", "t")) == sorted(want, key=repr)
    cut, large = scans.chunked(df, [], "o", chunk_rows=100)
    assert large and cut.groupBy("chunk_").count().agg(F.max("count")).first()[0] <= 3 * 3000 / scans.PARTS + 10  # no task holds the group
    assert scans.scan(df.limit(0), ["g"], ["o"], {"s": ("sum", v)}).collect() == []


def test_scan_with_null_and_repeated_orders(spark):
    df = spark.createDataFrame([(None, 1)] * 40 + [(7, 1)] * 300 + [(i, 1) for i in range(200)], "o long, v long")
    got = scans.scan(df, [], ["o"], {"s": ("sum", F.col("v"))}, chunk_rows=50).orderBy(F.coalesce("s", F.lit(0))).collect()
    assert [r["s"] or 0 for r in got] == list(range(540))
    assert [r["o"] is None for r in got] == [True] * 40 + [False] * 500 and [r["o"] for r in got[40:]] == sorted(r["o"] for r in got[40:])


@pytest.mark.parametrize("chunk_rows", [50, 10**6])
def test_islands_positions_and_runs_of_one_group(spark, chunk_rows):
    rng = random.Random(3)
    spans = [(a, a + rng.choice([0, 1, 2, 60])) for a in (rng.randrange(8000) for _ in range(1500))]
    want = []
    for a, b in sorted(spans):
        if want and a <= want[-1][1] + 1:
            want[-1] = (want[-1][0], max(want[-1][1], b))
        else:
            want.append((a, b))
    df = spark.createDataFrame([("x", *s) for s in spans], "g string, s long, e long")
    assert rows(Q.islands(df, ["g"], "s", "e", chunk_rows)) == sorted((("x", *w) for w in want), key=repr)
    texts = [(1, i, "l\n" * rng.randrange(5)) for i in range(400)]
    at, placed = 1, []
    for g, i, t in texts:
        n = t.count("\n")
        placed.append((g, i, at, at + n - 1))
        at += n
    got = K.running_positions(spark.createDataFrame(texts, "g long, i long, t string"), ["g"], "i", "t", chunk_rows)
    assert rows(got.select("g", "i", "start_line", "end_line")) == sorted(placed, key=repr)
    ids = [(1, i, [rng.randrange(9) for _ in range(rng.randrange(7))]) for i in range(500)]
    flat = [x for _, _, xs in ids for x in xs]
    runs = K.pack_tokens(spark.createDataFrame(ids, "g long, o long, ids array<int>"), "g", "o", "ids", 16, chunk_rows)
    assert rows(runs.select("run", "ids")) == sorted(((k, flat[16 * k : 16 * k + 16]) for k in range(len(flat) // 16 if len(flat) % 16 else len(flat) // 16 - 1)), key=repr)


def test_range_semi_join_of_nested_ranges(spark):
    rng = random.Random(5)
    lines = [(rng.choice("ab"), a, a + rng.choice([0, 3, 200])) for a in (rng.randrange(2000) for _ in range(400))] * 2
    ranges = [("a", a, a + rng.choice([0, 5, 700])) for a in (rng.randrange(2000) for _ in range(12))]
    want = [r for r in lines if any(r[0] == g and r[1] <= e and s <= r[2] for g, s, e in ranges)]
    schema = "g string, s long, e long"
    assert rows(Q.range_semi_join(spark.createDataFrame(lines, schema), spark.createDataFrame(ranges, schema), ["g"], "s", "e")) == sorted(want, key=repr)


@pytest.mark.parametrize("values", [[], [None], [3.0], [7.0] * 9000, [float(i % 3) for i in range(10_001)], [10.0 ** (i % 600 - 300) for i in range(20_000)], [float("inf"), 1.0, 2.0, None]], ids=["none", "nulls", "one", "constant", "few", "skewed", "infinite"])
def test_exact_quantiles(spark, values):
    import numpy as np

    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    have = sorted(v for v in values if v is not None)
    got = {r["share"]: r["quantile"] for r in scans.quantiles(df, F.col("v"), shares).collect()}
    want = {s: float(np.quantile(have, s)) if have and have[-1] < float("inf") else None for s in shares}
    if not have or have[-1] < float("inf"):
        assert got == pytest.approx(want, rel=1e-12) if have else got == want
    else:
        assert got[0.0] == 1.0 and got[0.5] == 2.0 and got[1.0] == float("inf")
    s = C.spread(df, F.col("v"))
    assert s.first()["n"] == len(have) and not re.search(r"Window \[.*\n?.*windowspecdefinition\(v", plan(s))


def test_numbers_along_an_order_of_any_types(spark):
    data = [(random.Random(i).choice("abc"), None if i % 7 == 0 else i % 11, i) for i in range(500)]
    df = spark.createDataFrame(data, "a string, b int, c long")
    got = ranking.number_rows(df, [F.col("a"), F.col("b"), F.col("c")], "n").collect()
    assert [r["c"] for r in sorted(got, key=lambda r: r["n"])] == [c for *_, c in sorted(data, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))]
    assert sorted(r["n"] for r in got) == list(range(500))
    text = plan(L.synthetic_index(df, ["a", "b"]))
    assert "SinglePartition" not in text


# ---- sketches and skew ----------------------------------------------------------------------


def test_sketch_holds_all_its_keys_and_few_others(spark):
    keys = spark.range(0, 40_000, 2).withColumnRenamed("id", "k")
    sketch = sketches.Sketch(keys, "k")
    every = spark.range(200_000).withColumnRenamed("id", "k").where(sketch.may_hold())
    held = {r["k"] for r in every.collect()}
    assert held >= set(range(0, 40_000, 2))
    strangers = len(held) - 20_000
    assert strangers / 180_000 < 2 * sketch.rate < 0.05
    full = sketches.Sketch(keys, "k", most_bits=4096)  # too small to be of use: everything passes
    assert spark.range(100).withColumnRenamed("id", "k").where(full.may_hold()).count() == 100


def test_sketched_joins_equal_plain_ones(spark):
    df = spark.createDataFrame([(None if i % 13 == 0 else i % 500, str(i % 3), i) for i in range(5000)], "k long, s string, i long")
    keys = spark.createDataFrame([(k, "1") for k in [None, *range(0, 700, 5)] * 2], "k long, s string")
    for key in ("k", ["k", "s"]):
        on = [key] if isinstance(key, str) else key
        seen = Observation()
        semi = rows(sketches.semi(df, keys, key, seen))
        assert semi == rows(df.join(keys.select(*on).distinct(), on, "left_semi").select(*df.columns))
        assert len(semi) <= seen.get["shuffled"] < len(semi) + 500  # of 5000 rows
        assert rows(sketches.anti(df, keys, key)) == rows(df.join(keys.select(*on).distinct(), on, "left_anti").select(*df.columns))
        flags = rows(sketches.flagged(df, keys, key, "hit").where("hit").drop("hit"))
        assert flags == semi
    assert sketches.semi(df, keys.limit(0), "k").collect() == [] and sketches.anti(df, keys.limit(0), "k").count() == 5000


def test_skew_join_equals_a_plain_join(spark):
    rng = random.Random(7)
    left = spark.createDataFrame([(rng.choice([None, 1, 1, 1, rng.randrange(400)]), f"r{i % 900}") for i in range(4000)], "k long, r string")
    right = spark.createDataFrame([(k % 300, f"x{k}") for k in range(450)] + [(None, "n")], "k long, x string")
    assert [json.loads(r["heavy_"])["k"] for r in Q.heavy_keys(left, ["k"]).where("heavy_ not like '%null%'").collect()] == [1]
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(Q.skew_join(left, right, ["k"], how, salts=8)) == rows(left.join(right, ["k"], how))
    spread = left.where("k = 1").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(8))).groupBy("salt").count()
    assert spread.count() == 8  # the third of all rows with one key is in eight tasks
    inner = Q.skew_join(left, right, ["k"], salts=8)
    assert plan(inner).count("Exchange hashpartitioning") + plan(inner).count("BroadcastExchange") <= 2


# ---- metrics by partition -------------------------------------------------------------------


def test_merged_states_equal_the_whole(spark, tmp_path):
    rng = random.Random(9)
    data = [(rng.choice([0, 1, 1, None]), rng.choice([0, 1, None]), rng.choice([None, 0.0, 1.0, 0.5, 0.29, round(rng.random(), 3)]), rng.choice("ab")) for _ in range(900)]
    df = spark.createDataFrame(data, "Label int, Prediction int, Prob double, d string")
    m = incremental.Metrics(spark, str(tmp_path / "m"), {"d": "string"})
    assert m.confusion(["d"]).collect() == [] and m.merged().count() == 0
    parts = [df.where(F.pmod(F.xxhash64("Prob", "Label", "d"), F.lit(3)) == i) for i in range(3)]
    assert [m.add(str(i), p) for i, p in enumerate(parts)] == [True] * 3
    assert not m.add("1", parts[1]) and not m.add("1", df)
    assert rows(m.confusion(["d"])) == rows(metrics.confusion(df, ["d"])) and rows(m.confusion()) == rows(metrics.confusion(df))
    assert rows(m.calibration()) == rows(C.calibration(df, m.bounds))
    assert rows(m.sweep()) == rows(C.sweep(df))
    assert m.add("empty", df.limit(0)) and rows(m.sweep()) == rows(C.sweep(df))


# ---- streams --------------------------------------------------------------------------------


def test_tallies_know_replays_leave_out_late_rows_and_end(spark, tmp_path):
    schema = "d string, i long, Label int, Prediction int, at timestamp"

    def put(name, values):
        made = spark.createDataFrame(values, "d string, i long, Label int, Prediction int, at long").withColumn("at", F.timestamp_seconds(F.col("at") + 1_700_000_000))
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))

    table = KeyedTable(spark, str(tmp_path / "t"), "part string, d string, tp long, tn long, fp long, fn long, total long, n long, ended boolean", "part", "n", buckets=2)
    progress = []

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = online.upsert_batches(online.tallies(stream, ["d"], "i", "at", late="1 hour", idle_seconds=1800, shards=2), table, str(tmp_path / "s"))
        q.awaitTermination()
        progress.extend(q.recentProgress)

    def state():
        return {r["d"]: (r["tp"], r["fp"], r["total"]) for r in online.tally_rates(table.read(), ["d"]).collect()}

    first = [("a", i, 1, 1, 10 * i) for i in range(50)] + [("b", i, 0, 1, 10 * i) for i in range(30)]
    put("1", first)
    run()
    assert state() == {"a": (50, 0, 50), "b": (0, 30, 30)}
    put("2", first)  # the file again
    run()
    assert state() == {"a": (50, 0, 50), "b": (0, 30, 30)}
    put("3", [("a", 1000, 1, 1, 20_000)])  # moves the watermark beyond the first rows by hours
    run()
    put("4", [("b", 2000, 0, 1, 100), ("a", 1001, 1, 1, 20_001)])  # one of them is late
    run()
    assert state() == {"a": (52, 0, 52), "b": (0, 30, 30)}
    last = [p for p in progress if p["stateOperators"]][-1]["stateOperators"]
    assert sum(s["numRowsTotal"] for s in last) <= 6  # 80 samples and two datasets' parts have gone from the states
    assert table.read().where("ended").count() >= 2


def test_windows_come_out_once_without_late_rows(spark, tmp_path):
    from verdigris.plans.storage import _run

    def put(seconds):
        spark.createDataFrame([(s, "k", 1) for s in seconds], "s long, k string, v int").select(F.timestamp_seconds("s").alias("ts"), "k", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    out = str(tmp_path / "out")
    for seconds, want in (([10, 20, 4000], []), ([30, 9000], [(0, 2 + 1)]), ([40, 20_000], [(0, 3), (3600, 1), (7200, 1)])):
        put(seconds)
        stream = online.windowed(online.file_stream(spark, str(tmp_path / "in"), "ts timestamp, k string, v int", files_per_trigger=1), "ts", "1 hour", "1 hour", ["k"], "v")
        got = _run(stream, out, "append")
        assert sorted((int(r["start"].timestamp()), r["n"]) for r in got.collect()) == want


# ---- nested records -------------------------------------------------------------------------


def plain_d2a(records):
    data = {}
    for r in records:
        if r.get("label_source") in (None, "after_fix_extractor"):
            continue
        file, name = r["bug_info"]["file"], r["bug_info"]["procedure"]
        key = next((t["func_key"] for t in r.get("trace") or [] if (t["file"], t["func_name"]) == (file, name)), None)
        code = next((f["code"] for _, f in sorted((r.get("functions") or {}).items()) if (f["file"], f["name"]) == (file, name)), None)
        start = re.search(r"\b(\d+):\d+-\d+:\d+\b", key) if key else None
        if code is None or start is None:
            continue
        at, lines = r["bug_info"]["line"] - int(start[1]), code.split("\n")
        if 0 <= at < len(lines):
            data.setdefault(key, set()).add(lines[at])
    return data


def test_d2a_records_equal_a_loop(spark):
    rng = random.Random(4)
    records = []
    for i in range(300):
        file, name = rng.choice("xy"), rng.choice("fg")
        key = f"{file} {rng.choice([1, 5])}:1-9:2 {i // 4}" if i % 9 else "no place"
        trace = [{"file": rng.choice("xy"), "func_name": rng.choice("fg"), "func_key": key, "n": [i]} for _ in range(rng.randrange(4))]
        functions = {str(j): {"file": rng.choice("xy"), "name": rng.choice("fg"), "code": "\n".join(f"{i // 4} line {n}" for n in range(rng.randrange(1, 6)))} for j in rng.sample(range(9), rng.randrange(4))}
        r = {"label_source": rng.choice(["before_fix_extractor", "after_fix_extractor"]), "label": i % 2, "bug_type": "t", "project": "p", "bug_info": {"file": file, "procedure": name, "line": rng.randrange(1, 9)}, "trace": trace, "functions": functions, "other": {"deep": [{}]}}
        for k in ("trace", "functions", "label_source"):
            if rng.random() < 0.1:
                del r[k]
        records.append(r)
    raw = spark.createDataFrame([(json.dumps(r),) for r in records] + [("{broken",), (None,), ("[]",)], "value string")
    got = {r["func_key"]: set(r["lines"]) for r in S.d2a(S.d2a_records(raw)).collect() if r["lines"]}
    assert got == plain_d2a(records)
