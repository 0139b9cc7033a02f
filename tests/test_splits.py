"""Quoted CSV and JSON arrays read in parallel within a file, against the whole-file readers, Python's own, and broken files."""

import csv
import io
import json
import random

import pytest

from verdigris.sources import readers, splits


@pytest.fixture
def small_splits(spark):
    """Byte ranges of a few dozen bytes, so records span many."""

    def set_to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def messy(rng, n):
    return "".join(rng.choice(['"', '""', "\n", ",", "\n\n", "a", "bc", " ", "é", "日本", '","', "\\", "'"]) for _ in range(n))


@pytest.mark.parametrize("size", [40, 300, 10**6])
def test_csv_equals_whole_file_reader_and_python(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    want = []
    for k in range(3):
        table = [[str(i), messy(rng, rng.choice([0, 1, 3, 20, 80])), messy(rng, 2)] for i in range(30)]
        with open(tmp_path / f"{k}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n" if k else "\r\n")
            w.writerows([["id", "a,\nb", "c"], *table])
        want += [tuple(x or None for x in r) for r in table]
    small_splits(size)
    df = splits.read_csv_splits(spark, str(tmp_path))
    assert df.columns == ["id", "a,\nb", "c"]
    assert rows(df) == sorted(want, key=repr)
    if size < 1000:
        assert splits.pieces(spark, str(tmp_path), splits.Csv()).rdd.getNumPartitions() > 10
    small_splits(10**8)
    (tmp_path / "0.csv").unlink()  # with \r\n beside \n in fields, where that reader keeps a \r
    whole = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path))
    assert rows(whole) == sorted(want[30:], key=repr)


def test_csv_oddities_equal_whole_file_reader(spark, tmp_path, small_splits):
    text = 'x;y\n1;a"b\n2;"q;\n""r"""\n\n3;"open\n4;"still; open ""\n'
    (tmp_path / "odd.csv").write_text(text)
    whole = spark.read.options(header=True, multiLine=True, escape='"', sep=";").csv(str(tmp_path / "odd.csv")).collect()
    for size in (5, 16):
        small_splits(size)
        assert rows(splits.read_csv_splits(spark, str(tmp_path / "odd.csv"), ";")) == rows(spark.createDataFrame(whole))
    (tmp_path / "head.csv").write_text("x,y\n")
    assert splits.read_csv_splits(spark, str(tmp_path / "head.csv")).collect() == []


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "large.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["id", "text"])
        for i in range(200_000):
            w.writerow([i, f'line {i}\n"said" so, {"x" * 60}'])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        df = readers.read_csv(spark, str(tmp_path / "large.csv"))
        assert df.rdd.getNumPartitions() >= 15
        assert df.selectExpr("count(*)", "count(distinct id)", "sum(length(text))").first()[:2] == (200_000, 200_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("size", [64, 500, 10**6])
def test_json_arrays_equal_python(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    tricky = ["}", "{", "]", "[", '"', "\\", '\\"', "},{", "\n", "é", "日本", "", '{"a":1}', "x" * 200]
    want = []
    for k, indent in enumerate((None, 2, 0)):
        items = [{"id": i, "t": "".join(rng.choices(tricky, k=rng.choice([0, 1, 4]))), "n": {"a": [{}, {"b": rng.choice(tricky)}]}} for i in range(15)]
        (tmp_path / f"{k}.json").write_text(json.dumps(items, indent=indent, ensure_ascii=bool(k)) + "\n" * k)
        want += items
    (tmp_path / "empty.json").write_text(" [ ] ")
    (tmp_path / "blank.json").write_text("")
    small_splits(size)
    got = [json.loads(r["value"]) for r in splits.scan_json_array(spark, str(tmp_path)).collect()]
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(got, key=key) == sorted(want, key=key)
    typed = splits.scan_json_array(spark, str(tmp_path), "id long, t string")
    assert rows(typed) == sorted(((x["id"], x["t"]) for x in want), key=repr)


BROKEN = {
    '{"a": 1}': "is not a JSON array", 'x [{"a": 1}]': "is not a JSON array", '[{"a": 1}': "Incomplete", '[{"a": 1': "Incomplete", '[{"a": "x': "Incomplete",
    '[{"a": 1}] {"b": 2}': "Unexpected content", '[{"a": 1}] x': "Unexpected content", '[1, {"a": 1}]': "no object", '[{"a": {"b": 1}, {"c": 2}]': "Incomplete", "[": "Incomplete", '[{"a": 1}, 7]': "Incomplete|no object|Unexpected",
}


@pytest.mark.parametrize("text", BROKEN)
def test_broken_arrays_fail(spark, tmp_path, small_splits, text):
    (tmp_path / "broken.json").write_text(text)
    for size in (3, 1000):
        small_splits(size)
        with pytest.raises(Exception, match=BROKEN[text]):
            splits.scan_json_array(spark, str(tmp_path / "broken.json")).collect()


def test_states_of_ranges_compose():
    rng = random.Random(1)
    for machine, alphabet in ((splits.Csv(), '",\na'), (splits.JsonArray(), '{}[]"\\",a')):
        for _ in range(300):
            text = "".join(rng.choices(alphabet, k=40))
            parts = text.split(machine.separator)
            for state in (0, 1):
                s = state
                for p in parts:
                    s, _ = machine.step(p, s)
                assert s in (0, 1)
    reader = csv.reader(io.StringIO('"a\nb",c\n'))
    assert next(reader) == ["a\nb", "c"] and splits.Csv().step('"a', 0) == (1, 0) and splits.Csv().step('b",c', 1) == (0, 0)
