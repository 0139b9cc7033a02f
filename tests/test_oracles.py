"""Every registered query of the library against its SQL, and row checks for those without."""

import os
import re
from collections import defaultdict

import duckdb
import pytest

from verdigris.plans import library
from verdigris.session import TABLES

REG = library()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canonical(table):
    cols = sorted(table.column_names)
    return sorted(tuple(repr(r[c]) for c in cols) for r in table.select(cols).to_pylist())


def schema(table):
    return sorted((f.name, str(f.type).replace("large_", "")) for f in table.schema)


@pytest.mark.parametrize("name", sorted(REG.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = REG.QUERIES[name](spark, sf).toArrow(), duck.sql(REG.ORACLES[name]).to_arrow_table()
    assert schema(got) == schema(want)
    assert canonical(got) == canonical(want)


def test_queries_without_sql_are_those_checked_below():
    assert set(REG.QUERIES) - set(REG.ORACLES) == {"c1_changed_ranges", "c3_split_oversized", "c4_c5_structural_chunks", "q14_contrastive_pairs", "q14_changed_chunks"}


def gathered(df, key):
    out = defaultdict(list)
    for r in df.collect():
        out[tuple(r[k] for k in key)].append(r)
    return out


def test_lines_outside_changed_ranges_are_equal(spark, sf):
    got = {(r.conv_id, r.k): r for r in REG.QUERIES["c1_changed_ranges"](spark, sf).collect()}
    turns = gathered(spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn"), ["conv_id"])
    pairs = 0
    for (conv,), rows in turns.items():
        for k, (a, b) in enumerate(zip((r for r in rows if r.role == "user"), (r for r in rows if r.role == "assistant"))):
            r = got.pop((conv, k), None) or got.pop((conv, k + 1))
            left, right = a.text.split("\n"), b.text.split("\n")
            same = [[x for i, x in enumerate(lines, 1) if not any(s.start <= i <= s.end for s in spans)] for lines, spans in ((left, r.before), (right, r.after))]
            assert same[0] == same[1] and (left == right) == (not r.before and not r.after)
            pairs += 1
    assert pairs and not got


def test_oversized_parts_of_every_document(spark, sf):
    parts = gathered(REG.QUERIES["c3_split_oversized"](spark, sf), ["doc_id"])
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(parts) == len(docs)
    for d in docs:
        rows = sorted(parts[(d.doc_id,)], key=lambda r: r.start)
        assert "\n".join(r.text for r in rows) == (d.text or "")
        assert rows[0].start == 1 and all(a.end + 1 == b.start for a, b in zip(rows, rows[1:]))
        assert all(r.end - r.start == r.text.count("\n") for r in rows)
        assert all(r.end == r.start or len(re.findall(r"\w+|[^\w\s]", r.text)) <= 64 for r in rows)


def test_structural_chunks_of_every_document(spark, sf):
    chunks = gathered(REG.QUERIES["c4_c5_structural_chunks"](spark, sf), ["doc_id"])
    solid = lambda t: re.sub(r"\s", "", t)
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        rows = sorted(chunks[(d.doc_id,)], key=lambda r: r.start)
        assert solid("".join(r.text for r in rows)) == solid(d.text or "")
        assert all(len(solid(r.text)) <= 1800 or r.start == r.end for r in rows)  # a line is not cut


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 1 and "f1" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pairs_of_the_export(spark, sf):
    """q14: lists, filters, joins, pairs, ranges and splits by plain loops."""
    import hashlib

    turns = [r.asDict() for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    taken = {r["conv_id"] for r in turns if r["turn"] * 60 <= 200 and r["conv_id"] % 11 != 3}
    taken = {c for c in taken if c % 4 or c % 90 <= 60}
    methods = defaultdict(list)
    for r in sorted(turns, key=lambda r: (r["conv_id"], r["turn"])):
        c = r["conv_id"]
        code = "same\ntext" if c % 5 == 0 else r["text"]
        if c in taken and code is not None and code.strip(" ") and len(code) <= 2000:
            key = "sig::sig" if c % 3 == 0 else f"name::m{r['turn'] // 2 % 2}"
            methods[c, key].append((r["role"] == "user", r["turn"] + 1, code))
    want = {}
    for (c, key), rows in methods.items():
        cve = f"CVE-{c % 7}" if c % 2 == 0 else None
        cwe = str(c % 7 + 70) if c % 2 == 0 and c % 7 < 5 else None
        for k, (b, a) in enumerate(zip((r for r in rows if r[0]), (r for r in rows if not r[0]))):
            if b[2] == a[2]:
                continue
            pair = f"{cve}::h{c}::{c}::f{c}.c::{key}"
            h = int(hashlib.md5(f"42::{pair}".encode()).hexdigest()[:8], 16) % 100
            want[pair, k + 1] = ("train" if h < 80 else "validate" if h < 90 else "test", cve, cwe, b[1], a[1], b[2], a[2])
    got = {(r["pair_id"], r["nth"]): r for r in REG.QUERIES["q14_contrastive_pairs"](spark, sf).collect()}
    assert got.keys() == want.keys() and got
    assert {k: (r["split"], r["cve_id"], r["cwe_id"], r["before_id"], r["after_id"]) for k, r in got.items()} == {k: w[:5] for k, w in want.items()}
    ranges = {k: [[tuple(map(int, x)) for x in re.findall(r"\{(\d+), (\d+)\}", r[s])] for s in ("before_ranges", "after_ranges")] for k, r in got.items()}
    chunks = gathered(REG.QUERIES["q14_changed_chunks"](spark, sf), ["pair_id", "nth"])
    for k, (*_, before, after) in want.items():
        meant = []
        for side, code, changed in (("before", before, ranges[k][0]), ("after", after, ranges[k][1])):
            lines = code.removesuffix("\n").split("\n")
            for i in range(0, len(lines), 2):
                s, e = i + 1, min(i + 2, len(lines))
                if any(s <= b and a <= e for a, b in changed):
                    meant.append((side, i // 2, s, e, "1" if side == "before" else "0", "\n".join(lines[i : i + 2])))
        if len({m[0] for m in meant}) < 2:
            meant = []
        assert sorted((r["side"], r["chunk_id"], r["start_line"], r["end_line"], r["label"], r["chunk_text"]) for r in chunks.pop(k, [])) == sorted(meant)
    assert not chunks


def test_queries_on_empty_tables(spark, sf, tmp_path):
    """No query fails where no table has a row."""
    for t in TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    failed = {}
    for name, query in sorted(REG.QUERIES.items()):
        try:
            query(spark, str(tmp_path)).toArrow()
        except Exception as e:
            failed[name] = str(e)[:300]
    assert not failed
