"""Contracts that SQL does not show: readers, sinks, failures, text scanners, streams, jobs."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from verdigris.functions import exprs as E
from verdigris.functions import responses as R
from verdigris.operators import calibration as C
from verdigris.operators import chunks as K
from verdigris.operators import merge as J
from verdigris.operators import metrics as M
from verdigris.operators import relational as Q
from verdigris.operators import sampling as Z
from verdigris.operators import similarity as V
from verdigris.plans import jobs
from verdigris.sources import readers as S
from verdigris.sources import sinks
from verdigris.sources.deltas import KeyedTable
from verdigris.streaming import online


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# ---- readers and sinks ----------------------------------------------------------------------


def test_json_forms(spark, tmp_path):
    rows = [{"index": 1, "code": "a\nb", "label": 0}, {"index": 2, "code": "c", "label": 1}]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "object.json").write_text(json.dumps(rows[0], indent=1))
    (tmp_path / "empty.json").write_text("  \n")
    (tmp_path / "bad.json").write_text('[{"index": 1, "co')
    n = {f: S.read_json_like(spark, str(tmp_path / f"{f}.json"), S.SAMPLE).count() for f in ("array", "lines", "object", "empty")}
    assert n == {"array": 2, "lines": 2, "object": 1, "empty": 0}
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        S.read_json_array(spark, str(tmp_path / "bad.json"), S.SAMPLE).collect()


def test_csv_with_breaks_and_any_spelling(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Index,Label,Prediction,prob,Response\n1, 1 ,0,0.25,"say ""hi"",\nthen go"\n2,0,x,,""\n')
    (tmp_path / "b.csv").write_text("Index,CWE,Label,Prediction,Prob\n3,CWE-79,1,1,0.75\n")
    a, b = (S.read_csv(spark, str(tmp_path / f)) for f in ("a.csv", "b.csv"))
    assert a.orderBy("Index").first().Response == 'say "hi",\nthen go'
    got = S.normalize_predictions(a).unionByName(S.normalize_predictions(b)).orderBy("Index").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 0.25, None), (2, 0, None, None, None), (3, 1, 1, 0.75, "CWE-79")]


def test_discovery_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.write_partitions(df, str(tmp_path / "out"), ["k"])
    found = S.discover(spark, [str(tmp_path / "out")], "*.json").collect()
    assert len(found) == 2
    with pytest.raises(PySparkException):
        sinks.write_partitions(df, str(tmp_path / "out"), ["k"])
    sinks.write_csv(df, str(tmp_path / "csv"), ["v", "k"])
    assert S.read_csv(spark, str(tmp_path / "csv")).columns == ["v", "k"]


def test_layouts(spark):
    big = spark.createDataFrame([({"0": ("f()", "", 1, "CWE-1", ""), "1": ("g()", "3", 0, "", "CVE-1")},)], "samples map<string,struct<code:string,line:string,vul:int,cwe:string,cve:string>>")
    assert {tuple(r) for r in S.bigvul(big).collect()} == {(0, "f()", None, 1, "CWE-1", None), (1, "g()", "3", 0, None, "CVE-1")}
    div = spark.createDataFrame([("a", ["", None], "m"), ("b", ["CWE-1"], "m")], "code string, cwe array<string>, message string")
    assert [tuple(r) for r in S.diversevul(div).collect()] == [("a", None), ("b", ["CWE-1"])]
    d2a = spark.createDataFrame(
        [("x", 1, 12, "k1", "f.c 10:1-20:2 z", "l10\nl11\nl12"), ("x", 0, 11, "k1", "f.c 10:1-20:2 z", "l10\nl11\nl12"), ("after_fix_extractor", 1, 1, "k2", "1:1-2:2", "c"), ("x", 1, 1, "k3", "nowhere", "c")],
        "label_source string, label int, bug_line int, func_key string, location string, code string",
    )
    assert [tuple(r) for r in S.d2a(d2a).collect()] == [("k1", 1, "l10\nl11\nl12", ["l11", "l12"])]
    cols = spark.createDataFrame([(["f", "g"], [True, False], [False, False])], "functionSource array<string>, `CWE-119` array<boolean>, `CWE-120` array<boolean>")
    assert [tuple(r) for r in S.draper(cols, ["CWE-119", "CWE-120"]).collect()] == [(0, "f", ["CWE-119"], 1), (1, "g", None, 0)]
    with pytest.raises(ValueError):
        S.mvuld(cols)


def test_once_replace_and_upsert(spark, tmp_path):
    path = str(tmp_path / "job")
    calls = []

    def job():
        calls.append(1)
        return spark.range(3)

    assert sinks.once(spark, path, job).count() == sinks.once(spark, path, job).count() == 3 and len(calls) == 1
    (tmp_path / "part").mkdir()
    with pytest.raises(FileExistsError):
        sinks.once(spark, str(tmp_path / "part"), job)
    sinks.replace_folder(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    a = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, t int, v string")
    b = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], "k int, t int, v string")
    assert {(r.k, r.v) for r in sinks.upsert(a, b, "k", "t").collect()} == {(1, "c"), (2, "b"), (3, "e")}


# ---- merges and metrics ---------------------------------------------------------------------


def test_override_ignores_reviews_of_negatives_and_bad_reviews(spark):
    small = spark.createDataFrame([(1, 1, 1, 0.9), (2, 0, 0, 0.1), (3, 1, 1, 0.8), (4, 0, 1, 0.7)], "Index long, Label int, Prediction int, Prob double")
    review = spark.createDataFrame([(1, " 0 "), (2, "1"), (3, "maybe")], "Index long, ReviewPrediction string")
    got = {r.Index: (r.FinalPrediction, r.DecisionSource) for r in J.override(small, review).collect()}
    assert got == {1: (0, E.OVERRIDE), 2: (0, E.UNREVIEWED_NEGATIVE), 3: (1, E.MISSING_REVIEW), 4: (1, E.MISSING_REVIEW)}


def test_strict_joins_fail(spark):
    a = spark.createDataFrame([(1, 1, 1, 0.5), (2, 0, 1, 0.5)], "Index long, Label int, Prediction int, Prob double")
    with pytest.raises(PySparkException, match="no match for 2"):
        J.strict_join(a, a.where("Index = 1").select("Index", F.lit(1).alias("x")), "Index").collect()
    with pytest.raises(PySparkException, match="differ"):
        J.checked_merge(a, a.where("Index = 1"), "union").collect()
    assert J.checked_merge(a, a, "union").count() == 2
    with pytest.raises(PySparkException, match="too few"):
        Z.one_to_n(a.select(F.col("Index").alias("index"), F.col("Label").alias("label")), 3).collect()


def test_zero_denominators_and_flat_correlation(spark):
    e = spark.createDataFrame([], "Label int, Prediction int, Prob double")
    r = M.confusion(e).first()
    assert (r.total, r.accuracy, r.f1, r.fpr) == (0, 0.0, 0.0, 0.0)
    c = spark.createDataFrame([(1, 1, 0.5), (0, 1, 0.5)], e.schema)
    assert C.correlation(c, F.col("Prob"), F.col("Label")).first().pearson is None


def test_bins_follow_their_edges(spark):
    bounds = C.edges("0", "1", "0.1")
    got = [one(spark, C.bin_of(F.lit(x), bounds).alias("b")).b for x in (0.0, 0.1, 0.3, 0.7, 0.95, 1.0, -0.1, 1.1)]
    assert got == [0, 1, 3, 7, 9, 9, None, None]


def test_majority_and_vote_of_absent_models(spark):
    t = spark.createDataFrame([(1, None, 0), (None, None, None), (1, 1, 0), (0, None, None)], "a int, b int, c int")
    assert [r.m for r in t.select(J.majority_of_three("a", "b", "c").alias("m")).collect()] == [None, None, 1, 0]


def test_folds_cover_every_row_once(spark):
    df = spark.range(103).select(F.col("id").alias("index"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    f = Z.stratified_folds(df, 5)
    assert f.count() == f.select("index").distinct().count() == 103
    n = {(r.label, r.fold): r["count"] for r in f.groupBy("label", "fold").count().collect()}
    assert all(max(v for (a, _), v in n.items() if a == k) - min(v for (a, _), v in n.items() if a == k) <= 1 for k in (0, 1))


# ---- text, chunks, ranges -------------------------------------------------------------------


def test_text_expressions(spark):
    r = one(
        spark, E.normalize_newlines(F.lit("a\\nb")).alias("a"), E.normalize_newlines(F.lit("a\r\nb\\n")).alias("b"), E.clean_text(F.lit("It's (fine)!")).alias("c"),
        E.strip_c_comments(F.lit("a/*x\n*/b//c\nd")).alias("d"), E.strip_format_blocks(F.lit("Judge it.\nReturn only 0 or 1.")).alias("e"), E.start_line(F.lit("at 12:3-14:5 in")).alias("f"),
        E.normalize_cwe(F.lit(" nvd-cwe-79 ")).alias("g"), E.infer_language(F.lit("#include <a.h>\nint x;")).alias("h"), E.infer_language(F.lit("def f(x):\n  pass")).alias("i"), E.infer_language(F.lit("nothing")).alias("j"),
        E.correct_spacing(F.lit("a , b .")).alias("k"), E.error_summary(F.lit("x\n  y")).alias("l"), E.lenient_int(F.lit("1.5"), 7).alias("m"),
    )
    assert tuple(r) == ("a\nb", "a\nb\\n", "it 's \\( fine \\) !", "ab\nd", "Judge it.", 12, "79", "cpp", "python", None, "a, b.", "x y", 7)


def test_solid_characters_of_a_prefix(spark):
    code = "def foo():\n    print('hello world')\n    return 42"
    for t in (code, code[:11]):
        assert one(spark, E.solid_chars(F.lit(t)).alias("n")).n == sum(not c.isspace() for c in t)


def test_line_chunks_edge_cases(spark):
    for text, n in (("", 0), ("\n", 0), ("a", 1), ("a\n", 1), ("a\r\nb\r\nc", 2), ("a\n\n", 1)):
        assert len(one(spark, K.line_chunks(F.lit(text), 2).alias("c")).c) == n, repr(text)


def test_oversized_parts_lose_no_line(spark):
    text = "\n".join(" ".join("w" for _ in range(n)) for n in (5, 50, 1, 1, 1, 30, 2))
    parts = spark.range(1).select(K.split_oversized(20)(F.lit(text), F.lit(10)).alias("p")).first().p
    assert "\n".join(p["text"] for p in parts) == text
    assert [p["start"] for p in parts] == [10] + [p["end"] + 1 for p in parts[:-1]]


def test_structural_chunks_cover_lines(spark):
    code = "int f() {\n  a;\n}\nint g() {\n  b;\n  c;\n}\nint x;\n"
    parts = spark.range(1).select(K.structural_chunks(12)(F.lit(code)).alias("p")).first().p
    assert "\n".join(p["text"] for p in parts) == code.rstrip("\n") and [p["start"] for p in parts][:2] == [1, 4]


def test_diff_ranges(spark):
    df = spark.createDataFrame([("a\nb\nc\n", "a\nx\nc\nd"), (None, "a"), ("a", "a"), ("", "")], "x string, y string")
    got = [(tuple(map(tuple, r.r.before)), tuple(map(tuple, r.r.after))) for r in df.select(K.changed_ranges(F.col("x"), F.col("y")).alias("r")).collect()]
    assert got == [(((2, 2),), ((2, 2), (4, 4))), ((), ((1, 1),)), ((), ()), ((), ())]


def test_keep_changed_needs_both_sides(spark):
    df = spark.createDataFrame([("p", "before", True), ("p", "after", True), ("q", "before", True), ("q", "after", False)], "pair string, side string, hit boolean")
    assert {r.pair for r in K.keep_changed(df, "pair", "side", F.col("hit")).collect()} == {"p"}


def test_merge_ranges_and_masks(spark):
    r = one(spark, E.merge_ranges(F.expr("array(named_struct('start', 5, 'end', 6), named_struct('start', 1, 'end', 2), named_struct('start', 3, 'end', 3))")).alias("m"))
    assert [tuple(x) for x in r.m] == [(1, 3), (5, 6)]
    ids, labels = K.mask_prompt(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)))
    r = one(spark, ids.alias("i"), labels.alias("l"))
    assert (r.i, r.l) == ([1, 2, 3], [-100, -100, 3])


def test_zip_pairs_truncates(spark):
    df = spark.createDataFrame([("g", "1", 1), ("g", "true", 2), ("g", "0", 3), ("g", "maybe", 4), ("h", "0", 5)], "k string, flag string, o int")
    got = Q.zip_pairs(df, ["k"], E.is_before("flag"), "o", ["o"]).collect()
    assert [(r["before"].o, r["after"].o) for r in got] == [(1, 3)]


def test_scanners():
    assert R.json_candidates('x {"a": 1} ```json\n{"b": {"c": "}"}}\n``` {bad') == ['{"b": {"c": "}"}}', '{"a": 1}', '{"b": {"c": "}"}}', '{"c": "}"}']
    assert R.code_tokens("int fooBar = x_y1 + 2; // c\n{}") == ["int", "foo", "bar", "=", "x", "y1", "+", "2"]


def test_reply_udfs(spark):
    body = json.dumps({"choices": [{"message": {"content": [{"type": "reasoning", "text": "hm"}, {"type": "text", "text": " yes "}]}}]})
    r = one(spark, R.response_text(F.lit(body)).alias("a"), R.response_text(F.lit("{}")).alias("b"), R.strip_code_comments(F.lit('a /* x */ "//s"\n\n// y\nb')).alias("c"), R.symbolic_code(F.lit('int f(int a) { return g(a, "s", 3); }')).alias("d"))
    assert (r.a, r.b, r.c) == ("yes", None, 'a   "//s"\nb')
    assert r.d == "int FUNC1 ( int VAR1 ) { return FUNC2 ( VAR1 , STRING , NUMBER ) ; }"


# ---- vectors, graphs, jobs, streams ---------------------------------------------------------


def test_nearest_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)] + [(99, [0.0, 0.0, 0.0]), (100, None)], "vec_id long, embedding array<float>")
    a = V.nearest(df.where("vec_id < 10"), df, 3).collect()
    b = V.nearest(df.where("vec_id < 10"), df, 3, block=3).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 30


def test_node_embeddings_and_word_vectors(spark):
    tok = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "node int, token string")
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "token string, vector array<double>")
    assert {r.node: r.vector for r in V.node_embeddings(tok, vec, ["node"]).collect()} == {1: [2.0, 3.0], 2: [1.0, 2.0]}
    model = V.word_vectors(spark.createDataFrame([(["a", "b", "a"],)], "w array<string>"), "w", size=4)
    assert model.getVectors().count() == 2


def test_jobs(spark):
    one_job = spark.createDataFrame([("j", "t", "running")], "job_id string, job_type string, status string").select("*", F.lit("{}").alias("params_json"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"), F.lit(None).cast("int").alias("return_code"), F.lit(None).cast("string").alias("error_message"))
    assert jobs.recover(one_job, F.current_timestamp()).first().status == "failed"
    ev = spark.createDataFrame([("j", "queued"), ("j", "completed")], "job_id string, status string").select("*", F.lit("2024-02-01").cast("timestamp").alias("updated_at"), F.lit(0).alias("return_code"), F.lit("").alias("error_message"))
    assert jobs.apply_transitions(one_job, ev).first().status == "completed"
    assert jobs.safe_path("/data", "a/../b") == "/data/b"
    for bad in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(ValueError):
            jobs.safe_path("/data", bad)


def test_streams(spark, sf, tmp_path):
    df = spark.range(100).select((F.col("id") % 2).cast("int").alias("Label"), (F.col("id") % 3 == 0).cast("int").alias("Prediction"), F.col("id").alias("k"), F.col("id").alias("ver"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = online.file_stream(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    q = online.running_confusion(stream).writeStream.outputMode("complete").format("memory").queryName("conf").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = M.confusion(df).first()
    assert tuple(spark.table("conf").first()) == tuple(want)
    table = KeyedTable(spark, str(tmp_path / "out"), "k long, ver long", "k", "ver")
    online.upsert_batches(stream.select((F.col("k") % 10).alias("k"), "ver"), table, str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.k, r.ver) for r in table.read().collect()} == {(i, 90 + i) for i in range(10)}


def test_ranks_of_skewed_numbers(spark):
    from verdigris.operators.ranking import rank_by_number

    # an outlier, ids over the whole range of long, and one value that half of the rows share
    values = [*range(3000), 10**12, -(1 << 63), (1 << 63) - 1, *[7] * 3000]
    df = spark.createDataFrame([(i, v, "ab"[i % 2]) for i, v in enumerate(values)], "id long, v long, g string")
    for by in ([], ["g"]):
        rows = rank_by_number(df, by, "v", chunks=64).collect()
        for g in {r.g if by else "" for r in rows}:
            some = sorted((r for r in rows if not by or r.g == g), key=lambda r: r.rank_)
            assert [r.rank_ for r in some] == list(range(1, len(some) + 1)) and all(r.size_ == len(some) for r in some)
            assert [r.v for r in some] == sorted(r.v for r in some)
    assert {(r.id, r.rank_) for r in rank_by_number(df, [], "v", 64).collect()} == {(r.id, r.rank_) for r in rank_by_number(df.repartition(7), [], "v", 64).collect()}
    assert rank_by_number(df.limit(0), [], "v").collect() == []
    nulls = rank_by_number(spark.createDataFrame([(None,), (3,), (1,), (None,)], "v long"), [], "v").collect()
    assert sorted((r.rank_, r.v) for r in nulls)[2:] == [(3, 1), (4, 3)]


def test_line_chunks_of_long_texts_are_linear(spark):
    import time

    from verdigris.operators import chunks as K

    text = "\n".join(f"line {i}" for i in range(60_000))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    began = time.time()
    rows = K.explode_chunks(df, "text", 80).select("chunk_id", "start_line", "end_line", "chunk_text").collect()
    assert time.time() - began < 20
    assert "\n".join(r.chunk_text for r in sorted(rows)) == text and max(r.end_line for r in rows) == 60_000


def test_median_and_correlation(spark):
    from verdigris.operators import calibration as C

    rows = [(float(i % 5), 1.0 + 1e-9 * (i % 2)) for i in range(1001)]
    df = spark.createDataFrame([*rows, (None, 1.0)], "a double, b double")
    assert C.spread(df, F.col("a")).first().median == 2.0
    assert C.spread(df.where("a in (1, 4)"), F.col("a")).first().median == 2.5
    assert abs(C.correlation(df, F.col("a"), F.col("b")).first().pearson) <= 1
    assert C.spread(df.limit(0), F.col("a")).first().median is None


def test_nearest_by_tokens_excludes_and_prefers(spark):
    from verdigris.operators import similarity as V

    base = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "x y"), (4, "a b")], "k long, t string")
    plain = {r.k: r.neighbor for r in V.most_similar_by_tokens(base, base, "k", "t", "k", "t").collect()}
    assert plain == {1: 1, 2: 2, 3: 3, 4: 2}
    given = spark.createDataFrame([(1, 3)], "k long, neighbor long")
    for block in (4096, 2):
        got = {r.k: (r.neighbor, r.similarity) for r in V.most_similar_by_tokens(base, base, "k", "t", "k", "t", exclude_same=True, given=given, block=block).collect()}
        assert got == {1: (3, None), 2: (4, 1.0), 4: (2, 1.0)}


def test_sqlite_npy_and_named_files(spark, tmp_path):
    import sqlite3

    import numpy as np

    from verdigris.sources import readers as S

    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("CREATE TABLE method (id INTEGER, code TEXT, score REAL)")
    rows = [(i, f"code {i}", i / 4) for i in range(1000)]
    db.executemany("INSERT INTO method VALUES (?, ?, ?)", rows)
    db.execute("CREATE TABLE empty (id INTEGER)")
    db.commit()
    db.close()
    got = S.read_sqlite(spark, str(tmp_path / "x.db"), "method", "id long, code string, score double", parts=3, batch=70)
    assert sorted(map(tuple, got.collect())) == rows
    assert S.read_sqlite(spark, str(tmp_path / "x.db"), "empty", "id long").count() == 0
    m = np.arange(30, dtype=np.float64).reshape(10, 3)
    np.save(tmp_path / "m.npy", m)
    assert [r.vector for r in S.read_npy(spark, str(tmp_path / "m.npy"), rows=4).orderBy("row").collect()] == m.tolist()
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "results.csv").write_text("x\n1\n")
    (tmp_path / "a" / "other.csv").write_text("x\n1\n")
    found = S.read_named(spark, [str(tmp_path), str(tmp_path / "missing")], {"results.csv"})
    assert [r.path.split("/")[-1] for r in found.collect()] == ["results.csv"]
    assert S.read_named(spark, [str(tmp_path / "missing")], {"x"}).count() == 0


def test_ingest_arrays_reports_and_lines(spark, tmp_path):
    import json

    from verdigris.sources import readers as S
    from verdigris.sources import sinks as K

    path = S.ingest(spark, b'[{"a": 1}]', "up.json", str(tmp_path))
    assert path.endswith("up.json") and json.loads((tmp_path / "up.json").read_text()) == [{"a": 1}]
    for content, name, error in ((b"[]", "up.json", Exception), (b"[]", "../x.json", ValueError), (b"no", "y.json", ValueError), (b"[]", "y.exe", ValueError)):
        with pytest.raises(error):
            S.ingest(spark, content, name, str(tmp_path))
    df = spark.createDataFrame([(2, "b", None), (1, "ä", 0.5)], "i long, s string, x double")
    assert K.write_json_array(df, str(tmp_path / "all.json"), ["i"]) == 2
    assert json.loads((tmp_path / "all.json").read_text()) == [{"i": 1, "s": "ä", "x": 0.5}, {"i": 2, "s": "b", "x": None}]
    assert K.write_json_array(df.limit(0), str(tmp_path / "none.json")) == 0 and json.loads((tmp_path / "none.json").read_text()) == []
    K.write_report({"t": df}, str(tmp_path / "rep"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rep/t.csv")).count() == 2 and spark.read.json(str(tmp_path / "rep/t.json")).count() == 2
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": \n')
    rows = K.lines_with_errors(spark, str(tmp_path / "l.jsonl"), "a long").orderBy("line").collect()
    assert [(r.line, r.a, r.corrupt is not None) for r in rows] == [(1, 1, False), (3, 2, False), (4, None, True)]
    with pytest.raises(Exception, match="line 4"):
        K.convert_lines(spark, str(tmp_path / "l.jsonl"), "a long").collect()
    (tmp_path / "ok.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert [r.a for r in K.convert_lines(spark, str(tmp_path / "ok.jsonl"), "a long").orderBy("a").collect()] == [1, 2]


def test_judge_retries_parses_and_resumes(spark):
    from verdigris.operators import judge as G

    def make_client():
        calls = {}

        def client(prompt):
            calls[prompt] = calls.get(prompt, 0) + 1
            if prompt == "busy" and calls[prompt] < 3:
                raise G.HttpError(429, "later")
            if prompt == "bad":
                raise G.HttpError(400, "no")
            return '```json\n{"vulnerable": "yes", "why": {"a": 1}}\n```' if prompt == "busy" else "0"

        return client

    df = spark.createDataFrame([(1, "busy"), (2, "bad"), (3, "fine"), (4, "fine")], "Index long, prompt string")
    done = spark.createDataFrame([(4, 1), (3, None)], "Index long, label int")
    got = {r.Index: (r.label, r.attempts, r.status) for r in G.judge(df, make_client, wait=0.0, done=done).collect()}
    assert got == {1: (1, 3, "json.vulnerable"), 2: (None, 1, "error:HttpError: HTTP 400: no"), 3: (0, 1, "exact.no")}


def test_python_comments_token_length_and_expansion(spark):
    from verdigris.functions import responses as R
    from verdigris.plans import jobs

    code = 'def f(x):\n    """Doc."""\n    # note\n    s = "# kept"  # gone\n    return s\n'
    df = spark.createDataFrame([(1, code), (2, "def broken(:\n  '''"), (3, None)], "i long, c string")
    got = [r[0] for r in df.select(R.strip_python_comments("c")).collect()]
    assert [x.rstrip() for x in got[0].split("\n")] == ["def f(x):", '    s = "# kept"', "    return s"] and got[1] == "def broken(:\n  '''" and got[2] is None
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b" ab": 257}
    text = spark.createDataFrame([("ab ab x",), (None,)], "t string")
    assert [r[0] for r in text.select(R.token_length(F.col("t"), ranks, r"\s?\w+").alias("n")).collect()] == [4, 0]
    assert text.select(R.token_length(F.col("t"))).first()[0] == 3
    assert jobs.expand({"a": ["$X/${Y}", 1]}, {"X": "x", "Y": "y"}) == {"a": ["x/y", 1]}
    assert jobs.expand("$Z", {}, strict=False) == ""
    with pytest.raises(KeyError):
        jobs.expand("$Z", {})


def test_syntax_chunks_cover_the_text():
    import random

    from verdigris.functions import syntax as S

    rng = random.Random(1)
    for _ in range(800):
        x = "".join(rng.choice(["{", "}", ";", "a", " ", "\n", "(", ")", '"', "'", "//", "/*", "*/", "b=c", "\n\n"]) for _ in range(rng.randrange(0, 60)))
        for limit in (1, 3, 10):
            assert "".join(x[a:b] for a, b in S.windows(x, S.bracket_tree(x), limit)) == x
        S.data_flow(x)
    deep = "{" * 5000 + "a;" + "}" * 5000
    assert S.chunks(deep, 10) and S.data_flow(deep) is not None
    code = "int f(int a) {\n  if (a) {\n    a = 1;\n  }\n  return a;\n}\nint g() {\n  return 2;\n}\n"
    assert [(a, b) for _, a, b, _ in S.chunks(code, 40)] == [(1, 6), (7, 9)]
    python = "@d\ndef f(x):\n    if x:\n        return 1\n    return 2\n\n\nclass A:\n    def g(self):\n        pass\n"
    got = S.chunks(python, 30, "python")
    assert [(a, b, how) for _, a, b, how in got] == [(1, 5, "ast:python"), (8, 10, "ast:python")]
    assert S.chunks("def f(:", 30, "python")[0][3] == "blocks" and S.chunks("", 5) == S.chunks(None, 5) == []
    assert S.solid("def foo():\n    print('hello world')\n    return 42") == 36 and S.solid("def foo():\n"[:11]) == 9


def test_data_flow_of_branches_and_loops():
    from verdigris.functions import syntax as S

    code = "x = a; if (x) { x = b; } y = x; while (y) { y = z; z = y; }"
    found = S.data_flow(code)
    name = {at: n for at, n, _ in found}
    by = {at: src for at, _, src in found}
    y = code.index("y = x")
    assert sorted(by[y + 4]) == [0, code.index("x = b")]  # the branch may not have run
    z = code.index("z;")
    assert code.index("z = y") in by[z]  # what one turn defines reaches the next
    assert all(name[s] for v in by.values() for s in v)


def test_key_ranges_resume_and_progress(spark, tmp_path):
    import shutil

    from verdigris.streaming import online

    df = spark.range(0, 100).union(spark.range(1000, 1010)).withColumn("x", F.col("id") * 2)
    path = str(tmp_path / "out")
    assert online.by_key_range(df, "id", 40, path, lambda p: p.select("id", "x")) == 4
    assert spark.read.parquet(path).count() == 110
    shutil.rmtree(tmp_path / "out" / "range=1")
    (tmp_path / "out" / "range=0" / "_SUCCESS").unlink()
    assert online.by_key_range(df, "id", 40, path, lambda p: p.select("id", "x")) == 2
    assert spark.read.parquet(path).select("id").distinct().count() == spark.read.parquet(path).count() == 110
    df.write.parquet(str(tmp_path / "in"))
    q = online.file_stream(spark, str(tmp_path / "in"), df.schema).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(p["rows"] for p in online.progress(q)) == 110


def test_first_seen_ids_are_those_of_one_sort(spark):
    rows = [(f"v{i * 7919 % 1000}", (i * 31) % 400 if i % 9 else None) for i in range(3000)]
    got = V.first_seen_ids(spark.createDataFrame(rows, "v string, p int"), "v", "p").collect()
    least: dict = {}
    for v, p in rows:
        least[v] = min((x for x in (least.get(v), p) if x is not None), default=None)
    want = sorted(least, key=lambda v: (least[v] is not None, least[v] or 0, v))
    assert [r.v for r in sorted(got, key=lambda r: r.id)] == want


def test_json_like_files_are_told_apart_one_by_one(spark, tmp_path):
    texts = {"a": '[{"a": 1},\n {"a": 2}]', "b": '{"a": 3}\n\n{"a": 4}\n', "c": '{\n "a": 5\n}', "d": "\n \n", "e": '\n{"a": 6}', "f": "[]"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(r.a for r in S.read_json_like(spark, str(tmp_path), "a int").collect()) == [1, 2, 3, 4, 5, 6]
    assert S.read_json_like(spark, str(tmp_path / "d.json"), "a int").count() == 0


def test_csv_keeps_space_and_breaks(spark, tmp_path):
    rows = [("1", "  a "), ("2", 'x "y", z\nnext\t'), ("4", None), ("5", "\\\"q\\")]
    sinks.write_csv(spark.createDataFrame(rows, "k string, v string"), str(tmp_path / "o"), ["k", "v"])
    assert sorted(map(tuple, S.read_csv(spark, str(tmp_path / "o")).collect())) == rows
