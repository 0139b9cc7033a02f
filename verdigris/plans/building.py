"""Queries of the sampling, relational, text, chunk, similarity and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import responses as R
from ..operators import chunks as K
from ..operators import merge as J
from ..operators import relational as Q
from ..operators import sampling as Z
from ..operators import similarity as V
from ..operators import tables as L
from ..sources import readers as S
from ..sources import sinks
from . import jobs
from .registry import PA, PB, Tables, query

SAMPLES = "s AS (SELECT d.doc_id AS index, d.text AS code, quality AS label, source, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _samples(t: Tables):
    return t.documents.select("doc_id", "text", "source", "lang").join(t.labels, "doc_id").select(F.col("doc_id").alias("index"), F.col("text").alias("code"), F.col("quality").alias("label"), "source", "lang")


H = "md5('42::' || CAST(index AS VARCHAR))"

# ---- sampling and splits --------------------------------------------------------------------


@query("z1_stratified_truncate", f"WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H}) AS k, count(*) OVER (PARTITION BY label) AS c, count(*) OVER () AS n FROM s) SELECT index, label FROM r WHERE n <= 150 OR k <= round_even(c * ((CAST(150 AS DOUBLE) + CAST(0.1 AS DOUBLE)) / n), 0)")
def _(t: Tables):
    return Z.truncate(_samples(t).select("index", "label"), 150)


@query("z2_truncate_buckets", f"WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY {H}) AS k, count(*) OVER (PARTITION BY lang, label) AS c FROM s), m AS (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM s GROUP BY lang)) SELECT index, label, lang FROM r, m WHERE m <= 60 OR k <= round_even(c * ((CAST(60 AS DOUBLE) + CAST(0.1 AS DOUBLE)) / m), 0)")
def _(t: Tables):
    return Z.truncate_buckets(_samples(t).select("index", "label", "lang"), 60, "lang")


@query("z3_positive_ratio", f"WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H}) AS k, count(*) FILTER (WHERE label = 1) OVER () AS pos FROM s) SELECT index, label FROM r WHERE label = 1 OR k <= round_even(pos / CAST(0.9 AS DOUBLE) - pos, 0)")
def _(t: Tables):
    return Z.to_positive_ratio(_samples(t).select("index", "label"), 0.9)


ONE_N = SAMPLES + ", f AS (SELECT index, CAST(1 - label AS INTEGER) AS label FROM s)"


@query("z4_one_to_n", f"WITH {ONE_N}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H}) AS k, count(*) FILTER (WHERE label = 1) OVER () AS pos FROM f) SELECT index, label FROM r WHERE label = 1 OR k <= pos * 2")
def _(t: Tables):
    return Z.one_to_n(_samples(t).select("index", (1 - F.col("label")).alias("label")), 2)


@query("z5_positional_split", f"WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (ORDER BY index) - 1 AS i, count(*) OVER () AS n FROM s) SELECT index, CASE WHEN i < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN i < floor(n * CAST(0.9 AS DOUBLE)) THEN 'validate' ELSE 'test' END AS split FROM r")
def _(t: Tables):
    return Z.positional_split(_samples(t).select("index"), "index")


SPLIT = "('0x' || substr(md5('42::' || CAST(index AS VARCHAR)), 1, 8))::BIGINT % 100"
SPLIT_SQL = f"CASE WHEN {SPLIT} < 80 THEN 'train' WHEN {SPLIT} < 90 THEN 'validate' ELSE 'test' END"


@query("z6_hash_split", f"WITH s AS (SELECT doc_id AS index FROM documents) SELECT index, {SPLIT_SQL} AS split FROM s")
def _(t: Tables):
    return t.documents.select(F.col("doc_id").alias("index"), E.hash_split("doc_id").alias("split"))


@query("z7_stratified_folds", f"WITH {SAMPLES} SELECT index, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {H}) - 1) % 5 AS INTEGER) AS fold FROM s")
def _(t: Tables):
    return Z.stratified_folds(_samples(t).select("index", "label"), 5)


@query("z8_head_fractions", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang FROM r WHERE k <= floor(n * CAST(CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.7 WHEN 'fr' THEN 1.0 ELSE 0 END AS DOUBLE))")
def _(t: Tables):
    return Z.head_fractions(t.documents.select("doc_id", "lang"), "lang", {"en": 0.5, "de": 0.7, "fr": 1.0}, "doc_id")


@query("z9_sample_percent", "SELECT doc_id FROM documents WHERE ('0x' || substr(md5('10::' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT < 1073741824")
def _(t: Tables):
    return Z.sample_percent(t.documents.select("doc_id"), 0.25, "doc_id")


@query("z10_shuffle_order", "WITH s AS (SELECT doc_id AS index FROM documents) SELECT index, row_number() OVER (ORDER BY md5('42::' || CAST(index AS VARCHAR)), index) AS place FROM s")
def _(t: Tables):
    from ..operators.ranking import rank_by_hash

    return rank_by_hash(t.documents.select(F.col("doc_id").alias("index")), [], E.shuffle_key("index"), "index").select("index", F.col("rank_").alias("place"))


@query("f5_length_buckets", f"WITH {SAMPLES}, b AS (SELECT *, CASE WHEN length(code) < 512 THEN '0-512' WHEN length(code) < 1024 THEN '512-1024' WHEN length(code) < 4096 THEN '1024-4096' ELSE '4096-*' END AS bucket FROM s) SELECT bucket, label, count(*) AS n, max(length(code)) AS longest FROM b GROUP BY bucket, label")
def _(t: Tables):
    b = _samples(t).withColumn("bucket", Z.length_bucket(F.length("code"), [0, 512, 1024, 4096]))
    return b.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.max(F.length("code")).cast("long").alias("longest"))


@query("w1_w2_dense_index", "SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS global_index, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS source_index FROM documents")
def _(t: Tables):
    d = Z.dense_index(t.documents.select("doc_id", "source"), "doc_id", name="global_index")
    return Z.dense_index(d, "doc_id", ["source"], "source_index")


@query("k3_split_routes", f"WITH s AS (SELECT doc_id AS index, source FROM documents), r AS (SELECT index AS id, {SPLIT_SQL} AS split, unnest(['all', source]) AS dataset FROM s) SELECT id, split, dataset, row_number() OVER (PARTITION BY dataset, split ORDER BY id) - 1 AS index FROM r")
def _(t: Tables):
    return Q.split_routes(t.documents.select(F.col("doc_id").alias("id"), "source"), "id", F.col("source"), "id").drop("source")


# ---- relational -----------------------------------------------------------------------------


@query("j12_j15_star_join", "WITH chosen AS (SELECT DISTINCT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)) SELECT n_nationkey, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_orders, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM chosen JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_nationkey")
def _(t: Tables):
    cwe = t.nation.select(F.col("n_nationkey").alias("cve_id"), F.concat(F.lit("CWE-"), F.col("n_regionkey").cast("string")).alias("cwe_id"))
    fixes = t.customer.select(F.col("c_nationkey").alias("cve_id"), F.col("c_custkey").alias("hash"))
    files = t.orders.select(F.col("o_custkey").alias("hash"), F.col("o_orderkey").alias("file_change_id"))
    methods = t.lineitem.select(F.col("l_orderkey").alias("file_change_id"), "l_quantity")
    rows = Q.methods_of_classes(cwe, fixes, t.customer.select(F.col("c_custkey").alias("hash")), files, methods, ["1", "3"])
    return rows.groupBy(F.col("cve_id").alias("n_nationkey")).agg(F.count("*").alias("n_rows"), F.count_distinct("file_change_id").alias("n_orders"), F.sum("l_quantity").cast("double").alias("qty"))


@query("j13_j14_left_fan_out", "SELECT c_custkey, count(*) AS n_rows, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t: Tables):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("*").alias("n_rows"), F.count("o_orderkey").alias("n_orders"))


@query("j13_j14_class_fan_out", "WITH k AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 3 <> 0 WHERE c_custkey % 2 = 0) SELECT n_regionkey AS cwe_id, c_nationkey AS cve_id, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_files FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN k ON k.c_custkey = o_custkey GROUP BY ALL")
def _(t: Tables):
    fixes = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("hash"), F.col("c_nationkey").alias("cve_id"))
    cwe = t.nation.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("cve_id"), F.col("n_regionkey").alias("cwe_id"))
    files = t.orders.select(F.col("o_custkey").alias("hash"), F.col("o_orderkey").alias("file_change_id"))
    rows = Q.methods_with_classes(files, t.lineitem.select(F.col("l_orderkey").alias("file_change_id")), fixes, cwe)
    return rows.groupBy("cwe_id", "cve_id").agg(F.count("*").alias("n_rows"), F.count_distinct("file_change_id").alias("n_files"))


@query("j16_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t: Tables):
    return Q.held_out(t.documents.select("doc_id"), t.labels.where("toxic = 1"), "doc_id")


@query("j17_p4_reweighting", f'WITH {PA}, e AS (SELECT DISTINCT "Index" FROM pa WHERE "Label" <> "Prediction") SELECT pa."Index", CASE WHEN e."Index" IS NOT NULL THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM pa LEFT JOIN e ON pa."Index" = e."Index"')
def _(t: Tables):
    return Q.reweigh(t.pa.select("Index"), t.pa.where("Label <> Prediction"), "Index", "multiply", 2.0)


@query("j18_zip_pairs", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations WHERE role IN ('user', 'assistant')) SELECT u.conv_id, u.k AS k, u.turn AS before_turn, a.turn AS after_turn FROM n u JOIN n a ON u.conv_id = a.conv_id AND u.k = a.k AND u.role = 'user' AND a.role = 'assistant'")
def _(t: Tables):
    side = F.when(F.col("role") == "user", True).when(F.col("role") == "assistant", False)
    return Q.zip_pairs(t.conversations, ["conv_id"], side, "turn", ["turn"]).select("conv_id", F.col("nth").cast("long").alias("k"), F.col("before.turn").alias("before_turn"), F.col("after.turn").alias("after_turn"))


@query("j19_adjacent_pairs", f"WITH {SAMPLES}, r AS (SELECT index, label, row_number() OVER (ORDER BY index) - 1 AS i FROM s) SELECT CAST(a.i // 2 AS BIGINT) AS pair, a.index AS first_index, b.index AS second_index FROM r a JOIN r b ON b.i = a.i + 1 AND a.i % 2 = 0 WHERE a.label <> b.label")
def _(t: Tables):
    return Q.adjacent_pairs(_samples(t).select("index", "label"), "index", "label", ["index"]).select("pair", F.col("a.index").alias("first_index"), F.col("b.index").alias("second_index"))


@query("u7_range_islands", "WITH x AS (SELECT l_suppkey AS g, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) % 5 AS e FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x), i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT g AS supplier, min(s) AS start_line, max(e) AS end_line FROM i GROUP BY g, k")
def _(t: Tables):
    return Q.islands(_lines(t), ["supplier"], "start_line", "end_line")


def _lines(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("start_line"), (F.col("l_partkey") + F.rint("l_quantity").cast("long") % 5).alias("end_line"))


@query("u7_merge_ranges_array", "WITH x AS (SELECT l_suppkey AS g, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) % 5 AS e FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x), i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m), r AS (SELECT g, min(s) AS s, max(e) AS e FROM i GROUP BY g, k) SELECT g AS supplier, count(*) AS n_ranges, CAST(sum(e - s + 1) AS BIGINT) AS covered FROM r GROUP BY g")
def _(t: Tables):
    g = _lines(t).groupBy("supplier").agg(F.collect_list(F.struct(F.col("start_line").alias("start"), F.col("end_line").alias("end"))).alias("r"))
    m = g.select("supplier", E.merge_ranges("r").alias("r"))
    sizes = F.filter(F.transform("r", lambda x: x["end"] - x["start"] + 1), lambda n: n.isNotNull())
    covered = F.when(F.size(sizes) > 0, F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n))
    return m.select("supplier", F.size("r").cast("long").alias("n_ranges"), covered.alias("covered"))


@query("j21_interval_overlap", "WITH r AS (SELECT l_suppkey AS g, l_partkey AS s, l_partkey + 2 AS e FROM lineitem), x AS (SELECT l_orderkey, l_linenumber, l_suppkey AS g, l_partkey + 3 AS s, l_partkey + 5 AS e FROM lineitem) SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS check_sum FROM x WHERE EXISTS (SELECT 1 FROM r WHERE r.g = x.g AND x.s <= r.e AND r.s <= x.e)")
def _(t: Tables):
    line = t.lineitem
    ranges = line.select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + 2).alias("e"))
    rows = line.select("l_orderkey", F.col("l_suppkey").alias("g"), (F.col("l_partkey") + 3).alias("s"), (F.col("l_partkey") + 5).alias("e"))
    return Q.range_semi_join(rows, ranges, ["g"], "s", "e").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("check_sum"))


FIRST_LAST = "SELECT source, {f}(doc_id) AS doc_id, arg_{f}(n_chars, doc_id) AS n_chars FROM documents GROUP BY source"


@query("u4_first_per_key", FIRST_LAST.format(f="min"))
def _(t: Tables):
    return J.first_per_key(t.documents.select("source", "doc_id", "n_chars"), "source", "doc_id")


@query("u5_last_per_key", FIRST_LAST.format(f="max"))
def _(t: Tables):
    return J.last_per_key(t.documents.select("source", "doc_id", "n_chars"), "source", "doc_id")


@query("u1_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'doc' AS kind, doc_id FROM documents UNION ALL SELECT 'label', doc_id FROM labels) GROUP BY kind")
def _(t: Tables):
    both = L.union_all([t.documents.select(F.lit("doc").alias("kind"), "doc_id"), t.labels.select(F.lit("label").alias("kind"), "doc_id", "quality")])
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("u2_key_sets", f'WITH {PA}, {PB} SELECT (SELECT count(*) FROM (SELECT "Index" FROM pa INTERSECT SELECT "Index" FROM pb)) AS n_common, (SELECT count(*) FROM (SELECT "Index" FROM pa UNION SELECT "Index" FROM pb)) AS n_all')
def _(t: Tables):
    return L.key_sets(t.pa, t.pb, "Index")


@query("u6_a29_distinct_paths", "SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)/', 1) AS host FROM pages")
def _(t: Tables):
    return L.distinct_parts(t.pages, "url", "^[a-z]+://([^/]+)/", "host")


@query("j1_strict_join", "SELECT l.doc_id, quality, source FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def _(t: Tables):
    return J.strict_join(t.labels.select("doc_id", "quality"), t.documents.select("doc_id", "source"), "doc_id")


@query("j2_position_fallback", """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1000000 ELSE doc_id END AS "Index" FROM labels), s AS (SELECT doc_id AS "Index", row_number() OVER (ORDER BY doc_id) - 1 AS pos, source AS code FROM documents WHERE doc_id % 4 <> 3)
SELECT p."Index", p.pos, coalesce(a.code, b.code) AS code, CASE WHEN a.code IS NOT NULL THEN 'index' WHEN b.code IS NOT NULL THEN 'position' ELSE 'unmatched' END AS matched_by FROM p LEFT JOIN s a ON p."Index" = a."Index" LEFT JOIN s b ON p.pos = b.pos""")
def _(t: Tables):
    p = Z.dense_index(t.labels.select("doc_id"), "doc_id", name="pos").select(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1000000).otherwise(F.col("doc_id")).alias("Index"), "pos")
    s = Z.dense_index(t.documents.where("doc_id % 4 <> 3").select(F.col("doc_id").alias("Index"), F.col("source").alias("code")), "Index", name="pos")
    return J.join_with_position_fallback(p, s)


@query("j3_left_with_defaults", f'WITH {PB} SELECT d.doc_id, coalesce("Prediction", -1) AS "Prediction" FROM documents d LEFT JOIN pb ON pb."Index" = d.doc_id')
def _(t: Tables):
    return J.with_defaults(t.documents.select("doc_id"), t.pb.select(F.col("Index").alias("doc_id"), "Prediction"), "doc_id", {"Prediction": -1})


@query("j27_resume", f'WITH {PA}, {PB} SELECT "Index" FROM pa WHERE "Index" NOT IN (SELECT "Index" FROM pb WHERE "Prob" >= 0.25)')
def _(t: Tables):
    return J.resume(t.pa.select("Index"), t.pb, "Index", F.col("Prob") >= 0.25)


@query("j10_a23_group_fold", "WITH c AS (SELECT l_orderkey AS k, l_linenumber AS o, l_partkey AS p, CAST(l_suppkey % 2 AS INTEGER) AS pred, CAST(l_quantity AS DOUBLE) AS prob FROM lineitem) SELECT k AS order_key, count(*) AS n_chunks, max(pred) AS max_pred, max(prob) AS max_prob, string_agg(CAST(p AS VARCHAR), ',' ORDER BY o, p) AS indexes FROM c GROUP BY k")
def _(t: Tables):
    c = t.lineitem.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("o"), F.col("l_partkey").alias("p"), (F.col("l_suppkey") % 2).cast("int").alias("pred"), F.col("l_quantity").cast("double").alias("prob"), F.lit("x").alias("text"))
    g = Q.fold_groups(c, ["order_key"], [F.col("o")], "text", ["pred", "prob"], "p")
    return g.select("order_key", "n_chunks", "max_pred", "max_prob", F.array_join(F.transform("indexes", lambda x: x.cast("string")), ",").alias("indexes"))


@query("a24_ordered_text", "SELECT conv_id, count(*) AS n_chunks, string_agg(regexp_replace(text, '\\n+$', ''), chr(10) ORDER BY turn) FILTER (WHERE trim(regexp_replace(text, '\\n+$', '')) <> '') AS text FROM conversations GROUP BY conv_id")
def _(t: Tables):
    g = Q.fold_groups(t.conversations, ["conv_id"], [F.col("turn")], "text", [], "turn")
    return g.select("conv_id", "n_chunks", "text")


@query("a39_reconstruction_counters", f"WITH {PB} SELECT count(*) AS n, count(*) FILTER (WHERE pb.\"Index\" IS NULL) AS without_result FROM labels l LEFT JOIN pb ON pb.\"Index\" = l.doc_id")
def _(t: Tables):
    return L.without_result(t.labels, t.pb.select(F.col("Index").alias("doc_id")), "doc_id")


@query("j25_case_bundle", f'WITH {PA}, {PB} SELECT d.doc_id, source, pa."Prediction" AS a, pb."Prediction" AS b FROM documents d JOIN pa ON pa."Index" = d.doc_id JOIN pb ON pb."Index" = d.doc_id')
def _(t: Tables):
    a = t.pa.select(F.col("Index").alias("doc_id"), F.col("Prediction").alias("a"))
    return L.case_bundle(t.documents.select("doc_id", "source"), [a, t.pb.select(F.col("Index").alias("doc_id"), F.col("Prediction").alias("b"))], "doc_id")


@query("a25_a26_sets_and_argmax", "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, arg_max(doc_id, n_chars * 1000000 - doc_id) AS longest FROM documents GROUP BY source")
def _(t: Tables):
    return t.documents.groupBy("source").agg(L.value_set("lang").alias("langs"), L.argmax("doc_id", "n_chars").alias("longest"))


@query("f3_f4_probability_filters", f'WITH {PA}, x AS (SELECT "Index", CASE WHEN "Index" % 5 > 0 THEN "Prediction" END AS p, CASE WHEN "Index" % 7 > 0 THEN "Prob" END AS q FROM pa) SELECT "Index", q BETWEEN 0.25 AND 0.75 AS in_range, coalesce(p, 1) = 1 AS any_matches, coalesce(p, 1) = 1 AND coalesce(q >= 0.6, false) AS matches FROM x')
def _(t: Tables):
    x = t.pa.select("Index", F.when(F.col("Index") % 5 > 0, F.col("Prediction")).alias("p"), F.when(F.col("Index") % 7 > 0, F.col("Prob")).alias("q"))
    return x.select("Index", L.between("q", 0.25, 0.75).alias("in_range"), L.called("p", 1, "q").alias("any_matches"), L.called("p", 1, "q", 0.6).alias("matches"))


@query("f9_diff_length", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN text END AS diff FROM documents) WHERE diff IS NULL OR length(diff) <= 1500")
def _(t: Tables):
    return t.documents.withColumn("diff", F.when(F.col("doc_id") % 5 > 0, F.col("text"))).where(L.short_text("diff", 1500)).where(L.short_text("diff", 0)).select("doc_id")


@query("f12_small_changes", "WITH x AS (SELECT CASE WHEN l_partkey % 9 > 0 THEN ' ' || l_suppkey || '-' || l_linenumber || ' ' ELSE '  ' END AS k, CASE WHEN l_orderkey % 6 > 0 THEN l_quantity END AS c, l_orderkey * 10 + l_linenumber AS o FROM lineitem), f AS (SELECT trim(k) AS file_change_id, min(o) AS first FROM x WHERE coalesce(c, 0) <= 20 AND trim(k) <> '' GROUP BY 1) SELECT * FROM f ORDER BY first, file_change_id LIMIT 300")
def _(t: Tables):
    key = F.when(F.col("l_partkey") % 9 > 0, F.concat(F.lit(" "), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(" "))).otherwise("  ")
    lines = F.when(F.col("l_orderkey") % 6 > 0, F.col("l_quantity").cast("long").cast("string")).otherwise("")
    rows = t.lineitem.select(key.alias("file_change_id"), lines.alias("changed_lines"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return L.small_changes(rows, "file_change_id", "changed_lines", "o", 20, 300)


@query("f8_f12_row_filters", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND length(text) <= 2000 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t: Tables):
    return t.documents.where(L.valid_text("text", 2000)).join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query("f16_min_group_size", "SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 30")
def _(t: Tables):
    return L.min_group(t.documents, ["source"], 30)


@query("o1_o10_sorted_top", "SELECT doc_id, n_chars FROM documents ORDER BY CASE WHEN lang = 'de' THEN 0 ELSE 1 END, n_chars DESC, doc_id LIMIT 25")
def _(t: Tables):
    return L.top(t.documents, [F.when(F.col("lang") == "de", 0).otherwise(1), F.desc("n_chars"), F.col("doc_id")], 25).select("doc_id", "n_chars")


@query("o9_length_batches", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars * 10000000 + doc_id) - 1 AS i FROM documents) SELECT doc_id, CAST(i // 32 AS BIGINT) AS batch FROM r")
def _(t: Tables):
    return L.length_batches(t.documents, "n_chars", "doc_id", 32).select("doc_id", "batch")


# ---- text -----------------------------------------------------------------------------------


@query("t1_approx_tokens", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS BIGINT) AS n FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", E.approx_tokens("text").cast("long").alias("n"))


@query("t3_identifiers", "SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*'))) AS BIGINT) AS n FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.size(E.identifiers("text")).cast("long").alias("n"))


@query("t9_t10_clean_text", r"""WITH s AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9(),!?''`]', ' ', 'g') AS t FROM documents),
u AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '''s', ' ''s'), '''ve', ' ''ve'), 'n''t', ' n''t'), '''re', ' ''re'), '''d', ' ''d'), '''ll', ' ''ll'), ',', ' , '), '!', ' ! '), '(', ' \( '), ')', ' \) '), '?', ' \? ') AS t FROM s)
SELECT doc_id, md5(lower(trim(regexp_replace(t, '\s{2,}', ' ', 'g')))) AS h FROM u""")
def _(t: Tables):
    return t.documents.select("doc_id", F.md5(E.clean_text("text")).alias("h"))


@query("t18_t19_solid_chars", r"SELECT doc_id, CAST(length(regexp_replace(text, '[ \t\n\r\x0b\x0c]', '', 'g')) AS BIGINT) AS solid, md5(text) AS h FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", E.solid_chars("text").cast("long").alias("solid"), F.md5("text").alias("h"))


@query("p24_p30_preview", r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 80) AS preview FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", E.preview(E.collapse_space("text"), 80).alias("preview"))


@query("p5_p7_lenient_casts", "SELECT turn, conv_id, coalesce(try_cast(trim(k) AS INTEGER), -1) AS n, coalesce(try_cast(nullif(trim(k), '') AS DOUBLE), 0.0) AS x, round(coalesce(CAST(length(text) AS DOUBLE) / nullif(turn, 0), 0.0), 6) AS ratio FROM (SELECT *, CASE turn % 4 WHEN 0 THEN ' ' || CAST(conv_id AS VARCHAR) || ' ' WHEN 1 THEN '' WHEN 2 THEN 'x' || CAST(conv_id AS VARCHAR) ELSE text END AS k FROM conversations)")
def _(t: Tables):
    m, c = F.col("turn") % 4, F.col("conv_id").cast("string")
    head = F.when(m == 0, F.concat(F.lit(" "), c, F.lit(" "))).when(m == 1, "").when(m == 2, F.concat(F.lit("x"), c)).otherwise(F.col("text"))
    return t.conversations.select("turn", "conv_id", E.lenient_int(head, -1).alias("n"), E.lenient_float(head, 0.0).alias("x"), F.round(E.safe_div(F.length("text"), F.col("turn")), 6).alias("ratio"))


CWES = "c AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'CWE-' || CAST(doc_id % 100 AS VARCHAR) WHEN 1 THEN 'NVD-CWE-noinfo' WHEN 2 THEN 'nvd-cwe-Other' WHEN 3 THEN CAST(doc_id % 100 AS VARCHAR) WHEN 4 THEN 'cwe' || CAST(doc_id % 100 AS VARCHAR) WHEN 5 THEN ' NVD-CWE-20 ' ELSE NULL END AS cwe FROM documents)"


@query("p14_p16_cwe_names", f"WITH {CWES}, n AS (SELECT doc_id, cwe, CASE WHEN regexp_matches(trim(cwe), '(?i)noinfo|other|unknown') THEN NULL ELSE regexp_replace(regexp_replace(trim(cwe), '(?i)^NVD-CWE-', ''), '(?i)^CWE-?', '') END AS bare FROM c) SELECT doc_id, bare, coalesce(nullif(cwe, ''), 'null') AS exported, bare || ',CWE-' || bare || ',NVD-CWE-' || bare AS spellings FROM n")
def _(t: Tables):
    d = F.col("doc_id")
    two = (d % 100).cast("string")
    cwe = F.when(d % 7 == 0, F.concat(F.lit("CWE-"), two)).when(d % 7 == 1, "NVD-CWE-noinfo").when(d % 7 == 2, "nvd-cwe-Other").when(d % 7 == 3, two).when(d % 7 == 4, F.concat(F.lit("cwe"), two)).when(d % 7 == 5, " NVD-CWE-20 ")
    c = t.documents.select("doc_id", cwe.alias("cwe")).withColumn("bare", E.normalize_cwe("cwe"))
    return c.select("doc_id", "bare", E.cwe_or_null_text("cwe").alias("exported"), F.when(F.col("bare").isNotNull(), F.array_join(E.cwe_spellings("bare"), ",")).alias("spellings"))


@query("p17_p21_identifiers", """SELECT doc_id, CASE lower(trim(lang)) WHEN 'de' THEN NULL WHEN 'c' THEN 'cpp' END AS language, CASE doc_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN NULL ELSE TRUE END AS before,
  CASE WHEN doc_id % 3 = 0 THEN 'name::' || source ELSE 'sig::' || lang END AS pair_key, CAST(doc_id AS VARCHAR) || '::' || source || '::' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'None' END AS pair_id FROM documents""")
def _(t: Tables):
    d = F.col("doc_id")
    flag = F.when(d % 4 == 0, "True").when(d % 4 == 1, "0").when(d % 4 == 2, "maybe").otherwise(" 1 ")
    return t.documents.select("doc_id", E.normalize_language("lang").alias("language"), E.is_before(flag).alias("before"), E.pair_key(F.when(d % 3 == 0, " ").otherwise(F.col("lang")), "source").alias("pair_key"), E.pair_id("doc_id", "source", F.when(d % 2 == 0, F.col("lang"))).alias("pair_id"))


@query("p22_prompts", "SELECT doc_id, replace(replace('Language: {lang}. Judge: {code}', '{lang}', lang), '{code}', text) AS prompt FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", E.prompt("Language: {lang}. Judge: {code}", {"lang": "lang", "code": "text"}).alias("prompt"))


@query("p1_p2_instructions", f"WITH {SAMPLES} SELECT 'Is it bad?' AS instruction, code AS input, CAST(label AS VARCHAR) AS output, index FROM s")
def _(t: Tables):
    return S.to_instructions(_samples(t), "Is it bad?")


@query("t11_binary_labels", """WITH r AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN '{"vulnerable": "yes"}' WHEN 1 THEN 'so "vulnerable": "No" it is' WHEN 2 THEN ' TRUE ' WHEN 3 THEN 'well' || chr(10) || 'no' WHEN 4 THEN 'perhaps' ELSE '' END AS k FROM conversations)
SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS label, CASE (conv_id + turn) % 6 WHEN 0 THEN 'json.vulnerable' WHEN 1 THEN 'regex.vulnerable' WHEN 2 THEN 'exact.yes' WHEN 3 THEN 'last_line.no' END AS how FROM r""")
def _(t: Tables):
    k = (F.col("conv_id") + F.col("turn")) % 6
    reply = F.when(k == 0, '{"vulnerable": "yes"}').when(k == 1, 'so "vulnerable": "No" it is').when(k == 2, " TRUE ").when(k == 3, "well\nno").when(k == 4, "perhaps").otherwise("")
    label, how = E.binary_label(reply)
    return t.conversations.select("conv_id", "turn", label.alias("label"), how.alias("how"))


@query("t21_json_fields", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def _(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("t12_json_candidates", "SELECT event_id, props || '|' || props AS found FROM events")
def _(t: Tables):
    reply = F.concat(F.lit("reply: ```json\n"), "props", F.lit("\n```"))
    return t.events.select("event_id", F.array_join(R.extract_json(reply), "|").alias("found"))


T5 = r"""WITH x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '/\*[\s\S]*?\*/|//[^\n]*', '', 'g') AS code FROM documents),
w AS (SELECT doc_id, regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+(?:\.\p{Nd}+)?|[^\s\x0B\x1C-\x1F\x{85}\p{Z}A-Za-z0-9_]') AS ws FROM x),
p AS (SELECT doc_id, list_filter(ws, lambda v: v NOT IN ('{', '}', ';', ':')) AS ws FROM w)
SELECT doc_id, CAST(coalesce(list_sum(list_transform(ws, lambda v: CASE WHEN regexp_matches(v, '^[A-Za-z_]') THEN len(list_filter(string_split(regexp_replace(v, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '_'), lambda y: y <> '')) ELSE 1 END)), 0) AS INTEGER) AS n_tokens FROM p"""


@query("t5_code_tokens", T5)
def _(t: Tables):
    return t.documents.select("doc_id", F.size(R.tokenize_code("text")).alias("n_tokens"))


# ---- chunks ---------------------------------------------------------------------------------

LINES = "l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents WHERE regexp_replace(text, '\\n$', '') <> '')"
CHUNKS = LINES + ", k AS (SELECT doc_id, ls, unnest(range(CAST(ceil(len(ls) / 3.0) AS BIGINT))) AS i FROM l)"


@query("c2_line_chunks", f"WITH {CHUNKS} SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, array_to_string(ls[i * 3 + 1 : i * 3 + 3], chr(10)) AS chunk_text, CAST(i * 3 + 1 AS INTEGER) AS start_line, CAST(least(i * 3 + 3, len(ls)) AS INTEGER) AS end_line FROM k")
def _(t: Tables):
    return K.explode_chunks(t.documents.select("doc_id", "text"), "text", 3).drop("text")


@query("c6_c7_chunk_labels", f"WITH {CHUNKS}, c AS (SELECT doc_id, i, i * 3 + 1 AS s, least(i * 3 + 3, len(ls)) AS e FROM k) SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, CASE WHEN s <= 5 AND 4 <= e THEN '1' ELSE '0' END AS label FROM c")
def _(t: Tables):
    c = K.explode_chunks(t.documents.select("doc_id", "text"), "text", 3).withColumn("side", F.lit("before")).withColumn("ranges", F.expr("array(named_struct('start', 4, 'end', 5))"))
    return K.label_chunks(c, "side", "ranges").select("doc_id", "chunk_id", "label")


@query("w8_running_positions", "WITH c AS (SELECT conv_id, turn, CASE WHEN regexp_replace(text, '\\n$', '') = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END AS n FROM conversations) SELECT conv_id, turn, CAST(coalesce(sum(n) OVER w, 0) + 1 AS BIGINT) AS start_line, CAST(coalesce(sum(n) OVER w, 0) + n AS BIGINT) AS end_line FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(t: Tables):
    return K.running_positions(t.conversations, ["conv_id"], "turn", "text").select("conv_id", "turn", "start_line", F.col("end_line").cast("long").alias("end_line"))


@query("c9_pad_or_cut", "SELECT o_orderkey, array_to_string([coalesce(x, 0) FOR x IN [list(l_partkey ORDER BY l_linenumber, l_partkey)[i] FOR i IN range(1, 5)]], ',') AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey".replace("[coalesce(x, 0) FOR x IN [list(l_partkey ORDER BY l_linenumber, l_partkey)[i] FOR i IN range(1, 5)]]", "list_concat(list(l_partkey ORDER BY l_linenumber, l_partkey)[1:4], list_transform(range(greatest(0, 4 - count(*))), lambda z: CAST(0 AS BIGINT)))"))
def _(t: Tables):
    g = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    ids = F.transform("a", lambda x: x["l_partkey"])
    return g.select("o_orderkey", F.array_join(F.transform(E.pad_or_cut(ids, 4), lambda x: x.cast("string")), ",").alias("ids"))


@query("c12_neighbour_context", "SELECT conv_id, turn, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM conversations")
def _(t: Tables):
    return K.with_neighbours(t.conversations, ["conv_id"], "turn", "text").select("conv_id", "turn", "context")


@query("c8_token_packing", "WITH x AS (SELECT l_suppkey AS g, l_partkey AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 100000 + l_partkey, l_quantity) - 1 AS p, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT l_suppkey, l_orderkey, l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)) SELECT g, CAST(p // 8 AS BIGINT) AS run, array_to_string(list(v ORDER BY p), ',') AS ids FROM x WHERE (p // 8 + 1) * 8 < n GROUP BY g, p // 8")
def _(t: Tables):
    x = t.lineitem.select(F.col("l_suppkey").alias("g"), "l_orderkey", "l_partkey").distinct().select("g", (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("o"), F.array("l_partkey").alias("ids"))
    return K.pack_tokens(x, "g", "o", "ids", 8).select("g", "run", F.array_join(F.transform("ids", lambda v: v.cast("string")), ",").alias("ids"))


@query("c14_nested_results", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS running, role AS sample_id, text FROM conversations WHERE trim(text) <> ''")
def _(t: Tables):
    one = F.struct("turn", F.col("role").alias("sample_id"), F.array(F.struct(F.col("text").alias("text"))).alias("chunks"))
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("results"))
    return K.flatten_results(g).select("conv_id", F.col("running").cast("long").alias("running"), "sample_id", "text")


@query("c1_changed_ranges")
def _(t: Tables):
    pairs = Q.zip_pairs(t.conversations, ["conv_id"], F.when(F.col("role") == "user", True).when(F.col("role") == "assistant", False), "turn", ["text"])
    return pairs.select("conv_id", F.col("nth").alias("k"), K.changed_ranges(F.col("before.text"), F.col("after.text")).alias("ranges")).select("conv_id", "k", "ranges.*")


@query("c3_split_oversized")
def _(t: Tables):
    return t.documents.select("doc_id", F.explode(K.split_oversized(64)(F.col("text"), F.lit(1))).alias("p")).select("doc_id", "p.*")


@query("c4_c5_structural_chunks")
def _(t: Tables):
    return t.documents.select("doc_id", F.explode(K.structural_chunks(1800)(F.col("text"))).alias("p")).select("doc_id", "p.*")


# ---- similarity and graphs ------------------------------------------------------------------


@query("j22_nearest_vectors", "WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), b AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query, b.vec_id AS neighbor, round(list_cosine_similarity(q.v, b.v), 6) AS similarity FROM q JOIN b ON q.vec_id <> b.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbor) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5")
def _(t: Tables):
    return V.nearest(t.embeddings.where("vec_id % 20 = 0"), t.embeddings, 5)


@query("j23_nearest_by_tokens", "WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*')) AS t FROM benchmark), b AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*')) AS t FROM documents), s AS (SELECT item_id, doc_id, len(list_intersect(q.t, b.t)) AS c, len(q.t) AS nq, len(b.t) AS nb FROM q, b), j AS (SELECT item_id, doc_id AS neighbor, round(c / CAST(nq + nb - c AS DOUBLE), 6) AS similarity, row_number() OVER (PARTITION BY item_id ORDER BY round(c / CAST(nq + nb - c AS DOUBLE), 6) DESC, doc_id) AS k FROM s WHERE c > 0) SELECT item_id, neighbor, similarity FROM j WHERE k = 1")
def _(t: Tables):
    return V.most_similar_by_tokens(t.benchmark, t.documents, "item_id", "text", "doc_id", "text")


TOKENS = "t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS ts FROM benchmark), a AS (SELECT item_id, unnest(ts) AS w, generate_subscripts(ts, 1) AS i FROM t)"
EDGES = TOKENS + ", e AS (SELECT x.item_id, x.w AS a, y.w AS b, x.i AS p, y.i AS q FROM a x JOIN a y ON x.item_id = y.item_id AND y.i > x.i AND y.i < x.i + 3)"


def _words(t: Tables):
    return F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))


@query("g4_co_occurrence", f"WITH {EDGES} SELECT item_id, a AS src, b AS dst, count(*) AS weight FROM (SELECT item_id, a, b FROM e WHERE a <> b UNION ALL SELECT item_id, b, a FROM e WHERE a <> b) GROUP BY ALL")
def _(t: Tables):
    return V.co_occurrence(t.benchmark, "item_id", _words(t), 3)


@query("g5_positional_graph", f"WITH {EDGES} SELECT DISTINCT item_id, CAST(p - 1 AS INTEGER) AS src, CAST(q - 1 AS INTEGER) AS dst FROM (SELECT item_id, p, q FROM e UNION ALL SELECT item_id, q, p FROM e)")
def _(t: Tables):
    return V.co_occurrence(t.benchmark, "item_id", _words(t), 3, distinct_positions=True)


@query("v6_normalized_adjacency", f"WITH {EDGES}, g AS (SELECT item_id, a AS src, b AS dst, count(*) AS weight FROM (SELECT item_id, a, b FROM e WHERE a <> b UNION ALL SELECT item_id, b, a FROM e WHERE a <> b) GROUP BY ALL), d AS (SELECT item_id, src, sum(weight) AS d FROM g GROUP BY ALL) SELECT g.item_id, g.src, g.dst, round(weight / sqrt(CAST(x.d * y.d AS DOUBLE)), 6) AS value FROM g JOIN d x ON x.item_id = g.item_id AND x.src = g.src JOIN d y ON y.item_id = g.item_id AND y.src = g.dst")
def _(t: Tables):
    return V.normalized_adjacency(V.co_occurrence(t.benchmark, "item_id", _words(t), 3), "item_id")


@query("g1_property_graph", "WITH n AS (SELECT l_orderkey AS g, l_linenumber AS k FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY ALL), e AS (SELECT l_orderkey AS g, l_linenumber AS a, l_linenumber + 1 AS b FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY ALL), f AS (SELECT e.* FROM e JOIN n x ON x.g = e.g AND x.k = a JOIN n y ON y.g = e.g AND y.k = b), v AS (SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS id FROM (SELECT g, a AS k FROM f UNION SELECT g, b FROM f)) SELECT f.g AS graph_id, CAST(x.id AS INTEGER) AS src, 'next' AS kind, CAST(y.id AS INTEGER) AS dst FROM f JOIN v x ON x.g = f.g AND x.k = a JOIN v y ON y.g = f.g AND y.k = b")
def _(t: Tables):
    nodes = t.lineitem.where("l_partkey % 4 <> 0").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("key"), F.lit(True).alias("is_cfg"), F.lit("Call").alias("type")).distinct()
    edges = t.lineitem.where("l_partkey % 3 <> 0").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), F.lit("next").alias("kind")).distinct()
    return V.property_graph(nodes, edges, ["next"])[1]


@query("g3_first_seen_ids", "SELECT event_type, row_number() OVER (ORDER BY p, event_type) - 1 AS id FROM (SELECT event_type, min(ts) AS p FROM events GROUP BY event_type)")
def _(t: Tables):
    return V.first_seen_ids(t.events, "event_type", "ts").withColumn("id", F.col("id").cast("long"))


@query("v1_vector_norms", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def _(t: Tables):
    return t.embeddings.select("vec_id", F.round(E.norm("embedding"), 5).alias("norm"))


# ---- sources, jobs and streams --------------------------------------------------------------


_NAME = r"'^(.*?)_(\d+-\d+)_(train|validate|test)\.json$'"


@query("s12_file_groups", f"WITH f AS (SELECT DISTINCT CAST(doc_id % 10 AS VARCHAR) || '_0-' || CAST(512 * (1 + doc_id % 2) AS VARCHAR) || '_' || CASE (doc_id // 10) % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'validate' WHEN 2 THEN 'test' ELSE 'other' END || '.json' AS name FROM documents WHERE doc_id % 10 > 3 OR (doc_id // 10) % 4 < 2), p AS (SELECT regexp_extract(name, {_NAME}, 1) AS dataset, regexp_extract(name, {_NAME}, 2) AS bucket, regexp_extract(name, {_NAME}, 3) AS split FROM f WHERE regexp_matches(name, {_NAME})) SELECT dataset, bucket, split FROM p WHERE (dataset, bucket) IN (SELECT (dataset, bucket) FROM p GROUP BY dataset, bucket HAVING count(DISTINCT split) = 3)")
def _(t: Tables):
    d, turn = F.col("doc_id") % 10, F.floor(F.col("doc_id") / 10) % 4
    kind = F.when(turn == 0, "train").when(turn == 1, "validate").when(turn == 2, "test").otherwise("other")
    name = F.concat(d.cast("string"), F.lit("_0-"), (512 * (1 + F.col("doc_id") % 2)).cast("string"), F.lit("_"), kind, F.lit(".json"))
    return S.complete_groups(t.documents.where((d > 3) | (turn < 2)).select(name.alias("name")).distinct()).select("dataset", "bucket", "split")


@query("s13_devign_layout", "SELECT row_number() OVER (ORDER BY d.doc_id) - 1 AS index, text AS code, quality AS label, source FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(t: Tables):
    raw = t.documents.select("doc_id", F.col("text").alias("func"), "source").join(t.labels.select("doc_id", F.col("quality").alias("target")), "doc_id")
    return S.devign(raw, "doc_id").select("index", "code", "label", "source")


@query("s14_reveal_layout", "WITH a AS (SELECT row_number() OVER (ORDER BY d.doc_id) - 1 AS index, text AS code FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1), b AS (SELECT row_number() OVER (ORDER BY d.doc_id) - 1 + (SELECT count(*) FROM a) AS index, text AS code FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 0) SELECT index, code, 1 AS label, 'vulnerable' AS source_file FROM a UNION ALL SELECT index, code, 0, 'clean' FROM b")
def _(t: Tables):
    d = t.documents.select("doc_id", F.col("text").alias("code")).join(t.labels, "doc_id")
    return S.reveal(d.where("quality = 1"), d.where("quality = 0"), "doc_id")


@query("s17_column_transposition", "WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index, text AS code, turn % 2 = 0 AS a, turn % 3 = 0 AS b FROM conversations) SELECT conv_id, index, code, array_to_string(list_filter([CASE WHEN a THEN 'CWE-119' END, CASE WHEN b THEN 'CWE-120' END], lambda x: x IS NOT NULL), ',') AS cwe, CAST(a OR b AS INTEGER) AS label FROM r")
def _(t: Tables):
    x = F.struct("turn", "text", (F.col("turn") % 2 == 0).alias("a"), (F.col("turn") % 3 == 0).alias("b"))
    cols = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(x)).alias("x"))
    cols = cols.select("conv_id", F.col("x.text").alias("functionSource"), F.col("x.a").alias("CWE-119"), F.col("x.b").alias("CWE-120"))
    flags = ["CWE-119", "CWE-120"]
    rows = cols.select("conv_id", F.posexplode(F.arrays_zip(F.col("functionSource").alias("code"), *[F.col(f"`{f}`") for f in flags])).alias("index", "x"))
    cwe = F.filter(F.array(*[F.when(F.col("x").getField(f), F.lit(f)) for f in flags]), lambda v: v.isNotNull())
    return rows.select("conv_id", F.col("index").cast("long").alias("index"), F.col("x.code").alias("code"), F.array_join(cwe, ",").alias("cwe"), (F.size(cwe) > 0).cast("int").alias("label"))


@query("p27_path_parts", "WITH p AS (SELECT url, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS rel FROM pages) SELECT url, string_split(rel, '/')[1] AS top, string_split(rel, '/')[-1] AS file, CAST(len(string_split(rel, '/')) - 1 AS INTEGER) AS depth FROM p")
def _(t: Tables):
    p = S.path_parts(F.concat(F.lit("/root/"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")), "/root")
    return t.pages.select("url", p["top"].alias("top"), p["file"].alias("file"), p["depth"].alias("depth"))


PATHS = "p AS (SELECT doc_id, 'outputs/' || CASE doc_id % 3 WHEN 0 THEN 'unix_lora' WHEN 1 THEN 'code_imbalance' ELSE 'code' END || '/' || source || '_' || CASE WHEN doc_id % 2 = 0 THEN '0-512' ELSE '1024' END || CASE WHEN doc_id % 5 = 0 THEN '_0.3' ELSE '' END || '/results.csv' AS path FROM documents)"


def _paths(t: Tables):
    d = F.col("doc_id")
    cat = F.when(d % 3 == 0, "unix_lora").when(d % 3 == 1, "code_imbalance").otherwise("code")
    return t.documents.select("doc_id", F.concat(F.lit("outputs/"), cat, F.lit("/"), "source", F.lit("_"), F.when(d % 2 == 0, "0-512").otherwise("1024"), F.when(d % 5 == 0, "_0.3").otherwise(""), F.lit("/results.csv")).alias("path"))


@query("r3_runs_from_paths", f"WITH {PATHS} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'unix' ELSE 'code' END AS model, CASE doc_id % 3 WHEN 0 THEN 'lora' WHEN 1 THEN 'imbalance' END AS action, regexp_extract(path, '/([^/_]+)_[^/]*/results', 1) AS dataset, CASE WHEN doc_id % 2 = 0 THEN '0-512' ELSE '1024' END AS length, CASE WHEN doc_id % 5 = 0 THEN 0.3::DOUBLE END AS ratio FROM p")
def _(t: Tables):
    r = jobs.run_of_path(F.col("path"))
    return _paths(t).select("doc_id", *[r[n].alias(n) for n in ("model", "action", "dataset", "length", "ratio")])


@query("r4_options", f"WITH {PATHS} SELECT DISTINCT regexp_extract(path, '/([^/_]+)_[^/]*/results', 1) AS dataset, CASE WHEN doc_id % 2 = 0 THEN '0-512' ELSE '1024' END AS length, CASE WHEN doc_id % 5 = 0 THEN 0.3::DOUBLE END AS ratio FROM p")
def _(t: Tables):
    return jobs.options(_paths(t))


@query("k8_keyed_upsert", "SELECT user_id, max(ts) AS ts, arg_max(event_type, epoch_us(ts) * 10 + length(event_type)) AS event_type FROM (SELECT user_id, ts, min(event_type) AS event_type FROM events GROUP BY user_id, ts) GROUP BY user_id")
def _(t: Tables):
    e = t.events.groupBy("user_id", "ts").agg(F.min("event_type").alias("event_type"))
    half = F.pmod(F.xxhash64("user_id", "ts"), F.lit(2)) == 0
    return sinks.upsert(e.where(half), e.where(~half), "user_id", "ts")


@query("k5_p26_flattened_union", "SELECT 'a' AS run, 1 AS m_tp, NULL::INTEGER AS m_fn, 'x' AS note UNION ALL SELECT 'b', 2, 3, NULL")
def _(t: Tables):
    a = t.spark.sql("select 'a' as run, named_struct('tp', 1) as m, 'x' as note")
    b = t.spark.sql("select 'b' as run, named_struct('tp', 2, 'fn', 3) as m")
    return sinks.union_of_keys([sinks.flatten(a), sinks.flatten(b)], ["run"])


@query("r2_job_transitions", "SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE o_orderkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'stopped' WHEN 2 THEN 'queued' ELSE 'queued' END AS status FROM orders")
def _(t: Tables):
    k = F.col("o_orderkey")
    ts = lambda s: F.lit(s).cast("timestamp")
    table = t.orders.select(k.cast("string").alias("job_id"), F.lit("train").alias("job_type"), F.lit("queued").alias("status"), F.lit("{}").alias("params_json"), ts("2024-01-01 00:00:00").alias("created_at"), ts("2024-01-01 00:00:00").alias("updated_at"), F.lit(None).cast("int").alias("return_code"), F.lit(None).cast("string").alias("error_message"))
    to = F.when(k % 4 == 0, "running").when(k % 4 == 1, "stopped").when(k % 4 == 2, "completed")
    events = t.orders.select(k.cast("string").alias("job_id"), to.alias("status"), ts("2024-01-02 00:00:00").alias("updated_at"), F.lit(0).alias("return_code"), F.lit(None).cast("string").alias("error_message")).where("status is not null")
    return jobs.apply_transitions(table, events).select("job_id", "status")


@query("p31_tail_lines", "WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, turn, text FROM r WHERE k <= 2")
def _(t: Tables):
    return L.tail(t.conversations, ["conv_id"], "turn", 2).select("conv_id", "turn", "text")
