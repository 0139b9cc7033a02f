"""Queries of the lookup, ordering, layout and orchestration rows that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import tables as L
from ..sources import readers as S
from .flows import provider_matrix
from .registry import PA, PB, PC, Tables, cells_sql, query, rates_sql


@query("j11_composite_lookup", "WITH m AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE turn % 3 <> 2) SELECT c.conv_id, c.turn, m.n AS length, m.n IS NULL AS unmatched FROM conversations c LEFT JOIN m ON m.conv_id = c.conv_id AND m.turn = c.turn")
def _(t: Tables):
    c = t.conversations
    meta = c.where("turn % 3 <> 2").select("conv_id", "turn", F.length("text").cast("long").alias("length"))
    return L.composite_lookup(c.select("conv_id", "turn"), meta, ["conv_id", "turn"], "length")


@query("j20_fold_zip", f'WITH {PA}, f AS (SELECT "Index", row_number() OVER (ORDER BY "Index") - 1 AS pos FROM pa), p AS (SELECT "Prediction", row_number() OVER (ORDER BY "Index") - 1 AS pos FROM pa) SELECT f."Index", f.pos AS source_order, p."Prediction" FROM f JOIN p ON f.pos = p.pos')
def _(t: Tables):
    return L.fold_zip(t.pa.select("Index"), t.pa.select("Index", "Prediction"), "Index").select("Index", "source_order", "Prediction")


@query("j26_lookup_by_priority", "WITH k AS (SELECT doc_id AS sample_id, source AS filename FROM documents WHERE doc_id % 3 <> 2), w AS (SELECT o_orderkey AS q, o_orderkey % 2000 AS sample_id, 'src' || CAST(o_orderkey % 25 AS VARCHAR) AS filename FROM orders), f AS (SELECT filename, min(sample_id) AS sample_id FROM k GROUP BY filename) SELECT q, coalesce(k.sample_id, f.sample_id) AS found FROM w LEFT JOIN k ON k.sample_id = w.sample_id LEFT JOIN f ON f.filename = w.filename")
def _(t: Tables):
    k = t.documents.where("doc_id % 3 <> 2").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("filename"))  # the catalogue lacks a third
    w = t.orders.select(F.col("o_orderkey").alias("q"), (F.col("o_orderkey") % 2000).alias("sample_id"), F.concat(F.lit("src"), (F.col("o_orderkey") % 25).cast("string")).alias("filename"))
    return L.lookup_by_priority(w, k.withColumn("id", F.col("sample_id")), "sample_id", "filename", "id", "found").select("q", "found")


@query("o2_o3_mixed_order", "WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN CAST(conv_id % 100 AS VARCHAR) ELSE role END AS k FROM conversations) SELECT conv_id, turn, k, coalesce(try_cast(k AS INTEGER), 1000000000) AS as_int, try_cast(k AS INTEGER) IS NULL AS is_text FROM x")
def _(t: Tables):
    k = F.when(F.col("turn") % 2 == 0, (F.col("conv_id") % 100).cast("string")).otherwise(F.col("role"))
    x = t.conversations.select("conv_id", "turn", k.alias("k"))
    is_text, as_int = L.mixed_order("k")
    return x.select("conv_id", "turn", "k", as_int.alias("as_int"), is_text.alias("is_text")).orderBy(is_text, as_int, "k", "conv_id", "turn")


@query("o7_o8_listing_order", "SELECT doc_id, lang, source, row_number() OVER (ORDER BY lang <> 'fr', lower(source), doc_id DESC) AS place FROM documents")
def _(t: Tables):
    d = t.documents.select("doc_id", "lang", "source")
    return L.listing_order(d, [F.col("lang") != "fr", F.lower("source"), F.col("doc_id").desc()])


@query("c11_interval_algebra", "SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey * 10 >= l_partkey AND l_suppkey * 10 + 5 <= l_partkey + 50 AS contained, l_suppkey * 10 < l_partkey + 50 AND l_partkey < l_suppkey * 10 + 5 AS overlapping FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(t: Tables):
    a, b, c, d = F.col("l_partkey"), F.col("l_partkey") + 50, F.col("l_suppkey") * 10, F.col("l_suppkey") * 10 + 5
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey")), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", "l_linenumber", "l_partkey", L.contained(a, b, c, d).alias("contained"), L.overlapping(a, b, c, d).alias("overlapping"))


@query("a27_a38_bucket_counts", "SELECT lang, count(*) AS n, CAST(max(len(regexp_extract_all(text, '[^ ]+'))) AS BIGINT) AS longest FROM documents GROUP BY lang")
def _(t: Tables):
    return L.bucket_counts(t.documents, ["lang"], F.regexp_count("text", F.lit("[^ ]+")))


@query("p18_infer_language", "WITH x AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '#include <a.h>' WHEN 1 THEN 'def f(x):' WHEN 2 THEN 'import java.util.List;' WHEN 3 THEN '<?php echo 1;' WHEN 4 THEN 'const f = x => x;' ELSE 'plain' END AS code FROM documents) SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'cpp' WHEN 1 THEN 'python' WHEN 2 THEN 'java' WHEN 3 THEN 'php' WHEN 4 THEN 'typescript' END AS language FROM x")
def _(t: Tables):
    k = F.col("doc_id") % 6
    code = F.when(k == 0, "#include <a.h>").when(k == 1, "def f(x):").when(k == 2, "import java.util.List;").when(k == 3, "<?php echo 1;").when(k == 4, "const f = x => x;").otherwise("plain")
    return t.documents.select("doc_id", E.infer_language(code).alias("language"))


@query("p25_p28_newlines_and_tags", "SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'a' || chr(10) || 'b' ELSE 'x' || chr(10) || 'y' END AS text, source AS tag FROM documents")
def _(t: Tables):
    raw = F.when(F.col("doc_id") % 2 == 0, "a\r\nb").otherwise("x\\ny")
    return t.documents.select("doc_id", E.normalize_newlines(raw).alias("text"), E.tag_of(F.concat(F.lit("set_"), "source", F.lit("_v1"))).alias("tag"))


@query("s15_keyed_map_rows", "SELECT conv_id, turn AS index, text AS code, nullif(CASE WHEN turn % 2 = 0 THEN '' ELSE role END, '') AS cwe FROM conversations")
def _(t: Tables):
    x = F.struct(F.col("text").alias("code"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role")).alias("cwe"))
    maps = t.conversations.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string").alias("k"), x.alias("v")))).alias("samples"))
    r = maps.select("conv_id", F.explode("samples").alias("k", "x"))
    turn = t.conversations.schema["turn"].dataType
    return r.select("conv_id", F.col("k").cast(turn).alias("index"), F.col("x.code").alias("code"), F.nullif(F.col("x.cwe"), F.lit("")).alias("cwe"))


@query("s19_split_names", "SELECT doc_id AS index, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validate' ELSE 'test' END AS split FROM documents")
def _(t: Tables):
    k = F.col("doc_id") % 3
    raw = t.documents.select(F.col("doc_id").alias("index"), F.col("text").alias("code"), F.lit(0).alias("label"), F.when(k == 0, "train").when(k == 1, "valid").otherwise("test").alias("split"))
    return S.mvuld(raw).select("index", "split")


@query("q8_q10_provider_matrix", f"""WITH {PA}, {PB}, {PC}, l AS (SELECT *, 'a' AS provider FROM pa UNION ALL SELECT *, 'b' FROM pb UNION ALL SELECT *, 'c' FROM pc), x AS (SELECT l.*, lang AS dataset FROM l JOIN documents d ON d.doc_id = l."Index"), c AS (SELECT provider, dataset, {cells_sql()} FROM x GROUP BY provider, dataset) SELECT *, {rates_sql()} FROM c""")
def _(t: Tables):
    return provider_matrix({"a": t.pa, "b": t.pb, "c": t.pc}, t.documents.select(F.col("doc_id").alias("Index"), F.col("lang").alias("dataset")))


@query("v4_v5_decisions", f'WITH {PA}, z AS (SELECT "Index", CAST("Index" % 17 - 8 AS DOUBLE) / 4 AS x, "Prob" FROM pa) SELECT "Index", round(1 / (1 + exp(-x)), 6) AS sigmoid, CAST("Prob" > 0.5 AS INTEGER) AS strict, CAST("Prob" >= 0.5 AS INTEGER) AS with_ties FROM z')
def _(t: Tables):
    x = (F.col("Index") % 17 - 8).cast("double") / 4
    return t.pa.select("Index", F.round(E.sigmoid(x), 6).alias("sigmoid"), E.decide("Prob").alias("strict"), E.decide("Prob", tie_positive=True).alias("with_ties"))
