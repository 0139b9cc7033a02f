"""Sources, sinks, streams and reply scanners as queries: what is written comes back whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import responses as R
from ..operators import chunks as K
from ..operators import similarity as V
from ..session import shared_folder
from ..sources import readers as S
from ..sources import sinks, splits
from ..sources.deltas import KeyedTable
from ..streaming import online
from .registry import PA, Tables, cells_sql, query, rates_sql

ITEM = "item_id long, text string"


# ---- files ----------------------------------------------------------------------------------


@query("s1_s2_k2_json_array", "SELECT item_id, text FROM benchmark")
def _(t: Tables):
    path = shared_folder(t.spark, "array") + ".json"
    sinks.write_json_array(t.benchmark.select("item_id", "text"), path, ["item_id"])
    return S.read_json_array(t.spark, path, ITEM)


@query("s3_k1_json_lines", "SELECT doc_id, text, lang, n_chars, nullif(source, '') AS source FROM documents")
def _(t: Tables):
    path = shared_folder(t.spark, "lines")
    sinks.write_partitions(t.documents, path, ["source"])
    return S.read_json_lines(t.spark, path, "doc_id long, text string, lang string, n_chars long, source string")


@query("s4_json_like", "SELECT item_id, text FROM benchmark")
def _(t: Tables):
    path, items = shared_folder(t.spark, "mixed"), t.benchmark.select("item_id", "text")
    sinks.write_json_array(items.where("item_id % 3 = 0"), f"{path}/array.json")
    sinks.write_json_array(items.where("item_id < 0"), f"{path}/empty.json")
    items.where("item_id % 3 <> 0").write.json(f"{path}/lines")
    return S.read_json_like(t.spark, [f"{path}/array.json", f"{path}/empty.json", f"{path}/lines"], ITEM)


@query("s5_k4_csv", "SELECT doc_id, nullif(text, '') AS text, nullif(lang, '') AS lang, nullif(source, '') AS source FROM documents")
def _(t: Tables):
    path = shared_folder(t.spark, "csv")
    sinks.write_csv(t.documents, path, ["doc_id", "text", "lang", "source"])
    return S.read_csv(t.spark, path).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("s5_csv_splits", "SELECT doc_id, nullif(text, '') AS text, source FROM documents")
def _(t: Tables):
    path = shared_folder(t.spark, "quoted")
    sinks.write_csv(t.documents, path, ["doc_id", "text", "source"])
    return splits.read_csv_splits(t.spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")


@query("s2_array_scan", "SELECT item_id, text FROM benchmark")
def _(t: Tables):
    path = shared_folder(t.spark, "scanned") + ".json"
    sinks.write_json_array(t.benchmark.select("item_id", "text"), path, ["item_id"])
    return splits.scan_json_array(t.spark, path, ITEM)


@query("s6_tsv", "SELECT CAST(l_orderkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst, l_linestatus AS kind FROM lineitem")
def _(t: Tables):
    path = shared_folder(t.spark, "tsv")
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linestatus").alias("kind"), "l_quantity")
    sinks.write_csv(edges, path, ["src", "dst", "kind", "l_quantity"], sep="\t")
    return S.read_csv(t.spark, path, "\t", ["src", "dst", "kind"])


@query("s11_discovery", "SELECT 'source=' || source AS folder, CAST(1 AS BIGINT) AS files FROM documents WHERE source <> '' GROUP BY source")
def _(t: Tables):
    path = shared_folder(t.spark, "tree")
    sinks.write_partitions(t.documents.where("source <> ''").select("source").distinct().withColumn("one", F.lit(1)).coalesce(1), path, ["source"])
    files = S.discover(t.spark, [path], "part-*.json")
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.count("*").alias("files"))


@query("k6_lines_with_errors", "SELECT row_number() OVER (ORDER BY item_id) AS line, CASE WHEN item_id % 10 <> 3 THEN item_id END AS item_id, CASE WHEN item_id % 10 = 3 THEN '{\"item_id\": ' || item_id END AS corrupt FROM benchmark")
def _(t: Tables):
    path = shared_folder(t.spark, "errors")
    i = F.col("item_id").cast("string")
    lines = F.when(F.col("item_id") % 10 == 3, F.concat(F.lit('{"item_id": '), i)).otherwise(F.concat(F.lit('{"item_id": '), i, F.lit("}")))
    t.benchmark.coalesce(1).sortWithinPartitions("item_id").select(lines.alias("value")).write.text(path)
    return sinks.lines_with_errors(t.spark, path, "item_id long").select("line", "item_id", "corrupt")


@query("k10_k11_idempotent_jobs", "SELECT n_nationkey, n_name || '!' AS n_name FROM nation")
def _(t: Tables):
    path = shared_folder(t.spark, "job")
    first = sinks.once(t.spark, path, lambda: t.nation.select("n_nationkey", "n_name"))
    again = sinks.once(t.spark, path, lambda: t.nation.select("n_nationkey", F.lit("not run").alias("n_name")))
    sinks.replace_folder(again.join(first, ["n_nationkey", "n_name"]).withColumn("n_name", F.concat("n_name", F.lit("!"))), path)
    return sinks.once(t.spark, path, lambda: t.nation.where("false").select("n_nationkey", "n_name"))


# ---- layouts --------------------------------------------------------------------------------


@query("s16_diversevul_layout", "SELECT text AS func, quality AS target, CASE WHEN l.doc_id % 3 > 0 THEN array_to_string(list_transform(range(1, 1 + CAST(l.doc_id % 3 AS BIGINT)), lambda i: 'CWE-' || i), ',') END AS cwe FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(t: Tables):
    n = F.col("doc_id") % 3
    names = F.when(n == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("CWE-"), i.cast("string"))))
    raw = t.documents.join(t.labels, "doc_id").select(F.col("text").alias("func"), F.col("quality").alias("target"), names.alias("cwe"), F.lit("a message").alias("message"))
    return S.diversevul(raw).withColumn("cwe", F.array_join("cwe", ","))


D2A = "SELECT doc_id // 2 AS func_key, quality AS label, doc_id % 4 + 1 AS bug_line, text AS code FROM documents JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND text IS NOT NULL"


@query("s18_d2a_layout", f"WITH r AS ({D2A}), x AS (SELECT *, string_split(code, chr(10)) AS ls FROM r) SELECT CAST(func_key AS VARCHAR) AS func_key, max(label) AS label, min(code) AS code, coalesce(array_to_string(list_sort(list_distinct(list(ls[bug_line]) FILTER (WHERE bug_line <= len(ls)))), chr(10)), '') AS lines FROM x GROUP BY func_key")
def _(t: Tables):
    d = F.col("doc_id")
    raw = t.documents.join(t.labels, "doc_id").select(
        F.when(d % 7 == 0, "after_fix_extractor").otherwise("before_fix_extractor").alias("label_source"), F.col("quality").alias("label"), (d % 4 + 9).cast("int").alias("bug_line"),
        F.floor(d / 2).cast("string").alias("func_key"), F.when(d % 5 == 0, "no place").otherwise("src/f.c 9:1-20:2").alias("location"), F.col("text").alias("code"),
    )
    return S.d2a(raw).withColumn("lines", F.array_join("lines", "\n"))


# ---- replies and code -----------------------------------------------------------------------


@query("p23_format_blocks", "SELECT item_id, trim(text) AS prompt FROM benchmark")
def _(t: Tables):
    tails = F.array(*[F.lit(x) for x in ("\nReturn only 0 or 1.", '\noutput in JSON format: {"a":\n 1}', "\nOutput requirements:\n{x}  ", "")])
    return t.benchmark.select("item_id", E.strip_format_blocks(F.concat("text", F.element_at(tails, (F.col("item_id") % 4 + 1).cast("int")))).alias("prompt"))


_IDS = "list_distinct(regexp_extract_all(lower({}), '[A-Za-z_][A-Za-z0-9_]*'))"


@query("t4_jaccard", f"WITH x AS (SELECT conv_id, turn, {_IDS.format('c.text')} AS a, {_IDS.format('d.text')} AS b FROM conversations c JOIN documents d ON d.doc_id = c.conv_id) SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END AS similarity FROM x")
def _(t: Tables):
    both = t.conversations.withColumnRenamed("text", "said").join(t.documents.select(F.col("doc_id").alias("conv_id"), "text"), "conv_id")
    return both.select("conv_id", "turn", E.jaccard(E.identifiers("said"), E.identifiers("text")).alias("similarity"))


_CODE = "'int a; // first' || chr(10) || 'b(' || text || ') /* x */ /* y' || chr(10) || '*/ c; /* open'"


@query("t7_c_comments", rf"SELECT doc_id, regexp_replace({_CODE}, '/\*[\s\S]*?\*/|//[^\n]*', '', 'g') AS code FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", E.strip_c_comments(F.concat(F.lit("int a; // first\nb("), "text", F.lit(") /* x */ /* y\n*/ c; /* open"))).alias("code"))


@query("t13_response_text", "SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN trim(text) END AS reply FROM conversations")
def _(t: Tables):
    part = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    body = lambda content: F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    plain, parts = body(F.col("text")), body(F.array(part("reasoning", F.lit("let me see")), part("text", F.col("text"))))
    turn = F.col("turn") % 3
    return t.conversations.select("conv_id", "turn", R.response_text(F.when(turn == 0, plain).when(turn == 1, parts).otherwise('{"error": "busy"}')).alias("reply"))


@query("t14_error_summary", r"SELECT doc_id, substr(trim(regexp_replace('  HTTP 500' || chr(9) || text, '\s+', ' ', 'g')), 1, 200) AS summary FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", E.error_summary(F.concat(F.lit("  HTTP 500\t"), "text")).alias("summary"))


@query("t15_start_line", r"WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a.c ' || doc_id || ':1-20:2, 7:1-8:1' WHEN 1 THEN 'a.c ' || doc_id || ':1' ELSE text END AS place FROM documents) SELECT doc_id, TRY_CAST(nullif(regexp_extract(place, '\b(\d+):\d+-\d+:\d+\b', 1), '') AS INTEGER) AS line FROM x")
def _(t: Tables):
    d = F.col("doc_id").cast("string")
    place = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a.c "), d, F.lit(":1-20:2, 7:1-8:1"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("a.c "), d, F.lit(":1"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", E.start_line(place).alias("line"))


@query("c10_prompt_mask", "WITH x AS (SELECT doc_id, doc_id % 7 AS p, doc_id % 5 AS a FROM documents), i AS (SELECT *, unnest(range(p + a)) AS pos FROM x) SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos < p THEN pos ELSE pos - p + 100 END AS id, CASE WHEN pos < p THEN CAST(-100 AS BIGINT) ELSE pos - p + 100 END AS label FROM i")
def _(t: Tables):
    def span(first: int, n):
        return F.transform(F.slice(F.sequence(F.lit(0), F.lit(9)), 1, n.cast("int")), lambda i: i.cast("long") + first)

    ids, labels = K.mask_prompt(span(0, F.col("doc_id") % 7), span(100, F.col("doc_id") % 5))
    return t.documents.select("doc_id", F.posexplode(F.arrays_zip(ids.alias("id"), labels.alias("label"))).alias("pos", "x")).select("doc_id", "pos", "x.id", "x.label")


# ---- vectors and scores ---------------------------------------------------------------------


@query("a35_node_means", "WITH x AS (SELECT conv_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM conversations JOIN embeddings ON vec_id = conv_id + turn), m AS (SELECT conv_id, d, round(avg(CAST(v AS DOUBLE)), 6) AS m FROM x GROUP BY conv_id, d) SELECT conv_id, CAST(d - 1 AS INTEGER) AS d, m AS x FROM m")
def _(t: Tables):
    tokens = t.conversations.select("conv_id", (F.col("conv_id") + F.col("turn")).alias("token"))
    return V.node_embeddings(tokens, t.embeddings.select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector")), ["conv_id"]).select("conv_id", F.posexplode("vector").alias("d", "x"))


def _scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        prob = b["Index"] * 7919 % 1000 / 1000.0
        yield pd.DataFrame({"Index": b["Index"], "Label": b["Label"], "Prediction": (prob > 0.5).astype("int32"), "Prob": prob})


@query("m1_batch_scores", f"WITH {PA} SELECT * FROM pa")
def _(t: Tables):
    rows = t.labels.select(F.col("doc_id").alias("Index"), F.col("quality").alias("Label"))
    return K.score_batches(rows, _scorer, "Index long, Label int, Prediction int, Prob double")


@query("o5_first_positives", f'WITH {PA} SELECT "Index", "Prob" FROM pa WHERE "Prediction" = 1 ORDER BY "Prob" DESC, "Index" LIMIT 50')
def _(t: Tables):
    return t.pa.where("Prediction = 1").orderBy(F.desc("Prob"), "Index").limit(50).select("Index", "Prob")


# ---- streams --------------------------------------------------------------------------------


def _stored(t: Tables, df: DataFrame, name: str) -> str:
    path = shared_folder(t.spark, name)
    df.write.parquet(path)
    return path


def _run(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream to its end; the result of its last micro-batch, or in append mode of all, read from the shared folder."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={epoch if mode == 'append' else 0}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{folder}/out") if sinks.exists(spark, f"{folder}/out") else spark.createDataFrame([], stream.schema)


@query("m2_online_confusion", f"WITH {PA}, c AS (SELECT {cells_sql()} FROM pa) SELECT *, {rates_sql()} FROM c")
def _(t: Tables):
    path = _stored(t, t.pa, "predictions")
    return _run(online.running_confusion(online.file_stream(t.spark, path, t.pa.schema)), shared_folder(t.spark, "online"), "complete")


@query("m2_stateful_confusion", f"WITH {PA}, x AS (SELECT pa.*, source FROM pa JOIN documents ON doc_id = \"Index\"), c AS (SELECT source, {cells_sql()} FROM x GROUP BY source) SELECT *, {rates_sql()} FROM c")
def _(t: Tables):
    rows = t.pa.join(t.documents.select(F.col("doc_id").alias("Index"), "source"), "Index").withColumn("at", F.timestamp_seconds(F.col("Index") + 1_700_000_000))
    path, folder = _stored(t, rows, "predictions"), shared_folder(t.spark, "tallies")
    rows.write.mode("append").parquet(path)  # a replay: every sample comes twice
    stream = online.tallies(online.file_stream(t.spark, path, rows.schema, files_per_trigger=8), ["source"], "Index", "at", late="3650 days", shards=4)
    table = KeyedTable(t.spark, f"{folder}/table", stream.schema, "part", "n", buckets=4)
    online.upsert_batches(stream, table, f"{folder}/state").awaitTermination()
    return online.tally_rates(table.read(), ["source"])


@query("m2_windowed_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, CAST(count(value) AS BIGINT) AS total FROM events GROUP BY ALL")
def _(t: Tables):
    ones = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.when(F.col("value").isNotNull(), 1).otherwise(0).alias("one"))
    stream = online.windowed(online.file_stream(t.spark, _stored(t, ones, "events"), ones.schema), "ts", "1 hour", None, ["event_type"], "one")
    return _run(stream, shared_folder(t.spark, "windows"), "complete").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("k9_upsert_batches", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(t: Tables):
    rows, folder = t.orders.select("o_custkey", "o_orderkey"), shared_folder(t.spark, "upsert")
    stream = online.file_stream(t.spark, _stored(t, rows.repartition(4, "o_orderkey"), "orders"), rows.schema, files_per_trigger=1)
    table = KeyedTable(t.spark, f"{folder}/table", rows.schema, "o_custkey", "o_orderkey", buckets=4)
    online.upsert_batches(stream, table, f"{folder}/state", compact_every=3).awaitTermination()
    return table.read()


@query("k8_base_and_deltas", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) || '!' WHEN c_custkey % 5 = 0 THEN lower(c_name) ELSE c_name END AS c_name, CAST(CASE WHEN c_custkey % 3 = 0 THEN 3 WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS changed FROM customer")
def _(t: Tables):
    row = lambda name, n: t.customer.select("c_custkey", name.alias("c_name"), F.lit(n).alias("changed"))
    table = KeyedTable(t.spark, shared_folder(t.spark, "deltas"), "c_custkey long, c_name string, changed int", "c_custkey", "changed", buckets=8)
    table.upsert(row(F.col("c_name"), 1))
    table.upsert(row(F.lower("c_name"), 2).where("c_custkey % 5 = 0"))
    table.compact(layers=1)
    table.upsert(row(F.upper("c_name"), 3).where("c_custkey % 3 = 0"))
    table.upsert(row(F.concat(F.upper("c_name"), F.lit("!")), 3).where("c_custkey % 3 = 0"))  # of equal versions the last one stays
    table.upsert(row(F.lit("late"), 0))
    return table.read()


@query("k9_key_ranges", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE doc_id IS NOT NULL")
def _(t: Tables):
    path = shared_folder(t.spark, "ranges")
    width = (t.documents.agg(F.max("doc_id")).first()[0] or 0) // 4 + 1
    work = lambda part: part.select("doc_id", F.length("text").cast("long").alias("n"))
    for _again in range(2):  # the second run finds every range done
        online.by_key_range(t.documents, "doc_id", width, path, work)
    done = "doc_id long, n long"
    return t.spark.read.schema(done).option("recursiveFileLookup", True).parquet(path) if sinks.exists(t.spark, path) else t.spark.createDataFrame([], done)
