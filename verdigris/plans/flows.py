"""Orchestrations: the reference's multi-step runs as plans over tables, each with a registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import responses as R
from ..functions import syntax
from ..operators import merge as J
from ..operators import metrics as M
from ..operators import relational as Q
from ..operators import sampling as Z
from ..operators import tables as L
from . import jobs
from .building import SAMPLES, H, _samples
from .registry import PA, PB, PC, REVIEW, Tables, cells_sql, query, rates_sql

LENGTHS = [0, 128, 256, 384, 512, 640, 768, 896, 1024]


def length_study(samples: DataFrame, length, bounds: list[int] = LENGTHS, ratio: float = 0.2, limit: int = 10_000) -> DataFrame:
    """Q3: length buckets without the open one, each brought to the ratio of positives and then to the limit."""
    b = samples.withColumn("bucket", Z.length_bucket(length, bounds)).where(F.col("bucket") != f"{bounds[-1]}-*")
    return Z.buckets_to_ratio(b, ratio, "bucket", limit)


def corpus_build(samples: DataFrame, length, bounds: list[int], limit: int, key: str = "index") -> DataFrame:
    """Q1: length buckets, cut to a limit by the ratio of the largest, and split by place within each."""
    b = samples.withColumn("bucket", Z.length_bucket(length, bounds)).select(key, "label", "bucket")
    return Z.positional_split(Z.truncate_buckets(b, limit, "bucket", key=key), key, ["bucket"])


def imbalance_sweep(samples: DataFrame, test: DataFrame, ratios: list[float], key: str = "index") -> DataFrame:
    """Q2: without the test set, the samples at each ratio of positives."""
    rest = Q.held_out(samples, test, key)
    return L.union_all([Z.to_positive_ratio(rest, r, key=key).withColumn("ratio", F.lit(r)) for r in ratios])


def provider_matrix(results: dict[str, DataFrame], datasets: DataFrame, key: str = "Index") -> DataFrame:
    """Q8, Q10: every provider's metrics on every data set (datasets: key, dataset), in one aggregation."""
    long = L.union_all([df.withColumn("provider", F.lit(n)) for n, df in results.items()])
    return M.confusion(long.join(datasets, key), ["provider", "dataset"])


def oof_pipeline(samples: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], folds: int = 5, exists: Callable[[str], DataFrame | None] = lambda name: None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> DataFrame:
    """Q4: every fold scored by a model of the others; a fold whose result exists is not made again.

    score(train, test) -> rows of test with Prediction and Prob; exists(name) gives a stored result, keep(name, df) stores one.
    """
    split = Z.stratified_folds(samples, folds)
    parts = []
    for k in range(folds):
        name = f"fold-{k}"
        got = exists(name)
        if got is None:
            got = keep(name, score(split.where(F.col("fold") != k), split.where(F.col("fold") == k)).withColumn("OOFFold", F.lit(k)))
        parts.append(got)
    return L.union_all(parts)


def review_flow(small: DataFrame, review: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Q5: positives go to the reviewer, valid answers override, and both sides are measured: (merged, metrics)."""
    merged = J.override(small, review(small.where("Prediction = 1")))
    return merged, M.before_after(merged, "OriginalPrediction", "FinalPrediction", F.lit(True))


# Fixed value: the instruction of review samples.
REVIEW_INSTRUCTION = "The small model predicts that the following code contains a vulnerability. Determine whether this prediction should be kept or rejected."


def reviewer_samples(preds: DataFrame, samples: DataFrame, code: str = "code") -> DataFrame:
    """Q9: instruction rows of the positive calls; a call without its sample fails the job."""
    pos = preds.where("Prediction = 1").select(F.col("Index").alias("index"), "Label", "Prob")
    j = J.strict_join(pos, samples.select("index", F.col(code).alias("code_")), "index")
    prompt = F.concat(F.lit("Small model confidence: "), F.col("Prob").cast("string"), F.lit("\n\nCode:\n"), F.col("code_"))
    return j.select(F.lit(REVIEW_INSTRUCTION).alias("instruction"), prompt.alias("input"), F.col("Prob").alias("prob"), F.when(F.col("Label") == 1, "1").otherwise("0").alias("output"), "index")


def detection_flow(samples: DataFrame, judged: DataFrame, default: int = 0) -> DataFrame:
    """Q11: every sample with its judgement, the default where there is none, and the metrics over all."""
    return M.confusion(J.with_defaults(samples, judged, "Index", {"Prediction": default}), [])


def over_datasets(tables: dict[str, DataFrame], flow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Q13: a flow over several data sets, with the name of each."""
    return L.union_all([flow(df).withColumn("dataset", F.lit(n)) for n, df in tables.items()])


def _bucket(n: str) -> str:
    parts = " ".join(f"WHEN {n} < {b} THEN '{a}-{b}'" for a, b in zip(LENGTHS, LENGTHS[1:]))
    return f"CASE {parts} END"


@query("q3_length_study", f"WITH {SAMPLES}, b AS (SELECT index, CAST(1 - label AS INTEGER) AS label, {_bucket('length(code) // 4')} AS bucket FROM s), k AS (SELECT * FROM b WHERE bucket IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY bucket, label ORDER BY {H}) AS k, count(*) FILTER (WHERE label = 1) OVER (PARTITION BY bucket) AS pos FROM k), p AS (SELECT index, label, bucket FROM r WHERE label = 1 OR k <= round_even(pos / CAST(0.2 AS DOUBLE) - pos, 0)), q AS (SELECT *, row_number() OVER (PARTITION BY bucket, label ORDER BY {H}) AS k, count(*) OVER (PARTITION BY bucket, label) AS c, count(*) OVER (PARTITION BY bucket) AS n FROM p) SELECT index, label, bucket FROM q WHERE n <= 20 OR k <= round_even(c * ((CAST(20 AS DOUBLE) + CAST(0.1 AS DOUBLE)) / n), 0)")
def _(t: Tables):
    s = _samples(t).select("index", (1 - F.col("label")).cast("int").alias("label"), F.floor(F.length("code") / 4).alias("units"))
    return length_study(s, F.col("units"), limit=20).select("index", "label", "bucket")


OOF = f"""WITH {SAMPLES}, f AS (SELECT index, label, source, CAST((row_number() OVER (PARTITION BY label ORDER BY {H}) - 1) % 5 AS INTEGER) AS fold FROM s),
m AS (SELECT a.index, a.label, a.source, a.fold, avg(b.label) AS p FROM f a LEFT JOIN f b ON b.source = a.source AND b.fold <> a.fold GROUP BY ALL)"""


def _rate_model(train: DataFrame, test: DataFrame) -> DataFrame:
    """Scores a sample by the rate of positives of its source among the training rows."""
    rate = train.groupBy("source").agg(F.avg("label").alias("p"))
    p = F.round(F.coalesce("p", F.lit(0.0)), 6)
    return test.join(rate, "source", "left").select(F.col("index").alias("Index"), F.col("label").alias("Label"), (p > 0.5).cast("int").alias("Prediction"), p.alias("Prob"))


@query("q4_oof_pipeline", OOF + """ SELECT index AS "Index", label AS "Label", CAST(round(coalesce(p, 0.0), 6) > 0.5 AS INTEGER) AS "Prediction", round(coalesce(p, 0.0), 6) AS "Prob", fold AS "OOFFold" FROM m""")
def _(t: Tables):
    return oof_pipeline(_samples(t).select("index", "label", "source"), _rate_model)


@query("q5_review_flow", f"""WITH {PA}, {REVIEW}, m AS (SELECT pa."Label" AS "Label", pa."Prediction" AS orig, CASE WHEN pa."Prediction" = 1 AND trim("ReviewPrediction") IN ('0', '1') THEN CAST(trim("ReviewPrediction") AS INTEGER) ELSE pa."Prediction" END AS fin FROM pa LEFT JOIN review ON review."Index" = pa."Index"),
c AS (SELECT {cells_sql(pred='orig', prefix='before_')}, {cells_sql(pred='fin', prefix='after_')} FROM m) SELECT *, {rates_sql('before_')}, {rates_sql('after_')} FROM c""")
def _(t: Tables):
    return review_flow(t.pa, lambda positives: t.review.join(positives.select("Index"), "Index", "left_semi"))[1]


def _preset_sql() -> str:
    """The ten votes over four models, where every one of a preset's models has voted."""
    columns = {"deepseek": "a", "baidu": "b", "llama": "c", "dscoder": "d"}
    parts = []
    for name, (models, strategy, threshold, weights) in J.PRESETS.items():
        votes = " + ".join(columns[m] for m in models)
        score = " + ".join(f"{columns[m]} * {(weights or {}).get(m, 1.0)}::DOUBLE" for m in models)
        rule = {"any": f"{votes} >= 1", "majority": f"({votes}) * 2 > {len(models)}", "threshold": f"{votes} >= {threshold}", "weighted": f"round({score}, 6) >= {threshold}::DOUBLE"}[strategy]
        present = " AND ".join(f"{columns[m]} IS NOT NULL" for m in models)
        parts.append(f"""SELECT '{name}' AS "Preset", "Index", CAST({rule} AS INTEGER) AS "EnsemblePrediction" FROM v WHERE {present}""")
    return " UNION ALL ".join(parts)


VOTES = f"""WITH {PA}, {PB}, {PC}, v AS (SELECT pa."Index", pa."Prediction" AS a, pb."Prediction" AS b, pc."Prediction" AS c, CASE WHEN pa."Index" % 3 <> 0 THEN 1 - pa."Prediction" END AS d FROM pa LEFT JOIN pb ON pb."Index" = pa."Index" LEFT JOIN pc ON pc."Index" = pa."Index")"""


@query("q6_ensemble_presets", f"{VOTES} {_preset_sql()}")
def _(t: Tables):
    other = t.pa.where("Index % 3 <> 0").withColumn("Prediction", 1 - F.col("Prediction"))
    models = {"deepseek": t.pa, "baidu": t.pb, "llama": t.pc, "dscoder": other}
    return L.union_all([J.vote_preset(models, p).select("Preset", "Index", "EnsemblePrediction") for p in J.PRESETS])


@query("q7_latest_checkpoints", "SELECT 'runs/' || source AS folder, max(doc_id) AS epoch FROM documents GROUP BY source")
def _(t: Tables):
    paths = t.documents.select(F.concat(F.lit("runs/"), "source", F.lit("/epoch-"), F.col("doc_id").cast("string")).alias("path"))
    other = t.documents.select(F.concat(F.lit("runs/"), "source", F.lit("/epoch-last")).alias("path"))
    return jobs.latest_checkpoint(paths.unionByName(other))


@query("q9_reviewer_samples", f"""WITH {PA} SELECT '{REVIEW_INSTRUCTION}' AS instruction, md5(text) AS code_hash, "Prob" AS prob, CAST("Label" AS VARCHAR) AS output, "Index" AS index FROM pa JOIN documents d ON d.doc_id = pa."Index" WHERE "Prediction" = 1""")
def _(t: Tables):
    r = reviewer_samples(t.pa, t.documents.select(F.col("doc_id").alias("index"), F.col("text").alias("code")))
    return r.select("instruction", F.md5(F.regexp_extract("input", r"(?s)^Small model confidence: [0-9.E-]+\n\nCode:\n(.*)$", 1)).alias("code_hash"), "prob", "output", "index")


@query("q11_detection_flow", f"""WITH {PB}, x AS (SELECT doc_id AS "Index", quality AS "Label", coalesce("Prediction", 0) AS "Prediction" FROM labels LEFT JOIN pb ON pb."Index" = doc_id), c AS (SELECT {cells_sql()} FROM x) SELECT *, {rates_sql()} FROM c""")
def _(t: Tables):
    return detection_flow(t.labels.select(F.col("doc_id").alias("Index"), F.col("quality").alias("Label")), t.pb.select("Index", "Prediction"))


@query("q13_datasets", f"""WITH {PA}, {PB}, x AS (SELECT 'a' AS dataset, * FROM pa UNION ALL SELECT 'b', * FROM pb), c AS (SELECT dataset, {cells_sql()} FROM x GROUP BY dataset) SELECT *, {rates_sql()} FROM c""")
def _(t: Tables):
    return over_datasets({"a": t.pa, "b": t.pb}, lambda df: M.confusion(df, []))


IDENT = "list_distinct(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*'))"


@query("q12_example_review", f"""WITH q AS (SELECT item_id, {IDENT} AS t FROM benchmark), s AS (SELECT x.item_id, y.item_id AS neighbor, len(list_intersect(x.t, y.t)) AS c, len(x.t) AS nx, len(y.t) AS ny FROM q x JOIN q y ON x.item_id <> y.item_id),
j AS (SELECT item_id, neighbor, row_number() OVER (PARTITION BY item_id ORDER BY round(c / CAST(nx + ny - c AS DOUBLE), 6) DESC, neighbor) AS k FROM s WHERE c > 0),
n AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN (item_id + 1) % (SELECT count(*) FROM benchmark) ELSE neighbor END AS neighbor FROM j WHERE k = 1)
SELECT b.item_id, n.neighbor, md5('Example: ' || coalesce(e.text, '') || ' Answer: ' || coalesce(CAST(e.item_id % 2 AS VARCHAR), '') || ' Code: ' || b.text) AS h FROM benchmark b JOIN n ON n.item_id = b.item_id LEFT JOIN benchmark e ON e.item_id = n.neighbor""")
def _(t: Tables):
    from ..operators.judge import with_examples

    n = t.benchmark.count()
    bank = t.benchmark.withColumn("Label", F.col("item_id") % 2)
    given = t.benchmark.where("item_id % 5 = 0").select("item_id", ((F.col("item_id") + 1) % n).alias("neighbor"))
    out = with_examples(t.benchmark, bank, "Example: {example} Answer: {answer} Code: {code}", "item_id", "text", "item_id", "text", given=given)
    return out.where("neighbor is not null").select("item_id", "neighbor", F.md5("prompt").alias("h"))


# ---- single rows ----------------------------------------------------------------------------


@query("f7_invalid_rows", "SELECT doc_id FROM documents WHERE NOT coalesce(text IS NOT NULL AND trim(text) <> '' AND length(text) <= 2000, FALSE)")
def _(t: Tables):
    return L.invalid(t.documents, L.valid_text("text", 2000)).select("doc_id")


@query("f11_weighted_rows", "SELECT doc_id, w <= 1.0 AS plain FROM (SELECT doc_id, coalesce(CASE WHEN doc_id % 4 > 0 THEN 0.5 * (doc_id % 4) END, 1.0) AS w FROM documents) WHERE w >= 1.0")
def _(t: Tables):
    weight = F.when(F.col("doc_id") % 4 > 0, 0.5 * (F.col("doc_id") % 4))
    return L.weighted(t.documents.withColumn("weight", weight), least=1.0).select("doc_id", (F.coalesce("weight", F.lit(1.0)) <= 1.0).alias("plain"))


@query("f14_empty_graphs", "WITH s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'train' ELSE 'test' END AS split FROM orders) SELECT * FROM s WHERE split <> 'train' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)")
def _(t: Tables):
    s = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "train").otherwise("test").alias("split"))
    return L.drop_empty_graphs(s, t.lineitem.where("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "split")


@query("f15_from_index", f'WITH {PA} SELECT "Index" FROM pa WHERE "Index" >= 20')
def _(t: Tables):
    return L.from_index(t.pa, 20).select("Index")


@query("a33_loss_means", "SELECT l_returnflag, count(l_discount) AS steps, round(avg(CAST(l_discount AS DOUBLE)), 6) AS mean_loss, round(exp(avg(CAST(l_discount AS DOUBLE))), 4) AS perplexity FROM lineitem GROUP BY l_returnflag")
def _(t: Tables):
    return L.loss_means(t.lineitem.withColumn("loss", F.col("l_discount").cast("double")), ["l_returnflag"], "loss")


@query("w3_group_bounds", "SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def _(t: Tables):
    return L.group_bounds(t.lineitem, ["l_orderkey"], "l_linenumber")


@query("w6_solid_prefix", r"WITH x AS (SELECT item_id, text, CAST(length(regexp_replace(text, '[ \t\n\r\x0b\x0c]', '', 'g')) AS INTEGER) AS solid FROM benchmark) SELECT item_id, solid AS whole, CAST(length(regexp_replace(substr(text, 1, length(text) // 2), '[ \t\n\r\x0b\x0c]', '', 'g')) AS INTEGER) AS half FROM x WHERE length(text) > 1")
def _(t: Tables):
    p = t.benchmark.where(F.length("text") > 1).select("item_id", F.length("text").alias("n"), R.solid_prefix("text").alias("p"))
    return p.select("item_id", F.element_at("p", -1).alias("whole"), F.element_at("p", F.floor(F.col("n") / 2).cast("int")).alias("half"))


@query("o4_synthetic_index", "SELECT source, lang, row_number() OVER (ORDER BY source, lang) - 1 AS index FROM (SELECT DISTINCT source, lang FROM documents)")
def _(t: Tables):
    return L.synthetic_index(t.documents, ["source", "lang"])


@query("c13_flat_chunks", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS chunk, turn, text FROM conversations")
def _(t: Tables):
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("chunks"))
    return L.flat_chunks(g, "chunks")


@query("c15_corrections", "WITH x AS (SELECT doc_id, 'a ' || source || ' .' AS s, unnest(['b ' || lang || ' !', '', 'c ,']) AS t FROM documents) SELECT 'a ' || source || '.' AS input, CASE t WHEN 'c ,' THEN 'c,' ELSE 'b ' || lang || '!' END AS target FROM x JOIN documents USING (doc_id) WHERE t <> ''")
def _(t: Tables):
    many = F.array(F.concat(F.lit("b "), "lang", F.lit(" !")), F.lit(""), F.lit("c ,"))
    return L.corrections(t.documents.select(F.concat(F.lit("a "), "source", F.lit(" .")).alias("s"), many.alias("m")), "s", "m")


@query("v3_mean_pool", "SELECT vec_id, round((embedding[1]::DOUBLE + embedding[3]::DOUBLE) / 2, 6) AS a, round((embedding[2]::DOUBLE + embedding[4]::DOUBLE) / 2, 6) AS b FROM embeddings")
def _(t: Tables):
    at = lambda i: F.element_at("embedding", i)
    states = F.array(F.array(at(1), at(2)), F.array(at(3), at(4)), F.array(at(5), at(6)))
    x = t.embeddings.select("vec_id", states.alias("s"), F.array(*map(F.lit, (1, 1, 1))).alias("m"), F.array(*map(F.lit, (0, 0, 1))).alias("special"))
    v = x.select("vec_id", L.mean_pool_no_special("s", "m", "special").alias("v"))
    return v.select("vec_id", F.round(F.element_at("v", 1), 6).alias("a"), F.round(F.element_at("v", 2), 6).alias("b"))


@query("g2_graphs_by_file", "SELECT n.l_orderkey AS file, nodes, edges FROM (SELECT l_orderkey, count(*) AS nodes FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY 1) n JOIN (SELECT l_orderkey, count(*) AS edges FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1) e ON e.l_orderkey = n.l_orderkey")
def _(t: Tables):
    line = t.lineitem.withColumnRenamed("l_orderkey", "file")
    return L.graphs_by_file(line.where("l_partkey % 4 <> 0"), line.where("l_partkey % 3 <> 0"))


@query("g10_batch_graphs", "SELECT conv_id, CAST(least(count(*), 3) AS INTEGER) AS n_nodes, coalesce(list(CAST(length(text) AS DOUBLE) ORDER BY turn)[2], 0.0) AS second, CASE WHEN count(*) < 3 THEN 0.0 ELSE list(CAST(length(text) AS DOUBLE) ORDER BY turn)[3] END AS third FROM conversations GROUP BY conv_id")
def _(t: Tables):
    n = t.conversations.select("conv_id", "turn", F.array(F.length("text").cast("double")).alias("x"))
    at = lambda i: F.element_at(F.element_at("features", i), 1)
    return L.batch_graphs(n, "conv_id", "turn", "x", 3).select("conv_id", "n_nodes", at(2).alias("second"), at(3).alias("third"))


@query("t17_number_texts", """SELECT doc_id, printf('%.1f', (doc_id % 8) / CAST(8 AS DOUBLE) * 100) || '%' AS share, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id // 4 AS VARCHAR) ELSE printf('%.4f', doc_id / CAST(4 AS DOUBLE)) END AS number, '&lt;' || source || '&gt;&amp;' AS safe FROM documents""")
def _(t: Tables):
    d = F.col("doc_id")
    return t.documents.select("doc_id", E.percent((d % 8) / F.lit(8.0)).alias("share"), E.number_text(d / F.lit(4.0)).alias("number"), E.xml_text(F.concat(F.lit("<"), "source", F.lit(">&"))).alias("safe"))


@query("p32_model_names", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'codellama/CodeLlama-7b-hf' WHEN 1 THEN 'meta-llama/Meta-Llama-3-8B' ELSE source END AS model FROM documents")
def _(t: Tables):
    k = F.col("doc_id") % 3
    return t.documents.select("doc_id", E.model_name(F.when(k == 0, "codellama").when(k == 1, " LLAMA3 ").otherwise(F.col("source"))).alias("model"))


@query("m3_first_char_labels", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS label FROM documents")
def _(t: Tables):
    k = F.col("doc_id") % 3
    return t.documents.select("doc_id", E.first_char_label(F.when(k == 0, " 1 yes").when(k == 1, "0").otherwise("no")).alias("label"))


@query("t12_final_response", """SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN '{"b": ' || turn || '}' WHEN 1 THEN '{"in": 1}' ELSE 'plain {x' END AS final FROM conversations""")
def _(t: Tables):
    k = (F.col("conv_id") + F.col("turn")) % 3
    reply = F.when(k == 0, F.concat(F.lit('first {"a": 1} then {"b": '), F.col("turn").cast("string"), F.lit("} end"))).when(k == 1, '{"out": {"in": 1}}').otherwise(" plain {x ")
    return t.conversations.select("conv_id", "turn", R.final_response(reply).alias("final"))


@query("r1_catalogue", "SELECT doc_id, source AS dataset, 'csv' AS kind, CASE WHEN doc_id % 2 = 0 THEN 'results.csv' ELSE 'Metrics.CSV' END AS file FROM documents")
def _(t: Tables):
    name = F.when(F.col("doc_id") % 2 == 0, "results.csv").otherwise("Metrics.CSV")
    paths = t.documents.select("doc_id", F.concat(F.lit("outputs/code/"), "source", F.lit("_512/"), name).alias("path"))
    facts = jobs.catalogue(paths.select("path")).select("path", "dataset", "kind", "file").distinct()
    return paths.join(facts, "path").select("doc_id", "dataset", "kind", "file")


@query("q2_test_is_held_out", f"WITH {SAMPLES} SELECT index FROM s WHERE index % 10 <> 0")
def _(t: Tables):
    s = _samples(t).select("index")
    return Q.held_out(s, s.where("index % 10 = 0"), "index")


@query("g6_g8_data_flow", "SELECT doc_id, source AS name, CAST(length(source) + 6 AS INTEGER) AS b_at, CAST(length(source) + 10 AS INTEGER) AS read_at, 0 AS def_at FROM documents")
def _(t: Tables):
    code = F.concat("source", F.lit(" = 1; b = "), "source")
    v = t.documents.select("doc_id", syntax.flow(code).alias("v"))
    return v.select("doc_id", F.col("v")[0]["name"].alias("name"), F.col("v")[1]["at"].alias("b_at"), F.col("v")[1]["sources"][0].alias("read_at"), F.col("v")[2]["sources"][0].alias("def_at"))


@query("g7_attention_mask", "SELECT doc_id, CAST(CASE doc_id % 2 WHEN 0 THEN 12 ELSE 17 END AS INTEGER) AS cells FROM documents")
def _(t: Tables):
    # two or three code tokens; node 0 stands for token 0, node 1 for tokens 0 and 1 and comes from node 0 (even rows: node 0 alone, from node 1 too)
    one = F.expr("array(named_struct('a', 0, 'b', 1, 'sources', array(1)), named_struct('a', 0, 'b', 2, 'sources', array(0)))")
    return t.documents.select("doc_id", F.size(L.attention_mask(F.lit(2) + (F.col("doc_id") % 2).cast("int"), one)).alias("cells"))


@query("q1_corpus_build", f"WITH {SAMPLES}, b AS (SELECT *, CASE WHEN length(code) < 1024 THEN '0-1024' WHEN length(code) < 4096 THEN '1024-4096' ELSE '4096-*' END AS bucket FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY bucket, label ORDER BY {H}) AS k, count(*) OVER (PARTITION BY bucket, label) AS c FROM b), m AS (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM b GROUP BY bucket)), t AS (SELECT index, label, bucket FROM r, m WHERE m <= 80 OR k <= round_even(c * ((CAST(80 AS DOUBLE) + CAST(0.1 AS DOUBLE)) / m), 0)), n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY index) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n FROM t) SELECT bucket, CASE WHEN i < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN i < floor(n * CAST(0.9 AS DOUBLE)) THEN 'validate' ELSE 'test' END AS split, index, CAST(label AS VARCHAR) AS output FROM n")
def _(t: Tables):
    kept = corpus_build(_samples(t), F.length("code"), [0, 1024, 4096], 80)
    return kept.select("bucket", "split", "index", F.col("label").cast("string").alias("output"))


@query("q2_imbalance_sweep", f"WITH {SAMPLES}, h AS (SELECT index, label FROM s WHERE index % 10 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H}) AS k, count(*) FILTER (WHERE label = 1) OVER () AS pos FROM (SELECT index, CAST(1 - label AS INTEGER) AS label FROM h)), q AS (SELECT unnest([0.2, 0.3, 0.4])::DOUBLE AS ratio) SELECT ratio, label, count(*) AS n FROM r, q WHERE label = 1 OR k <= round_even(pos / ratio - pos, 0) GROUP BY ratio, label")
def _(t: Tables):
    s = _samples(t).select("index", (1 - F.col("label")).alias("label"))
    return imbalance_sweep(s, s.where("index % 10 = 0"), [0.2, 0.3, 0.4]).groupBy("ratio", "label").agg(F.count("*").alias("n"))
