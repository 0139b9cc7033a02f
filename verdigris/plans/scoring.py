"""Queries of the metrics, merge, vote and calibration operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import calibration as C
from ..operators import merge as J
from ..operators import metrics as M
from ..operators import tables as L
from .registry import BIG, PA, PB, PC, REVIEW, Tables, cells_sql, div, query, rates_sql


@query("a1_confusion_metrics", f"WITH {PA}, c AS (SELECT {cells_sql()} FROM pa) SELECT *, {rates_sql()} FROM c")
def _(t: Tables):
    return M.confusion(t.pa)


@query("a1_confusion_metrics_large", f"WITH {BIG}, c AS (SELECT mode, {cells_sql()} FROM big GROUP BY mode) SELECT *, {rates_sql()} FROM c")
def _(t: Tables):
    return M.confusion(t.big, ["mode"])


OVER = f"""{PA}, {REVIEW}, j AS (
  SELECT pa."Index", "Label", "Prob", pa."Prediction" AS orig,
         CASE WHEN trim("ReviewPrediction") IN ('0', '1') THEN CAST(trim("ReviewPrediction") AS INTEGER) END AS r
  FROM pa LEFT JOIN review ON pa."Index" = review."Index"),
m AS (SELECT *, CASE WHEN orig = 1 AND r IS NOT NULL THEN r ELSE orig END AS fin FROM j)"""


def _merged(t: Tables):
    return J.override(t.pa, t.review)


@query("j4_reviewer_override", f"""WITH {OVER} SELECT "Index", "Label", orig AS "OriginalPrediction", fin AS "FinalPrediction",
  CASE WHEN orig <> 1 THEN 'small_model_unreviewed_negative' WHEN r IS NULL THEN 'small_model_positive_missing_reviewer' ELSE 'reviewer_override_positive_subset' END AS "DecisionSource" FROM m""")
def _(t: Tables):
    return _merged(t).select("Index", "Label", "OriginalPrediction", "FinalPrediction", "DecisionSource")


@query("a2_reviewed_before_after", f"WITH {OVER}, c AS (SELECT {cells_sql(pred='orig', prefix='before_', where='orig = 1')}, {cells_sql(pred='fin', prefix='after_', where='orig = 1')} FROM m) SELECT *, {rates_sql('before_')}, {rates_sql('after_')} FROM c")
def _(t: Tables):
    return M.before_after(_merged(t), "OriginalPrediction", "FinalPrediction", F.col("OriginalPrediction") == 1)


@query("a3_llm_only_metrics", f"""WITH {OVER} SELECT count(*) FILTER (WHERE "Label" = 1) AS positive_labels, count(*) FILTER (WHERE "Label" = 0) AS negative_labels,
  count(*) FILTER (WHERE fin = 1) AS positive_predictions, count(*) FILTER (WHERE fin = 0) AS negative_predictions, count(*) FILTER (WHERE fin <> orig) AS changed, count(*) FILTER (WHERE fin = orig) AS kept,
  count(*) FILTER (WHERE "Label" = 1 AND fin = 1) AS actual_positive_kept, count(*) FILTER (WHERE "Label" = 1 AND fin = 0) AS actual_positive_rejected FROM m WHERE orig = 1""")
def _(t: Tables):
    return L.reviewed_counters(_merged(t))


@query("p12_positive_case_status", f"""WITH {OVER} SELECT "Index", CASE WHEN orig <> 1 THEN 'missed_by_original_model' WHEN r IS NULL THEN 'true_positive_not_reviewed_by_llm' WHEN fin = 1 THEN 'true_positive_kept_by_llm' ELSE 'true_positive_rejected_by_llm' END AS status FROM m WHERE "Label" = 1""")
def _(t: Tables):
    reviewed = F.col("DecisionSource") == E.OVERRIDE
    return _merged(t).where("Label = 1").select("Index", E.positive_case_status("Label", "OriginalPrediction", "FinalPrediction", reviewed).alias("status"))


@query("a4_positive_case_summary", f"""WITH {OVER}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE orig = 1 AND r IS NOT NULL) AS reviewed, count(*) FILTER (WHERE orig <> 1) AS missed,
  count(*) FILTER (WHERE orig = 1 AND r IS NOT NULL AND fin = 1) AS kept, count(*) FILTER (WHERE orig = 1 AND r IS NOT NULL AND fin = 0) AS rejected, count(*) FILTER (WHERE orig = 1) AS called FROM m WHERE "Label" = 1)
SELECT *, {div('reviewed', 'total')} AS original_recall_on_actual_positives, {div('called', 'total')} AS true_original_recall, {div('kept', 'total')} AS final_recall, {div('kept', 'reviewed')} AS keep_rate, {div('rejected', 'reviewed')} AS reject_rate FROM s""")
def _(t: Tables):
    return L.positive_case_summary(_merged(t))


GATE = OVER.rsplit(", m AS", 1)[0].rsplit("\nm AS", 1)[0].rstrip(",") + """, g AS (SELECT *, CASE WHEN orig = 1 THEN "Prob" ELSE 1 - "Prob" END AS conf FROM j),
m AS (SELECT *, CASE WHEN conf >= 0.8 THEN orig WHEN r IS NOT NULL THEN r ELSE orig END AS fin, CASE WHEN conf >= 0.8 THEN 'small_model_high_confidence' WHEN r IS NOT NULL THEN 'llm_low_confidence_override' ELSE 'small_model_low_confidence_fallback' END AS src FROM g)"""


@query("j6_confidence_gate", f'WITH {GATE} SELECT "Index", "Label", orig AS "Prediction", fin AS "FinalPrediction", src AS "DecisionSource" FROM m')
def _(t: Tables):
    return J.gated_override(t.pa, t.review, 0.8).select("Index", "Label", "Prediction", "FinalPrediction", "DecisionSource")


@query("a5_decision_counters", f"""WITH {GATE} SELECT src AS "DecisionSource", orig AS "Prediction", count(*) AS n, count(*) FILTER (WHERE fin <> orig) AS changed FROM m GROUP BY src, orig""")
def _(t: Tables):
    return L.decision_counters(J.gated_override(t.pa, t.review, 0.8))


@query("a6_metrics_per_file", f"""WITH {PA}, x AS (SELECT pa.*, source FROM pa JOIN documents d ON d.doc_id = pa."Index"), c AS (SELECT source, {cells_sql()} FROM x GROUP BY source) SELECT *, {rates_sql()} FROM c""")
def _(t: Tables):
    return M.confusion(t.pa.join(t.documents.select(F.col("doc_id").alias("Index"), "source"), "Index"), ["source"])


@query("a7_regrouped_metrics", f"""WITH {BIG}, c AS (
  SELECT 'mode' AS dimension, mode AS value, {cells_sql()} FROM big GROUP BY mode UNION ALL SELECT 'status', status, {cells_sql()} FROM big GROUP BY status)
SELECT *, {rates_sql()} FROM c""")
def _(t: Tables):
    return M.grouped(t.big, ["mode", "status"])


@query("a8_macro_average", f"""WITH {BIG}, c AS (SELECT mode, {cells_sql()} FROM big GROUP BY mode), r AS (SELECT *, {rates_sql()} FROM c)
SELECT round(avg(accuracy), 6) AS avg_accuracy, round(avg(f1), 6) AS avg_f1, count(*) AS n_datasets FROM r""")
def _(t: Tables):
    return M.macro_average(M.confusion(t.big, ["mode"]), ["accuracy", "f1"])


BOTH = f"""{PA}, {PB}, b AS (SELECT pa."Index", pa."Label", pa."Prediction" AS x, pb."Prediction" AS y, greatest(pa."Prob", pb."Prob") AS q FROM pa JOIN pb ON pa."Index" = pb."Index")"""


@query("a9_a10_overlap", f"""WITH {BOTH}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE x = y) AS same, count(*) FILTER (WHERE x <> y) AS different, count(*) FILTER (WHERE x = 1 AND y = 1) AS both_positive, count(*) FILTER (WHERE x = 0 AND y = 0) AS both_negative,
  count(*) FILTER (WHERE x = 1 AND y = 0) AS only_a, count(*) FILTER (WHERE x = 0 AND y = 1) AS only_b, count(*) FILTER (WHERE x = 1 OR y = 1) AS positive_union,
  count(*) FILTER (WHERE "Label" = 1 AND x = 0 AND y = 1) AS rescued_by_b, count(*) FILTER (WHERE "Label" = 1 AND x = 1 AND y = 0) AS rescued_by_a FROM b)
SELECT *, {div('both_positive', 'positive_union')} AS jaccard, {div('same', 'n')} AS agreement FROM s""")
def _(t: Tables):
    both = t.pa.join(t.pb.select("Index", F.col("Prediction").alias("B")), "Index")
    return M.overlap(both, "Prediction", "B")


@query("j7_union_merge", f'WITH {BOTH} SELECT "Index", "Label", greatest(x, y) AS "Prediction", q AS "Prob" FROM b')
def _(t: Tables):
    return J.merge_two(t.pa, t.pb, "union")


@query("j7_intersection_merge", f'WITH {BOTH} SELECT "Index", "Label", least(x, y) AS "Prediction", q AS "Prob" FROM b')
def _(t: Tables):
    return J.checked_merge(t.pa.join(t.pb.select("Index"), "Index", "left_semi"), t.pb, "intersection")


@query("u3_key_difference", f"""WITH {PA}, {PB} SELECT "Index", 'only_a' AS side FROM pa WHERE "Index" NOT IN (SELECT "Index" FROM pb) UNION ALL SELECT "Index", 'only_b' FROM pb WHERE "Index" NOT IN (SELECT "Index" FROM pa)""")
def _(t: Tables):
    return J.key_differences(t.pa, t.pb)


def _votes(strategy: str, having: str = "") -> str:
    rule = {"any": "pos >= 1", "majority": "pos * 2 > n", "threshold": "pos >= 2", "weighted": "score >= 1.75"}[strategy]
    return f"""WITH {PA}, {PB}, {PC}, l AS (SELECT *, 'a' AS m, 0.5 AS w FROM pa UNION ALL SELECT *, 'b', 1.0 FROM pb UNION ALL SELECT *, 'c', 2.0 FROM pc),
g AS (SELECT "Index", max("Label") AS "Label", count(*) AS n, CAST(sum("Prediction") AS BIGINT) AS pos, round(sum("Prediction" * CAST(w AS DOUBLE)), 6) AS score, string_agg(m, ',' ORDER BY m) AS present,
  max("Prediction") FILTER (WHERE m = 'a') AS va, max("Prediction") FILTER (WHERE m = 'b') AS vb, max("Prediction") FILTER (WHERE m = 'c') AS vc FROM l GROUP BY "Index" {having})
SELECT "Index", "Label", n AS "TotalVotes", pos AS "PositiveVotes", score AS "Score", present AS "PresentModels", va AS "Vote_a", vb AS "Vote_b", vc AS "Vote_c", CAST({rule} AS INTEGER) AS "EnsemblePrediction", '{strategy}' AS "Strategy" FROM g"""


def _ensemble(t: Tables, strategy: str, keys: str, threshold=None):
    return J.vote({"a": t.pa, "b": t.pb, "c": t.pc}, strategy, keys, {"a": 0.5, "b": 1.0, "c": 2.0}, threshold)


@query("a30_vote_any", _votes("any"))
def _(t: Tables):
    return _ensemble(t, "any", "union")


@query("a30_vote_majority", _votes("majority", "HAVING count(*) = 3"))
def _(t: Tables):
    return _ensemble(t, "majority", "intersection")


@query("a30_vote_threshold", _votes("threshold"))
def _(t: Tables):
    return _ensemble(t, "threshold", "union", 2)


@query("a30_vote_weighted", _votes("weighted"))
def _(t: Tables):
    return _ensemble(t, "weighted", "union")


@query("a31_majority_of_three", f"""WITH {PA}, {PB}, {PC}, j AS (SELECT pa."Index", pa."Prediction" AS a, pb."Prediction" AS b, pc."Prediction" AS c FROM pa LEFT JOIN pb ON pa."Index" = pb."Index" LEFT JOIN pc ON pa."Index" = pc."Index"),
s AS (SELECT "Index", coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS ones, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n FROM j)
SELECT "Index", CASE WHEN ones * 2 > n THEN 1 WHEN ones * 2 < n THEN 0 END AS majority FROM s""")
def _(t: Tables):
    j = t.pa.select("Index", F.col("Prediction").alias("a")).join(t.pb.select("Index", F.col("Prediction").alias("b")), "Index", "left").join(t.pc.select("Index", F.col("Prediction").alias("c")), "Index", "left")
    return j.select("Index", J.majority_of_three("a", "b", "c").alias("majority"))


@query("a32_chunk_verdicts", """WITH e AS (SELECT l_orderkey AS g, l_partkey * 100 + l_linenumber AS o, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_suppkey % 2 AS INTEGER) END AS p, CASE WHEN l_partkey % 13 = 0 THEN 'error:' || CAST(l_partkey AS VARCHAR) END AS err FROM lineitem)
SELECT g AS group_id, count(*) AS n_chunks, CASE WHEN count(p) = count(*) THEN max(p) END AS prediction, CASE WHEN count(p) = count(*) THEN 'ok' ELSE 'partial' END AS status, arg_min(err, o) FILTER (WHERE err IS NOT NULL) AS first_error FROM e GROUP BY g""")
def _(t: Tables):
    bad = F.col("l_partkey") % 13 == 0
    e = t.lineitem.select(F.col("l_orderkey").alias("group_id"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("o"), F.when(~bad, (F.col("l_suppkey") % 2).cast("int")).alias("p"), F.when(bad, F.concat(F.lit("error:"), F.col("l_partkey").cast("string"))).alias("err"))
    return J.fold_chunks(e, "group_id", "o", "p", "err")


@query("a34_weighted_mean", f"""SELECT l_returnflag, {div('sum(l_extendedprice * l_quantity)', 'sum(l_quantity)')} AS weighted_mean FROM lineitem GROUP BY l_returnflag""".replace(", 6)", ", 3)"))
def _(t: Tables):
    m = M.weighted_mean(t.lineitem, F.col("l_extendedprice"), F.col("l_quantity"), ["l_returnflag"])
    return m.withColumn("weighted_mean", F.round("weighted_mean", 3))


MODELS = f"""{PA}, {PB}, l AS (SELECT *, 'a' AS model FROM pa UNION ALL SELECT *, 'b' FROM pb), c AS (SELECT model, {cells_sql()} FROM l GROUP BY model), r AS (SELECT *, {rates_sql()} FROM c)"""


@query("a37_unpivot", f"WITH {MODELS} SELECT model, metric, CAST(value AS DOUBLE) AS value FROM (SELECT model, CAST(tp AS DOUBLE) AS tp, CAST(total AS DOUBLE) AS total, accuracy, f1 FROM r) UNPIVOT (value FOR metric IN (tp, total, accuracy, f1))")
def _(t: Tables):
    return M.unpivot(_models(t), ["model"], ["tp", "total", "accuracy", "f1"])


@query("a36_pivot", f"""WITH {MODELS}, u AS (SELECT model, metric, CAST(value AS DOUBLE) AS value FROM (SELECT model, CAST(tp AS DOUBLE) AS tp, CAST(total AS DOUBLE) AS total, accuracy, f1 FROM r) UNPIVOT (value FOR metric IN (tp, total, accuracy, f1)))
SELECT metric, max(value) FILTER (WHERE model = 'a') AS a, max(value) FILTER (WHERE model = 'b') AS b FROM u GROUP BY metric""")
def _(t: Tables):
    return M.pivot(M.unpivot(_models(t), ["model"], ["tp", "total", "accuracy", "f1"]), "metric", "model", "value", ["a", "b"])


def _models(t: Tables):
    return M.confusion(t.pa.withColumn("model", F.lit("a")).unionByName(t.pb.withColumn("model", F.lit("b"))), ["model"])


@query("p29_metric_deltas", f"""WITH {MODELS}, p AS (SELECT max(f1) FILTER (WHERE model = 'a') AS fa, max(f1) FILTER (WHERE model = 'b') AS fb FROM r) SELECT fa, fb, round(fb - fa, 6) AS delta, round(fb - greatest(fa, fb), 6) AS delta_best FROM p""")
def _(t: Tables):
    return L.metric_deltas(_models(t), "model", "f1", "a", "b").withColumnsRenamed({"first": "fa", "second": "fb"})


@query("j9_probability_backfill", f"""WITH {PA}, {PB}, x AS (SELECT "Index", CASE WHEN "Index" % 3 <> 0 THEN "Prob" END AS "Prob" FROM pa) SELECT x."Index", coalesce(x."Prob", pb."Prob") AS "Prob" FROM x LEFT JOIN pb ON x."Index" = pb."Index" """)
def _(t: Tables):
    return J.backfill(t.pa.select("Index", F.when(F.col("Index") % 3 != 0, F.col("Prob")).alias("Prob")), t.pb, "Prob")


@query("p8_p11_flags", f"""WITH {BOTH} SELECT "Index", CASE WHEN "Label" = x THEN 'correct' WHEN "Label" = 0 AND x = 1 THEN 'FP' WHEN "Label" = 1 AND x = 0 THEN 'FN' ELSE 'unknown' END AS error_type,
  CAST(y <> "Label" AS INTEGER) AS judge_wrong, CAST(x <> "Label" AS INTEGER) AS small_wrong, CAST(x <> y AS INTEGER) AS changed, CAST(x <> "Label" AND y = "Label" AS INTEGER) AS fixed, CAST(x = "Label" AND y <> "Label" AS INTEGER) AS introduced, round(greatest(q, 1 - q), 6) AS confidence FROM b""")
def _(t: Tables):
    b = t.pa.join(t.pb.select("Index", F.col("Prediction").alias("y"), F.col("Prob").alias("q")), "Index")
    q = F.greatest("Prob", "q")
    return b.select("Index", E.error_kind("Label", "Prediction").alias("error_type"), *[c.alias(n) for n, c in E.change_flags("Label", "Prediction", "y").items()], F.round(E.confidence(q), 6).alias("confidence"))


# ---- calibration ----------------------------------------------------------------------------

EDGES = C.edges("0.5", "1.0", "0.1")
_CUTS = lambda e, v: " + ".join(f"CAST({v} >= {x!r} AS INTEGER)" for x in e)
_BIN = lambda e, v: f"CAST(CASE WHEN {v} < {e[0]!r} OR {v} > {e[-1]!r} THEN NULL ELSE least({_CUTS(e, v)} - 1, {len(e) - 2}) END AS INTEGER)"
CAL = """SELECT bin, count(*) AS count, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS ratio, round(avg(CAST("Label" = "Prediction" AS INTEGER)), 6) AS accuracy, round(avg(v), 6) AS avg_value,
  round(avg(v) - avg(CAST("Label" = "Prediction" AS INTEGER)), 6) AS gap, round(avg("Label"), 6) AS label_rate, round(avg("Prediction"), 6) AS call_rate FROM x WHERE bin IS NOT NULL GROUP BY bin"""


@query("a11_confidence_calibration", f"""WITH {BIG}, y AS (SELECT *, greatest("Prob", 1 - "Prob") AS v FROM big), x AS (SELECT *, {_BIN(EDGES, 'v')} AS bin FROM y) {CAL}""")
def _(t: Tables):
    return C.calibration(t.big, EDGES)


PROB_EDGES = C.edges("0", "1", "0.1")


@query("a12_probability_calibration", f"""WITH {BIG}, y AS (SELECT *, "Prob" AS v FROM big), x AS (SELECT *, {_BIN(PROB_EDGES, 'v')} AS bin FROM y) {CAL}""")
def _(t: Tables):
    return C.calibration(t.big, PROB_EDGES, use_confidence=False)


PB_SQL = f"""WITH {BIG}, x AS (SELECT *, {_BIN(C.POSITIVE_EDGES, '"Prob"')} AS bin FROM big), g AS (SELECT bin, count(*) AS n, count(*) FILTER (WHERE "Label" = 1) AS tp, count(*) FILTER (WHERE "Label" = 0) AS fp FROM x GROUP BY bin),
e AS (SELECT CAST(i AS INTEGER) AS bin, lo, hi FROM (VALUES {', '.join(f'({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)' for i, (a, b) in enumerate(zip(C.POSITIVE_EDGES, C.POSITIVE_EDGES[1:])))}) v(i, lo, hi)),
f AS (SELECT e.bin, lo, hi, coalesce(n, 0) AS count, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp FROM e LEFT JOIN g ON e.bin = g.bin),
s AS (SELECT *, {div('tp', 'count')} AS precision, {div('fp', 'sum(fp) OVER ()')} AS fp_share, {div('tp', 'sum(tp) OVER ()')} AS tp_share, {div('count', 'sum(count) OVER ()')} AS sample_share, round(fp * (1 - coalesce(CAST(tp AS DOUBLE) / nullif(count, 0), 0.0)), 6) AS gain FROM f)"""


@query("a13_positive_buckets", PB_SQL + " SELECT * FROM s")
def _(t: Tables):
    return C.positive_buckets(t.big)


@query("a14_best_bucket", PB_SQL + " SELECT (SELECT bin FROM s ORDER BY gain DESC, bin LIMIT 1) AS best_bin, (SELECT round(max(gain), 6) FROM s) AS best_score, (SELECT bin FROM s ORDER BY gain, bin LIMIT 1) AS worst_bin, (SELECT round(min(gain), 6) FROM s) AS worst_score")
def _(t: Tables):
    return C.best_bucket(C.positive_buckets(t.big))


SWEEP = f"""WITH {BIG}, t AS (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(101) r(i)), h AS (SELECT "Prob" AS p, count(*) FILTER (WHERE "Label" = 1) AS y, count(*) FILTER (WHERE "Label" = 0) AS n FROM big GROUP BY "Prob"),
c AS (SELECT threshold, CAST(coalesce(sum(y) FILTER (WHERE p >= threshold), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (WHERE p >= threshold), 0) AS BIGINT) AS fp, CAST(coalesce(sum(y) FILTER (WHERE p < threshold), 0) AS BIGINT) AS fn, CAST(coalesce(sum(n) FILTER (WHERE p < threshold), 0) AS BIGINT) AS tn FROM t, h GROUP BY threshold),
s AS (SELECT *, {div('tp', 'tp + fp')} AS precision, {div('tp', 'tp + fn')} AS recall, {div('2 * tp', '2 * tp + fp + fn')} AS f1, {div('fp', 'fp + tn')} AS fpr FROM c)"""


@query("a15_threshold_sweep", SWEEP + " SELECT * FROM s")
def _(t: Tables):
    return C.sweep(t.big)


@query("a15_best_thresholds", SWEEP + """ SELECT (SELECT threshold FROM s ORDER BY f1 DESC, threshold LIMIT 1) AS best_f1_threshold, (SELECT max(f1) FROM s) AS best_f1,
  (SELECT threshold FROM s WHERE fpr <= 0.1 ORDER BY recall DESC, threshold LIMIT 1) AS best_recall_threshold, (SELECT max(recall) FROM s WHERE fpr <= 0.1) AS best_recall""")
def _(t: Tables):
    return C.best_thresholds(C.sweep(t.big))


CONF = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


@query("a16_a17_coverage", f"""WITH {BIG}, t AS (SELECT unnest({CONF!r})::DOUBLE AS threshold), h AS (SELECT greatest("Prob", 1 - "Prob") AS v, count(*) AS n, count(*) FILTER (WHERE "Label" = "Prediction") AS ok FROM big GROUP BY 1),
c AS (SELECT threshold, CAST(coalesce(sum(n) FILTER (WHERE v >= threshold), 0) AS BIGINT) AS kept, CAST(coalesce(sum(ok) FILTER (WHERE v >= threshold), 0) AS BIGINT) AS correct, sum(n) AS total FROM t, h GROUP BY threshold)
SELECT threshold, kept, {div('kept', 'total')} AS coverage, {div('correct', 'kept')} AS accuracy, round(1 - coalesce(CAST(correct AS DOUBLE) / nullif(kept, 0), 0.0), 6) AS error_rate FROM c""")
def _(t: Tables):
    return C.coverage(t.big, CONF)


@query("a18_correlation", f"""WITH {PA} SELECT count(*) AS n, round(corr("Prob", CAST("Label" <> "Prediction" AS INTEGER)), 6) AS pearson FROM pa""")
def _(t: Tables):
    return C.correlation(t.pa, F.col("Prob"), (F.col("Label") != F.col("Prediction")).cast("int"))


@query("a19_a20_spread", f"""WITH {PA} SELECT count(*) AS n, round(avg("Prob"), 6) AS mean, round(median("Prob"), 6) AS median, min("Prob") AS least, max("Prob") AS greatest FROM pa""")
def _(t: Tables):
    return C.spread(t.pa, F.col("Prob"))


@query("a21_mean_of_means", "WITH m AS (SELECT source, avg(length(text)) AS m FROM documents GROUP BY source) SELECT round(avg(m), 4) AS mean_of_means, count(*) AS n FROM m")
def _(t: Tables):
    return L.mean_of_means(t.documents, ["source"], F.length("text"))


@query("a22_alignment", f"""WITH {PA}, {PB}, j AS (SELECT pa."Index", pa."Label" = pb."Label" AND pa."Prediction" = pb."Prediction" AS ok FROM pa JOIN pb ON pa."Index" = pb."Index") SELECT count(*) AS checked, count(*) FILTER (WHERE ok) AS matched, {div('count(*) FILTER (WHERE ok)', 'count(*)')} AS rate FROM j""")
def _(t: Tables):
    return L.alignment(t.pa, t.pb)
