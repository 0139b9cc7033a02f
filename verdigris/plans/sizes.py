"""Queries over what keeps joins, scans and metrics going on large or lopsided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental as I
from ..operators import relational as Q
from ..operators import scans as N
from ..operators import sketches as B
from ..session import shared_folder
from ..sources import readers as S
from . import scoring
from .registry import BIG, Tables, cells_sql, query, rates_sql

# ---- scans and order statistics -------------------------------------------------------------


@query("w8_scan_one_group", "SELECT doc_id, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS before, max(n) OVER w AS longest, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT doc_id, length(text) AS n FROM documents WHERE doc_id IS NOT NULL) WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(t: Tables):
    rows = t.documents.where("doc_id is not null").select("doc_id", F.length("text").cast("long").alias("n"))
    n = F.col("n")
    out = N.scan(rows, [], ["doc_id"], {"before": ("sum", n), "longest": ("max", n)}, {"total": n}, chunk_rows=200)
    return out.select("doc_id", F.coalesce("before", F.lit(0)).alias("before"), "longest", "total")


_SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@query("a20_exact_quantiles", f"SELECT share, round(quantile, 6) AS quantile FROM (SELECT unnest({_SHARES})::DOUBLE AS share, unnest(quantile_cont(CAST(l_extendedprice AS DOUBLE), {_SHARES})) AS quantile FROM lineitem)")
def _(t: Tables):
    return N.quantiles(t.lineitem, F.col("l_extendedprice"), _SHARES).withColumn("quantile", F.round("quantile", 6))


# ---- joins with large key lists and heavy keys ----------------------------------------------


@query("f10_bloom_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)")
def _(t: Tables):
    return B.semi(t.lineitem.select("l_orderkey", "l_linenumber"), t.orders.where("o_custkey % 10 = 3").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query("j16_bloom_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 1)")
def _(t: Tables):
    return Q.held_out(t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", sketch=True)


@query("j17_bloom_reweighting", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 6 = 2 THEN 3.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM lineitem")
def _(t: Tables):
    errors = t.part.where("p_partkey % 6 = 2").select(F.col("p_partkey").alias("l_partkey"))
    return Q.reweigh(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), errors, "l_partkey", "add", 2.5, sketch=True).select("l_orderkey", "l_linenumber", "weight")


@query("j12_skewed_join", "WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE CAST(event_id % 50 AS VARCHAR) END AS k, event_id FROM events), s AS (SELECT DISTINCT k, k || '!' AS name FROM e WHERE k <> '7') SELECT e.k, s.name, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM e LEFT JOIN s ON e.k = s.k GROUP BY ALL")
def _(t: Tables):
    key = F.when(F.col("event_id") % 3 == 0, "hot").otherwise((F.col("event_id") % 50).cast("string"))
    e = t.events.select(key.alias("k"), "event_id")
    names = e.select("k").distinct().where("k <> '7'").withColumn("name", F.concat("k", F.lit("!")))
    return Q.skew_join(e, names, ["k"], "left").groupBy("k", "name").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


# ---- metrics by partition -------------------------------------------------------------------


def _added(t: Tables, by: dict[str, str] | None = None) -> I.Metrics:
    """The large prediction table, added by line number, some of it twice."""
    m = I.Metrics(t.spark, shared_folder(t.spark, "metrics"), by, bounds=scoring.EDGES)
    modes = [str(i) for i in range(1, 8)]
    for k in [*modes, "3", "5"]:
        m.add(k, t.big.where(F.col("mode") == k))
    m.add("others", t.big.where(~F.col("mode").isin(modes)))
    return m


@query("a1_incremental", f"WITH {BIG}, c AS (SELECT status, {cells_sql()} FROM big GROUP BY status) SELECT *, {rates_sql()} FROM c")
def _(t: Tables):
    return _added(t, {"status": "string"}).confusion(["status"])


@query("a11_incremental", f"""WITH {BIG}, y AS (SELECT *, greatest("Prob", 1 - "Prob") AS v FROM big), x AS (SELECT *, {scoring._BIN(scoring.EDGES, 'v')} AS bin FROM y) {scoring.CAL}""")
def _(t: Tables):
    return _added(t).calibration()


@query("a15_incremental", scoring.SWEEP + " SELECT * FROM s")
def _(t: Tables):
    return _added(t).sweep()


# ---- nested records -------------------------------------------------------------------------

_KEY = "'a.c ' || (doc_id % 7 + 2) || ':1-90:2 ' || doc_id // 2"


@query("s18_d2a_nested", f"WITH r AS (SELECT {_KEY} AS func_key, quality AS label, doc_id % 4 + 1 AS pos, text AS code FROM documents JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 AND text IS NOT NULL), x AS (SELECT *, string_split(code, chr(10)) AS ls FROM r) SELECT func_key, max(label) AS label, min(code) AS code, coalesce(array_to_string(list_sort(list_distinct(list(ls[pos]) FILTER (WHERE pos <= len(ls)))), chr(10)), '') AS lines FROM x GROUP BY func_key")
def _(t: Tables):
    d = F.col("doc_id")
    key = F.concat(F.lit("a.c "), (d % 7 + 2).cast("string"), F.lit(":1-90:2 "), F.floor(d / 2).cast("string"))
    trace = lambda file, name, k: F.struct(F.lit(file).alias("file"), F.lit(name).alias("func_name"), k.alias("func_key"), d.alias("idx"))
    code = lambda file, name, text: F.struct(F.lit(file).alias("file"), F.lit(name).alias("name"), text.alias("code"), F.lit(0).alias("loc"))
    wrong = F.lit("wrong 1:1-2:2")
    seen = F.when(d % 5 == 0, F.array(trace("b.c", "f", wrong))).otherwise(F.array(trace("b.c", "f", wrong), trace("a.c", "g", wrong), trace("a.c", "f", key), trace("a.c", "f", wrong)))
    held = F.when(d % 11 == 0, F.create_map(F.lit("1"), code("a.c", "g", F.lit("no")))).otherwise(F.create_map(F.lit("0"), code("b.c", "f", F.lit("no")), F.lit("1"), code("a.c", "f", F.col("text")), F.lit("2"), code("a.c", "f", F.lit("late"))))
    info = F.struct(F.lit("a.c").alias("file"), F.lit("f").alias("procedure"), (d % 4 + d % 7 + 2).alias("line"))
    source = F.when(d % 7 == 0, "after_fix_extractor").otherwise("before_fix_extractor")
    record = F.to_json(F.struct(source.alias("label_source"), F.col("quality").alias("label"), F.lit("x").alias("bug_type"), info.alias("bug_info"), seen.alias("trace"), held.alias("functions")))
    raw = t.documents.join(t.labels, "doc_id").select(record.alias("value"))
    return S.d2a(S.d2a_records(raw)).select("func_key", "label", "code", F.array_join("lines", "\n").alias("lines"))
