"""The before/after export as one plan, review groups with full code, and queries that run operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import responses as R
from ..operators import chunks as K
from ..operators import judge
from ..operators import relational as Q
from ..operators import similarity as V
from ..operators import tables as L
from ..session import shared_folder
from ..sources import readers as S
from ..sources import sinks
from .building import CHUNKS
from .registry import Tables, query


def contrastive_pairs(listed: DataFrame, files: DataFrame, methods: DataFrame, fixes: DataFrame, cwe: DataFrame, most_changed: int = 200, most_code: int = 100_000, most_diff: int = 100_000, n: int | None = None) -> DataFrame:
    """A row for each pair of a method before and after its change, with the changed lines of both.

    listed names the file changes to take, in an order; files and methods that are too long stay out, a file's k-th
    method of a key before the change goes with the k-th after it, and pairs without a change are dropped. The list is small next to
    the files, the files next to the methods, which are shuffled once for their file and once for their pairs.
    """
    ids = L.small_changes(listed, "file_change_id", "changed_lines", "place", most_changed, n).select("file_change_id")
    kept = files.where(L.short_text("diff", most_diff)).join(ids, "file_change_id", "left_semi")
    code = methods.where(L.valid_text("code", most_code or None))
    rows = Q.methods_with_classes(kept.drop("diff"), code, fixes, cwe).withColumn("pair_key", E.pair_key("signature", "name"))
    pairs = Q.zip_pairs(rows, ["file_change_id", "pair_key"], E.is_before("before_change"), ["method_change_id", "cve_id", "cwe_id"], ["hash", "filename", "cve_id", "cwe_id", "method_change_id", "code"])
    b = {c: F.col(f"before.{c}") for c in ("hash", "filename", "cve_id", "cwe_id")}
    ranges = K.changed_ranges(F.col("before.code"), F.col("after.code"))
    out = pairs.withColumn("ranges", ranges).where((F.size("ranges.before") > 0) | (F.size("ranges.after") > 0))
    out = out.withColumn("pair_id", E.pair_id(b["cve_id"], b["hash"], "file_change_id", b["filename"], "pair_key"))
    return out.select(
        "pair_id", E.hash_split("pair_id").alias("split"), "file_change_id", "pair_key", "nth", b["cve_id"].alias("cve_id"), E.normalize_cwe(b["cwe_id"]).alias("cwe_id"),
        "before", "after", F.col("ranges.before").alias("before_ranges"), F.col("ranges.after").alias("after_ranges"),
    )


def changed_chunks(pairs: DataFrame, lines: int = 80) -> DataFrame:
    """Chunks of both sides that meet a changed range, of the pairs that have one on each side, with their label."""
    key = ["pair_id", "nth", "split"]
    side = lambda s: pairs.select(*key, F.lit(s).alias("side"), F.col(f"{s}.code").alias("code"), F.col(f"{s}_ranges").alias("ranges"))
    cut = K.label_chunks(K.explode_chunks(side("before").unionByName(side("after")), "code", lines), "side", "ranges")
    kept = K.keep_changed(cut.withColumn("pair_", F.struct("pair_id", "nth")), "pair_", "side", E.overlaps_any("start_line", "end_line", "ranges"))
    return kept.select(*key, "side", "chunk_id", "start_line", "end_line", "label", "chunk_text")


def _pairs(t: Tables) -> DataFrame:
    """Conversations as methods: what a user says stands before a change, the answer after it."""
    c, text = t.conversations, F.col("text")
    listed = c.select((F.col("conv_id").cast("string")).alias("file_change_id"), (F.col("turn") * 60).cast("string").alias("changed_lines"), (F.col("conv_id") * 100 + F.col("turn")).alias("place"))
    path = shared_folder(t.spark, "listed")
    sinks.write_csv(listed.where("conv_id % 11 <> 3"), path, ["file_change_id", "changed_lines", "place"])
    listed = S.read_csv(t.spark, path).withColumn("place", F.col("place").cast("long"))
    ids = c.select("conv_id").distinct()
    conv = F.col("conv_id").cast("string")
    files = ids.select(conv.alias("file_change_id"), F.concat(F.lit("h"), conv).alias("hash"), F.concat(F.lit("f"), conv, F.lit(".c")).alias("filename"), F.when(F.col("conv_id") % 4 == 0, F.repeat(F.lit("x"), (F.col("conv_id") % 90).cast("int"))).alias("diff"))
    methods = c.select(
        conv.alias("file_change_id"), (F.col("turn") + 1).alias("method_change_id"), F.concat(F.lit("m"), (F.floor(F.col("turn") / 2) % 2).cast("string")).alias("name"), F.when(F.col("conv_id") % 3 == 0, F.lit(" sig ")).alias("signature"),
        F.when(F.col("role") == "user", "True").otherwise("0").alias("before_change"), F.when((F.col("conv_id") % 5 == 0) & (F.col("role") == "assistant") & (F.col("turn") > 2), F.lit("same\ntext")).when(F.col("conv_id") % 5 == 0, F.lit("same\ntext")).otherwise(text).alias("code"),
    )
    fixes = ids.where("conv_id % 2 = 0").select(F.concat(F.lit("h"), conv).alias("hash"), F.concat(F.lit("CVE-"), (F.col("conv_id") % 7).cast("string")).alias("cve_id"))
    cwe = t.spark.range(0, 5).select(F.concat(F.lit("CVE-"), F.col("id").cast("string")).alias("cve_id"), F.concat(F.lit("CWE-"), (F.col("id") + 70).cast("string")).alias("cwe_id"))
    return contrastive_pairs(listed, files, methods, fixes, cwe, most_changed=200, most_code=2000, most_diff=60)


@query("q14_contrastive_pairs")
def _(t: Tables):
    return _pairs(t).select("pair_id", "split", "nth", "cve_id", "cwe_id", F.col("before.method_change_id").alias("before_id"), F.col("after.method_change_id").alias("after_id"), F.col("before_ranges").cast("string").alias("before_ranges"), F.col("after_ranges").cast("string").alias("after_ranges"))


@query("q14_changed_chunks")
def _(t: Tables):
    return changed_chunks(_pairs(t), 2)


# ---- review groups --------------------------------------------------------------------------


@query("j10_review_groups", f"WITH {CHUNKS}, c AS (SELECT doc_id, i, array_to_string(ls[i * 3 + 1 : i * 3 + 3], chr(10)) AS x FROM k), m AS (SELECT * FROM c WHERE (doc_id + i) % 4 <> 1 AND coalesce((doc_id * 13 + i * 7) % 10 >= 3 AND doc_id % 9 > 0, false)), g AS (SELECT doc_id, count(*) AS n, string_agg(CAST(i AS VARCHAR) || ':' || x, '|' ORDER BY i) AS chunks FROM m WHERE doc_id % 7 <> 2 GROUP BY doc_id) SELECT row_number() OVER (ORDER BY g.doc_id) AS group_index, g.doc_id AS sample_id, n AS n_chunks, chunks, length(d.text) AS code_length FROM g JOIN documents d ON d.doc_id = g.doc_id")
def _(t: Tables):
    d, i = F.col("doc_id"), F.col("chunk_id")
    cut = K.explode_chunks(t.documents.select("doc_id", "text"), "text", 3)
    preds = cut.select(d.alias("sample_id"), i.alias("chunk_index"), F.when((d + i) % 4 > 1, 1).when((d + i) % 4 == 1, 0).alias("pred"), F.when(d % 9 > 0, ((d * 13 + i * 7) % 10).cast("double") / 10).alias("prob"))
    code = t.documents.where("doc_id % 7 <> 2").select(d.alias("sample_id"), F.col("text").alias("code"))
    groups = Q.review_groups(preds, cut.select(d.alias("sample_id"), i.alias("chunk_index"), "chunk_text"), code, "sample_id", 1, 0.3)
    text = F.array_join(F.transform("chunks", lambda x: F.concat(x["chunk_index"].cast("string"), F.lit(":"), x["text"])), "|")
    return groups.select("group_index", "sample_id", F.col("n_chunks"), text.alias("chunks"), F.length("code").cast("long").alias("code_length"))


@query("c7_changed_on_both_sides", "WITH x AS (SELECT conv_id, turn, role FROM conversations WHERE length(text) % 3 = 0 AND role IN ('user', 'assistant')) SELECT conv_id, turn, role FROM x WHERE conv_id IN (SELECT conv_id FROM x GROUP BY conv_id HAVING count(DISTINCT role) = 2)")
def _(t: Tables):
    sides = t.conversations.where("role in ('user', 'assistant')").select("conv_id", "turn", "role", "text")
    return K.keep_changed(sides, "conv_id", "role", F.length("text") % 3 == 0).drop("text")


# ---- layouts, by the readers themselves -----------------------------------------------------


@query("s15_bigvul_layout", "SELECT turn AS index, conv_id || ' ' || text AS code, CASE WHEN turn % 3 > 0 THEN CAST(turn AS VARCHAR) END AS line, CAST(turn % 2 AS INTEGER) AS label, CASE WHEN turn % 2 = 1 THEN 'CWE-' || conv_id END AS cwe, CAST(NULL AS VARCHAR) AS cve FROM conversations")
def _(t: Tables):
    s = lambda c: c.cast("string")
    x = F.struct(
        F.concat(s(F.col("conv_id")), F.lit(" "), "text").alias("code"), F.when(F.col("turn") % 3 > 0, s(F.col("turn"))).otherwise("").alias("line"), s(F.col("turn") % 2).alias("vul"),
        F.when(F.col("turn") % 2 == 1, F.concat(F.lit("CWE-"), s(F.col("conv_id")))).otherwise("").alias("cwe"), F.lit("").alias("cve"),
    )
    files = t.conversations.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(s(F.col("turn")), x))).alias("samples"))
    return S.bigvul(files)


@query("s17_draper_layout", "WITH r AS (SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index, text AS code, turn % 2 = 0 AS a, turn % 3 = 0 AS b FROM conversations) SELECT index, code, CASE WHEN a OR b THEN array_to_string(list_filter([CASE WHEN a THEN 'CWE-119' END, CASE WHEN b THEN 'CWE-other' END], lambda x: x IS NOT NULL), ',') END AS cwe, CAST(a OR b AS INTEGER) AS label FROM r")
def _(t: Tables):
    x = F.struct("turn", "text", (F.col("turn") % 2 == 0).alias("a"), (F.col("turn") % 3 == 0).alias("b"))
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(x)).alias("x"))
    part = lambda f: F.transform("x", lambda e: e[f])
    files = g.select(part("text").alias("functionSource"), part("a").alias("CWE-119"), part("b").alias("CWE-other"))
    return S.draper(files, ["CWE-119", "CWE-other"]).withColumn("cwe", F.array_join("cwe", ","))


@query("s20_any_producer", "SELECT doc_id AS \"Index\", quality AS \"Label\", CASE WHEN doc_id % 3 > 0 THEN CAST(toxic AS INTEGER) END AS \"Prediction\", doc_id % 10 / CAST(10 AS DOUBLE) AS \"Prob\", CASE WHEN doc_id % 2 = 1 THEN 'CWE-1' END AS \"CWE\" FROM labels")
def _(t: Tables):
    d = F.col("doc_id")
    rows = t.labels.select(
        F.concat(F.lit(" "), d.cast("string")).alias("INDEX"), F.col("quality").cast("string").alias("label"), F.when(d % 3 > 0, F.col("toxic").cast("string")).otherwise("n/a").alias("finalprediction"),
        (d % 10 / F.lit(10.0)).cast("string").alias("ReviewerProb"), F.when(d % 2 == 1, "CWE-1").otherwise("").alias("cwe"),
    )
    return S.normalize_predictions(rows)


@query("k5_p26_tables", "SELECT 'documents' AS run, doc_id AS m_id, CAST(length(text) AS INTEGER) AS m_n, NULL::INTEGER AS m_bad, lang AS note FROM documents UNION ALL SELECT 'labels', doc_id, NULL, CAST(toxic AS INTEGER), NULL FROM labels")
def _(t: Tables):
    a = t.documents.select(F.lit("documents").alias("run"), F.struct(F.col("doc_id").alias("id"), F.length("text").alias("n")).alias("m"), F.col("lang").alias("note"))
    b = t.labels.select(F.lit("labels").alias("run"), F.struct(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("bad")).alias("m"))
    return sinks.union_of_keys([sinks.flatten(a), sinks.flatten(b)], ["run"])


@query("k7_report", f"WITH m AS (SELECT source, count(*) AS n FROM documents GROUP BY source), l AS (SELECT lang, max(length(text)) AS longest FROM documents GROUP BY lang) SELECT coalesce(source, '') || chr(9) || n AS line FROM m UNION ALL SELECT coalesce(lang, '') || chr(9) || coalesce(CAST(longest AS VARCHAR), '') FROM l UNION ALL SELECT unnest(['report', '', 'sources', 'source' || chr(9) || 'n', '', 'languages', 'lang' || chr(9) || 'longest'])")
def _(t: Tables):
    folder = shared_folder(t.spark, "report")
    tables = {"sources": t.documents.groupBy("source").agg(F.count("*").alias("n")), "languages": t.documents.groupBy("lang").agg(F.max(F.length("text")).alias("longest"))}
    sinks.write_report(tables, folder)
    return t.spark.read.text(f"{folder}/report.txt").select(F.col("value").alias("line"))


# ---- texts and vectors, whole ---------------------------------------------------------------

_PLAIN = r"regexp_replace(text, '[\n\"\\*/'']', ' ', 'g')"


@query("t8_code_comments", f"SELECT doc_id, 'int a;  ' || chr(10) || 's = ' || chr(34) || '// ' || {_PLAIN} || chr(34) || ';' AS code FROM documents")
def _(t: Tables):
    text = F.regexp_replace("text", r"""[\n"\\*/']""", " ")
    code = F.concat(F.lit("int a; // "), text, F.lit("\n/* "), text, F.lit("\n x */\n   \ns = \"// "), text, F.lit('";'))
    return t.documents.select("doc_id", R.strip_code_comments(code).alias("code"))


_WORDS = "regexp_extract_all(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), '[A-Za-z]+')"
_FIXED = ", ".join(f"'{w}'" for w in sorted(R._KEYWORDS))


@query("t6_symbolic_names", f"WITH w AS (SELECT doc_id, unnest({_WORDS}) AS x, generate_subscripts({_WORDS}, 1) AS i FROM documents), f AS (SELECT doc_id, x, min(i) AS i FROM w WHERE lower(x) NOT IN ({_FIXED}) GROUP BY ALL), v AS (SELECT doc_id, x, 'VAR' || row_number() OVER (PARTITION BY doc_id ORDER BY i) AS y FROM f), o AS (SELECT w.doc_id, string_agg(coalesce(y, w.x), ' ' ORDER BY i) AS code FROM w LEFT JOIN v ON v.doc_id = w.doc_id AND v.x = w.x GROUP BY w.doc_id) SELECT d.doc_id, coalesce(code, '') AS code FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id WHERE d.text IS NOT NULL")
def _(t: Tables):
    return t.documents.where("text is not null").select("doc_id", R.symbolic_code(F.regexp_replace("text", "[^A-Za-z ]", " ")).alias("code"))


@query("t11_nested_labels", "SELECT d.doc_id, CAST(toxic AS INTEGER) AS label, 'json.vulnerable' AS how FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def _(t: Tables):
    said = F.to_json(F.struct(F.struct(F.struct(F.struct(F.col("text").alias("why")).alias("b")).alias("a")).alias("analysis"), F.when(F.col("toxic") == 1, "Yes").otherwise("no").alias("vulnerable")))
    label, how = E.binary_label(F.concat(F.lit("My answer:\n```json\n"), said, F.lit("\n``` as asked")))
    return t.documents.join(t.labels, "doc_id").select("doc_id", label.alias("label"), how.alias("how"))


@query("w6_solid_positions", r"WITH p AS (SELECT item_id, text, unnest(range(length(text))) AS pos FROM benchmark) SELECT item_id, CAST(pos AS INTEGER) AS pos, CAST(length(regexp_replace(substr(text, 1, pos + 1), '[ \t\n\r\x0b\x0c]', '', 'g')) AS INTEGER) AS solid FROM p")
def _(t: Tables):
    return t.benchmark.select("item_id", F.posexplode(R.solid_prefix("text")).alias("pos", "solid"))


@query("v3_mean_of_whole_vectors", "WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, [x * x FOR x IN CAST(embedding AS DOUBLE[])] AS b FROM embeddings), u AS (SELECT vec_id, unnest(a) AS a, unnest(b) AS b, generate_subscripts(a, 1) - 1 AS d FROM n) SELECT vec_id, CAST(d AS INTEGER) AS d, round((a + b) / 2, 6) AS x FROM u")
def _(t: Tables):
    v = F.col("embedding").cast("array<double>")
    states = F.array(v, F.transform(v, lambda x: x * x), F.transform(v, lambda x: x + 100.0), F.transform(v, lambda x: x - 7.0))
    mean = L.mean_pool_no_special("s", "m", "special")
    rows = t.embeddings.select("vec_id", states.alias("s"), F.array(*map(F.lit, (1, 1, 0, 1))).alias("m"), F.array(*map(F.lit, (0, 0, 0, 1))).alias("special"))
    return rows.select("vec_id", F.posexplode(mean).alias("d", "x")).withColumn("x", F.round("x", 6))


_TYPES = ["A", "N", "R"]


@query("g1_node_features", "WITH n AS (SELECT l_orderkey AS g, l_linenumber AS k, max(l_returnflag) AS type, count(*) AS c FROM lineitem GROUP BY ALL), w AS (SELECT l_orderkey AS g, l_linenumber AS k, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM lineitem JOIN embeddings ON vec_id = l_partkey % 1000), s AS (SELECT g, k, sum(CAST(v AS DOUBLE)) AS a, sum(CAST(v AS DOUBLE) * (d + 3)) AS b FROM w GROUP BY ALL) SELECT n.g, n.k, CAST(list_position(['A', 'N', 'R'], type) AS INTEGER) AS type_at, CAST(67 AS INTEGER) AS n, round(coalesce(a / c, 0), 5) + 0.0::DOUBLE AS total, round(coalesce(b / c, 0), 4) + 0.0::DOUBLE AS weighted FROM n LEFT JOIN s ON s.g = n.g AND s.k = n.k")
def _(t: Tables):
    tokens = t.lineitem.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 1000).alias("token"))
    nodes = t.lineitem.groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("k")).agg(F.max("l_returnflag").alias("type"))
    vectors = t.embeddings.select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    f = V.node_features(nodes, tokens, vectors, ["g", "k"], _TYPES, 64)
    kind, mean = F.slice("features", 1, 3), F.slice("features", 4, 64)
    added = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    weighted = added(F.transform(mean, lambda x, i: x * (i + 4)))
    return f.select("g", "k", F.array_position(kind, F.lit(1.0)).cast("int").alias("type_at"), F.size("features").alias("n"), (F.round(added(mean), 5) + 0.0).alias("total"), (F.round(weighted, 4) + 0.0).alias("weighted"))


# ---- judged, weighted and joined inputs -----------------------------------------------------


def _client():
    """A reviewer that answers by a prompt's length; every first call for some prompts fails, others are refused."""
    calls: dict[str, int] = {}

    def reply(prompt: str) -> str:
        n = len(prompt)
        calls[prompt] = calls.get(prompt, 0) + 1
        if n % 11 == 0:
            raise judge.HttpError(400, "no")
        if n % 7 == 0 and calls[prompt] % 2:
            raise judge.HttpError(429)
        return '{"vulnerable": "yes"}' if n % 3 == 0 else "No" if n % 3 == 1 else "who knows"

    return reply


@query("m4_m6_judged", """WITH x AS (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents) SELECT doc_id, CAST(CASE WHEN n % 11 > 0 AND n % 7 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts, CAST(CASE WHEN n % 11 > 0 AND n % 3 = 0 THEN 1 WHEN n % 11 > 0 AND n % 3 = 1 THEN 0 END AS INTEGER) AS label, CASE WHEN n % 11 = 0 THEN 'error:HttpError: HTTP 400: no' WHEN n % 3 = 0 THEN 'json.vulnerable' WHEN n % 3 = 1 THEN 'exact.no' ELSE 'unparsed' END AS status FROM x""")
def _(t: Tables):
    return judge.judge(t.documents, _client, "text", "doc_id", wait=0).drop("reply")


@query("p2_many_inputs", "SELECT 'judge this' AS instruction, text AS input, CAST(quality AS VARCHAR) AS output, doc_id AS index FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'judge this', text, CAST(turn % 2 AS VARCHAR), conv_id FROM conversations")
def _(t: Tables):
    a = t.documents.join(t.labels, "doc_id").select("doc_id", "text", "quality")
    b = t.conversations.select(F.col("conv_id").alias("doc_id"), "text", (F.col("turn") % 2).alias("quality"))
    return S.instruction_set([a, b], "judge this", code="text", label="quality", index="doc_id")


@query("p3_weight_modes", "SELECT doc_id, CASE WHEN toxic = 1 THEN 7.5::DOUBLE ELSE w END AS set_weight, CASE WHEN toxic = 1 THEN w + 7.5 ELSE w END AS add_weight, CASE WHEN toxic = 1 THEN w * 7.5 ELSE w END AS multiply_weight FROM (SELECT doc_id, toxic, coalesce(CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 5 AS DOUBLE) END, 1.0) AS w FROM labels)")
def _(t: Tables):
    errors = t.labels.where("toxic = 1")
    out = t.labels.select("doc_id", F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 5).cast("double")).alias("w"))
    for mode in ("set", "add", "multiply"):
        out = Q.reweigh(out.withColumn(f"{mode}_weight", F.col("w")), errors, "doc_id", mode, 7.5, f"{mode}_weight")
    return out.drop("w")


@query("v5_softmax", "SELECT vec_id, round(exp(embedding[2]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE)), 6) AS p FROM embeddings")
def _(t: Tables):
    a, b = (F.element_at("embedding", i).cast("double") for i in (1, 2))
    return t.embeddings.select("vec_id", F.round(E.softmax2(a, b), 6).alias("p"))


@query("t10_spacing", "SELECT doc_id, replace(replace(replace(text, 'th', 'T-'), '. ', '.' || chr(10)), 'T-e', 'the') AS text FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", E.correct_spacing("text", (("th", "T-"), (". ", ".\n"), ("T-e", "the"))).alias("text"))
