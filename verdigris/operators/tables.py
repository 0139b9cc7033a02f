"""Row filters, lookups, orders, counters and set operations over prediction and sample tables."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from .ranking import number_rows, rank_by_number
from .sampling import dense_index

# ---- filters --------------------------------------------------------------------------------


def between(prob: str, low: float | None = None, high: float | None = None) -> Column:
    """low <= prob <= high, either end open if not given."""
    parts = [F.col(prob) >= low] * (low is not None) + [F.col(prob) <= high] * (high is not None)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def called(pred: str, value: int, prob: str, least: float | None = None) -> Column:
    """a call of that value, or none at all, with at least that probability; a missing one fails if a least is set."""
    fits = F.col(pred).isNull() | (F.col(pred) == value)
    return fits if least is None else fits & F.coalesce(F.col(prob) >= least, F.lit(False))


def valid_text(text: str, max_chars: int | None = None) -> Column:
    """Not null, not blank, not too long."""
    t = F.col(text)
    ok = t.isNotNull() & (F.trim(t) != "")
    return ok if max_chars is None else ok & (F.length(t) <= max_chars)


def short_text(text: str, max_chars: int) -> Column:
    """a text that is absent or not too long; 0 sets no limit."""
    return F.lit(True) if max_chars <= 0 else F.col(text).isNull() | (F.length(text) <= max_chars)


def small_changes(df: DataFrame, key: str, changed: str, order: str, most: int, n: int | None = None) -> DataFrame:
    """trimmed keys of rows of at most `most` changed lines (blank: 0), by first occurrence; the first n of them.

    Columns: key and the order of its first such row. Blank keys go. A task keeps a row a key, and its own first n.
    """
    lines = F.coalesce(F.expr(f"try_cast(nullif(trim(cast(`{changed}` as string)), '') as long)"), F.lit(0))
    kept = df.where(lines <= most).withColumn(key, F.trim(F.col(key).cast("string"))).where(F.col(key) != "")
    first = kept.groupBy(key).agg(F.min(order).alias("first"))
    return first if n is None else first.orderBy("first", key).limit(n)


def weighted(df: DataFrame, weight: str = "weight", least: float = 2.0) -> DataFrame:
    """rows of at least that weight; a missing one is 1."""
    return df.where(F.coalesce(F.col(weight), F.lit(1.0)) >= least)


def invalid(df: DataFrame, valid: Column) -> DataFrame:
    """the rows a validity test does not keep, unknown ones included."""
    return df.where(~F.coalesce(valid, F.lit(False)))


def drop_empty_graphs(samples: DataFrame, nodes: DataFrame, key: str, split: str) -> DataFrame:
    """training samples without a node go; other splits stay whole."""
    train = F.col(split) == "train"
    return samples.where(~train | F.col(split).isNull()).unionByName(samples.where(train).join(nodes.select(key).distinct(), key, "left_semi").select(*samples.columns))


def from_index(df: DataFrame, start: int | None, key: str = "Index") -> DataFrame:
    """F15."""
    return df if start is None else df.where(F.col(key) >= start)


def min_group(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """F16: groups of at least that many rows, with their sizes."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


# ---- lookups --------------------------------------------------------------------------------


def composite_lookup(df: DataFrame, meta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A value by several keys; `unmatched` says where there is none."""
    return df.join(meta.select(*keys, value), keys, "left").withColumn("unmatched", F.col(value).isNull())


def fold_zip(meta: DataFrame, rows: DataFrame, key: str, name: str = "source_order") -> DataFrame:
    """The k-th row of one table with the k-th of the other, both in the order of key."""
    return dense_index(meta, key, name=name).join(dense_index(rows, key, name=name).drop(key), name)


def case_bundle(cases: DataFrame, tables: list[DataFrame], key: str) -> DataFrame:
    """Everything known of the given cases; cases that a table lacks stay out."""
    return reduce(lambda a, b: a.join(b, key), tables, cases)


def lookup_by_priority(df: DataFrame, catalogue: DataFrame, first: str, second: str, value: str, name: str) -> DataFrame:
    """By the first key, else by the second, under which the least value counts."""
    a = df.join(catalogue.groupBy(first).agg(F.min(value).alias("a_")), first, "left")
    b = catalogue.groupBy(second).agg(F.min(value).alias("b_"))
    return a.join(b, second, "left").withColumn(name, F.coalesce("a_", "b_")).drop("a_", "b_")


# ---- counters -------------------------------------------------------------------------------


def reviewed_counters(df: DataFrame, label: str = "Label", original: str = "OriginalPrediction", final: str = "FinalPrediction") -> DataFrame:
    """A-3: counts over the rows that the first model called positive."""
    fin, orig, lab = F.col(final), F.col(original), F.col(label)
    conds = {
        "positive_labels": lab == 1, "negative_labels": lab == 0, "positive_predictions": fin == 1, "negative_predictions": fin == 0,
        "changed": fin != orig, "kept": fin == orig, "actual_positive_kept": (lab == 1) & (fin == 1), "actual_positive_rejected": (lab == 1) & (fin == 0),
    }
    return df.where(orig == 1).agg(*[F.count_if(c).alias(n) for n, c in conds.items()])


def positive_case_summary(df: DataFrame, label: str = "Label", original: str = "OriginalPrediction", final: str = "FinalPrediction", source: str = "DecisionSource") -> DataFrame:
    """A-4: what became of the actual positives."""
    status = E.positive_case_status(label, original, final, F.col(source) == E.OVERRIDE)
    s = df.where(F.col(label) == 1).withColumn("s", status).agg(
        F.count("*").alias("total"), F.count_if(F.col("s").isin(E.KEPT, E.REJECTED)).alias("reviewed"), F.count_if(F.col("s") == E.MISSED).alias("missed"),
        F.count_if(F.col("s") == E.KEPT).alias("kept"), F.count_if(F.col("s") == E.REJECTED).alias("rejected"), F.count_if(F.col(original) == 1).alias("called"))
    r = lambda a, b, n: F.round(E.safe_div(a, b), 6).alias(n)
    return s.select("*", r("reviewed", "total", "original_recall_on_actual_positives"), r("called", "total", "true_original_recall"), r("kept", "total", "final_recall"), r("kept", "reviewed", "keep_rate"), r("rejected", "reviewed", "reject_rate"))


def decision_counters(df: DataFrame, source: str = "DecisionSource", pred: str = "Prediction", final: str = "FinalPrediction") -> DataFrame:
    """A-5: rows and changed calls by where the decision comes from."""
    return df.groupBy(source, pred).agg(F.count("*").alias("n"), F.count_if(F.col(final) != F.col(pred)).alias("changed"))


def mean_of_means(df: DataFrame, keys: list[str], value: Column, digits: int = 4) -> DataFrame:
    """A-21: every group weighs the same."""
    return df.groupBy(*keys).agg(F.avg(value).alias("m")).agg(F.round(F.avg("m"), digits).alias("mean_of_means"), F.count("*").alias("n"))


def alignment(a: DataFrame, b: DataFrame, key: str = "Index", columns: tuple[str, ...] = ("Label", "Prediction")) -> DataFrame:
    """A-22: of the rows both tables have, how many agree in the columns."""
    j = a.select(key, F.struct(*columns).alias("x_")).join(b.select(key, F.struct(*columns).alias("y_")), key)
    return j.agg(F.count("*").alias("checked"), F.count_if(F.col("x_") == F.col("y_")).alias("matched")).withColumn("rate", F.round(E.safe_div("matched", "checked"), 6))


def value_set(column: str, sep: str = ",") -> Column:
    """A-25: the distinct values of a group, in order, as text."""
    return F.array_join(F.array_sort(F.collect_set(column)), sep)


def argmax(key: str, value: str) -> Column:
    """A-26: the key of the greatest value, the least key among equals."""
    return F.max_by(key, F.struct(F.col(value), -F.col(key)))


def bucket_counts(df: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """A-27, A-28, A-38: rows and greatest size of each bucket."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(size).cast("long").alias("longest"))


def without_result(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """A-39: inputs, and those that no result answers."""
    return inputs.join(results.select(key, F.lit(1).alias("has_")).dropDuplicates([key]), key, "left").agg(F.count("*").alias("n"), F.count_if(F.col("has_").isNull()).alias("without_result"))


def loss_means(df: DataFrame, keys: list[str], loss: str) -> DataFrame:
    """A-33: mean loss of the logged steps and its exponential, the perplexity."""
    return df.groupBy(*keys).agg(F.count(loss).alias("steps"), F.avg(loss).alias("m_")).select(*keys, "steps", F.round("m_", 6).alias("mean_loss"), F.round(F.exp("m_"), 4).alias("perplexity"))


def metric_deltas(df: DataFrame, model: str, metric: str, first: str, second: str) -> DataFrame:
    """A metric of two models, their difference, and that to the better one."""
    of = lambda m: F.max(F.when(F.col(model) == m, F.col(metric)))
    p = df.agg(of(first).alias("first"), of(second).alias("second"))
    return p.select("first", "second", F.round(F.col("second") - F.col("first"), 6).alias("delta"), F.round(F.col("second") - F.greatest("first", "second"), 6).alias("delta_best"))


# ---- orders ---------------------------------------------------------------------------------


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of an order; a task keeps its own first n."""
    return df.orderBy(*order).limit(n)


def mixed_order(column: str, last: int = 1_000_000_000) -> tuple[Column, Column]:
    """O2, O3: sort keys under which numbers come before texts, by value; texts as they are."""
    n = F.col(column).try_cast("int")
    return n.isNull(), F.coalesce(n, F.lit(last))


def synthetic_index(df: DataFrame, keys: list[str], name: str = "index") -> DataFrame:
    """Distinct composite keys, numbered from 0 in their order: dense, over the keys alone, by ranges of the order."""
    return number_rows(df.select(*keys).distinct(), [F.col(k) for k in keys], name)


def listing_order(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows numbered from 1 along an order of columns of any types, by ranges of it."""
    return number_rows(df, order, name).withColumn(name, F.col(name) + 1)


def distinct_parts(df: DataFrame, column: str, pattern: str, name: str, group: int = 1) -> DataFrame:
    """U6, A-29: the different values of a part of a path or address; a task hands on each of its own once."""
    return df.select(F.regexp_extract(column, pattern, group).alias(name)).distinct()


def length_batches(df: DataFrame, length: str, key: str, size: int) -> DataFrame:
    """Batches of rows of about the same length; ties by an integer key of up to 18 digits."""
    order = F.col(length).cast("decimal(19,0)") * F.lit(Decimal(10**18)) + F.col(key).cast("decimal(19,0)")
    r = rank_by_number(df.select(length, key, order.cast("decimal(38,0)").alias("o_")), [], "o_")
    return r.select(length, key, F.floor((F.col("rank_") - 1) / size).alias("batch"))


def tail(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= n).drop("k_")


def group_bounds(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First and last row and size of each group of an ordered table: one aggregation, no scan in order."""
    return df.groupBy(*keys).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


# ---- sets, intervals, chunks, vectors -------------------------------------------------------


def union_all(parts: list[DataFrame]) -> DataFrame:
    """By name; a column that a part lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in common and keys in all."""
    sides = a.select(key, F.lit(1).alias("s")).unionByName(b.select(key, F.lit(2).alias("s"))).groupBy(key).agg(F.countDistinct("s").alias("n"))
    return sides.agg(F.count_if(F.col("n") == 2).alias("n_common"), F.count("*").alias("n_all"))


def contained(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """C11: does b lie in a?"""
    return (b_start >= a_start) & (b_end <= a_end)


def overlapping(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """C11: do the half-open a and b meet?"""
    return (b_start < a_end) & (a_start < b_end)


def flat_chunks(df: DataFrame, chunks: str) -> DataFrame:
    """Every chunk of every sample as a row with its place; nothing is cut off."""
    keys = [c for c in df.columns if c != chunks]
    return df.select(*keys, F.posexplode(chunks).alias("chunk", "x_")).select(*keys, "chunk", "x_.*")


def corrections(df: DataFrame, sentence: str, many: str) -> DataFrame:
    """(input, target) for each correction of a sentence, both spaced right; blank ones are left out."""
    rows = df.select(E.correct_spacing(sentence).alias("input"), F.explode(many).alias("t_"))
    return rows.select("input", E.correct_spacing("t_").alias("target")).where("input <> '' and target <> ''")


def mean_pool(states: Column | str, mask: Column | str) -> Column:
    """V3: the mean of the vectors whose mask is 1, per dimension; zeros where none is."""
    s, m = (F.col(x) if isinstance(x, str) else x for x in (states, mask))
    kept = F.filter(F.zip_with(s, m, lambda v, x: F.struct(v.alias("v"), x.alias("m"))), lambda x: x["m"] == 1)
    zero = F.transform(F.element_at(s, 1), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, x: F.zip_with(acc, x["v"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept).cast("double"), F.lit(1e-12)))


def mean_pool_no_special(states: str, mask: str, special: str) -> Column:
    """V3: special tokens left out."""
    return mean_pool(states, F.zip_with(F.col(mask), F.col(special), lambda m, s: m * (1 - s)))


def graphs_by_file(nodes: DataFrame, edges: DataFrame, file: str = "file") -> DataFrame:
    """Nodes and edges of each file; files with one of them only are skipped."""
    n = nodes.groupBy(file).agg(F.count("*").alias("nodes"))
    e = edges.groupBy(file).agg(F.count("*").alias("edges"))
    return n.join(e, file)


def batch_graphs(nodes: DataFrame, graph: str, node: str, feature: str, width: int) -> DataFrame:
    """A graph's node vectors in node order, padded with zero vectors (or cut) to `width`, and the real number."""
    g = nodes.groupBy(graph).agg(F.array_sort(F.collect_list(F.struct(F.col(node).alias("n"), F.col(feature).alias("x")))).alias("a"))
    vectors = F.transform("a", lambda s: s["x"])
    zero = F.transform(F.element_at(vectors, 1), lambda _: F.lit(0.0))
    padded = F.concat(F.slice(vectors, 1, width), F.array_repeat(zero, F.greatest(F.lit(0), width - F.size(vectors))))
    return g.select(graph, F.least(F.size("a"), F.lit(width)).alias("n_nodes"), padded.alias("features"))


def attention_mask(n_code: Column, nodes: Column) -> Column:
    """(row, column) cells that see each other: code sees code, a data-flow node its tokens [a, b) both ways, and its sources.

    nodes: array of structs (a, b, sources: array of node numbers); node i stands at n_code + i.
    """
    code = F.sequence(F.lit(0), n_code - 1)
    cell = lambda r, c: F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"))
    plain = F.flatten(F.transform(code, lambda r: F.transform(code, lambda c: cell(r, c))))

    def of_node(x: Column, i: Column) -> Column:
        span = F.when((x["a"] < x["b"]) & (x["b"] <= n_code), F.sequence(x["a"], x["b"] - 1)).otherwise(F.array().cast("array<int>"))
        at = n_code + i
        return F.flatten(F.array(F.transform(span, lambda p: cell(at, p)), F.transform(span, lambda p: cell(p, at)), F.transform(F.filter(x["sources"], lambda s: s < F.size(nodes)), lambda s: cell(at, n_code + s))))

    return F.array_sort(F.array_distinct(F.concat(plain, F.flatten(F.transform(nodes, of_node)))))
