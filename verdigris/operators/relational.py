"""Relational building: star joins over fix tables, before/after pairs, anti and semi joins, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from . import sketches, tables
from .ranking import number_rows, rank_by_number
from .scans import CHUNK_ROWS, scan


#: A key with more than one in PARTS of the dealt side's rows is heavy: its rows go to SALTS tasks.
PARTS, SALTS = 200, 64


def heavy_keys(df: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """Keys that hold more than one in `parts` of the rows, by a frequent-items sketch of bounded size: parts + 1 rows at most.

    Counts are estimates; a key too many or too few changes where rows go, not what a join gives.
    """
    s = df.select(F.struct(*keys).alias("k"))
    top = s.agg(F.expr(f"approx_top_k(to_json(k, map('ignoreNullFields', 'false')), {parts + 1}, {64 * parts})").alias("top"), F.count("*").alias("n"))
    return top.select("n", F.explode("top").alias("x")).where(F.col("x.count") * parts > F.col("n")).select(F.col("x.item").alias("heavy_"))


def skew_join(dealt: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", parts: int = PARTS, salts: int = SALTS) -> DataFrame:
    """Equi-join whose dealt side may have keys with a large share of all rows.

    Rows of a heavy key are dealt over `salts` tasks; the other side's rows of that key alone are copied to each. how is
    inner, left, left_semi or left_anti: each dealt row meets every partner once, so the result is that of a plain join.
    """
    heavy = [r["heavy_"] for r in heavy_keys(dealt, keys, parts).collect()]  # parts + 1 at most
    if not heavy:
        return dealt.join(other, keys, how)
    mark = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).isin(heavy)
    salt = F.when(mark, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))).otherwise(0)
    copies = F.when(mark, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = dealt.withColumn("salt_", salt.cast("int"))
    return left.join(other.withColumn("salt_", F.explode(copies)), [*keys, "salt_"], how).drop("salt_")


def methods_of_classes(cwe: DataFrame, fixes: DataFrame, commits: DataFrame, files: DataFrame, methods: DataFrame, classes: list[str]) -> DataFrame:
    """Methods of the fixes of the given classes, under any spelling, a row for each fix that leads to it.

    A commit with many files and a file with many methods are dealt over tasks.
    """
    spellings = [s for n in classes for s in (n, f"CWE-{n}", f"NVD-CWE-{n}")]
    chosen = cwe.where(F.col("cwe_id").isin(spellings)).select("cve_id").distinct()
    fixed = fixes.join(chosen, "cve_id", "left_semi").select("cve_id", "hash").join(commits.select("hash"), "hash")
    return skew_join(methods, skew_join(files, fixed, ["hash"]), ["file_change_id"])


def methods_with_classes(files: DataFrame, methods: DataFrame, fixes: DataFrame, cwe: DataFrame) -> DataFrame:
    """Every method with its file, fixes and classes, where there are any; a row for each combination.

    The small sides are joined with each other first, so the methods are shuffled once, by file.
    """
    known = fixes.select("hash", "cve_id").join(cwe.select("cve_id", "cwe_id"), "cve_id", "left")
    return skew_join(methods, skew_join(files, known, ["hash"], "left"), ["file_change_id"])


def review_groups(preds: DataFrame, chunks: DataFrame, code: DataFrame, sample: str, value: int = 1, least: float | None = None, index: str = "chunk_index", text: str = "chunk_text") -> DataFrame:
    """The called chunks of each sample with its full code, numbered from 1 in the order of samples.

    preds (sample, index, pred, prob) that are called, in order, with their chunk's text, or null if it has none. A sample without
    code or without any chunk is left out. A group gathers one sample's chunks.
    """
    hit = preds.where(tables.called("pred", value, "prob", least))
    known = chunks.select(sample).distinct()
    rows = hit.join(known, sample, "left_semi").join(chunks.select(sample, index, F.col(text).alias("text")), [sample, index], "left")
    grouped = rows.groupBy(sample).agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.struct(index, "text", "prob"))).alias("chunks"))
    groups = grouped.join(code.select(sample, "code"), sample)
    return number_rows(groups, [F.col(sample)], "group_index").withColumn("group_index", F.col("group_index") + 1)


def zip_pairs(df: DataFrame, keys: list[str], side: Column, order: str | list[str], columns: list[str]) -> DataFrame:
    """The k-th `before` row of a group with its k-th `after` row; surplus rows stay out.

    One shuffle: both sides are numbered and folded under the same grouping keys, with no self-join.
    """
    kept = df.withColumn("side_", side).where("side_ is not null")
    w = Window.partitionBy(*keys, "side_").orderBy(*([order] if isinstance(order, str) else order))
    n = kept.withColumn("nth", F.row_number().over(w))
    row = F.struct(*columns)
    both = n.groupBy(*keys, "nth").agg(F.max(F.when(F.col("side_"), row)).alias("before"), F.max(F.when(~F.col("side_"), row)).alias("after"))
    return both.where("before is not null and after is not null")


def adjacent_pairs(df: DataFrame, order: str, label: str, columns: list[str]) -> DataFrame:
    """Rows 0-1, 2-3, ... whose labels differ."""
    r = rank_by_number(df, [], order).withColumn("pair", F.floor((F.col("rank_") - 1) / 2))
    first = F.pmod(F.col("rank_"), F.lit(2)) == 1
    row = F.struct(label, *columns)
    g = r.groupBy("pair").agg(F.max(F.when(first, row)).alias("a"), F.max(F.when(~first, row)).alias("b"))
    return g.where(F.col(f"a.{label}") != F.col(f"b.{label}"))


def held_out(df: DataFrame, test: DataFrame, key: str, sketch: bool = False) -> DataFrame:
    """Rows whose key the test set does not hold; sketch: for a test set too large to broadcast."""
    return sketches.anti(df, test, key) if sketch else df.join(test.select(key).distinct(), key, "left_anti")


def reweigh(df: DataFrame, errors: DataFrame, key: str, mode: str, value: float, weight: str = "weight", sketch: bool = False) -> DataFrame:
    """Set, add or multiply the weight of the rows that were misjudged; others have 1. sketch: for many errors."""
    if sketch:
        hit = sketches.flagged(df, errors, key, "hit_")
    else:
        hit = df.join(errors.select(key).distinct().withColumn("hit_", F.lit(True)), key, "left")
    w = F.coalesce(F.col(weight), F.lit(1.0)) if weight in df.columns else F.lit(1.0)
    new = {"set": F.lit(value), "add": w + value, "multiply": w * value}[mode]
    return hit.withColumn(weight, F.when(F.col("hit_"), new).otherwise(w)).drop("hit_")


def islands(df: DataFrame, by: list[str], start: str, end: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """U7 on rows: overlapping or adjacent [start, end] rows of a group become one, by gaps and islands.

    Rows that begin at one place are one row first; then scans by chunks, so a group may hold all rows.
    Nulls come last along a group. A row that covers nothing (no end, or one before its start) joins the island that reaches it,
    else it stays as it is, once for each copy; one without start stays only if its group has no end at all.
    """
    total = df.count()
    s, e = F.col(start), F.col(end)
    real = F.coalesce(e >= s - 1, F.lit(False))
    rows = df.select(*by, start, F.when(s.isNotNull(), e).alias(end))
    one = rows.groupBy(*by, start, real.alias("real_"), F.when(~real, e).alias("low_")).agg(F.max(end).alias(end), F.count("*").alias("n_"))
    seen = scan(one, by, [start, e.asc_nulls_last()], {"reach_": ("max", e)}, {"ends_": e.isNotNull().cast("long")}, chunk_rows, total)
    apart = lambda reach: reach.isNull() | (s > reach + 1)
    kept = seen.where(F.col("real_") | F.when(s.isNull(), F.col("ends_") == 0).otherwise(apart(F.greatest("reach_", end))))
    begins = F.when(F.col("real_") & apart(F.col("reach_")), s)
    # an island is known by where it begins: the greatest beginning up to a row
    marked = scan(kept.withColumn("begin_", begins), by, [start], {"island_": ("max", F.col("begin_"))}, chunk_rows=chunk_rows, total=total)
    island = F.when(F.col("real_"), F.coalesce("begin_", "island_")).otherwise(s)
    out = marked.groupBy(*by, island.alias("island_"), "real_", "low_").agg(F.max(end).alias(end), F.max("n_").alias("n_"))
    copies = F.explode(F.when(F.col("real_"), F.array(F.lit(1))).otherwise(F.array_repeat(F.lit(1), F.col("n_").cast("int"))))
    return out.select(*by, F.col("island_").alias(start), end, copies.alias("copy_")).drop("copy_")


def range_semi_join(df: DataFrame, ranges: DataFrame, by: list[str], start: str, end: str, width: int = 64) -> DataFrame:
    """J21 on rows: rows that overlap a range of their group.

    A group's ranges are merged first, so those that cover a place over and over are one. Then both sides are cut into blocks of
    `width` lines and the overlap is an equi-join on (group, block): a semi-join where all of a row lies in one block, which
    leaves no copies to drop.
    """
    def block(c: str) -> Column:
        return F.floor(F.col(c) / width)

    whole = islands(ranges.select(*by, F.col(start).alias("s_"), F.col(end).alias("e_")), by, "s_", "e_")
    right = whole.withColumn("block_", F.explode(F.sequence(block("s_"), block("e_"))))
    meets = (F.col(start) <= F.col("e_")) & (F.col("s_") <= F.col(end))
    here = [F.col(c).alias(f"g{i}_") for i, c in enumerate(by)]
    right = right.select(*here, F.col("block_").alias("b_"), "s_", "e_")
    same = meets & (F.col("block_") == F.col("b_"))
    for i, c in enumerate(by):
        same = same & (F.col(c) == F.col(f"g{i}_"))
    inside = df.where(block(start) == block(end)).withColumn("block_", block(start)).join(right, same, "left_semi").drop("block_")
    longer = df.where(block(start) < block(end)).withColumn("row_", F.monotonically_increasing_id())
    longer = longer.withColumn("block_", F.explode(F.sequence(block(start), block(end)))).join(right, same, "left_semi")
    return inside.unionByName(longer.dropDuplicates(["row_"]).select(*df.columns))


def split_routes(df: DataFrame, key: str, dataset: Column, order: str) -> DataFrame:
    """Every row to `all` and to its own dataset, with its hash split and a dense index in each."""
    routed = df.withColumn("split", E.hash_split(key)).withColumn("dataset", F.explode(F.array(F.lit("all"), dataset)))
    return rank_by_number(routed, ["dataset", "split"], order).withColumn("index", F.col("rank_") - 1).drop("rank_", "size_")


def fold_groups(df: DataFrame, keys: list[str], order: list[Column], text: str, maxima: list[str], index: str) -> DataFrame:
    """A-23, A-24, O2, W10: per group the maxima, the count, the indexes in order, and the texts joined in order.

    Blank texts are skipped and trailing newlines dropped. What a group gathers is its chunks' text, so
    groups are bounded by one method's or document's size.
    """
    entry = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(index).alias("index"), F.col(text).alias("text"))
    g = df.groupBy(*keys).agg(F.count("*").alias("n_chunks"), *[F.max(m).alias(f"max_{m}") for m in maxima], F.array_sort(F.collect_list(entry)).alias("e_"))
    texts = F.filter(F.transform("e_", lambda e: F.regexp_replace(e["text"], "\n+$", "")), lambda t: F.trim(t) != "")
    return g.select(*keys, "n_chunks", *[f"max_{m}" for m in maxima], F.transform("e_", lambda e: e["index"]).alias("indexes"), F.array_join(texts, "\n").alias("text"))
