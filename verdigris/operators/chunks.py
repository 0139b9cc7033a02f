"""Line chunks, diffs and token packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import syntax
from ..functions.lazy import arrow_udf
from .scans import CHUNK_ROWS, scan

RANGES = "array<struct<start:int,end:int>>"


def line_chunks(text: Column | str, n: int = 80) -> Column:
    """Array of (chunk, text, start, end): runs of n lines, 1-based and inclusive."""

    def chunks(lines: Column) -> Column:
        count = F.ceil(F.size(lines) / n).cast("int")

        def one(i: Column) -> Column:
            start = i * n + 1
            part = F.slice(lines, start, F.lit(n))
            return F.struct(i.alias("chunk"), F.array_join(part, "\n").alias("text"), start.alias("start"), (i * n + F.size(part)).alias("end"))

        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<struct<chunk:int,text:string,start:int,end:int>>"))

    # the lines are bound by an outer lambda, so the text is split once, not once a chunk
    return F.element_at(F.transform(F.array(E.lines_of(text)), chunks), 1)


def explode_chunks(df: DataFrame, text: str, n: int = 80) -> DataFrame:
    return df.select("*", F.explode(line_chunks(text, n)).alias("c_")).select(*df.columns, F.col("c_.chunk").alias("chunk_id"), F.col("c_.text").alias("chunk_text"), F.col("c_.start").alias("start_line"), F.col("c_.end").alias("end_line"))


def running_positions(df: DataFrame, keys: list[str], order: str, text: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Start and end lines of chunks laid one after the other; a scan by chunks, so a group may hold all rows."""
    counted = df.withColumn("lines_", F.size(E.lines_of(text)))
    placed = scan(counted, keys, [order], {"at_": ("sum", F.col("lines_"))}, chunk_rows=chunk_rows)
    start = F.coalesce("at_", F.lit(0)) + 1
    return placed.select(*df.columns, start.alias("start_line"), (start + F.col("lines_") - 1).alias("end_line"))


def label_chunks(df: DataFrame, side: str, ranges: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """A before chunk that meets a changed range is 1, all others 0."""
    hit = (F.col(side) == "before") & E.overlaps_any(start, end, ranges)
    return df.withColumn("label", F.when(hit, "1").otherwise("0"))


def keep_changed(df: DataFrame, pair: str, side: str, changed: Column) -> DataFrame:
    """Changed chunks of the pairs that have one on both sides."""
    kept = df.where(changed)
    sides = F.size(F.collect_set(side).over(Window.partitionBy(pair)))
    return kept.withColumn("sides_", sides).where("sides_ = 2").drop("sides_")


def _merge(ranges: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


@arrow_udf(f"struct<before:{RANGES},after:{RANGES}>")
def changed_ranges(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """The 1-based line ranges on either side that a line diff changes, merged."""
    from difflib import SequenceMatcher

    def lines(t: str | None) -> list[str]:
        return (t or "").replace("\r\n", "\n").removesuffix("\n").split("\n") if t else []

    rows = []
    for x, y in zip(before, after):
        a, b = [], []
        for op, i1, i2, j1, j2 in SequenceMatcher(None, lines(x), lines(y)).get_opcodes():
            if op != "equal":
                a += [(i1 + 1, i2)] if i2 > i1 else []
                b += [(j1 + 1, j2)] if j2 > j1 else []
        rows.append((_merge(a), _merge(b)))
    return pd.DataFrame(rows, columns=["before", "after"])


PIECES = "array<struct<text:string,start:int,end:int>>"


def split_oversized(max_tokens: int):
    """A UDF (text, start line) -> parts of at most max_tokens approximate tokens, on line bounds.

    Every line lands in exactly one part: a window that is still too long loses lines from its end,
    and the next part starts with them. A single line beyond the limit is a part by itself.
    """
    import re

    token = re.compile(r"\w+|[^\w\s]")

    @F.pandas_udf(PIECES)
    def split(texts: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, starts):
            lines = (t or "").split("\n")
            sizes = [len(token.findall(x)) for x in lines]
            if sum(sizes) <= max_tokens:
                out.append([{"text": t or "", "start": int(s), "end": int(s) + len(lines) - 1}])
                continue
            parts = max(2, -(-sum(sizes) // max_tokens))
            window = -(-len(lines) // parts)
            rows, i = [], 0
            while i < len(lines):
                j = min(len(lines), i + window)
                while j > i + 1 and sum(sizes[i:j]) > max_tokens:
                    j -= 1
                rows.append({"text": "\n".join(lines[i:j]), "start": int(s) + i, "end": int(s) + j - 1})
                i = j
            out.append(rows)
        return pd.Series(out)

    return split


def structural_chunks(max_chars: int, language: str | None = None, overlap: int = 0):
    """A UDF text -> chunks of whole syntax blocks, of at most max_chars solid characters where a block allows it.

    Each has its lines and the source of its structure. overlap prefixes a chunk with the last lines of the one before.
    """

    @F.pandas_udf("array<struct<text:string,start:int,end:int,source:string>>")
    def chunk(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            t = (t or "").replace("\r\n", "\n")
            lines, rows = t.split("\n"), []
            for body, first, last, how in syntax.chunks(t, max_chars, language):
                lead = max(0, first - 1 - overlap) if overlap and rows else first - 1
                rows.append({"text": "\n".join([*lines[lead : first - 1], body]), "start": lead + 1, "end": last, "source": how})
            out.append(rows)
        return pd.Series(out)

    return chunk


def pack_tokens(df: DataFrame, group: str, order: str, ids: str, size: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per group, ids in order, cut into runs of `size`; the remainder is dropped, and an exact fit waits for more.

    Arithmetic on running offsets, by a scan in chunks: each id goes to run (offset div size); no group is gathered
    but its runs of fixed size.
    """
    size_ = F.size(ids).cast("long")
    at = scan(df.select(group, order, ids), [group], [order], {"at_": ("sum", size_)}, {"all_": size_}, chunk_rows)
    each = at.select(group, "all_", F.coalesce("at_", F.lit(0)).alias("at_"), F.col(ids).alias("ids_")).select(group, "all_", "at_", F.posexplode("ids_").alias("p_", "id_")).withColumn("pos_", F.col("at_") + F.col("p_"))
    runs = each.withColumn("run", F.floor(F.col("pos_") / size)).where((F.col("run") + 1) * size < F.col("all_"))
    return runs.groupBy(group, "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos_", "id_"))), lambda x: x["id_"]).alias("ids"))


def mask_prompt(prompt: Column | str, answer: Column | str, ignore: int = -100) -> tuple[Column, Column]:
    """(ids, labels) with the prompt's labels ignored."""
    p, a = (F.col(x) if isinstance(x, str) else x for x in (prompt, answer))
    return F.concat(p, a), F.concat(F.transform(p, lambda _: F.lit(ignore)), a)


def with_neighbours(df: DataFrame, keys: list[str], order: str, text: str, k: int = 1) -> DataFrame:
    """Each chunk with the text of its k neighbours on either side."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-k, k)
    return df.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))


def flatten_results(df: DataFrame, results: str = "results") -> DataFrame:
    """C14: results[].chunks[] as rows with a running index per input row; blank texts are skipped."""
    def chunks(r: Column) -> Column:
        one = F.transform(r["chunks"], lambda y, i: F.struct(r["sample_id"].alias("sample_id"), i.alias("chunk"), F.coalesce(y["text"], F.lit("")).alias("text")))
        return F.filter(F.coalesce(one, F.slice(one, 1, 0)), lambda y: F.trim(y["text"]) != "")

    flat = F.flatten(F.transform(F.filter(results, lambda r: r["chunks"].isNotNull()), chunks))
    keys = [x for x in df.columns if x != results]
    return df.select(*keys, F.posexplode(flat).alias("running", "x_")).select(*keys, "running", "x_.*")


def score_batches(df: DataFrame, scorer, schema: str) -> DataFrame:
    """M1: predictions by an injected scorer: Iterator[pandas batch] -> Iterator[pandas batch]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from scorer(batches)

    return df.mapInPandas(run, schema)
