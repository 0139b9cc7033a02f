"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised (lower case, white space runs become one space). An item of m
characters has an error budget e = floor(m * rate). Cut into e + 1 pieces, at least one piece of any
occurrence with at most e edits is intact, so an Aho-Corasick scan for all pieces misses none; each
hit is verified by Myers' bit-parallel edit distance over the window it can lie in.

Null and empty texts hold nothing, null and empty items are never found. Items of fewer than `min_chars`
normalised characters have a budget of 0 and must stand as whole words. Repeated documents and items are
matched row by row; empty tables give empty results. The items may be of any number: they are handled in blocks
of `block_chars`, so what a task holds is bounded; `decontaminate` judges all blocks in one pass over the
documents, `match_benchmark` takes one pass a block. Extra columns are passed on by `decontaminate`, whatever their
names, and ignored by `match_benchmark`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE_PERCENT = 5
MIN_CHARS = 16
BLOCK_CHARS = 2_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edits between pattern and any substring of text, and the first end where they occur."""
    return Myers(pattern).search(text)


class Myers:
    """Bit-parallel approximate matching (Myers 1999); Python's integers serve as the bit vectors."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.mask = (1 << self.m) - 1
        self.top = 1 << (self.m - 1)
        self.eq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | (1 << i)

    def search(self, text: str) -> tuple[int, int]:
        pv, mv, score = self.mask, 0, self.m
        best, end, mask, top, eq = self.m, 0, self.mask, self.top, self.eq
        for j, c in enumerate(text, 1):
            e = eq.get(c, 0)
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph = mv | ~(xh | pv) & mask
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            # 0 is shifted in: an occurrence may begin anywhere
            ph = (ph << 1) & mask
            mh = (mh << 1) & mask
            pv = mh | ~(xv | ph) & mask
            mv = ph & xv
            if score < best:
                best, end = score, j
        return best, end


class Matcher:
    """Finds items in normalised texts. items: (item_id, raw text)."""

    def __init__(self, items: list[tuple[int, str]], rate_percent: int = RATE_PERCENT, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            t = normalise(raw)
            if not t:
                continue
            words = len(t) < min_chars
            budget = 0 if words else len(t) * rate_percent // 100
            n = len(self.items)
            self.items.append((item_id, t, budget, None if words else Myers(t), None if words else Myers(t[::-1])))
            cuts = [len(t) * k // (budget + 1) for k in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(t[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.automaton.add_word(p, (len(p), where))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best occurrence of each item; text is normalised."""
        if self.empty or not text:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        seen: set[tuple[int, int]] = set()
        for last, (size, where) in self.automaton.iter(text):
            at = last + 1 - size
            for n, offset in where:
                diagonal = at - offset
                if (n, diagonal) in seen:
                    continue
                seen.add((n, diagonal))
                _, t, budget, forward, backward = self.items[n]
                got = best.get(n)
                if got and got[0] == 0:
                    continue
                if forward is None:  # short: the whole item, on word bounds
                    if not text[at - 1 : at].isalnum() and not text[last + 1 : last + 2].isalnum():
                        best[n] = (0, at, last + 1)
                    continue
                lo = max(0, diagonal - budget)
                d, end = forward.search(text[lo : diagonal + len(t) + budget])
                if d > budget or got and (got[0], got[2]) <= (d, lo + end):
                    continue
                end += lo
                _, back = backward.search(text[max(0, end - len(t) - budget) : end][::-1][: len(t) + budget])
                best[n] = (d, end - back, end)
        return [(self.items[n][0], *v) for n, v in sorted(best.items())]


def item_blocks(benchmark: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_chars characters; the driver holds one block at a time."""
    block, size = [], 0
    for r in benchmark.select(key, text).toLocalIterator():
        if r[1] is None:
            continue
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def match_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id",
                    item_text: str = "text", rate_percent: int = RATE_PERCENT, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item found in it: key, item_id, distance, budget, start, end.

    The best occurrence is given (least distance, then first end), in offsets of the normalised text. A column whose name
    an earlier one has (an item key named like the document's) gets a trailing underscore.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = f"a {docs.schema[key].dataType.simpleString()}, b {benchmark.schema[item_key].dataType.simpleString()}, c int, d long, e long"
    out = None
    for block in item_blocks(benchmark, item_key, item_text, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            m = Matcher(shared.value, rate_percent, min_chars)
            for pdf in batches:
                rows = [(k, *h) for k, t in zip(pdf["k"], pdf["t"]) for h in m.hits(normalise(t))]
                yield pd.DataFrame(rows, columns=["a", "b", "c", "d", "e"])

        part = narrow.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    out = out if out is not None else spark.createDataFrame([], schema)
    return out.toDF(*common.free_names([key, item_key, "distance", "start", "end"], []))


def holds(items: Broadcast, rate_percent: int, min_chars: int):
    """A UDF: does the text hold any of the items?"""

    @F.pandas_udf("boolean")
    def dirty(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(items.value, rate_percent, min_chars)
        for texts in parts:
            yield texts.map(lambda t: bool(m.hits(normalise(t)))).astype(bool)

    return dirty


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  rate_percent: int = RATE_PERCENT, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that hold no item, all columns as they are; judged in place, without a join."""
    spark = docs.sparkSession
    common.small_batches(spark)
    for block in item_blocks(benchmark, item_key, item_text, block_chars):
        docs = docs.where(~holds(spark.sparkContext.broadcast(block), rate_percent, min_chars)(F.col(text)))
    return docs


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_benchmark(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
