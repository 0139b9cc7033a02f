"""Edit-aware token counts: a segment tree of pre-token runs per document.

The leaves of a document's tree are runs of pre-tokens that begin where white space follows a
non-space, which no pre-token crosses; every node holds the characters and tokens below it. An edit
finds its leaves by offset, takes in one character of context on either side (and so a neighbouring
leaf, where the edit touches a boundary), re-encodes only that text and updates the sums on the way to
the root. The count always equals that of encoding the edited text as a whole.

Null texts count as empty: no leaves, no tokens. Edits apply in their given order, each to the text the
one before left; offsets beyond the end are cut to it, and null parts of an edit mean 0 or "". Repeated rows
and equal texts are counted each; empty tables give empty results. Extra columns are passed on, whatever their
names, but for those of the names that are added.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, units

LEAF_UNITS = 64
EDIT_TYPE = "array<struct<start:int,end:int,replacement:string>>"


def cut_leaves(text: str, cache, leaf_units: int = LEAF_UNITS, held: int = 0) -> tuple[list[int], list[int]]:
    """Characters and tokens of each leaf of a text; where it fits `held` leaves of up to 2 * leaf_units, of as many at most."""
    us = units.split_units(text)
    if not us:
        return [], []
    if held and len(us) <= 2 * leaf_units * held:
        leaf_units = max(leaf_units, -(-len(us) // held))
    cuts = [0]
    at = leaf_units
    while at < len(us):
        # a leaf starts with white space after a non-space
        if us[at][0].isspace() and not us[at - 1][-1].isspace():
            cuts.append(at)
            at += leaf_units
        else:
            at += 1
    n = np.array(cache.of(us), np.int64)
    c = np.array(list(map(len, us)), np.int64)
    return np.add.reduceat(c, cuts).tolist(), np.add.reduceat(n, cuts).tolist()


class Tree:
    """A segment tree: node 1 is the root; an inner node has two children, and node 0 is none. Leaves may be empty."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.left, self.right, self.up, self.chars, self.tokens, self.count = ([0, 0] for _ in range(6))
        self.reencoded = self.moved = 0  # characters encoded again; leaves placed again by splits and balancing
        self.fill(1, list(zip(chars, tokens)))

    def node(self, up: int) -> int:
        for x in (self.left, self.right, self.chars, self.tokens, self.count):
            x.append(0)
        self.up.append(up)
        return len(self.up) - 1

    def fill(self, i: int, leaves: list[tuple[int, int]]) -> None:
        """Makes node i the root of a balanced subtree of leaves."""
        self.count[i] = max(1, len(leaves))
        if len(leaves) < 2:
            self.left[i] = self.right[i] = 0
            self.chars[i], self.tokens[i] = leaves[0] if leaves else (0, 0)
            return
        half = (len(leaves) + 1) // 2
        a = self.left[i] = self.node(i)
        b = self.right[i] = self.node(i)
        self.fill(a, leaves[:half])
        self.fill(b, leaves[half:])
        self.chars[i], self.tokens[i] = self.chars[a] + self.chars[b], self.tokens[a] + self.tokens[b]

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        i, start = 1, 0
        while self.left[i]:
            first = self.chars[self.left[i]]
            if offset - start >= first:
                start += first
                i = self.right[i]
            else:
                i = self.left[i]
        return i, start

    def after(self, i: int) -> int:
        """The next leaf."""
        while i == self.right[self.up[i]]:
            i = self.up[i]
        i = self.right[self.up[i]]
        while self.left[i]:
            i = self.left[i]
        return i

    def below(self, i: int) -> list[tuple[int, int]]:
        """The leaves under a node that are not empty, in order."""
        out, todo = [], [i]
        while todo:
            i = todo.pop()
            if self.left[i]:
                todo += [self.right[i], self.left[i]]
            elif self.chars[i]:
                out.append((self.chars[i], self.tokens[i]))
        return out

    def leaves(self) -> tuple[list[int], list[int]]:
        found = self.below(1)
        return [c for c, _ in found], [t for _, t in found]

    def put(self, leaf: int, new: list[tuple[int, int]]) -> None:
        """Replaces a leaf by one or more; the sums above it follow, and the highest lopsided subtree is balanced."""
        before = self.chars[leaf], self.tokens[leaf], self.count[leaf]
        self.fill(leaf, new)
        dc, dt, dn = (x - y for x, y in zip((self.chars[leaf], self.tokens[leaf], self.count[leaf]), before))
        i, lopsided = self.up[leaf], 0
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            self.count[i] += dn
            if dn and 4 * max(self.count[self.left[i]], self.count[self.right[i]]) > 3 * self.count[i] + 16:
                lopsided = i
            i = self.up[i]
        self.moved += len(new) * (len(new) > 1)
        if lopsided:
            found = self.below(lopsided)
            lost = self.count[lopsided] - len(found)
            self.moved += len(found)
            self.fill(lopsided, found)
            i = self.up[lopsided]
            while i:
                self.count[i] -= lost
                i = self.up[i]

    def edit(self, text: str, start: int, end: int, replacement: str, cache, leaf_units: int = LEAF_UNITS) -> str:
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        a, lo = self.find(max(0, start - 1))
        b, hi = self.find(min(end, max(0, len(text) - 1)))
        hi += self.chars[b]
        touched = [a]
        while touched[-1] != b:
            touched.append(self.after(touched[-1]))
        held = [i for i in touched if self.chars[i]] or [a]
        region = text[lo:start] + replacement + text[end:hi]
        self.reencoded += len(region)
        new = list(zip(*cut_leaves(region, cache, leaf_units, len(held))))
        # the last leaf takes what is over (and comes last, since it may move others); leaves without a part are empty
        for k, leaf in enumerate(held):
            self.put(leaf, new[k:] if k == len(held) - 1 else new[k : k + 1])
        return text[:start] + replacement + text[end:]


def build_trees(docs: DataFrame, text: str = "text", vocabulary: str | None = None, leaf_units: int = LEAF_UNITS) -> DataFrame:
    """docs plus n_tokens, leaf_chars and leaf_tokens: the state that later edits start from."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared, pattern = spark.sparkContext.broadcast(units.load(vocabulary)), units.pattern()

    @F.pandas_udf("struct<n_tokens:bigint,leaf_chars:array<int>,leaf_tokens:array<int>>")
    def tree(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = units.UnitCache(shared.value, pattern)
        for texts in parts:
            got = [cut_leaves(t or "", cache, leaf_units) for t in texts]
            yield pd.DataFrame({"n_tokens": [sum(t) for _, t in got], "leaf_chars": [c for c, _ in got], "leaf_tokens": [t for _, t in got]})

    docs = docs.drop("n_tokens", "leaf_chars", "leaf_tokens")
    name = "tree"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, tree(F.col(text))).select(*docs.columns, f"{name}.*")


def apply_edits(trees: DataFrame, edits: Column | str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
                leaf_units: int = LEAF_UNITS, keep_text: bool = False) -> DataFrame:
    """key, counts before and after the edits, what was re-encoded, and the new leaves (and text, on request)."""
    spark = trees.sparkSession
    common.small_batches(spark)
    shared, pattern = spark.sparkContext.broadcast(units.load(vocabulary)), units.pattern()
    kind = trees.schema[key].dataType.simpleString().replace("bigint", "long")
    schema = f"k {kind}, n_tokens long, n_edits int, n_tokens_after long, n_chars_after long, reencoded_chars long, leaf_chars array<int>, leaf_tokens array<int>"
    schema += ", text_after string" if keep_text else ""

    def make():
        cache = units.UnitCache(shared.value, pattern)

        def step(c):
            rows = []
            for t, chars, tokens, todo in zip(*(c[x].to_pylist() for x in ("t", "c", "n", "e"))):
                t, todo = t or "", todo or []
                tree = Tree(chars or [], tokens or [])
                before = tree.tokens[1]
                for e in todo:
                    t = tree.edit(t, e["start"] or 0, e["end"] or 0, e["replacement"] or "", cache, leaf_units)
                rows.append((before, len(todo), tree.tokens[1], tree.chars[1], tree.reencoded, *tree.leaves(), t if keep_text else None))
            names = ("n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "reencoded_chars", "leaf_chars", "leaf_tokens", "text_after")
            return {"k": c["k"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return step

    edits = F.col(edits) if isinstance(edits, str) else edits
    narrow = trees.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col("leaf_chars").alias("c"), F.col("leaf_tokens").alias("n"), edits.cast(EDIT_TYPE).alias("e"))
    return common.map_rows(narrow, make, schema).transform(common.keyed, key)


def with_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """docs plus `edits`, an edit table (key, seq, start, end, replacement) gathered per document in seq order."""
    per = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(seq, "start", "end", "replacement"))).alias("e"))
    per = per.select(key, F.transform("e", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("replacement"))).alias("edits"))
    return docs.join(per, key, "left")


def derived_edits(key: Column, text: Column) -> Column:
    """Three edits of a document, all of them fixed by its key: a replacement, an insertion and a deletion."""
    t = F.coalesce(text, F.lit(""))

    def at(salt: int) -> Column:
        return F.pmod(F.crc32(F.concat(key.cast("string"), F.lit(f":{salt}"))), F.length(t) + 1).cast("int")

    def one(start: Column, end: Column, new: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), new.alias("replacement"))

    return F.array(
        one(at(1), at(1) + 12, F.concat(F.lit("revised "), F.substring(t, 1, 9))),
        one(at(2), at(2), F.lit(" in the second edition,")),
        one(at(3), at(3) + 40, F.lit("")),
    )


def op4_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_edits(build_trees(docs), derived_edits(F.col("doc_id"), F.col("text")))
    return out.select("doc_id", "n_tokens", F.size("leaf_chars").alias("n_leaves"), "n_edits", "n_tokens_after", "n_chars_after", "reencoded_chars")
