"""Nearest neighbours by cosine and by token Jaccard, and token graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from .ranking import rank_by_value

#: Queries that a task compares at a time, and bytes of query vectors (or of tokens' vectors) that it holds: one scan of the base serves as many.
BLOCK, HELD_BYTES = 4096, 64 << 20


def nearest(queries: DataFrame, base: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, digits: int = 6) -> DataFrame:
    """The k most cosine-similar base rows of each query, itself excluded; ties by key.

    The stated queries go in blocks of HELD_BYTES (some 130,000 of 64 numbers); each is a dense matrix that every task multiplies
    with its base rows, `block` queries at a time, keeping its own top k, and only those meet in a shuffle. Zero vectors have
    similarity 0 with everything. k bounds the result, as asked for.
    """
    out = None
    for ids, matrix in _blocks(queries, key, vector):
        shared = base.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            parts = [slice(a, a + block) for a in range(0, len(ids), block)]
            best = [(np.full((len(ids[p]), 0), 0.0), np.zeros((len(ids[p]), 0), np.int64)) for p in parts]
            for pdf in batches:
                pdf = pdf[pdf["v"].notna()]
                if not len(pdf):
                    continue
                b = np.stack([np.asarray(x, np.float64) for x in pdf["v"]])
                b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
                own = pdf["k"].to_numpy()
                for at, p in enumerate(parts):
                    s = np.round(q[p] @ b.T, digits)
                    s[ids[p][:, None] == own[None, :]] = -np.inf
                    best_s = np.concatenate([best[at][0], s], axis=1)
                    best_i = np.concatenate([best[at][1], np.broadcast_to(own, s.shape)], axis=1)
                    if best_s.shape[1] > 4 * k:  # the best few alone are put in order
                        some = np.argpartition(-best_s, k - 1, axis=1)[:, : k]
                        least = np.take_along_axis(best_s, some, 1).min(axis=1, keepdims=True)
                        wide = max(k, int((best_s >= least).sum(axis=1).max()))  # with all that tie for the last place
                        some = np.argpartition(-best_s, min(wide, best_s.shape[1]) - 1, axis=1)[:, :wide]
                        best_s, best_i = np.take_along_axis(best_s, some, 1), np.take_along_axis(best_i, some, 1)
                    top = np.lexsort((best_i, -best_s), axis=1)[:, :k]
                    best[at] = np.take_along_axis(best_s, top, 1), np.take_along_axis(best_i, top, 1)
            for (best_s, best_i), p in zip(best, parts):
                keep = np.isfinite(best_s).ravel()
                yield pd.DataFrame({"query": np.repeat(ids[p], best_s.shape[1])[keep], "neighbor": best_i.ravel()[keep], "similarity": best_s.ravel()[keep]})

        part = base.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, "query long, neighbor long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return base.sparkSession.createDataFrame([], "query long, neighbor long, similarity double, rank int")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbor")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, key: str, vector: str):
    ids, rows = [], []
    for r in queries.select(key, vector).where(F.col(vector).isNotNull()).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if 8 * len(ids) * len(rows[0]) >= HELD_BYTES:
            yield np.array(ids, np.int64), _unit(rows)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), _unit(rows)


def _unit(rows: list) -> np.ndarray:
    q = np.array(rows, np.float64)
    return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)


def most_similar_by_tokens(queries: DataFrame, base: DataFrame, q_key: str, q_text: str, b_key: str, b_text: str, exclude_same: bool = False,
                           given: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The base row of the greatest identifier Jaccard for each query; ties by key; queries that share none stay out.

    The stated queries go in blocks of bounded size, each an inverted index that every task holds; a task reads
    its base rows once, counts shared tokens by the index and keeps its own best row of each query, and only those
    meet in a shuffle. exclude_same leaves out the base row with the query's own key. given, a table (q_key,
    neighbor) of neighbours known beforehand, goes before: its queries get that neighbour and a null similarity.
    """
    q = queries.select(F.col(q_key).cast("long").alias("q"), E.identifiers(q_text).alias("t"))
    if given is not None:
        known = given.select(F.col(q_key).cast("long").alias("q"), F.col("neighbor").cast("long").alias("neighbor")).where("neighbor is not null").dropDuplicates(["q"])
        q = q.join(known.select("q"), "q", "left_anti")
    rows = base.select(F.col(b_key).cast("long").alias("b"), E.identifiers(b_text).alias("t")).where(F.size("t") > 0)
    spark, out = base.sparkSession, None
    for ids, sizes, index in _token_blocks(q, block):
        shared = spark.sparkContext.broadcast((ids, sizes, index))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, sizes, index = shared.value
            none = np.zeros(0, np.int64)
            best = np.full(len(ids), -1, np.int64)  # similarity in whole millionths
            found, common = np.full(len(ids), np.iinfo(np.int64).max), np.zeros((2, len(ids)), np.int64)
            for pdf in batches:
                for key, tokens in zip(pdf["b"].to_numpy(), pdf["t"]):
                    hit = np.concatenate([index.get(x, none) for x in tokens])
                    if not len(hit):
                        continue
                    who, n = np.unique(hit, return_counts=True)
                    union = sizes[who] + len(tokens) - n
                    score = np.floor(n / union * 1e6 + 0.5).astype(np.int64)
                    use = (score > best[who]) | ((score == best[who]) & (key < found[who]))
                    if exclude_same:
                        use &= ids[who] != key
                    who = who[use]
                    best[who], found[who], common[0, who], common[1, who] = score[use], key, n[use], union[use]
            some = best >= 0
            yield pd.DataFrame({"q": ids[some], "neighbor": found[some], "common": common[0, some], "total": common[1, some]})

        part = rows.mapInPandas(run, "q long, neighbor long, common long, total long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "q long, neighbor long, common long, total long")
    score = F.round(F.col("common") / F.col("total").cast("double"), 6)
    top = out.withColumn("similarity", score).groupBy("q").agg(F.max_by(F.struct("neighbor", "similarity"), F.struct("similarity", -F.col("neighbor"))).alias("x"))
    top = top.select("q", "x.neighbor", "x.similarity")
    if given is not None:
        top = top.unionByName(known.join(queries.select(F.col(q_key).cast("long").alias("q")), "q", "left_semi").withColumn("similarity", F.lit(None).cast("double")))
    return top.select(F.col("q").cast(queries.schema[q_key].dataType).alias(q_key), F.col("neighbor").cast(base.schema[b_key].dataType).alias("neighbor"), "similarity")


def _token_blocks(q: DataFrame, block: int):
    def made():
        index: dict[str, list[int]] = {}
        for i, (_, tokens) in enumerate(held):
            for x in tokens:
                index.setdefault(x, []).append(i)
        return np.array([k for k, _ in held], np.int64), np.array([len(x) for _, x in held], np.int64), {x: np.array(v) for x, v in index.items()}

    held = []
    for r in q.where(F.size("t") > 0).toLocalIterator():
        held.append((r["q"], r["t"]))
        if len(held) == block:
            yield made()
            held = []
    if held:
        yield made()


def co_occurrence(df: DataFrame, key: str, tokens: Column, window: int, distinct_positions: bool = False) -> DataFrame:
    """Per document, how often two different tokens stand within `window` of each other (both directions).

    distinct_positions gives G5: positions are the nodes, and each pair counts once.
    """
    t = df.select(key, tokens.alias("t_"))
    at = t.select(key, "t_", F.posexplode("t_").alias("i_", "a_"))
    ahead = F.slice(F.col("t_"), F.col("i_") + 2, F.lit(window - 1))
    pair = at.select(key, "i_", "a_", F.posexplode(ahead).alias("d_", "b_"))
    if distinct_positions:
        e = pair.select(key, F.col("i_").alias("src"), (F.col("i_") + F.col("d_") + 1).alias("dst"))
        return e.unionByName(e.select(key, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = pair.where("a_ <> b_").select(key, F.col("a_").alias("src"), F.col("b_").alias("dst"))
    return e.unionByName(e.select(key, F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy(key, "src", "dst").agg(F.count("*").alias("weight"))


def normalized_adjacency(edges: DataFrame, graph: str, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """V6: weights divided by the square roots of both ends' degrees; 0 where a degree is 0."""
    deg = edges.groupBy(graph, F.col(src).alias("n_")).agg(F.sum(weight).alias("d_"))
    a = edges.join(deg.select(graph, F.col("n_").alias(src), F.col("d_").alias("ds_")), [graph, src])
    b = a.join(deg.select(graph, F.col("n_").alias(dst), F.col("d_").alias("dd_")), [graph, dst])
    return b.select(graph, src, dst, F.round(F.coalesce(F.try_divide(F.col(weight).cast("double"), F.sqrt(F.col("ds_") * F.col("dd_"))), F.lit(0.0)), 6).alias("value"))


def property_graph(nodes: DataFrame, edges: DataFrame, kinds: list[str], graph: str = "graph_id") -> tuple[DataFrame, DataFrame]:
    """CFG nodes and allowed edges between them; nodes without an edge go, the rest get dense numbers."""
    cfg = nodes.where(F.col("is_cfg") & (F.col("type") != "File"))
    ends = cfg.select(graph, "key")
    e = edges.where(F.col("kind").isin(kinds)).join(ends.withColumnRenamed("key", "start"), [graph, "start"], "left_semi").join(ends.withColumnRenamed("key", "end"), [graph, "end"], "left_semi")
    touched = e.select(graph, F.col("start").alias("key")).unionByName(e.select(graph, F.col("end").alias("key"))).distinct()
    w = Window.partitionBy(graph).orderBy("key")
    dense = cfg.join(touched, [graph, "key"], "left_semi").withColumn("node", F.row_number().over(w) - 1)
    ids = dense.select(graph, "key", "node")
    out = e.join(ids.select(graph, F.col("key").alias("start"), F.col("node").alias("src")), [graph, "start"]).join(ids.select(graph, F.col("key").alias("end"), F.col("node").alias("dst")), [graph, "end"])
    return dense, out.select(graph, "src", "kind", "dst")


def first_seen_ids(df: DataFrame, value: str, position: str, name: str = "id") -> DataFrame:
    """Values numbered in the order of their first appearance, by chunks between quantiles. The dictionary has a row per value."""
    first = df.groupBy(value).agg(F.min(position).alias("p_"))
    return rank_by_value(first, "p_", value).select(value, (F.col("rank_") - 1).alias(name))


def node_embeddings(tokens: DataFrame, vectors: DataFrame, node: list[str], token: str = "token", vector: str = "vector") -> DataFrame:
    """A-35: the mean token vector of each node, per dimension."""
    long = tokens.join(vectors, token).select(*node, F.posexplode(vector).alias("d", "x"))
    means = long.groupBy(*node, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(*node).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: F.round(s["m"], 6)).alias(vector))


def node_features(nodes: DataFrame, tokens: DataFrame, vectors: DataFrame, node: list[str], types: list[str], size: int, kind: str = "type", token: str = "token", vector: str = "vector") -> DataFrame:
    """G1: nodes (a row each) plus `features`: one of types as 0s and a 1, then the mean vector of the node's tokens.

    A token without a vector counts with zeros; a node without tokens has zeros. What is shuffled is a node's distinct tokens with
    their counts, never a vector, so a node with many tokens has a row for each word at most. The vectors that tokens ask for meet
    them where a node's rows lie: broadcast where they take HELD_BYTES at most, else by a join.
    Vectors have `size` numbers; nulls in them count as 0.
    """
    bags = tokens.groupBy(*node, token).agg(F.count("*").alias("n_"))
    words = tokens.select(token).distinct()
    used = vectors.join(words, token, "left_semi").groupBy(token).agg(F.array(*[F.sum(F.get(vector, F.lit(i)).cast("double")) for i in range(size)]).alias("v_"))
    few = words.count() * size * 8 <= HELD_BYTES
    rows = nodes.join(bags, node, "left").join(F.broadcast(used) if few else used, token, "left")
    one = [(F.first(kind) == x).cast("double") for x in types]
    # one array column and one aggregation: as columns of their own, the numbers make methods too long for the JVM to compile
    mean = [F.coalesce(F.sum(F.get("v_", F.lit(i)) * F.col("n_")) / F.sum("n_"), F.lit(0.0)) for i in range(size)]
    rest = [F.first(c).alias(c) for c in nodes.columns if c not in node]
    return rows.groupBy(*node).agg(*rest, F.array(*one, *mean).alias("features")).select(*nodes.columns, "features")


def word_vectors(df: DataFrame, tokens: str, size: int = 128, seed: int = 42):
    """Word2Vec over token arrays (window and epochs as given to the estimator)."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(vectorSize=size, minCount=1, maxIter=5, seed=seed, inputCol=tokens, outputCol="vector").fit(df)
