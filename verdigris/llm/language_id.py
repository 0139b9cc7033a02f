"""Language identification by segmentation-marginalised unigrams.

Every language has a unigram distribution over the pieces of a fixed public vocabulary. A text's
likelihood under a language is the product over its words of the sum over all segmentations of the
word into pieces (forward algorithm); the probabilities are fitted by expectation maximisation over
the same sums. Words are lower-cased and prefixed by one space. Every piece takes part, however long, and
every word is summed whole: words of up to SHORT bytes together with all of their length, longer ones
(also texts without white space) one by one in logarithms, in time and memory linear in their length.

Training reads at most `docs_per_language` rows per language, drawn by hash (a documented sample);
scoring reads every whole text. The languages are the distinct labels, and the model is a table of pieces
by languages on the driver and in every task: lang must be a label column, not free text. Texts that are
null or hold no letter (Unicode category L) get `und` and score 0. Repeated rows are scored alike; without
any labelled row every text is `und`. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a word, with its space, up to which its sums cannot underflow.
SHORT = 32
CACHE_WORDS = 400_000
#: Rounds of expectation maximisation, and the pseudo-count of every piece.
ROUNDS, FLOOR = 3, 0.02
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary's lower-case pieces and all single bytes, by length, as sorted 64-bit codes.

    A code is a polynomial of the bytes modulo 2**64; no two pieces of one length share one (checked), and any
    other string shares one with a chance of about 2**-50.
    """

    def __init__(self, ranks: dict[bytes, int]):
        by_len: dict[int, list[bytes]] = {}
        for p in {*ranks, *(bytes([b]) for b in range(256))}:
            if p and p == p.lower():
                by_len.setdefault(len(p), []).append(p)
        self.codes, self.first, self.pieces = {}, {}, []
        for k, ps in sorted(by_len.items()):
            chars = np.frombuffer(b"".join(ps), np.uint8).reshape(len(ps), k)
            code = np.zeros(len(ps), np.uint64)
            for i in range(k):
                code = code * FACTOR + chars[:, i] + np.uint64(1)
            order = np.argsort(code)
            self.codes[k] = code[order]
            if len(np.unique(code)) < len(code):
                raise ValueError("two pieces share a code")
            self.first[k] = len(self.pieces)
            self.pieces += [ps[i] for i in order]
        self.size, self.longest = len(self.pieces), max(by_len)

    def lookup(self, words: list[bytes]) -> list[np.ndarray | None]:
        """For words of one length n: for each piece length k, the piece ids at each start, -1 for none; None if all are."""
        n = len(words[0])
        chars = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        out, code = [], np.zeros((len(words), n + 1), np.uint64)
        for k in range(1, min(self.longest, n) + 1):
            code = code[:, : n - k + 1] * FACTOR + chars[:, k - 1 :]
            table = self.codes.get(k)
            if table is None:
                out.append(None)
                continue
            flat = code.ravel()
            at = np.minimum(np.searchsorted(table, flat), len(table) - 1)
            found = table[at] == flat
            out.append(np.where(found, at + self.first[k], -1).reshape(code.shape).astype(np.int32) if found.any() else None)
        return out

    def matches(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and id of every piece in a word, by end."""
        found = []
        for k, ids in enumerate(self.lookup([word]), 1):
            if ids is not None:
                i = np.flatnonzero(ids[0] >= 0)
                found.append(np.stack([i, i + k, ids[0][i]]))
        start, end, ids = np.concatenate(found, axis=1)
        order = np.lexsort((start, end))
        return start[order], end[order], ids[order]


def forward(ids: list[np.ndarray | None], prob: np.ndarray) -> np.ndarray:
    """alpha[position, word, language] of words of one length; prob has a last row of zeros for absent pieces."""
    u, n = ids[0].shape
    alpha = np.zeros((n + 1, u, prob.shape[1]))
    alpha[0] = 1.0
    for j in range(1, n + 1):
        for k in range(1, min(len(ids), j) + 1):
            if ids[k - 1] is None:
                continue
            p = ids[k - 1][:, j - k]
            if k <= 3:
                alpha[j] += alpha[j - k] * prob[p]
            elif len(some := np.flatnonzero(p >= 0)):  # long pieces are rare
                alpha[j, some] += alpha[j - k, some] * prob[p[some]]
    return alpha


def log_sums(n: int, start: np.ndarray, end: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """log alpha[position, language] of one word: terms are its pieces' log probabilities, in the order of their ends."""
    out = np.full((n + 1, terms.shape[1]), -np.inf)
    out[0] = 0.0
    bounds = np.searchsorted(end, np.arange(1, n + 2)).tolist()
    for j in range(1, n + 1):
        a, b = bounds[j - 1], bounds[j]
        x = out[start[a:b]] + terms[a:b]
        top = x.max(axis=0)
        out[j] = top + np.log(np.exp(x - top).sum(axis=0))
    return out


def by_length(words: list[bytes]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


class Words:
    """Words with their counts a language, and where the vocabulary's pieces lie in them."""

    def __init__(self, counts: dict[bytes, np.ndarray], n_lang: int, pieces: Pieces):
        self.n_lang, self.size = n_lang, pieces.size
        short = [w for w in counts if len(w) <= SHORT]
        self.weight = np.array([counts[w] for w in short]).reshape(len(short), n_lang)
        self.groups = [(idx, pieces.lookup([short[i] for i in idx])) for _, idx in sorted(by_length(short).items())]
        self.long = [(counts[w], len(w), *pieces.matches(w)) for w in counts if len(w) > SHORT]

    def expected(self, prob: np.ndarray) -> np.ndarray:
        """How often each piece is met in each language, over all segmentations of the words by their probability."""
        n_lang, expected = self.n_lang, np.zeros((self.size + 1, self.n_lang))
        for idx, ids in self.groups:
            for a in range(0, len(idx), 20_000):
                part = [x if x is None else x[a : a + 20_000] for x in ids]
                w = self.weight[idx[a : a + 20_000]]
                n = part[0].shape[1]
                alpha = forward(part, prob)
                beta = np.zeros_like(alpha)
                beta[n] = 1.0
                for j in range(n - 1, -1, -1):
                    for k in range(1, min(len(part), n - j) + 1):
                        if part[k - 1] is not None:
                            beta[j] += beta[j + k] * prob[part[k - 1][:, j]]
                scale = w / alpha[n]
                for k in range(1, len(part) + 1):
                    if part[k - 1] is None:
                        continue
                    for i in range(n - k + 1):
                        some = np.flatnonzero(part[k - 1][:, i] >= 0)
                        p = part[k - 1][some, i]
                        share = alpha[i, some] * prob[p] * beta[i + k, some] * scale[some]
                        for g in range(n_lang):
                            expected[:, g] += np.bincount(p, share[:, g], len(expected))
        for w, n, start, end, ids in self.long:
            terms = np.log(prob[ids])
            ahead = log_sums(n, start, end, terms)
            turned = np.lexsort((-end, n - start))  # the same sums from the end
            behind = log_sums(n, (n - end)[turned], (n - start)[turned], terms[turned])[::-1]
            share = np.exp(ahead[start] + terms + behind[end] - ahead[n]) * w
            for g in range(n_lang):
                expected[:, g] += np.bincount(ids, share[:, g], len(expected))
        return expected


def start_of(pieces: Pieces, n_lang: int) -> np.ndarray:
    prob = np.full((pieces.size + 1, n_lang), 1.0 / pieces.size)
    prob[-1] = 0
    return prob


def next_of(expected: np.ndarray, floor: float) -> np.ndarray:
    expected = expected + floor
    expected[-1] = 0
    return expected / expected.sum(axis=0)


def fit(counts: dict[bytes, np.ndarray], n_lang: int, pieces: Pieces, rounds: int = ROUNDS, floor: float = FLOOR) -> np.ndarray:
    """prob[piece, language] by EM; every piece keeps `floor` pseudo-counts, so nothing is impossible."""
    words, prob = Words(counts, n_lang, pieces), start_of(pieces, n_lang)
    for _ in range(rounds):
        prob = next_of(words.expected(prob), floor)
    return prob


def fit_in_tasks(words: DataFrame, n_lang: int, pieces: Pieces, rounds: int = ROUNDS, floor: float = FLOOR) -> np.ndarray:
    """fit() over a table (p: word, n: its count in each language): tasks expect over their words, one aggregation a round adds up.

    The driver gets a row a piece met and language, of a fixed vocabulary; sums are of whole billionths, the same in any order.
    """
    sc, prob = words.sparkSession.sparkContext, start_of(pieces, n_lang)
    tables = sc.broadcast(vars(pieces))
    for _ in range(rounds):
        shared = sc.broadcast(prob)

        def expect(batches, shared=shared):
            counts = {bytes(r["p"]): np.array(r["n"], float) for r in common.dicts(batches)}
            if counts:
                got = np.rint(Words(counts, n_lang, unpacked(tables.value)).expected(shared.value) * 1e9).astype(np.int64)
                piece, lang = np.nonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(got[piece, lang])], names=["piece", "lang", "n"])

        expected = np.zeros_like(prob)
        met = words.mapInArrow(expect, "piece int, lang int, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        expected[met["piece"], met["lang"]] = met["n"].to_numpy() / 1e9
        prob = next_of(expected, floor)
    return prob


def unpacked(tables: dict) -> Pieces:
    """Pieces from their plain tables: broadcasts hold no objects of this package."""
    pieces = Pieces.__new__(Pieces)
    vars(pieces).update(tables)
    return pieces


class Scorer:
    """Sums log likelihoods of words; remembers the words it has met, up to CACHE_WORDS."""

    def __init__(self, pieces: Pieces, prob: np.ndarray):
        self.pieces, self.prob = pieces, prob
        with np.errstate(divide="ignore"):
            self.logs = np.log(prob)
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((0, self.prob.shape[1]))

    def learn(self, words: list[bytes]) -> None:
        new = np.zeros((len(words), self.prob.shape[1]))
        spaced = [b" " + w for w in words]
        for n, idx in by_length(spaced).items():
            if n > SHORT:
                for i in idx:
                    start, end, ids = self.pieces.matches(spaced[i])
                    new[i] = log_sums(n, start, end, self.logs[ids])[-1]
                continue
            for a in range(0, len(idx), 20_000):
                some = idx[a : a + 20_000]
                new[some] = np.log(forward(self.pieces.lookup([spaced[i] for i in some]), self.prob)[-1])
        self.known.update(zip(words, range(len(self.rows), len(self.rows) + len(words))))
        self.rows = np.concatenate([self.rows, new])

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """Log likelihood [text, language]; a text is a list of words, none empty."""
        if len(self.known) > CACHE_WORDS:
            self.reset()
        if fresh := set().union(*texts) - self.known.keys():
            self.learn(sorted(fresh))
        out = np.zeros((len(texts), self.prob.shape[1]))
        for i, ws in enumerate(texts):
            if ws:
                out[i] = self.rows[list(map(self.known.__getitem__, ws))].sum(axis=0)
        return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def training_counts(docs: DataFrame, lang: str, text: str, key: str, docs_per_language: int) -> tuple[list[str], DataFrame | None, np.ndarray]:
    """Languages, the sample's words with their count in each (p, n), and the share of each language among all labelled rows."""
    labelled = docs.where(F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], None, np.zeros(0)
    span = 1 << 30
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("lang")), F.lit(span))
    upto = F.create_map(*[F.lit(x) for g in langs for x in (g, min(span, int(1.3 * docs_per_language / sizes[g] * span) + 1))])
    small = labelled.where(draw < upto[F.col(lang)]).select(F.col(lang).alias("g"), F.col(text).alias("t"), draw.alias("h"), F.col(key).alias("k"))
    small = small.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("h", "k", F.xxhash64("t")))).where(F.col("rn") <= docs_per_language)

    def count(batches: Iterator):
        import pandas as pd
        from collections import Counter

        for pdf in batches:
            c: Counter = Counter()
            for g, t in zip(pdf["g"], pdf["t"]):
                c.update((g, b" " + w) for w in words_of(t))
            yield pd.DataFrame([(g, p, n) for (g, p), n in c.items()], columns=["g", "p", "n"])

    met = small.mapInPandas(count, "g string, p binary, n long").groupBy("p").agg(*[F.coalesce(F.sum(F.when(F.col("g") == g, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, g in enumerate(langs)])
    counts = common.written(met.select("p", F.array(*[f"n{i}" for i in range(len(langs))]).alias("n")).repartition(docs.sparkSession.sparkContext.defaultParallelism, "p"), "words")
    total = sum(sizes.values())
    return langs, counts, np.array([sizes[g] / total for g in langs])


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
             docs_per_language: int = 250, vocabulary: str | None = None) -> DataFrame:
    """key, lang_pred, score for every row of docs; only labelled's text and lang are learnt from."""
    spark = docs.sparkSession
    common.small_batches(spark)
    ranks = common.load_ranks(vocabulary or common.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    langs, counts, prior = training_counts(labelled, lang, text, key, docs_per_language)
    pieces = Pieces(ranks)
    prob = np.zeros((pieces.size + 1, 0))
    if langs:
        prob = fit_in_tasks(counts, len(langs), pieces)
        common.drop_written(counts)
    model = spark.sparkContext.broadcast((vars(pieces), prob, langs, np.log(prior) if langs else prior))  # plain arrays: executors need no copy of this package

    def make():
        tables, prob, langs, prior = model.value
        scorer = Scorer(unpacked(tables), prob)

        def step(c):
            texts = c["t"].to_pylist()
            known = [bool(langs) and any(map(str.isalpha, t or "")) for t in texts]
            preds, scores = [], []
            for a in range(0, len(texts), 200):
                ll = scorer.score([words_of(t) if k else [] for t, k in zip(texts[a : a + 200], known[a : a + 200])]) + prior
                for row, k in zip(ll, known[a : a + 200]):
                    if not k:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    i = int(row.argmax())
                    preds.append(langs[i])
                    scores.append(float(1.0 / np.exp(row - row[i]).sum()))
            return {"k": c["k"], "lang_pred": preds, "score": scores}

        return step

    kind = docs.schema[key].dataType.simpleString().replace("bigint", "long")
    return common.keyed(common.map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), make, f"k {kind}, lang_pred string, score double"), key)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = common.is_held(F.col("doc_id"), 4)
    return identify(docs, docs.where(~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
