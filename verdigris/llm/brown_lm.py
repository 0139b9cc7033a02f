"""Scoring by a Brown class-based bigram model.

Every training word has a class by exchange clustering. The `top_words` most frequent words, and units
of shape (a hash of the last characters) that hold all others, are clustered first, on the table of
their bigrams: in turn, each unit moves to the class that raises the likelihood of the training text's
class bigrams most. Then every other training word, with the class of its shape unit as its start, moves
by the same gain in a distributed pass over its own left and right class counts, all words against the
tables of the pass's start. Unseen words keep the class of their shape. A token then has the probability

    P(class | previous class) * P(word | class)

with the transition interpolated between bigram and unigram, and one added to every count and one unseen
word to every class. All counts cover the whole training corpus and stay distributed. Texts stay where
they are read: each task numbers the words of its rows in blocks of bounded bytes, once, and only
compressed columns move afterwards, a row per block and bucket of words (a bucket is a hash range of the
vocabulary): the words with their counts, the neighbours' classes of rare words, and back the class and
count of each word. A task works on one block or bucket at a time and adds up as it reads, so neither a
frequent word nor a large corpus fills it. The driver holds tables of a fixed size.

Null texts are empty and consist of their end token. Repeated rows are scored alike. Without training
rows every count is zero and the model is uniform over its classes. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOP_WORDS = 1792
SHAPES = 256
CLASSES = 48
ROUNDS = 4
BLOCK_BYTES = 16_000_000
#: Text bytes a bucket of the vocabulary stands for; fixes what a task holds of words.
BUCKET_BYTES = 32_000_000
MIN_BUCKETS = 24
END = b""  # the end token; no word is empty


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words and one end."""
    return [*(text or b"").lower().split(), END]


def shape_of(word: bytes, shapes: int = SHAPES) -> int:
    """A fixed hash of the word's last three characters, punctuation included."""
    end = word[-3:]
    if not end.isascii():
        end = word[-12:].decode("utf-8", "ignore")[-3:].encode()
    return zlib.crc32(end) % shapes


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit, from a square table of unit bigram counts, by exchange clustering.

    Maximises sum N(c,d) log N(c,d) - sum N(c,.) log N(c,.) - sum N(.,c) log N(.,c). Units start in
    the order of their counts, dealt over the classes; each round visits all units once.
    """
    n = len(bigrams)
    freq = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.lexsort((np.arange(n), -freq))
    cls = np.empty(n, np.int64)
    cls[order] = np.arange(n) % classes
    member = np.zeros((n, classes))
    member[np.arange(n), cls] = 1
    table = member.T @ (bigrams @ member)

    for _ in range(rounds):
        moved = 0
        for u in order:
            if not freq[u]:
                continue
            own = cls[u]
            right = bigrams[u] @ member  # to each class
            left = bigrams[:, u] @ member  # from each class
            self_n = bigrams[u, u]
            right[own] -= self_n
            left[own] -= self_n
            # take u out
            table[own] -= right
            table[:, own] -= left
            table[own, own] -= self_n
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            to, frm = right.sum() + self_n, left.sum() + self_n
            # the gain of putting u into class c: row c gets `right`, column c gets `left`
            gain = (xlogx(table + right) - xlogx(table)).sum(axis=1) + (xlogx(table.T + left) - xlogx(table.T)).sum(axis=1)
            d = np.diag(table)
            gain += xlogx(d + right + left + self_n) - xlogx(d + right) - xlogx(d + left) + xlogx(d)
            gain -= xlogx(rows + to) - xlogx(rows) + xlogx(cols + frm) - xlogx(cols)
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            table[best] += right
            table[:, best] += left
            table[best, best] += self_n
            if best != own:
                member[u, own], member[u, best] = 0, 1
                cls[u] = best
                moved += 1
        if not moved:
            break
    return cls


class Model:
    """Log10 probabilities: of a class after a class, and of each count of a word within its class."""

    def __init__(self, table: np.ndarray, distinct: np.ndarray, total: int, vocabulary: int, trust: float = 10.0):
        count = table.sum(axis=0)  # tokens of each class
        uni = (count + 1) / (count.sum() + len(table))
        rows = table.sum(axis=1, keepdims=True)
        self.transition = np.log10((table + trust * uni) / (rows + trust))
        # a class has its distinct words, each with its count plus one, and one unseen word
        self.class_total = np.log10(count + distinct + 1)
        self.total, self.vocabulary = total, vocabulary


class Numbers(dict):
    """word -> number in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def squeeze(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def spread(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def join_words(words: list[bytes]) -> bytes:
    """Words hold no space; the list must not be empty."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b" ".join(words))


def split_words(data: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data).split(b" ")


def encode(batches: Iterator[pa.RecordBatch], n_buckets: int, shapes: int, block_bytes: int) -> Iterator[dict]:
    """Blocks of a task's rows (k, t, train). A block's words are numbered in the order of their buckets:
    per bucket its words, their training counts and shapes; per document its key and length, and all ids."""
    part, seq = TaskContext.get().partitionId(), 0
    number, ids, keys, train, size = Numbers(), [], [], [], 0

    def block() -> dict:
        words, m = list(number), len(number)
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, m) % n_buckets
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(m, np.int32)
        rank[order] = np.arange(m, dtype=np.int32)
        flat = rank[np.concatenate(ids)]
        ends = np.array(list(map(len, ids)), np.int32)
        n = np.bincount(flat[np.repeat(np.array(train, bool), ends)], minlength=m).astype("<u4")
        words = [words[i] for i in order]
        shape = np.fromiter((shape_of(w, shapes) for w in words), np.uint16, m)
        found, first = np.unique(bucket[order], return_index=True)
        spans = list(zip(first.tolist(), [*first[1:].tolist(), m]))
        return {
            "block": (part << 32) + seq, "bucket": found.tolist(), "words": [join_words(words[a:b]) for a, b in spans], "n": [squeeze(n[a:b]) for a, b in spans],
            "shape": [squeeze(shape[a:b]) for a, b in spans], "k": keys, "train": np.array(train, bool).tobytes(), "ends": squeeze(ends), "ids": squeeze(flat),
        }

    for b in batches:
        for k, t, is_train in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
            ws = tokens(t)
            ids.append(np.fromiter(map(number.__getitem__, ws), np.int32, len(ws)))
            keys.append(k)
            train.append(bool(is_train))
            size += len(t or b"") + 8
            if size >= block_bytes:
                yield block()
                seq += 1
                number, ids, keys, train, size = Numbers(), [], [], [], 0
    if ids:
        yield block()


class Block:
    """A stored block's words, and the bigrams of its training rows."""

    def __init__(self, row: dict, at: dict[bytes, int], n_top: int):
        self.words = [w for x in row["words"] for w in split_words(x)]
        unit = np.array([at.get(w, -1) for w in self.words], np.int64)
        shape = np.concatenate([spread(x, "<u2") for x in row["shape"]])
        self.rest = unit < 0
        self.unit = np.where(self.rest, n_top + shape, unit)
        self.bounds = np.cumsum([0, *(len(spread(x, "<u2")) for x in row["shape"])])
        ids, ends = spread(row["ids"], "<i4"), spread(row["ends"], "<i4")
        self.right = ids[np.repeat(np.frombuffer(row["train"], bool), ends)]
        self.left = np.roll(self.right, 1)  # every text ends with END, which also precedes the next


def contexts(row: dict, block: Block, cls: np.ndarray, classes: int) -> Iterator[dict]:
    """Per bucket, the neighbours of its words outside the top table: word (step from the one before), class
    (0..classes-1 right, classes.. left) and count."""
    left, right, wide = block.left, block.right, 2 * classes
    a, b = block.rest[left], block.rest[right]
    codes = np.concatenate([left[a].astype(np.int64) * wide + cls[right[a]], right[b].astype(np.int64) * wide + classes + cls[left[b]]])
    code, n = np.unique(codes, return_counts=True)
    at = np.searchsorted(code, block.bounds * wide)
    for i, bucket in enumerate(row["bucket"]):
        some = slice(at[i], at[i + 1])
        if at[i] < at[i + 1]:
            word = code[some] // wide - block.bounds[i]
            yield {"block": row["block"], "bucket": bucket, "step": squeeze(np.diff(word, prepend=0).astype("<u4")), "ctx": squeeze((code[some] % wide).astype("<u2")), "times": squeeze(n[some].astype("<u4"))}


def tables(sums: np.ndarray) -> Iterator[dict]:
    """The rows that hold anything of a square table."""
    for u in np.flatnonzero(sums.any(axis=1)).tolist():
        yield {"u": u, "vec": squeeze(sums[u].astype("<i8"))}


def added(parts: DataFrame, n: int) -> np.ndarray:
    """The n x n sum of what tasks gave as `tables`."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(n, "<i8")
        for v in group["vec"].to_pylist():
            total += spread(v, "<i8")
        return pa.table({"u": group["u"].slice(0, 1), "vec": pa.array([squeeze(total)], pa.binary())})

    out = np.zeros((n, n))
    got = parts.groupBy("u").applyInArrow(add, "u int, vec binary").toArrow()  # at most n rows
    for u, v in zip(got["u"].to_pylist(), got["vec"].to_pylist()):
        out[u] = spread(v, "<i8")
    return out


def best_classes(vectors: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word (a row: counts of right, then left neighbours' classes) of the greatest gain.

    The gain is that of exchange(), each word taken out of its own class in the tables; a word's bigrams
    with itself count as bigrams with its old class.
    """
    classes = len(table)
    g, a = vectors.nonzero()
    v = vectors[g, a]
    by = np.concatenate([table.T, table])  # by[d]: counts of each class before d; by[classes + d]: after d
    logs, at, home = xlogx(by), by[a], own[g]
    gain = xlogx(at + v[:, None]) - logs[a]
    x = at[np.arange(len(a)), home]
    gain[np.arange(len(a)), home] = xlogx(x) - xlogx(np.maximum(x - v, 0))
    total = np.zeros((len(vectors), classes))
    some, first = np.unique(g, return_index=True)
    if len(some):
        total[some] = np.add.reduceat(gain, first, axis=0)
    every = np.arange(len(vectors))
    for sums, part in ((table.sum(axis=1), vectors[:, :classes]), (table.sum(axis=0), vectors[:, classes:])):
        m = part.sum(axis=1)
        loss = xlogx(sums + m[:, None]) - xlogx(sums)
        loss[every, own] = xlogx(sums[own]) - xlogx(np.maximum(sums[own] - m, 0))
        total -= loss
    best = total.argmax(axis=1)
    return np.where(total[every, best] > total[every, own] + 1e-9, best, own)


def vocabulary(bucket: int, rows: Iterator[dict], n_top: int) -> Iterator[dict]:
    """A bucket's words over all blocks: for each block, where its words lie among them; then, as block -1, the
    words with their training counts and shapes, the most frequent ones, and the sums of counts and of words."""
    number, c, shape = Numbers(), np.zeros(1024, np.int64), np.zeros(1024, np.uint16)
    for r in rows:
        ws = split_words(r["words"])
        at = np.fromiter(map(number.__getitem__, ws), np.int32, len(ws))
        while len(number) > len(c):
            c, shape = np.concatenate([c, np.zeros_like(c)]), np.concatenate([shape, np.zeros_like(shape)])
        c[at] += spread(r["n"], "<u4")
        shape[at] = spread(r["shape"], "<u2")
        yield {"bucket": bucket, "block": r["block"], "idx": squeeze(at)}
    words, c, shape = list(number), c[: len(number)], shape[: len(number)]
    least = np.partition(c, -n_top)[-n_top] if len(c) > n_top else 0
    top = sorted(((-int(c[i]), words[i]) for i in np.flatnonzero(c >= max(least, 1))))[:n_top]
    yield {
        "bucket": bucket, "block": -1, "words": join_words(words), "c": squeeze(c), "shape": squeeze(shape), "total": int(c.sum()), "distinct": int((c > 0).sum()),
        "top": [w for _, w in top], "top_c": [-n for n, _ in top],
    }


def move_words(bucket: int, rows: Iterator[dict], at: dict[bytes, int], seed: np.ndarray, table: np.ndarray, n_top: int) -> Iterator[dict]:
    """The class and count of each word of a bucket, for each block in its own order; then, as block -1, the
    number of distinct training words of each class. rows are those of `vocabulary`, each block's before its `contexts`."""
    head = next(rows)
    words, c, shape = split_words(head["words"]), spread(head["c"], "<i8"), spread(head["shape"], "<u2")
    unit = np.array([at.get(w, -1) for w in words], np.int64)
    cls = seed[np.where(unit < 0, n_top + shape, unit)]
    wide = 2 * len(table)
    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    kept: list[tuple[int, bytes]] = []

    def merged():
        every = np.concatenate([code, *(x for x, _ in waiting)])
        u, inverse = np.unique(every, return_inverse=True)
        return u, np.bincount(inverse, np.concatenate([n, *(x for _, x in waiting)]), len(u)).astype(np.int64)

    for r in rows:
        if r["idx"] is not None:
            kept.append((r["block"], r["idx"]))
            continue
        word = spread(kept[-1][1], "<i4")[np.cumsum(spread(r["step"], "<u4"))]
        waiting.append((word.astype(np.int64) * wide + spread(r["ctx"], "<u2"), spread(r["times"], "<u4")))
        if sum(len(x) for x, _ in waiting) > 2_000_000 + len(code):
            code, n = merged()
            waiting = []
    code, n = merged()
    who, first = np.unique(code // wide, return_index=True)
    first = np.append(first, len(code))
    for i in range(0, len(who), 2000):
        some, a, b = who[i : i + 2000], first[i], first[min(i + 2000, len(who))]
        vectors = np.zeros((len(some), wide))
        vectors[np.searchsorted(some, code[a:b] // wide), code[a:b] % wide] = n[a:b]
        cls[some] = best_classes(vectors, cls[some], table)
    yield {"bucket": bucket, "block": -1, "distinct": np.bincount(cls[c > 0], minlength=len(table)).tolist()}
    for block, idx in kept:
        i = spread(idx, "<i4")
        yield {"bucket": bucket, "block": block, "cls": squeeze(cls[i].astype(np.uint8)), "c": squeeze(c[i])}


def read_back(rows: Iterator[dict]) -> Iterator[dict]:
    """A block's documents as sequences of classes, from its stored row and the answers of its buckets in order."""
    row = next(rows)
    answers = [(spread(r["cls"], "u1"), spread(r["c"], "<i8")) for r in rows]
    cls, c = (np.concatenate(x) for x in zip(*answers))
    ids, ends = spread(row["ids"], "<i4"), spread(row["ends"], "<i4")
    starts = np.cumsum(ends) - ends
    known = np.add.reduceat((c > 0).astype(np.int64)[ids], starts)
    logs = np.add.reduceat(np.log10(c + 1.0)[ids], starts)
    seq = cls[ids].tobytes()
    train = np.frombuffer(row["train"], bool)
    for k, t, s, m, kn, lg in zip(row["k"], train.tolist(), starts.tolist(), ends.tolist(), known.tolist(), logs.tolist()):
        yield {"k": k, "train": t, "n_tokens": m, "n_known": kn, "log_c": lg, "seq": seq[s : s + m]}


def score(docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id", top_words: int = TOP_WORDS, shapes: int = SHAPES,
          classes: int = CLASSES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score for every row; rows where train holds are learnt from.

    classes is at most 256. The returned rows read one stored table of class sequences; the others are removed.
    Null texts count as empty, very long ones are scored whole; a key named like an added column wins over it (common.keyed).
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n_buckets = max(MIN_BUCKETS, -(-size // bucket_bytes))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    ddl = f"block long, bucket array<int>, words array<binary>, n array<binary>, shape array<binary>, k array<{kind}>, train binary, ends binary, ids binary"
    encoded = common.written(common.map_dicts(rows, lambda batches: encode(batches, n_buckets, shapes, block_bytes), ddl), "encoded")

    def by_bucket(df: DataFrame, *order: str | Column) -> DataFrame:
        return df.repartitionById(min(parts, n_buckets), F.pmod(F.col("bucket"), F.lit(min(parts, n_buckets)))).sortWithinPartitions("bucket", "block", *order)

    # the vocabulary, and its most frequent words
    per_bucket = encoded.select("block", F.explode(F.arrays_zip("bucket", "words", "n", "shape")).alias("x")).select("block", "x.*")
    ddl = "bucket int, block long, idx binary, words binary, c binary, shape binary, total long, distinct long, top array<binary>, top_c array<long>"
    words = common.written(common.map_groups(by_bucket(per_bucket), "bucket", lambda b, rs: vocabulary(b, rs, top_words), ddl), "vocabulary")
    heads = words.where("block = -1")
    most = heads.select(F.explode(F.arrays_zip("top", "top_c")).alias("x")).select("x.*").orderBy(F.desc("top_c"), "top").limit(top_words)
    at = {bytes(r["top"]): r["top_c"] for r in most.collect()}
    if END not in at:
        at = {END: 0, **dict(list(at.items())[: top_words - 1])}
    at, n_top = {w: u for u, w in enumerate(at)}, len(at)
    total, distinct_words = heads.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()

    # classes of the top words and the shapes
    n_units = n_top + shapes
    shared_at = spark.sparkContext.broadcast(at)

    def unit_pairs(batches):
        sums = np.zeros(n_units * n_units, np.int64)
        for r in common.dicts(batches):
            block = Block(r, shared_at.value, n_top)
            sums += np.bincount(block.unit[block.left] * n_units + block.unit[block.right], minlength=n_units * n_units)
        yield from tables(sums.reshape(n_units, n_units))

    in_block = encoded.select("block", "bucket", "words", "shape", "train", "ends", "ids")
    bigrams = added(common.map_dicts(in_block, unit_pairs, "u int, vec binary"), n_units)
    seed = exchange(bigrams, classes, rounds)
    member = np.zeros((n_units, classes))
    member[np.arange(n_units), seed] = 1
    table = member.T @ (bigrams @ member)

    # every other word's class
    def all_contexts(batches):
        for r in common.dicts(batches):
            block = Block(r, shared_at.value, n_top)
            yield from contexts(r, block, seed[block.unit], classes)

    met = common.map_dicts(in_block, all_contexts, "block long, bucket int, step binary, ctx binary, times binary")
    met = words.select("bucket", "block", "idx", "words", "c", "shape").unionByName(met, allowMissingColumns=True)
    moved = common.map_groups(by_bucket(met, F.col("idx").isNull()), "bucket", lambda b, rs: move_words(b, rs, shared_at.value, seed, table, n_top), "bucket int, block long, cls binary, c binary, distinct array<long>")
    answers = common.written(moved, "answers")
    distinct = np.zeros(classes)
    for r in answers.where("block = -1").select(F.posexplode("distinct").alias("cls", "n")).groupBy("cls").agg(F.sum("n").alias("n")).collect():
        distinct[r["cls"]] = r["n"]

    # back to the documents
    back = encoded.select("block", F.lit(-1).alias("bucket"), "k", "train", "ends", "ids").unionByName(answers.where("block >= 0").select("block", "bucket", "cls", "c"), allowMissingColumns=True)
    back = back.repartition(parts, "block").sortWithinPartitions("block", "bucket")
    ddl = f"k {kind}, train boolean, n_tokens long, n_known long, log_c double, seq binary"
    ready = common.written(common.map_groups(back, "block", lambda _, rs: read_back(rs), ddl), "sequences")
    for stored in (encoded, words, answers):
        common.drop_written(stored)

    def class_pairs(batches):
        sums = np.zeros(classes * classes, np.int64)
        for b in batches:
            right = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8)
            sums += np.bincount(np.roll(right, 1).astype(np.int64) * classes + right, minlength=classes * classes)
        yield from tables(sums.reshape(classes, classes))

    table = added(common.map_dicts(ready.where("train").select("seq"), class_pairs, "u int, vec binary"), classes)
    shared = spark.sparkContext.broadcast((table, distinct, total, distinct_words))  # plain arrays: executors need no copy of this package

    def make():
        model = Model(*shared.value)
        step_of = (model.transition - model.class_total).ravel()
        unit = np.log10(model.total + model.vocabulary + 1)

        def step(c):
            m, logs = c["n_tokens"].to_numpy(), c["log_c"].to_numpy()
            i = np.frombuffer(b"".join(c["seq"].to_pylist()), np.uint8).astype(np.int64)
            steps = step_of[np.roll(i, 1) * classes + i]  # END ends each text and precedes the next
            full = np.add.reduceat(steps, np.cumsum(m) - m) if len(m) else np.zeros(0)
            return {"k": c["k"], "n_tokens": m, "n_known": c["n_known"], "train_tokens": np.full(len(m), model.total), "base_score": logs - m * unit, "score": logs + full}

        return step

    ddl = f"k {kind.replace('bigint', 'long')}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return common.keyed(common.map_rows(ready, make, ddl), key)


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = common.is_held(F.col("doc_id"), 7)
    return score(docs, ~held).withColumn("held_out", held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
