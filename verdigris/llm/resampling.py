"""Importance resampling of documents towards a target's word statistics, over a vectorised byte automaton.

Texts stay in their Arrow buffers: a lookup table classifies and lower-cases every byte, word boundaries are
the differences of that mask (and the ends of texts), and CRC registers of all words of a block take one byte
a step together. Runs of words go on from the registers of the runs one word shorter, through a space.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Texts are read in slices of about this many bytes, words in blocks of so many; both bound memory alone.
SLICE_BYTES, BLOCK_WORDS = 4_000_000, 1 << 19
#: Registers step together through so many bytes of a word; the tails of longer words are finished one by one.
STEPS = 64
#: What is added to every bucket's count.
SMOOTHING = 1
DRAW_SPAN = 1 << 32


def byte_classes() -> np.ndarray:
    """Lower-cased bytes of words (digits, letters, everything from 0x80 on), 0 for all others."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    for a, b in ((0x00, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
        table[a:b] = 0
    return table


def crc_table() -> np.ndarray:
    """Of the reflected CRC-32: eight shifts of each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def step(state: np.ndarray, byte: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[(state ^ byte) & 0xFF] ^ (state >> 8)


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The registers after length bytes of data from start each; those of short words drop out first."""
    short = np.minimum(length, STEPS).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]  # longest first: the live ones are a prefix
    alive = len(order) - np.cumsum(np.bincount(short, minlength=STEPS + 1))  # alive[k]: words of over k bytes
    now, at = state[order], start[order]
    for k in range(STEPS):
        n = alive[k]
        if not n:
            break
        now[:n] = step(now[:n], data[at[:n] + k], table)
    out = np.empty_like(state)
    out[order] = now
    for i in np.flatnonzero(length > STEPS):
        out[i] = zlib.crc32(data[start[i] + STEPS : start[i] + length[i]], int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def words(texts: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word lengths, words before each text and after the last) of a string array without nulls."""
    _, offsets, values = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.zeros(0, np.uint8)
    bounds -= bounds[0]
    data = classes[raw]
    inside = data != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = bounds[1:-1]
    at = edge[(edge > 0) & (edge < len(data))]
    begins[at] = inside[at]  # a word never runs on into the next text
    ends[at - 1] = inside[at - 1]
    starts = np.flatnonzero(begins)
    return data, starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(starts, bounds)


def slices(batch: pa.Array) -> Iterator[pa.Array]:
    """Parts of about SLICE_BYTES; a longer text is a part of its own."""
    texts = pc.fill_null(batch, "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SLICE_BYTES, "right")))
        yield texts.slice(a, b - a)
        a = b


class Automaton:
    """Buckets of all runs of 1 to `longest` words of texts."""

    def __init__(self, buckets: int, longest: int):
        self.classes, self.table, self.buckets, self.longest = byte_classes(), crc_table(), buckets, longest

    def runs(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, bucket) of every feature, block by block, and the number of words of each text with the first block."""
        data, starts, lengths, before = words(texts, self.classes)
        text_of = np.repeat(np.arange(len(texts)), np.diff(before))
        last = before[1:][text_of]  # the first word after a word's text
        for a in range(0, max(len(starts), 1), BLOCK_WORDS):
            i = np.arange(a, min(a + BLOCK_WORDS, len(starts)))
            state = np.full(len(i), 0xFFFFFFFF, np.uint32)
            for more in range(self.longest):
                if more:
                    on = i + more < last[i]
                    i, state = i[on], step(state[on], np.uint32(0x20), self.table)
                state = advance(state, data, starts[i + more], lengths[i + more], self.table)
                yield text_of[i], ((state ^ 0xFFFFFFFF) % self.buckets).astype(np.int64)


def bucket_counts(df: DataFrame, text: str, buckets: int, longest: int) -> np.ndarray:
    """Features of each bucket in the whole table: each task adds up its own, one row a bucket and task is shuffled."""
    common.small_batches(df.sparkSession)

    def count(batches):
        reader, sums = Automaton(buckets, longest), np.zeros(buckets, np.int64)
        for b in batches:
            for part in slices(b.column(0)):
                for _, bucket in reader.runs(part):
                    sums += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(sums[met], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in df.select(F.col(text).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]  # a row a bucket at most
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares), a bucket each."""
    n, total, wanted = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float((t + SMOOTHING) * (total + SMOOTHING * n)) / float((s + SMOOTHING) * (wanted + SMOOTHING * n))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(source, target)], np.int64)


def weights(df: DataFrame, text: str, key: str, gain: np.ndarray, longest: int) -> DataFrame:
    """key, n_words, n_features and weight (floored mean of the gains) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def make():
        gain = shared.value
        reader = Automaton(len(gain), longest)

        def run(c):
            got = []
            for part in slices(c["t"]):
                sums, n, ones = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                for k, (text_of, bucket) in enumerate(reader.runs(part)):
                    if len(text_of):
                        first = np.flatnonzero(np.diff(text_of, prepend=-1))  # features stand in the order of texts
                        sums[text_of[first]] += np.add.reduceat(gain[bucket], first)
                        count = np.bincount(text_of, minlength=len(part))
                        n += count
                        ones += count * (k % longest == 0)
                got.append((ones, n, np.where(n > 0, sums // np.maximum(n, 1), 0)))
            ones, n, weight = map(np.concatenate, zip(*got)) if got else [np.zeros(0, np.int64)] * 3
            return {"k": c["k"], "n_words": ones, "n_features": n, "weight": weight}

        return run

    kind = df.schema[key].dataType.simpleString().replace("bigint", "long")
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return common.map_rows(rows, make, f"k {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel variate) drawn by the first 32 bits of sha256(`seed:key`); a null key counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(DRAW_SPAN)))))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str | None = None, buckets: int = 10_000,
             longest: int = 2, least_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """key, n_words, n_features, weight, score and rank of every row of docs; rank is null where a row isn't drawn.

    weight compares the target's smoothed bucket shares with those of docs; the rows of the highest weight plus
    Gumbel noise are a draw without replacement in proportion to exp(weight / 1000). Of the rows with least_words
    words, percent of a hundred (rounded down) are drawn.

    Two passes over the texts; what the driver gets is a row a bucket, and one for each distinct score (whole
    numbers from a range of some 90,000). Ties go to the smaller key (nulls last), then to fewer features and the
    smaller weight; rows equal in all of that (repeated rows) are counted first and numbered as one row with a count, so
    one key may hold any share of the rows. Null and empty texts have no features, weight 0 and are never drawn;
    very long texts are read whole, in blocks; an empty table gives none, an empty target counts 0 in every bucket;
    extra columns are not read, so their names may be anything.
    """
    target_text = target_text or text
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    rows = weights(docs, text, key, gain, longest).withColumn("score", F.col("weight") + noise(F.col("k"), seed))
    rows = common.written(rows, "resampled")
    fit = F.col("n_words") >= least_words
    counts = sorted(rows.where(fit).groupBy("score").count().collect(), reverse=True)
    wanted = sum(n for _, n in counts) * percent // 100
    before, seen, cut = [], 0, None
    for score, n in counts:
        if seen >= wanted:
            break
        before.append((score, seen))
        seen, cut = seen + n, score
    if cut is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).transform(common.keyed, key)

    near = F.coalesce(fit & (F.col("score") >= cut), F.lit(False))
    same = rows.where(near).groupBy("k", "n_words", "n_features", "weight", "score").agg(F.count("*").alias("copies_"))
    starts = F.broadcast(docs.sparkSession.createDataFrame(before, "score long, before_ long"))  # a row a score
    inside = Window.partitionBy("score").orderBy(F.col("k").asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("inside_", F.coalesce(F.sum("copies_").over(inside), F.lit(0))).join(starts, "score")
    ranked = same.withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("copies_")))).withColumn("rank", F.col("before_") + F.col("inside_") + F.col("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = rows.where(~near).withColumn("rank", F.lit(None).cast("long"))
    return rest.unionByName(ranked.select(*rest.columns)).transform(common.keyed, key)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
