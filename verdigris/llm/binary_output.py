"""Training-order materialisation of token ids in fixed-stride binary shards.

Texts are tokenised and laid end to end in the order of a column (the key, unless another is named; ties by a
hash of the text), each followed by an end id, and cut into sequences of `length` ids. Sequence number i of N
gets the global slot P(i): P is a keyed Feistel permutation of the next power of four, walked along its cycle
until it falls below N, so it is a bijection of 0..N-1 and needs no sort or table. Shard s holds the slots
[s * per_shard, (s + 1) * per_shard) in order, each of the same number of bytes: a reader finds slot t at byte
(t % per_shard) * stride of shard t // per_shard, and resumes anywhere. With a `window`, sequences are permuted
inside consecutive windows of that many instead, which keeps the proportions of a mixed input in every window.

The result depends on the rows alone: texts are range-partitioned by their order, each task packs its range
into pieces that are written once to the shared folder, the ranges' token totals place the pieces, pieces are
cut at the sequences' bounds, and consecutive slots go to a task, which builds one shard at a time. Neither the
number of cores nor of files changes a byte, and a lost executor repeats only its tasks. Ids take two bytes, or
four if the vocabulary has more than 65,536. Null and empty texts contribute their end id. The last sequence is
padded with the end id (n_tokens has the real count). Repeated rows are packed each; empty tables give no shard.
Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, units

END_ID = 50256
LENGTH = 1024
PER_SHARD = 512
KEY = 0x5EED
ROUNDS = 6
#: Sequences a packed piece holds.
RUN = 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of splitmix64)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def feistel(x: np.ndarray, bits: int, key: int) -> np.ndarray:
    """A permutation of 0..4**bits - 1."""
    b, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> b, x & mask
    for r in range(ROUNDS):
        salt = np.uint64((key * 1_000_003 + r * 7_919) & 0xFFFFFFFFFFFFFFFF)
        left, right = right, left ^ (mixed(right ^ mixed(np.full_like(right, salt))) & mask)
    return (left << b) | right


def slot_of(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The permutation of 0..n-1, by cycle walking."""
    bits = half_bits(n)
    x = feistel(np.asarray(index, np.uint64), bits, key)
    out = x >= np.uint64(n)
    while out.any():
        x[out] = feistel(x[out], bits, key)
        out = x >= np.uint64(n)
    return x.astype(np.int64)


def slots_in_windows(index: np.ndarray, n: int, key: int = KEY, window: int | None = None) -> np.ndarray:
    """Slots of sequences; each window of them is permuted by a key of its own."""
    if not window:
        return slot_of(index, n, key)
    out = np.empty(len(index), np.int64)
    for w in np.unique(index // window).tolist():
        at, first = index // window == w, w * window
        out[at] = first + slot_of(index[at] - first, min(window, n - first), key + w)
    return out


def id_type(ranks: dict[bytes, int], end_id: int) -> str:
    return "<u2" if max(end_id, *ranks.values()) <= 0xFFFF else "<u4"


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, vocabulary: str | None = None, end_id: int = END_ID, order: str | None = None) -> DataFrame:
    """Pieces (part, k, ids, n_tokens, starts, doc_ids) of each range of rows: ids are up to RUN * length little-endian
    numbers as one zstd frame (which a third of the disk and shuffle bytes go without), doc_ids the documents that
    begin in it, at starts."""
    spark = docs.sparkSession
    ranks = units.load(vocabulary)
    pattern, id_kind = units.pattern(), id_type(ranks, end_id)
    shared = spark.sparkContext.broadcast(ranks)
    width = np.dtype(id_kind).itemsize
    stride = width * length * RUN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import zstandard

        part, k = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=1).compress
        encode, code = units.encoder(shared.value, pattern), "H" if width == 2 else "I"
        end = np.array([end_id], id_kind).tobytes()
        held, begun = bytearray(), []  # begun: (byte where it begins, key)

        def piece(a: int, b: int) -> dict:
            here = [x for x in begun if a <= x[0] < b]
            return {"part": part, "k": k, "ids": press(bytes(held[a:b])), "n_tokens": (b - a) // width, "starts": [(x - a) // width for x, _ in here], "doc_ids": [d for _, d in here]}

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                begun.append((len(held), d))
                for stretch in units.stretches(t or ""):
                    held += array(code, encode(stretch)).tobytes()
                held += end
                full = len(held) // stride * stride
                for a in range(0, full, stride):
                    yield piece(a, a + stride)
                    k += 1
                if full:
                    del held[:full]
                    begun = [(a - full, x) for a, x in begun if a >= full]
        if held:
            yield piece(0, len(held))

    kind = docs.schema[key].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(order or key).alias("o"), F.xxhash64(text).alias("tie"))
    ranged = rows.repartitionByRange(parts, "o", "tie").sortWithinPartitions("o", "tie", "k").select("k", "t")
    return common.map_dicts(ranged, run, f"part int, k long, ids binary, n_tokens int, starts array<int>, doc_ids array<{kind}>")


def place(pieces: DataFrame, length: int = LENGTH, id_kind: str = "<u2", key: int = KEY, window: int | None = None) -> tuple[DataFrame, int]:
    """The parts (slot, at, ids, n_tokens, doc_ids) of sequences that stored pieces hold, and the number of sequences."""
    sizes = pieces.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = -(-total // length)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each task that packed, so small enough to broadcast
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    kind = pieces.schema["doc_ids"].dataType.simpleString()
    size = np.dtype(id_kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = list(common.dicts([batch]))
            begins = [r["begin"] + r["k"] * RUN * length for r in rows]
            spans = [(b // length, (b + r["n_tokens"] - 1) // length + 1) for b, r in zip(begins, rows)]
            every = slots_in_windows(np.concatenate([np.arange(a, b) for a, b in spans] or [np.zeros(0, np.int64)]), n, key, window).tolist()
            at = 0
            for r, begin, (first, last) in zip(rows, begins, spans):
                ids = unpress(r["ids"])
                found: list[list] = [[] for _ in range(first, last)]
                for s, d in zip(r["starts"], r["doc_ids"]):
                    found[(begin + s) // length - first].append(d)
                for seq, slot, docs in zip(range(first, last), every[at : at + last - first], found):
                    a, b = max(begin, seq * length), min(begin + r["n_tokens"], (seq + 1) * length)
                    yield {"slot": slot, "at": a % length, "ids": ids[(a - begin) * size : (b - begin) * size], "n_tokens": b - a, "doc_ids": docs}
                at += last - first

    placed = pieces.join(F.broadcast(starts), "part").select("begin", "k", "ids", "n_tokens", "starts", "doc_ids")
    return common.map_dicts(placed, run, f"slot long, at int, ids binary, n_tokens int, doc_ids {kind}"), n


def shards(placed: DataFrame, n: int, per_shard: int = PER_SHARD, length: int = LENGTH, id_kind: str = "<u2", end_id: int = END_ID) -> DataFrame:
    """One row per shard of n sequences: its slots' ids one after the other, each of stride bytes. Ranges of shards go to a task."""
    size = np.dtype(id_kind).itemsize
    end = np.array([end_id], id_kind).tobytes()
    kind = placed.schema["doc_ids"].dataType.simpleString()

    def build(shard: int, rows: Iterator[dict]) -> Iterator[dict]:
        payload, docs, real = bytearray(), [], 0
        slot, fill = shard * per_shard - 1, length
        for r in rows:
            if r["slot"] != slot:
                payload += end * (length - fill)
                slot, fill = slot + 1, 0
            if (r["slot"], r["at"]) != (slot, fill):
                raise ValueError(f"shard {shard} has a gap at slot {slot}")
            payload += r["ids"]
            fill += r["n_tokens"]
            docs += r["doc_ids"]
            real += r["n_tokens"]
        payload += end * (length - fill)
        yield {"shard": shard, "first_slot": shard * per_shard, "n_sequences": slot + 1 - shard * per_shard, "length": length, "stride": length * size, "n_tokens": real, "doc_ids": docs, "payload": bytes(payload)}

    n_shards = max(1, -(-n // per_shard))
    parts = min(n_shards, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = placed.withColumn("shard", F.floor(F.col("slot") / per_shard))
    ranged = keyed.repartitionById(parts, F.floor(F.col("shard") * parts / n_shards).cast("int")).sortWithinPartitions("slot", "at")
    return common.map_groups(ranged, "shard", build, f"shard long, first_slot long, n_sequences int, length int, stride int, n_tokens long, doc_ids {kind}, payload binary")


def materialise(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, per_shard: int = PER_SHARD, order_key: int = KEY,
                vocabulary: str | None = None, window: int | None = None, order: str | None = None, end_id: int = END_ID) -> DataFrame:
    id_kind = id_type(units.load(vocabulary), end_id)
    pieces = common.written(pack(docs, text, key, length, vocabulary, end_id, order), "pieces")
    placed, n = place(pieces, length, id_kind, order_key, window)
    return shards(placed, n, per_shard, length, id_kind, end_id)


def read_slots(store: DataFrame, first: int, n: int, per_shard: int = PER_SHARD) -> Iterator[tuple[int, np.ndarray]]:
    """Slots first..first+n-1 in order, shard by shard: a resumable sequential read."""
    for s in range(first // per_shard, (first + n - 1) // per_shard + 1):
        for r in store.where(F.col("shard") == s).select("first_slot", "length", "stride", "payload").collect():
            ids = np.frombuffer(r["payload"], f"<u{r['stride'] // r['length']}").reshape(-1, r["length"])
            for t in range(max(first, r["first_slot"]), min(first + n, r["first_slot"] + len(ids))):
                yield t, ids[t - r["first_slot"]]


def export_files(store: DataFrame, folder: str) -> DataFrame:
    """Writes each payload to <folder>/shard-<number>.bin and returns the index: shard, path, bytes, first_slot, n_sequences, stride.

    folder is a path or URI (file, hdfs, s3, gs) that every executor reaches by Arrow's file systems. A task writes under a
    name of its own and renames, so a shard is there whole or not at all, and a repeated task leaves the same bytes.
    """

    def run(batches):
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root, recursive=True)
        for pdf in batches:
            paths = []
            for s, data in zip(pdf["shard"], pdf["payload"]):
                path = f"{root.rstrip('/')}/shard-{s:09d}.bin"
                part = f"{path}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(data)
                system.move(part, path)
                paths.append(path)
            yield pdf[["shard"]].assign(path=paths, bytes=pdf["payload"].map(len), first_slot=pdf["first_slot"], n_sequences=pdf["n_sequences"], stride=pdf["stride"])

    rows = store.select("shard", "payload", "first_slot", "n_sequences", "stride")
    return rows.mapInPandas(run, "shard long, path string, bytes long, first_slot long, n_sequences int, stride int")


def op6_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(common.table(spark, sf_dir, "documents"))
