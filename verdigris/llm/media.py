"""Media columns kept as content-defined chunks: stored once each, joined back by ordered lists.

A payload (a text's bytes, padded) is held as 8-bit samples of a mono WAV file: header and samples. A rolling gear hash
cuts the samples where their content says so, so a change moves the cuts next to it alone. The store has one row a
distinct chunk (digest and compressed bytes); a media row has its header and the ordered digests. Reading back joins
digests to chunks, puts the file together, verifies its digest and computes features from its samples.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a chunk: at least, on average beyond that, at most.
LEAST, MEAN, MOST = 2048, 8192, 32_768
#: The gear hash of a position depends on so many bytes up to it.
WINDOW = 32
#: Payloads of a run (media that are put together side by side) hold about this many bytes.
RUN_BYTES = 1 << 20
#: A chunk wanted by one in so many (chunk, run) pairs is sent to all tasks: at most so many chunks of MOST bytes.
HOT = 1000
#: Chunks that the compression dictionary is trained on, its bytes, and digests that a task remembers as sent.
DICTIONARY_CHUNKS, DICTIONARY_BYTES, SEEN = 1000, 112_640, 1 << 18
#: Of the compression.
LEVEL = 9
#: Bytes of chunks in a bucket of the store, at most about.
BUCKET_BYTES = 1 << 28
HEADER = "<4sI4s4sIHHIIHH4sI"
HEADER_BYTES = struct.calcsize(HEADER)
RATE = 8000


def gear() -> np.ndarray:
    """A fixed 32-bit number for each byte, from a hash of the byte."""
    return np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), "<u4")


def cuts(payload: bytes, table: np.ndarray) -> list[int]:
    """Ends of a payload's chunks.

    The hash of position i is the sum of table[byte i - k] << k for k below WINDOW, made for all positions in five
    doublings; chunks end where its top bits are zero, but not before LEAST and no later than MOST bytes.
    """
    data = np.frombuffer(payload, np.uint8)
    ends: list[int] = []
    begin, n = 0, len(data)
    step = 1 << 22  # positions hashed at once, with the bytes before them
    marks: list[np.ndarray] = []
    for a in range(0, n, step):
        h = table[data[max(a - WINDOW + 1, 0) : a + step]]
        reach = 1
        while reach < WINDOW:
            further = h.copy()
            further[reach:] += h[:-reach] << np.uint32(reach)
            h, reach = further, 2 * reach
        h = h[min(a, WINDOW - 1) :]
        marks.append(np.flatnonzero(h < np.uint32((1 << 32) // MEAN)) + a + 1)
    at = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    while begin < n:
        i = int(np.searchsorted(at, begin + LEAST))
        end = min(int(at[i]) if i < len(at) else n, begin + MOST, n)
        ends.append(end)
        begin = end
    return ends


def chunks(payload: bytes, table: np.ndarray) -> Iterator[bytes]:
    begin = 0
    for end in cuts(payload, table):
        yield payload[begin:end]
        begin = end


def padded(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % 64 or 64 * (not data))


def header(n: int) -> bytes:
    """Of a mono WAV file with n unsigned 8-bit samples; lengths beyond 32 bits are written as the format's largest."""
    most = (1 << 32) - 1
    return struct.pack(HEADER, b"RIFF", min(n + HEADER_BYTES - 8, most), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", min(n, most))


def samples(media: bytes) -> bytes:
    """The samples of a mono 8-bit WAV file, by its header's length."""
    riff, _, wave, _, _, coding, channels, _, _, _, bits, data, n = struct.unpack_from(HEADER, media)
    if (riff, wave, data, coding, channels, bits) != (b"RIFF", b"WAVE", b"data", 1, 1, 8):
        raise ValueError("not a mono 8-bit WAV file")
    return media[HEADER_BYTES :] if n == (1 << 32) - 1 else media[HEADER_BYTES : HEADER_BYTES + n]


def feature(payload: bytes) -> str:
    """Samples, their sum, sum of squares around the middle, and sign changes around it: whole numbers, colon-joined."""
    x = np.frombuffer(payload, np.uint8)
    total = square = changes = 0
    for a in range(0, len(x), 1 << 20):
        part = x[a : a + (1 << 20) + 1].astype(np.int64) - 128  # one more, for the change to the next part
        changes += int(np.count_nonzero(np.diff(part < 0)))
        part = part[: 1 << 20]
        total += int(part.sum())
        square += int((part * part).sum())
    return f"pcm8:{len(x)}:{total}:{square}:{changes}"


@dataclass
class Stored:
    """media: run, k, n_bytes, payload_bytes, media_sha256, first, digests, parts; chunks: digest, data (compressed).

    A run numbers its chunks from 0 as it meets them: a row's digests are those it meets first, from number `first` on,
    and parts are the numbers of all its chunks in order.
    """

    media: DataFrame
    chunks: DataFrame
    dictionary: bytes
    key: str
    table: str = ""

    def drop(self) -> None:
        """Removes the lists and this store's own chunks."""
        for df in (self.media, self.chunks):
            common.drop_written(df)
        self.chunks.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def packer(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False) if dictionary else zstandard.ZstdCompressor(level=LEVEL)


def unpacker(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def cut_chunks(docs: DataFrame, text: str, pack: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """digest, data of the chunks of every text; a task sends a chunk again only once it has met SEEN others."""

    def run(batches):
        table, send, seen = gear(), pack(), set()
        for r in common.dicts(batches):
            for c in chunks(padded(r["t"]), table):
                d = hashlib.sha256(c).digest()
                if d not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(d)
                    yield {"digest": d, "data": send(c)}

    return common.map_dicts(docs.select(F.col(text).cast("string").alias("t")), run, "digest binary, data binary")


def train_dictionary(docs: DataFrame, text: str) -> bytes:
    """A compression dictionary from the first DICTIONARY_CHUNKS chunks met; it changes no result, only the store's size."""
    import zstandard

    got = [bytes(r["data"]) for r in cut_chunks(docs, text, lambda: lambda c: c).limit(DICTIONARY_CHUNKS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, got).as_bytes()
    except zstandard.ZstdError:  # too few chunks
        return b""


def ingest(docs: DataFrame, text: str = "text", key: str = "doc_id", earlier: Stored | None = None) -> Stored:
    """Cuts every text's payload and stores what is new.

    earlier: a store whose chunks are not stored again (a left anti join on digests); the new one's chunks then
    hold both. Two passes over the texts: lists of digests first, then the bytes of new chunks, one row a digest.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()

    def lists(batches):
        from pyspark import TaskContext

        table, run, size = gear(), TaskContext.get().partitionId() << 33, 0
        numbers: dict[bytes, int] = {}
        for r in common.dicts(batches):
            payload = padded(r["t"])
            if size >= RUN_BYTES:
                run, size = run + 1, 0
                numbers.clear()
            size += len(payload)
            whole = hashlib.sha256(header(len(payload)))
            whole.update(payload)
            first, parts = len(numbers), [numbers.setdefault(hashlib.sha256(c).digest(), len(numbers)) for c in chunks(payload, table)]
            n_bytes = len((r["t"] or "").encode("utf-8", "surrogatepass"))
            yield {"run": run, "k": r["k"], "n_bytes": n_bytes, "payload_bytes": len(payload), "media_sha256": whole.digest(), "first": first, "digests": list(itertools.islice(numbers, first, None)), "parts": parts}

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    media = common.written(common.map_dicts(rows, lists, f"run long, k {kind}, n_bytes long, payload_bytes long, media_sha256 binary, first int, digests array<binary>, parts array<int>"), "media")
    dictionary = earlier.dictionary if earlier else train_dictionary(docs, text)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(media.agg(F.sum("payload_bytes")).first()[0] or 0) // BUCKET_BYTES))
    table, path = f"chunks_{uuid.uuid4().hex}", common.shared_dir(spark, "chunks")
    store_chunks(docs, text, dictionary, earlier, table, path, buckets)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # the driver's cleaner now drops the files of the shuffle that the store was written from
    fresh = spark.table(table)
    stored = fresh if earlier is None else earlier.chunks.unionByName(fresh)
    stored.stored_at = path
    return Stored(media, stored, dictionary, key, table)


def store_chunks(docs: DataFrame, text: str, dictionary: bytes, earlier: Stored | None, table: str, path: str, buckets: int) -> None:
    """Writes the chunks that aren't stored yet, bucketed by digest, so that joins on it don't shuffle them again."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)
    cut = cut_chunks(docs, text, lambda: packer(shared.value).compress)
    if earlier:
        cut = cut.join(earlier.chunks.select("digest"), "digest", "left_anti")
    one = cut.groupBy("digest").agg(F.first("data").alias("data"))
    one.write.format("parquet").bucketBy(buckets, "digest").options(path=path, compression="zstd").saveAsTable(table)


def read_back(stored: Stored, compute: Callable[[bytes], dict], ddl: str) -> DataFrame:
    """key, n_bytes, payload_bytes and what compute(media file) gives for each row, verified against its digest.

    Each run asks once for each of its chunks, which an equi-join brings there. A chunk that more than one in HOT of all
    (chunk, run) pairs asks for isn't joined but sent to every task: there are at most HOT of them, of MOST bytes.
    A run's chunks come first and its rows one by one, in the order they were numbered, so a task holds RUN_BYTES, or one
    larger payload, at a time.
    """
    spark = stored.media.sparkSession
    wanted = stored.media.select("run", "first", F.posexplode("digests").alias("pos", "digest")).select("run", (F.col("first") + F.col("pos")).alias("part"), "digest")
    total = stored.media.agg(F.sum(F.size("digests"))).first()[0] or 0
    name = F.xxhash64("digest")
    hot = wanted.groupBy(name.alias("name")).count().where((F.col("count") * HOT > total) & (F.col("count") > 8)).select("name")
    hot = spark.createDataFrame(hot.collect(), hot.schema)  # HOT rows at most
    near = {bytes(r["digest"]): bytes(r["data"]) for r in stored.chunks.join(F.broadcast(hot), name == F.col("name")).select("digest", "data").collect()}
    shared = spark.sparkContext.broadcast((stored.dictionary, near))
    rest = wanted.join(F.broadcast(hot), name == F.col("name"), "left_anti")
    moved = stored.chunks.join(rest, "digest").select("run", "part", "data")
    # a row needs its run's digests only where they name chunks that all tasks have
    known = F.transform("digests", lambda d: F.when(d.isin(*[F.lit(x) for x in near]), d)) if near else F.lit(None).cast("array<binary>")
    rows = moved.unionByName(stored.media.withColumn("digests", F.when(F.exists(known, lambda d: d.isNotNull()), known)), allowMissingColumns=True)
    rows = rows.repartition("run").sortWithinPartitions("run", F.col("part").isNull(), "first")

    def run(_, rs):
        dictionary, near = shared.value
        unpack, met, known = unpacker(dictionary).decompress, {}, {}
        for r in rs:
            if r["part"] is not None:
                met[r["part"]] = r["data"]
                continue
            for i, d in enumerate(r["digests"] or []):
                if d is not None:
                    met[r["first"] + i] = near[d]
            if r["media_sha256"] not in known:
                media = bytearray(header(r["payload_bytes"]))
                for i in r["parts"]:
                    media += unpack(met[i], max_output_size=MOST)
                media = bytes(media)
                if hashlib.sha256(media).digest() != r["media_sha256"]:
                    raise ValueError(f"media {r['media_sha256'].hex()} differs from what was stored")
                known[r["media_sha256"]] = compute(media)
            yield {"k": r["k"], "n_bytes": r["n_bytes"], "payload_bytes": r["payload_bytes"], **known[r["media_sha256"]]}

    kind = stored.media.schema["k"].dataType.simpleString()
    return common.map_groups(rows, "run", run, f"k {kind}, n_bytes long, payload_bytes long, {ddl}").transform(common.keyed, stored.key)


def digests(media: bytes) -> dict:
    """What the stored samples and the file itself come to."""
    payload = samples(media)
    return {
        "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(payload),
    }


def store_and_verify(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row, read back from the store.

    A null text counts as empty, an empty one as 64 zero bytes; very long texts are cut in steps and put together one at a
    time; repeated rows and copies share all chunks and each gives a row, null keys too; an empty table gives
    none; extra columns are not read, so their names may be anything.
    """
    stored = ingest(docs, text, key)
    return read_back(stored, digests, "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op13_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_verify(common.table(spark, sf_dir, "documents"))
