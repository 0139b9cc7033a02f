"""Shared pieces of the training-data operators."""

from __future__ import annotations

import base64
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`; bytes.split() uses the same set.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Arrow batches of this many rows bound a Python worker's memory when texts are long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from here on (only ever lowered).

    Batches are made when a frame runs, after its maker has returned, so the setting stays; batches are
    bounded in bytes too, by the session's spark.sql.execution.arrow.maxBytesPerBatch.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo mod."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(mod))


def is_held(key: Column, mod: int) -> Column:
    """Whether a key's fold is 2, the one held out; a null key's is not."""
    return F.coalesce(fold(key, mod) == 2, F.lit(False))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share.

    Where the setting is absent, one machine in local mode (as in tests) uses its temporary folder; a cluster must set it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = f"file://{tempfile.gettempdir()}/verdigris-checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession, "rdd"))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it back; later stages reread files, not lineage.

    options go to the writer; drop_written() removes the files of the returned frame.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def keyed(df: DataFrame, key: str) -> DataFrame:
    """df with its column k named key; an added column of that name gets a trailing underscore."""
    return df.toDF(*[key if c == "k" else f"{c}_" if c == key else c for c in df.columns])


def free_names(names: list[str], taken: list[str]) -> list[str]:
    """names, with trailing underscores while a name is taken (by an earlier one too)."""
    out: list[str] = []
    for n in names:
        while n in taken or n in out:
            n += "_"
        out.append(n)
    return out


def drop_written(df: DataFrame) -> None:
    """Removes what written() stored, once nothing reads it any more."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dicts(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, one at a time; a few megabytes of a batch are turned into Python values at once."""
    for b in batches:
        step = max(1, int(b.num_rows * 4_000_000 / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            for row in zip(*(c.to_pylist() for c in b.slice(i, step).columns)):
                yield dict(zip(b.schema.names, row))


def in_batches(rows: Iterable[dict], schema: pa.Schema, max_bytes: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded length and size; absent fields are null."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in held], f.type) for f in schema], schema=schema)

    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) if isinstance(v, bytes) else 8 * len(v) if isinstance(v, list) else 8 for v in r.values())
        if len(held) >= BATCH_ROWS or size >= max_bytes:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_dicts(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str) -> DataFrame:
    """mapInArrow whose function gives rows as dicts."""
    small_batches(df.sparkSession)
    schema = arrow_schema(ddl)
    return df.mapInArrow(lambda batches: in_batches(make(batches), schema), ddl)


def map_groups(df: DataFrame, key: str, make: Callable[..., Iterator[dict]], ddl: str) -> DataFrame:
    """map_dicts by groups of equal key: make(key, rows). df is partitioned and sorted by key already, and rows
    arrive one by one, so a group need not fit in memory."""

    def run(batches):
        for value, rows in itertools.groupby(dicts(batches), lambda r: r[key]):
            yield from make(value, rows)

    return map_dicts(df, run, ddl)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, **options) -> DataFrame:
    """mapInArrow over column lists: make() runs once a task and returns lists -> lists."""
    small_batches(df.sparkSession)
    out = schema_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            got = step({n: b.column(i) for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema, **options)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<bigint>": pa.list_(pa.int64())}


def schema_of(ddl: str) -> pa.Schema:
    return pa.schema([(n.strip(), _ARROW[t.strip()]) for n, t in (x.strip().rsplit(" ", 1) for x in ddl.split(","))])


def load_ranks(path: str) -> dict[bytes, int]:
    """Pieces of a .tiktoken vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer_path(name: str) -> str:
    """Where the public vocabularies lie; override with the environment variable VERDIGRIS_TOKENIZERS."""
    return os.path.join(os.environ.get("VERDIGRIS_TOKENIZERS", "/opt/tokenizers"), name)
