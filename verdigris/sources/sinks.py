"""Sinks: partitioned JSON, fixed-column CSV, union-of-keys tables, keyed upserts, idempotent jobs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_partitions(df: DataFrame, path: str, by: list[str], fmt: str = "json", mode: str = "errorifexists") -> None:
    """K1, K3: one folder per key; an existing target is an error unless the mode says otherwise."""
    df.write.mode(mode).partitionBy(*by).format(fmt).save(path)


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists", sep: str = ",") -> None:
    """K4: the given columns, with a header; white space at the ends of a field stays, also line breaks of either kind."""
    df.select(*columns).write.mode(mode).options(header=True, quoteAll=False, escape='"', sep=sep, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def union_of_keys(frames: list[DataFrame], first: list[str]) -> DataFrame:
    """K5: all rows, all columns: those of `first` in that order, then the others by name."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*[c for c in first if c in out.columns], *sorted(set(out.columns) - set(first)))


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Structs become columns a_b_c; arrays and maps become JSON text; booleans become numbers."""
    out = []

    def walk(path: list[str], t: T.DataType) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk([*path, f.name], f.dataType)
            return
        c = F.col(".".join(f"`{p}`" for p in path))
        if isinstance(t, (T.ArrayType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(t, T.BooleanType):
            c = c.cast("int")
        out.append(c.alias(sep.join(path)))

    for f in df.schema.fields:
        walk([f.name], f.dataType)
    return df.select(*out)


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """K8: the newest row per key of both tables; a row per key leaves each task before the shuffle."""
    both = current.unionByName(changes, allowMissingColumns=True)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), version).alias("r_")).select("r_.*")


def jsonl_to_json(spark: SparkSession, source: str, target: str, schema: str) -> None:
    """K6: JSON lines in, JSON out; a bad line fails the job."""
    spark.read.schema(schema).option("mode", "FAILFAST").json(source).write.json(target)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def once(spark: SparkSession, path: str, job: Callable[[], DataFrame]) -> DataFrame:
    """Runs and writes the job unless its complete output is there; partial output is an error."""
    if exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    if exists(spark, path):
        raise FileExistsError(f"partial output at {path}")
    job().write.parquet(path)
    return spark.read.parquet(path)


def replace_folder(df: DataFrame, path: str) -> None:
    """Writes beside the target, then swaps by renames; the old folder goes last, so a crash leaves one of them whole."""
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(fs_path(old), True)
    if fs.exists(fs_path(path)):
        fs.rename(fs_path(path), fs_path(old))
    if not fs.rename(fs_path(new), fs_path(path)):
        raise OSError(f"cannot rename {new}")
    fs.delete(fs_path(old), True)


class OneFile:
    """A file put together from pieces that tasks wrote, by the file system's streams; it appears under its name once it is whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.fs_path = self.jvm.org.apache.hadoop.fs.Path
        self.target, self.part = self.fs_path(path), self.fs_path(f"{path}.part")
        self.fs = self.target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def __enter__(self):
        self.out = self.fs.create(self.part, True)
        return self

    def text(self, text: str) -> None:
        self.out.write(bytearray(text.encode()))

    def lines(self, df: DataFrame, skip: int = 0) -> int:
        """The one text column of df, a line a row in the order of its partitions, without the first `skip` bytes; the number of rows."""
        pieces = self.fs_path(f"{self.path}.pieces")
        df.write.mode("overwrite").text(pieces.toString())
        for name in sorted(s.getPath().getName() for s in self.fs.listStatus(pieces) if s.getPath().getName().startswith("part-") and s.getLen()):
            source = self.fs.open(self.fs_path(pieces, name))
            source.seek(skip)
            self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, self.out, 1 << 16, False)
            source.close()
            skip = 0
        n = df.sparkSession.read.text(pieces.toString()).count()
        self.fs.delete(pieces, True)
        return n

    def __exit__(self, kind, error, trace) -> None:
        self.out.close()
        if kind:
            self.fs.delete(self.part, False)
            return
        self.fs.delete(self.target, False)
        if not self.fs.rename(self.part, self.target):
            raise OSError(f"cannot write {self.path}")


def write_json_array(df: DataFrame, path: str, order: list[str] | None = None) -> int:
    """K2: one file with an array of all rows, an object a line. Returns the number of rows.

    Tasks write the objects, in ranges of the order, and the file is put together as bytes: neither the driver's Python nor its
    memory sees a row.
    """
    rows = (df.orderBy(*order) if order else df).select(F.concat(F.lit(","), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("value"))
    with OneFile(df.sparkSession, path) as file:
        file.text("[\n")
        n = file.lines(rows, skip=1)  # the first object has no comma before it
        file.text("]\n")
    return n


def write_report(tables: dict[str, DataFrame], folder: str, title: str = "report") -> None:
    """K7: every table as CSV and JSON in a folder of its own, and all of them, tab-separated below their names, as one text.

    A table's rows keep the order of its partitions; null values are empty in the text.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
        df.write.mode("overwrite").json(f"{folder}/{name}.json")
    with OneFile(next(iter(tables.values())).sparkSession, f"{folder}/{title}.txt") as file:
        file.text(f"{title}\n")
        for name, df in tables.items():
            file.text("\n" + name + "\n" + "\t".join(df.columns) + "\n")
            file.lines(df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value")))


def lines_with_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """K6: JSON lines with the file and 1-based line of each row; the text of a line that does not parse is in `corrupt`.

    Lines are numbered inside each split, which the sizes of the splits before it shift, so no file is read by one task.
    """
    split = ["file", "block"]
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    sizes = raw.groupBy(*split).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    starts = sizes.select(*split, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    parsed = F.from_json("value", f"{schema}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    rows = raw.join(starts, split).where(F.trim("value") != "")
    return rows.select("file", (F.col("start") + F.col("id") - F.col("first") + 1).alias("line"), parsed.alias("x")).select("file", "line", "x.*")


def convert_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """K6: the rows of JSON lines files; a line that does not parse fails the job, naming file and line."""
    rows = lines_with_errors(spark, path, schema)
    message = F.concat(F.col("file"), F.lit(" line "), F.col("line").cast("string"), F.lit(" is not valid: "), F.substring("corrupt", 1, 80))
    guard = F.when(F.col("corrupt").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return rows.where(guard).drop("file", "line", "corrupt")
