"""Readers: JSON arrays, JSON lines, CSV, TSV and the sample-set layouts, each to one explicit schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import rank_by_number
from . import splits

SAMPLE = "index long, code string, label int"


def read_json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One array of objects per file; a malformed file fails the job. Files beyond a split are read in parallel."""
    most = discover(spark, path if isinstance(path, list) else [path], "*").agg(F.max("length")).first()[0] or 0
    if most > _split_bytes(spark):
        return splits.scan_json_array(spark, path, schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """S3: an object a line; blank lines are skipped; splits at line bounds, so files of any size read in parallel."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_like(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Arrays, single objects and lines, told apart file by file; empty files give no rows.

    A file is of lines where its first line that is not blank is a whole object: a pretty-printed object or array is not.
    """
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    at = F.struct(block.alias("block"), F.monotonically_increasing_id().alias("id"))
    heads = spark.read.text(path).select(file.alias("file"), at.alias("at"), F.trim("value").alias("line")).where("line <> ''").groupBy("file").agg(F.min_by("line", "at").alias("line"))
    whole = F.col("line").startswith("{") & F.expr("try_parse_json(line)").isNotNull()
    kinds: dict[bool, list[str]] = {True: [], False: []}
    for r in heads.select("file", whole.alias("whole")).toLocalIterator():  # a row per file, as a file listing
        kinds[r["whole"]].append(r["file"])
    out = [read(spark, kinds[k], schema) for k, read in ((True, read_json_lines), (False, read_json_array)) if kinds[k]]
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """Header, all strings, quoted fields may hold separators and line breaks; blank fields are null.

    Spark's multi-line reader takes a task a file, so it reads files no longer than a split; longer ones are read in parallel.
    """
    most = discover(spark, path if isinstance(path, list) else [path], "*").agg(F.max("length")).first()[0] or 0
    if most > _split_bytes(spark):
        return splits.read_csv_splits(spark, path, sep, columns)
    df = spark.read.options(header=True, multiLine=True, escape='"', sep=sep, inferSchema=False).csv(path)
    return df.select(*columns) if columns else df


def _split_bytes(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def discover(spark: SparkSession, roots: list[str], pattern: str) -> DataFrame:
    """File names below the roots that match a glob, with size and time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(roots)
    return files.select("path", "length", "modificationTime")


FILE_NAME = r"^(.*?)_(\d+-\d+)_(train|validate|test)\.json$"


def file_parts(name: Column) -> dict[str, Column]:
    """Dataset, length bucket and split of a file name; null where it has another form."""
    ok = name.rlike(FILE_NAME)
    return {n: F.when(ok, F.regexp_extract(name, FILE_NAME, i)) for i, n in ((1, "dataset"), (2, "bucket"), (3, "split"))}


def complete_groups(files: DataFrame) -> DataFrame:
    """Files of the (dataset, bucket) groups that have all three splits."""
    p = files.select("*", *[c.alias(n) for n, c in file_parts(F.col("name")).items()]).where("dataset is not null")
    full = p.groupBy("dataset", "bucket").agg(F.count_distinct("split").alias("n")).where("n = 3")
    return p.join(full.drop("n"), ["dataset", "bucket"], "left_semi")


def path_parts(path: Column, root: str) -> dict[str, Column]:
    """Relative path, folder, depth, top folder and experiment folder below a root."""
    rel = F.regexp_replace(path, f"^.*?{root}/", "")
    parts = F.split(rel, "/")
    return {
        "relative": rel,
        "folder": F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"),
        "depth": F.size(parts) - 1,
        "top": F.element_at(parts, 1),
        "file": F.element_at(parts, -1),
    }


# ---- sample sets ----------------------------------------------------------------------------


def devign(df: DataFrame, order: str) -> DataFrame:
    """Func, target -> code, label; a dense index in input order; other columns stay."""
    out = df.withColumnsRenamed({"func": "code", "target": "label"})
    return rank_by_number(out, [], order).withColumn("index", F.col("rank_") - 1).drop("rank_", "size_")


def reveal(vulnerable: DataFrame, clean: DataFrame, order: str) -> DataFrame:
    """Two tables, one label each; one index over both, with the source kept."""
    both = vulnerable.select(F.col(order).alias("o_"), "code", F.lit(1).alias("label"), F.lit(0).alias("s_")).unionByName(clean.select(F.col(order).alias("o_"), "code", F.lit(0).alias("label"), F.lit(1).alias("s_")))
    counted = rank_by_number(both, ["s_"], "o_")
    n = vulnerable.agg(F.count("*").alias("n_"))
    idx = F.col("rank_") - 1 + F.when(F.col("s_") == 1, F.col("n_")).otherwise(0)
    return counted.crossJoin(F.broadcast(n)).select(idx.alias("index"), "code", "label", F.when(F.col("s_") == 0, "vulnerable").otherwise("clean").alias("source_file"))


def bigvul(df: DataFrame, samples: str = "samples") -> DataFrame:
    """A map keyed by "0", "1", ... of structs to rows; empty line, cwe and cve become null."""
    r = df.select(F.explode(samples).alias("k_", "x_"))
    blank = lambda c: F.nullif(F.col(f"x_.{c}"), F.lit("")).alias(c)
    return r.select(F.col("k_").cast("long").alias("index"), F.col("x_.code").alias("code"), blank("line"), F.col("x_.vul").cast("int").alias("label"), blank("cwe"), blank("cve"))


def diversevul(df: DataFrame) -> DataFrame:
    """Drops message; cwe is always an array, null where it is empty."""
    cwe = F.filter("cwe", lambda x: x.isNotNull() & (x != ""))
    return df.drop("message").withColumn("cwe", F.when(F.size(cwe) > 0, cwe))


def draper(df: DataFrame, flags: list[str], source: str = "functionSource") -> DataFrame:
    """Parallel arrays to rows; set flags to a cwe array; label = any flag."""
    rows = df.select(F.posexplode(F.arrays_zip(F.col(source).alias("code"), *[F.col(f"`{f}`") for f in flags])).alias("index", "x_"))
    cwe = F.filter(F.array(*[F.when(F.col("x_").getField(f), F.lit(f)) for f in flags]), lambda v: v.isNotNull())
    return rows.select(F.col("index").cast("long"), F.col("x_.code").alias("code"), F.when(F.size(cwe) > 0, cwe).alias("cwe"), (F.size(cwe) > 0).cast("int").alias("label"))


def d2a_records(raw: DataFrame, value: str = "value") -> DataFrame:
    """The columns that d2a() takes from raw nested records, a JSON object a row.

    The key of the function is that of the first trace entry of the bug's file and procedure, its code that of the first
    entry of `functions` (an object of objects, in the order of its keys' text) of that file and name. Records
    without either come out with nulls, which d2a() drops, as it does those of the after-fix extractor. Variant values
    hold the records, so nothing of their many other fields needs a schema.
    """
    text = lambda c, path: F.try_variant_get(c, path, "string")
    r = raw.select(F.monotonically_increasing_id().alias("row_"), F.try_parse_json(value).alias("r_"))
    file, name = text(F.col("r_"), "$.bug_info.file"), text(F.col("r_"), "$.bug_info.procedure")
    head = r.select(
        "row_", "r_", text(F.col("r_"), "$.label_source").alias("label_source"), F.try_variant_get("r_", "$.label", "int").alias("label"), text(F.col("r_"), "$.bug_type").alias("bug_type"),
        text(F.col("r_"), "$.project").alias("project"), F.try_variant_get("r_", "$.bug_info.line", "int").alias("bug_line"), file.alias("file_"), name.alias("name_"),
    )
    entry = "struct<file:string,func_name:string,func_key:string>"
    traces = F.try_variant_get("r_", "$.trace", f"array<{entry}>")
    functions = F.map_values(F.try_variant_get("r_", "$.functions", "map<string,struct<file:string,name:string,code:string>>"))

    def first(entries: Column, kind: str, field: str) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: (e["file"] == F.col("file_")) & (e[kind] == F.col("name_"))), F.lit(1))[field]

    found = head.withColumn("func_key", first(traces, "func_name", "func_key")).withColumn("code", first(functions, "name", "code"))
    return found.withColumn("location", F.col("func_key")).drop("row_", "r_", "file_", "name_")


def d2a(df: DataFrame) -> DataFrame:
    """Bug records to one row per function, with its distinct bug lines.

    Columns: label_source, label, bug_line, func_key, location, code. Records of the after-fix extractor
    and records without a start line or code are dropped.
    """
    from ..functions.exprs import start_line

    r = df.where("label_source <> 'after_fix_extractor'").withColumn("s_", start_line("location")).where("s_ is not null and code is not null and func_key is not null")
    at = F.col("bug_line") - F.col("s_") + 1
    lines = F.split("code", "\n")
    line = F.when((at >= 1) & (at <= F.size(lines)), F.try_element_at(lines, at))
    return r.withColumn("l_", line).groupBy("func_key").agg(F.max("label").alias("label"), F.min("code").alias("code"), F.array_sort(F.collect_set("l_")).alias("lines"))


def mvuld(df: DataFrame) -> DataFrame:
    """Split names to ours; the fields must be there; instruction rows come out."""
    need = {"code", "label", "index", "split"} - set(df.columns)
    if need:
        raise ValueError(f"missing columns: {sorted(need)}")
    m = F.create_map(*[F.lit(x) for kv in (("train", "train"), ("valid", "validate"), ("test", "test")) for x in kv])
    return df.withColumn("split", F.try_element_at(m, F.col("split")))


def to_instructions(df: DataFrame, instruction: str, code: str = "code", label: str = "label", index: str = "index") -> DataFrame:
    """Instruction, input, output ("0" or "1"), index."""
    return df.select(F.lit(instruction).alias("instruction"), F.col(code).alias("input"), F.col(label).cast("string").alias("output"), F.col(index).cast("long").alias("index"))


def instruction_set(parts: list[DataFrame], instruction: str, **columns: str) -> DataFrame:
    """The instruction rows of several inputs, one after the other."""
    return reduce(DataFrame.unionByName, [to_instructions(p, instruction, **columns) for p in parts])


def normalize_predictions(df: DataFrame) -> DataFrame:
    """Any producer's results as Index, Label, Prediction, Prob, CWE; a column is found in any case, and the first of its spellings wins."""
    from ..functions.exprs import lenient_float, lenient_int

    have = {}
    for c in df.columns:
        have.setdefault(c.lower(), c)

    def pick(*names: str) -> Column:
        got = [F.col(have[n.lower()]) for n in names if n.lower() in have]
        return F.coalesce(*got) if got else F.lit(None).cast("string")

    return df.select(
        lenient_int(pick("Index")).cast("long").alias("Index"), lenient_int(pick("Label")).alias("Label"),
        lenient_int(pick("Prediction", "FinalPrediction", "OriginalPrediction", "ReviewerPrediction")).alias("Prediction"),
        lenient_float(pick("prob", "OriginalProb", "ReviewerProb")).alias("Prob"),
        F.nullif(pick("CWE").cast("string"), F.lit("")).alias("CWE"),
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Matrices as Parquet of (key, array<float>); row alignment is an explicit key."""
    return spark.read.parquet(path)


def read_named(spark: SparkSession, roots: list[str], names: set[str]) -> DataFrame:
    """The files below the roots whose name is in the set; a missing root is left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def found(root: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(root)
        return bool(path.getFileSystem(conf).globStatus(path))  # None or empty where there is nothing

    there = [r for r in roots if found(r)]
    if not there:
        return spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    return discover(spark, there, "*").where(F.element_at(F.split("path", "/"), -1).isin(*names))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8, batch: int = 5000) -> DataFrame:
    """A table of an SQLite file, read by row-id ranges, each by a task of its own through a read-only connection.

    The file lies where all executors see it. Rows travel in batches, so a range need not fit in memory.
    """
    import sqlite3

    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    quoted = ", ".join('"' + c.replace('"', '""') + '"' for c in columns)
    name = '"' + table.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {name}").fetchone()
    if low is None:
        return spark.createDataFrame([], schema)
    step = -(-(high - low + 1) // parts)

    def scan(batches):
        import pandas as pd

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for b in batches:
                for a in b["id"]:
                    rows = db.execute(f"SELECT {quoted} FROM {name} WHERE rowid >= ? AND rowid < ?", (low + a * step, low + (a + 1) * step))
                    while part := rows.fetchmany(batch):
                        yield pd.DataFrame(part, columns=columns)

    return spark.range(0, parts, 1, parts).mapInPandas(scan, schema)


def read_npy(spark: SparkSession, path: str, rows: int = 4096) -> DataFrame:
    """A matrix of an .npy file as (row, vector); tasks map the file and read their rows only."""
    import numpy as np

    n = len(np.load(path, mmap_mode="r", allow_pickle=False))

    def scan(batches):
        import pandas as pd

        matrix = np.load(path, mmap_mode="r", allow_pickle=False)
        for b in batches:
            for i in b["id"]:
                part = np.asarray(matrix[i * rows : (i + 1) * rows], np.float32)
                yield pd.DataFrame({"row": np.arange(i * rows, i * rows + len(part)), "vector": list(part)})

    return spark.range(0, -(-n // rows)).mapInPandas(scan, "row long, vector array<float>")


def read_hdf5(spark: SparkSession, path: str, columns: list[str], schema: str) -> DataFrame:
    """Equally long data sets of an HDF5 file as columns; needs h5py, which is no dependency."""
    try:
        import h5py
    except ImportError as e:
        raise NotImplementedError("reading HDF5 needs h5py; convert the file to Parquet first") from e
    with h5py.File(path, "r") as f:
        data = {c: [x.decode() if isinstance(x, bytes) else x.item() if hasattr(x, "item") else x for x in f[c][()]] for c in columns}
    return spark.createDataFrame(list(zip(*data.values())), schema)


def ingest(spark: SparkSession, content: bytes, name: str, folder: str, overwrite: bool = False) -> str:
    """Stores an uploaded file under a folder and returns its path; a path in the name, an unknown kind or a file in the way is an error."""
    import os

    if not name or name != os.path.basename(name) or name.startswith(".") or "\\" in name:
        raise ValueError(f"not a plain file name: {name!r}")
    kind = name.rpartition(".")[2].lower()
    if kind not in ("json", "jsonl", "csv"):
        raise ValueError(f"not a data file: {name!r}")
    text = content.decode("utf-8").lstrip()
    if kind != "csv" and text[:1] not in ("[", "{"):
        raise ValueError(f"no JSON in {name!r}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder, name)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not overwrite:
        raise FileExistsError(str(target))
    out = fs.create(target, overwrite)
    out.write(bytearray(content))
    out.close()
    return target.toString()
