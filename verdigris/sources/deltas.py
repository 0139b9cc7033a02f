"""Keyed tables as a base and deltas: an upsert writes its own rows, readers merge, compaction folds.

Rows lie in folders of data files, bucketed by a hash of the key. A version is a small manifest that names the layers
(folder, bucket, age) which make up the table; it comes into being by one rename, so a writer that dies leaves
the last version as it was and files that no manifest names. Reading takes the newest row of each key over a bucket's
layers; buckets of one layer are read as they lie. Compaction merges the buckets with many layers, old versions are dropped with
the folders that only they name. One writer at a time; a second one's commit of the same version fails.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

BUCKETS = 16
#: Layers of a bucket beyond which compact() merges it, and versions that expire() keeps.
LAYERS, KEPT = 4, 2


class KeyedTable:
    """The newest row of every key, by a version column; of equal versions the one that was upserted last."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, version: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.version, self.buckets = spark, path.rstrip("/"), key, version, buckets
        self.schema = spark.createDataFrame([], schema).schema

    # ---- manifests

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._names(f"{self.path}/versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """{"number", "batch" (the last one upserted), "layers": [[folder, bucket, age], ...]}."""
        have = self.versions()
        if not have and version is None:
            return {"number": -1, "batch": None, "layers": []}
        p, fs = self._fs(f"{self.path}/versions/{have[-1] if version is None else version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, before: dict, batch, layers: list[list]) -> dict:
        made = {"number": before["number"] + 1, "batch": batch, "layers": layers}
        target = f"{self.path}/versions/{made['number']:012d}.json"
        part, fs = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        to, _ = self._fs(target)
        if fs.exists(to) or not fs.rename(part, to):
            fs.delete(part, False)
            raise FileExistsError(f"another writer has made version {made['number']} of {self.path}")
        return made

    # ---- data

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, number: int) -> list[list]:
        """Writes rows (with age_) to a new folder; its layers."""
        folder = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("bucket_", self._bucket()).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/data/{folder}")
        return [[folder, int(n.split("=")[1]), number] for n in self._names(f"{self.path}/data/{folder}") if n.startswith("bucket_=")]

    def _newest(self, rows: DataFrame) -> DataFrame:
        """A row a key, with the age of its layer; each task hands on one a key."""
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), F.struct(self.version, "age_")).alias("r_")).select("r_.*")

    def _read(self, layers: list[list]) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("age_", LongType())])
        folders = [f"{self.path}/data/{f}/bucket_={b}" for f, b, _ in layers]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, changes: DataFrame, batch: int | None = None) -> dict:
        """Adds a layer of the changes' newest rows; a batch that was committed before changes nothing.

        Rows of a null key count as one key. What is written is as large as the changes.
        """
        now = self.manifest()
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return now
        rows = changes.select(*self.schema.names).withColumn("age_", F.lit(now["number"] + 1).cast("long"))
        layers = self._write(self._newest(rows), now["number"] + 1)
        return self._commit(now, now["batch"] if batch is None else batch, now["layers"] + layers)

    def read(self, version: int | None = None) -> DataFrame:
        """The table, or one of its kept versions."""
        layers, many = self.manifest(version)["layers"], {}
        for layer in layers:
            many.setdefault(layer[1], []).append(layer)
        parts = [self._read([x for of in many.values() if len(of) == 1 for x in of]), self._newest(self._read([x for of in many.values() if len(of) > 1 for x in of]))]
        return reduce(DataFrame.unionByName, parts).select(*self.schema.names)

    def compact(self, layers: int = LAYERS) -> dict:
        """Merges the buckets of more than `layers` layers into one layer each; the others stay as they lie."""
        now, many = self.manifest(), {}
        for layer in now["layers"]:
            many.setdefault(layer[1], []).append(layer)
        full = {b for b, of in many.items() if len(of) > layers}
        if not full:
            return now
        made = self._write(self._newest(self._read([x for b in full for x in many[b]])), now["number"] + 1)
        return self._commit(now, now["batch"], [x for x in now["layers"] if x[1] not in full] + made)

    def expire(self, keep: int = KEPT) -> None:
        """Drops all but the newest versions, and the files that none of them names (those of dead writers too)."""
        have = self.versions()
        named = {f for v in have[-keep:] for f, _, _ in self.manifest(v)["layers"]}
        for v in have[:-keep]:
            p, fs = self._fs(f"{self.path}/versions/{v:012d}.json")
            fs.delete(p, False)
        for folder in self._names(f"{self.path}/data"):
            if folder not in named:
                p, fs = self._fs(f"{self.path}/data/{folder}")
                fs.delete(p, True)
