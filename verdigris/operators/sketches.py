"""Joins with key lists too large to broadcast: a Bloom sketch of the keys goes to the tasks that scan the large side.

Rows whose key the sketch lacks are certain not to be in the list, so they never enter the shuffle; the exact join
that follows takes the others. The sketch's bits are set by one aggregation and bounded by MOST_BITS.
"""

from __future__ import annotations

from math import exp, log

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.lazy import arrow_udf

#: Bits for each key (a false positive rate of about 1 %), hashes a key, and bits of a sketch at most (32 MB).
BITS_A_KEY, HASHES, MOST_BITS = 10, 7, 1 << 28
#: A sketch that lets more than this share of strangers through is not worth its scan.
USEFUL = 0.5


class Sketch:
    """Bits of a key list, on the driver and broadcast to tasks."""

    def __init__(self, keys: DataFrame, key: str | list[str], bits_a_key: int = BITS_A_KEY, most_bits: int = MOST_BITS):
        self.key = [key] if isinstance(key, str) else list(key)
        self.spark = keys.sparkSession
        rows = keys.dropna(subset=self.key).select(*self.key).distinct()
        self.n = rows.count()
        self.bits = min(max(64, 1 << (self.n * bits_a_key - 1).bit_length() if self.n else 64), most_bits)
        self.hashes = max(1, min(HASHES, round(self.bits / max(self.n, 1) * log(2))))
        self.rate = (1 - exp(-self.hashes * self.n / self.bits)) ** self.hashes
        self._broadcast = None
        if self.rate <= USEFUL:
            words = rows.select(F.explode(F.array(*self._places())).alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b"))
            self._broadcast = self.spark.sparkContext.broadcast(self._filled(words.toPandas()))  # at most MOST_BITS / 64 rows

    def _pair(self) -> tuple[Column, Column]:
        """Two hashes of a key, of 31 bits, the second odd."""
        low = F.lit((1 << 31) - 1)
        return F.xxhash64(*self.key).bitwiseAND(low), F.xxhash64(*self.key, F.lit(1)).bitwiseAND(low).bitwiseOR(F.lit(1))

    def _places(self) -> list[Column]:
        """The bits of a key: multiples of one hash beside another, modulo a power of two."""
        a, b = self._pair()
        return [(a + F.lit(i).cast("long") * b).bitwiseAND(F.lit(self.bits - 1)) for i in range(self.hashes)]

    def _filled(self, words: pd.DataFrame):
        import numpy as np

        out = np.zeros(self.bits // 64, np.int64)
        out[words["w"].to_numpy()] = words["b"].to_numpy()
        return out

    def may_hold(self) -> Column:
        """False for rows whose key is certain not to be in the list (a null key is in none)."""
        known = F.lit(True)
        for k in self.key:
            known = known & F.col(k).isNotNull()
        if self._broadcast is None:
            return known
        shared, bits, hashes = self._broadcast, self.bits, self.hashes

        def test(a: pd.Series, b: pd.Series) -> pd.Series:
            import numpy as np

            words, x, y = shared.value, a.to_numpy(np.int64), b.to_numpy(np.int64)
            found = np.ones(len(x), bool)
            for i in range(hashes):
                p = (x + i * y) & (bits - 1)
                found &= (words[p >> 6] >> (p & 63)) & 1 == 1
            return pd.Series(found)

        return known & arrow_udf("boolean")(test)(*self._pair())


def _counted(df: DataFrame, seen: Observation | None) -> DataFrame:
    """df, whose rows an observation counts as they go into the shuffle."""
    return df if seen is None else df.observe(seen, F.count(F.lit(1)).alias("shuffled"))


def semi(df: DataFrame, keys: DataFrame, key: str | list[str], seen: Observation | None = None) -> DataFrame:
    """rows whose key is in the list; `seen` gets the number of rows that enter the join."""
    sketch = Sketch(keys, key)
    return _counted(df.where(sketch.may_hold()), seen).join(keys.select(*sketch.key).distinct(), sketch.key, "left_semi")


def anti(df: DataFrame, keys: DataFrame, key: str | list[str], seen: Observation | None = None) -> DataFrame:
    """Rows whose key isn't in the list; those the sketch lacks stay where they are."""
    sketch = Sketch(keys, key)
    marked = df.withColumn("may_", sketch.may_hold())
    rest = _counted(marked.where("may_").drop("may_"), seen).join(keys.select(*sketch.key).distinct(), sketch.key, "left_anti")
    return marked.where("not may_").drop("may_").unionByName(rest.select(*df.columns))


def flagged(df: DataFrame, keys: DataFrame, key: str | list[str], name: str, seen: Observation | None = None) -> DataFrame:
    """Every row, with whether its key is in the list."""
    sketch = Sketch(keys, key)
    marked = df.withColumn("may_", sketch.may_hold())
    hit = keys.select(*sketch.key).distinct().withColumn(name, F.lit(True))
    rest = _counted(marked.where("may_").drop("may_"), seen).join(hit, sketch.key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return marked.where("not may_").drop("may_").withColumn(name, F.lit(False)).unionByName(rest.select(*df.columns, name))
