"""Registered queries: a DataFrame builder and, where SQL can say the same, the SQL that says it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a data directory, by attribute, and stand-in prediction tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def _preds(self, factor: int) -> DataFrame:
        prob = ((F.col("doc_id") * factor) % 1000) / F.lit(1000.0)
        return self.labels.select(F.col("doc_id").alias("Index"), F.col("quality").alias("Label"), (prob > 0.5).cast("int").alias("Prediction"), prob.alias("Prob"))

    @property
    def pa(self) -> DataFrame:
        return self._preds(7919)

    @property
    def pb(self) -> DataFrame:
        """Another model, that lacks every seventh row."""
        return self._preds(104729).where("Index % 7 <> 0")

    @property
    def pc(self) -> DataFrame:
        return self._preds(15485863).where("Index % 5 <> 0")

    @property
    def review(self) -> DataFrame:
        """A review table: text predictions, some of them invalid."""
        return self.pb.select("Index", F.when(F.col("Index") % 11 == 0, "").otherwise(F.concat(F.lit(" "), F.col("Prediction").cast("string"))).alias("ReviewPrediction"))

    @property
    def big(self) -> DataFrame:
        """A large prediction table without a key."""
        prob = ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 1000) / F.lit(1000.0)
        return self.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("Label"), (prob > 0.5).cast("int").alias("Prediction"), prob.alias("Prob"), F.col("l_linenumber").cast("string").alias("mode"), F.col("l_linestatus").alias("status"))


def _p(name: str, factor: int, where: str = "") -> str:
    prob = f"((doc_id * {factor}) % 1000) / CAST(1000 AS DOUBLE)"
    return f'{name} AS (SELECT doc_id AS "Index", quality AS "Label", CAST({prob} > 0.5 AS INTEGER) AS "Prediction", {prob} AS "Prob" FROM labels {where})'


PA = _p("pa", 7919)
PB = _p("pb", 104729, "WHERE doc_id % 7 <> 0")
PC = _p("pc", 15485863, "WHERE doc_id % 5 <> 0")
REVIEW = PB + """, review AS (SELECT "Index", CASE WHEN "Index" % 11 = 0 THEN '' ELSE ' ' || CAST("Prediction" AS VARCHAR) END AS "ReviewPrediction" FROM pb)"""
_BP = "((l_orderkey * 31 + l_linenumber * 17) % 1000) / CAST(1000 AS DOUBLE)"
BIG = f"""big AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS "Label", CAST({_BP} > 0.5 AS INTEGER) AS "Prediction", {_BP} AS "Prob", CAST(l_linenumber AS VARCHAR) AS mode, l_linestatus AS status FROM lineitem)"""


def div(a: str, b: str) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0), 6)"


def cells_sql(label: str = '"Label"', pred: str = '"Prediction"', prefix: str = "", where: str = "TRUE") -> str:
    c = lambda y, p: f"count(*) FILTER (WHERE {where} AND {label} = {y} AND {pred} = {p})"
    return f"{c(1, 1)} AS {prefix}tp, {c(0, 0)} AS {prefix}tn, {c(0, 1)} AS {prefix}fp, {c(1, 0)} AS {prefix}fn, count(*) FILTER (WHERE {where} AND {label} IN (0, 1) AND {pred} IN (0, 1)) AS {prefix}total"


def rates_sql(p: str = "") -> str:
    return (
        f"{div(f'{p}tp + {p}tn', f'{p}total')} AS {p}accuracy, {div(f'{p}tp', f'{p}tp + {p}fp')} AS {p}precision, {div(f'{p}tp', f'{p}tp + {p}fn')} AS {p}recall, "
        f"{div(f'2 * {p}tp', f'2 * {p}tp + {p}fp + {p}fn')} AS {p}f1, {div(f'{p}fp', f'{p}fp + {p}tn')} AS {p}fpr"
    )


def query(name: str, sql: str | None = None):
    """Registers a builder (of Tables) under a name."""

    def wrap(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return wrap
