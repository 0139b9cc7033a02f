"""Pandas UDFs that are made when first used, so modules import without a session."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F


def arrow_udf(ddl: str):
    def wrap(f):
        @wraps(f)
        def call(*columns):
            return F.pandas_udf(f, ddl)(*columns)

        return call

    return wrap
