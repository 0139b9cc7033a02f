"""Reviewers as injected clients: prompts go out in batches per task, with retries; nothing calls a network by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from .merge import resume
from .similarity import most_similar_by_tokens

REPLIES = "key long, reply string, attempts int, error string"


class HttpError(Exception):
    """What a client raises for a refused call."""

    def __init__(self, status: int, detail: str = ""):
        super().__init__(f"HTTP {status}: {detail}" if detail else f"HTTP {status}")
        self.status = status


def retryable(e: Exception) -> bool:
    """M4: too many calls, server errors and lost connections are tried again, other refusals are not."""
    return not isinstance(e, HttpError) or e.status == 429 or not 400 <= e.status < 500


def ask(client: Callable[[str], str], prompt: str, retries: int, wait: float) -> tuple[str | None, int, str | None]:
    """The reply, the calls it took, and the last error."""
    import time

    for n in range(1, retries + 2):
        try:
            return client(prompt), n, None
        except Exception as e:  # the client is foreign code; its failure is a row's result, not the job's
            error = f"{type(e).__name__}: {e}"
            if n > retries or not retryable(e):
                return None, n, error
            time.sleep(wait * n)
    raise AssertionError


def judge(df: DataFrame, make_client: Callable[[], Callable[[str], str]], prompt: str = "prompt", key: str = "Index", retries: int = 3, wait: float = 1.0, done: DataFrame | None = None) -> DataFrame:
    """M4, M6: a row per input with its reply, the parsed label and how it was found, or the error.

    make_client runs once a task (M9: a model or session is made once and serves all its rows). done, earlier
    results with `label`, leaves out what has one already.
    """
    todo = df if done is None else resume(df, done, key, F.col("label").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for pdf in batches:
            client = client or make_client()
            got = [ask(client, p or "", retries, wait) for p in pdf["p"]]
            yield pd.DataFrame({"key": pdf["key"], "reply": [r for r, _, _ in got], "attempts": [n for _, n, _ in got], "error": [e for _, _, e in got]})

    replies = todo.select(F.col(key).cast("long").alias("key"), F.col(prompt).alias("p")).mapInPandas(run, REPLIES)
    label, how = E.binary_label("reply")
    status = F.when(F.col("error").isNotNull(), F.concat(F.lit("error:"), F.col("error"))).otherwise(F.coalesce("how", F.lit("unparsed")))
    out = replies.select(F.col("key").alias(key), "reply", "attempts", "error", label.cast("int").alias("label"), how.alias("how"))
    return out.select(key, "reply", "attempts", "label", status.alias("status"))


def with_examples(df: DataFrame, bank: DataFrame, template: str, key: str = "Index", text: str = "input", bank_key: str = "Index", bank_text: str = "input", answer: str = "Label", given: DataFrame | None = None) -> DataFrame:
    """M5: df plus `prompt`: the template filled with the nearest example of the bank (never the row itself) and its answer."""
    near = most_similar_by_tokens(df, bank, key, text, bank_key, bank_text, exclude_same=True, given=given)
    shown = bank.select(F.col(bank_key).alias("neighbor"), F.col(bank_text).alias("example_"), F.col(answer).cast("string").alias("answer_")).dropDuplicates(["neighbor"])
    found = near.select(key, "neighbor").join(shown, "neighbor", "left")
    prompt: Column = E.prompt(template, {"example": "example_", "answer": "answer_", "code": text})
    return df.join(found, key, "left").withColumn("prompt", prompt).drop("example_", "answer_")
