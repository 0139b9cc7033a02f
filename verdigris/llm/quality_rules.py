"""Quality rules as a short-circuit cascade.

Each rule reads a few text features. A bounded sample gives every rule's cost (seconds, with the
features it shares) and its selectivity; rules then run in the order of rejections per cost, and a
document leaves the cascade at the first rule that rejects it. The verdict is a conjunction, so the
order changes the cost alone, never the rows kept.

Null and empty texts have no words and are rejected by the length rule. Repeated rows and ties are
judged one by one; extra columns pass through the operator untouched. Empty tables stay empty, very long texts are judged whole.
"""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"


class TextFeatures:
    """Features of one text, each computed at most once and only when asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, common.SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(common.SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that the text holds twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(windows) == len(set(windows)):
            return 0
        counts = Counter(windows)
        covered, upto = 0, 0
        for i, x in enumerate(windows):
            if counts[x] > 1:
                covered += i + 3 - max(i, upto)
                upto = i + 3
        return covered

    @cached_property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def capitals(self) -> int:
        return sum(map(str.isupper, self.text))


@dataclass(frozen=True)
class Rule:
    """reject(features) -> True when the document fails."""

    name: str
    needs: tuple[str, ...]
    threshold: float

    def rejects(self, f: TextFeatures) -> bool:
        return REJECT[self.name](f, self.threshold)


REJECT = {
    "few_words": lambda f, t: f.n_words < t,
    "repeated_windows": lambda f, t: 100 * f.n_repeat_words > t * f.n_words,
    "symbols": lambda f, t: 100 * f.n_symbols > t * f.n_words,
    "repeated_lines": lambda f, t: 100 * f.n_dup_lines > t * len(f.lines),
    "short_words": lambda f, t: 10 * f.word_chars < t * f.n_words,
    "long_words": lambda f, t: 10 * f.word_chars > t * f.n_words,
    "capitals": lambda f, t: 100 * f.capitals > t * f.letters,
}

RULES = (
    Rule("few_words", ("n_words",), 50),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), 50),
    Rule("symbols", ("n_symbols", "n_words"), 10),
    Rule("repeated_lines", ("n_dup_lines", "lines"), 50),
    Rule("short_words", ("word_chars", "n_words"), 20),
    Rule("long_words", ("word_chars", "n_words"), 150),
    Rule("capitals", ("capitals", "letters"), 60),
)
BASE_RULES = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class RuleStats:
    name: str
    cost: float
    selectivity: float
    rank: float


def order_rules(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[RuleStats]:
    """Greedy order by rejections per second over a sample of texts.

    After a rule is placed, the rest are measured anew on the survivors, with what the placed rules
    have already computed free of charge: cost and selectivity are conditional, as in the cascade.
    """
    alive = [TextFeatures(t) for t in texts]
    left, placed = list(rules), []
    done: set[str] = set()
    while left:
        stats = []
        for r in left:
            fresh = [TextFeatures(f.text) for f in alive]
            for f in fresh:
                for n in done:
                    getattr(f, n)
            t0 = time.perf_counter()
            hits = sum(map(r.rejects, fresh))
            cost = (time.perf_counter() - t0) / max(1, len(fresh)) + 1e-9
            sel = hits / max(1, len(fresh))
            stats.append((RuleStats(r.name, cost, sel, sel / cost), r))
        # ties and rules without a rejection: cheapest first, then by name
        best, rule = min(stats, key=lambda s: (-s[0].rank, s[0].cost, s[0].name))
        placed.append(best)
        left.remove(rule)
        done |= set(rule.needs) | ({"words"} if "n_words" in rule.needs else set())
        alive = [f for f in alive if not rule.rejects(f)]
    return placed


def sample_texts(docs: DataFrame, text: str, sample_rows: int, sample_chars: int) -> list[str | None]:
    """At most sample_rows whole texts of at most sample_chars each (which bounds the driver), drawn by hash.

    The sample steers the order of the rules and nothing else.
    """
    n = docs.count()
    if not n:
        return []
    share = min(1.0, 1.5 * sample_rows / n)
    pick = docs.where(F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    return [r[0] for r in pick.where(F.coalesce(F.length(F.col(text)), F.lit(0)) <= sample_chars).select(text).limit(sample_rows).collect()]


def quality_cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 300,
                    sample_chars: int = 100_000, with_features: bool = False, key: str = "doc_id") -> DataFrame:
    """Adds `failed_rule` (the first of the cascade that rejects) and `kept` (all rules passed).

    docs' own columns stay as they are; where it has one of these names, the added one gets a trailing underscore. An
    empty table gives an empty one, very long texts are judged whole, repeated rows alike.

    with_features instead returns the key, the features of the base contract and the verdict, for
    every document: one pass over the texts, no shuffle.
    """
    spark = docs.sparkSession
    by_name = {r.name: r for r in rules}
    order = tuple(by_name[s.name] for s in order_rules(sample_texts(docs, text, sample_rows, sample_chars), rules))
    common.small_batches(spark)

    def verdict(f: TextFeatures) -> str | None:
        return next((r.name for r in order if r.rejects(f)), None)

    if with_features:
        def make():
            def step(c):
                fs = [TextFeatures(t) for t in c["t"].to_pylist()]
                failed = [verdict(f) for f in fs]
                out = {n: [getattr(f, n) for f in fs] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
                base = [any(by_name[n].rejects(f) for n in BASE_RULES if n in by_name) for f in fs]
                return out | {"k": c["k"], "base_failed": base, "kept": [x is None for x in failed]}
            return step

        kind = docs.schema[key].dataType.simpleString().replace("bigint", "long")
        schema = f"k {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
        return common.map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), make, schema).transform(common.keyed, key)

    @F.pandas_udf("string")
    def failed_rule(texts):
        return texts.map(lambda t: verdict(TextFeatures(t)))

    rule, kept = common.free_names(["failed_rule", "kept"], docs.columns)
    return docs.withColumn(rule, failed_rule(F.col(text))).withColumn(kept, F.col(rule).isNull())


def passing(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs that no rule rejects, columns as they are."""
    judged = quality_cascade(docs.select(F.col(text).alias("t"), F.struct(*docs.columns).alias("row")), "t", **options)
    return judged.where("kept").select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(common.table(spark, sf_dir, "documents"), with_features=True)


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents),
win AS (
  SELECT row_number() OVER () AS rid, *,
         list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g
  FROM d),
u AS (SELECT rid, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM win),
c AS (SELECT rid, x, i, count(*) OVER (PARTITION BY rid, x) AS n FROM u),
p AS (SELECT rid, count(DISTINCT pos) AS n_rep
      FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM c WHERE n > 1) GROUP BY rid),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words,
         len(ln) AS n_lines,
         length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters,
         length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS capitals
  FROM win LEFT JOIN p USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR 10 * word_chars < 20 * n_words
            OR 10 * word_chars > 150 * n_words OR 100 * capitals > 60 * letters) AS kept
FROM f
"""
