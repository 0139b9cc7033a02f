"""Secret scans: base patterns plus a token-efficiency test.

Random strings cost a byte-pair vocabulary many tokens: a run of base64-like characters with few
characters per token is reported as kind `random`, unless it is a known digest (hex of 32, 40, 56,
64, 96 or 128 digits), a UUID, a run without letters, an identifier (at least half of it parts that are
cheap in tokens themselves: words, digit groups between separators). Base spans are cut out of a run first, and
what they leave is judged by itself.

Null texts are scanned as empty. Empty texts have no spans; very long ones are scanned whole. Offsets are code points, end
exclusive. Repeated rows are scanned alike, empty tables give empty results, extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The base patterns. Letters of the keywords match in either ASCII case only.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(rf"""({"|".join(map(_either, KEYWORDS))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

LEAST_RUN = 20
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Letters-only parts and short numbers, joined by separators or case: names, paths, versions, dates.
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost, non-overlapping per kind; failing matches consume their text."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def is_known(run: str) -> bool:
    """Digests, UUIDs and runs without letters (numbers, dates, rules), which are not secrets by themselves."""
    if DIGEST.fullmatch(run):
        return len(run) in DIGEST_LENGTHS or run.isdigit()
    return bool(UUID.fullmatch(run)) or not re.search("[A-Za-z]", run)


def is_identifier(run: str, count_tokens, max_ratio: float) -> bool:
    """Whether at least half of the letters and digits lie in parts that are cheap in tokens themselves."""
    cheap = 0
    for m in PARTS.finditer(run):
        part, around = m[0], run[max(m.start() - 1, 0) : m.start()] + run[m.end() : m.end() + 1]
        if part.isdigit():
            cheap += len(part) * (not any(map(str.isalnum, around)))
        elif len(part) >= 4 and len(part) > max_ratio * count_tokens(part):
            cheap += len(part)
    return 2 * cheap >= sum(map(str.isalnum, run))


def outside(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the taken intervals (sorted, disjoint) leave of start..end."""
    left = []
    for a, b in taken:
        if start < a:
            left.append((start, min(a, end)))
        start = max(start, b)
    return [*left, (start, end)] if start < end else left


def random_spans(text: str, count_tokens, max_ratio: float, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Random parts of text outside the base spans; a run beside or around a base span is judged by what is left of it."""
    merged: list[tuple[int, int]] = []
    for a, b, _ in sorted(taken):
        merged[-1:] = [(merged[-1][0], max(merged[-1][1], b))] if merged and a <= merged[-1][1] else [*merged[-1:], (a, b)]
    ends = [b for _, b in merged]
    out = []
    for m in RUN.finditer(text):
        near = []
        for a, b in merged[bisect_right(ends, m.start()) :]:
            if a >= m.end():
                break
            near.append((a, b))
        for s, e in outside(*m.span(), near):
            part = text[s:e]
            if e - s >= LEAST_RUN and not is_known(part) and (e - s) <= max_ratio * count_tokens(part) and not is_identifier(part, count_tokens, max_ratio):
                out.append((s, e, "random"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return ",".join(f"{k}:{s}:{e}" for s, e, k in ordered)


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", max_ratio: float = 2.0,
                 vocabulary: str | None = None) -> DataFrame:
    """One row per document: key, base counts, base_spans, spans (`kind:start:end`, comma-joined).

    One pass over whole texts, no shuffle. vocabulary: a .tiktoken file, read by the driver and
    shipped with the task (a fixed 50k pieces); max_ratio: characters a token, at or below which a
    run counts as random.
    """
    spark = docs.sparkSession
    import public_tokenizers

    pattern = public_tokenizers.PATTERN
    ranks = spark.sparkContext.broadcast(common.load_ranks(vocabulary or common.tokenizer_path("byte_bpe_50k.tiktoken")))

    def make():
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})

        def count(s: str) -> int:
            return len(enc.encode_ordinary(s))

        def step(c):
            base, every = [], []
            for t in c["t"].to_pylist():
                b = base_spans(t or "")
                base.append(b)
                every.append(b + random_spans(t or "", count, max_ratio, b))
            kinds = [[k for _, _, k in b] for b in base]
            return {"k": c["k"], "base_spans": [joined(b) for b in base], "spans": [joined(b) for b in every]} | {f"n_{k}": [x.count(k) for x in kinds] for k in KINDS[:3]}

        return step

    kind = docs.schema[key].dataType.simpleString().replace("bigint", "long")
    schema = f"k {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string"
    return common.map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), make, schema).transform(common.keyed, key)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan_secrets(common.table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans")
