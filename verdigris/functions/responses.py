"""Reviewer replies and code text that need a scanner: Arrow UDFs over whole columns."""

from __future__ import annotations

import json
import re

import pandas as pd

from .lazy import arrow_udf
from .syntax import LITERAL_OR_COMMENT

# Fixed value: a JSON object in a fence.
_FENCED_JSON = re.compile(r"```json\s*(\{.*?\})\s*```", re.S | re.I)


def json_candidates(text: str | None) -> list[str]:
    """The texts of fenced JSON objects first, then of every object that decodes from any `{`, nested ones too."""
    text = text or ""
    found = [m[1] for m in _FENCED_JSON.finditer(text)]
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            found.append(text[at : decoder.raw_decode(text, at)[1]])
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return found


def decodes(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


@arrow_udf("string")
def final_response(texts: pd.Series) -> pd.Series:
    """The last JSON object of a reply, or the whole reply where it has none."""
    return texts.map(lambda t: next((c.strip() for c in reversed(json_candidates((t or "").strip())) if decodes(c)), (t or "").strip()))


@arrow_udf("array<string>")
def extract_json(texts: pd.Series) -> pd.Series:
    return texts.map(json_candidates)


@arrow_udf("string")
def response_text(bodies: pd.Series) -> pd.Series:
    """The message of a chat completion; content parts are joined, reasoning parts are left out."""

    def one(body: str | None) -> str | None:
        try:
            content = json.loads(body or "")["choices"][0]["message"]["content"]
        except (ValueError, KeyError, IndexError, TypeError):
            return None
        if isinstance(content, str):
            return content.strip()
        if isinstance(content, list):
            return "\n".join(p["text"] for p in content if isinstance(p, dict) and p.get("type") != "reasoning" and isinstance(p.get("text"), str)).strip()
        return None

    return bodies.map(one)


@arrow_udf("string")
def strip_code_comments(codes: pd.Series) -> pd.Series:
    """T8 for C-like languages: comments become a space, literals stay, blank lines go."""

    def one(code: str | None) -> str | None:
        if code is None:
            return None
        out = LITERAL_OR_COMMENT.sub(lambda m: " " if m[0][0] == "/" else m[0], code)
        return "\n".join(x for x in out.split("\n") if x.strip())

    return codes.map(one)


def _without_docstrings(code: str) -> str:
    """Python source without comments and docstrings; broken source stays."""
    import io
    import tokenize

    out, row, col, before = [], 1, 0, tokenize.INDENT
    try:
        for kind, text, (r0, c0), (r1, c1), _ in tokenize.generate_tokens(io.StringIO(code).readline):
            if r0 > row:
                col = 0
            out.append(" " * (c0 - col) if c0 > col else "")
            doc = kind == tokenize.STRING and before in (tokenize.INDENT, tokenize.NEWLINE, tokenize.NL, tokenize.DEDENT)
            if kind != tokenize.COMMENT and not doc:
                out.append(text)
            before = before if kind in (tokenize.COMMENT, tokenize.NL) else kind
            row, col = r1, c1
    except (tokenize.TokenError, SyntaxError):
        return code
    return "".join(out)


@arrow_udf("string")
def strip_python_comments(codes: pd.Series) -> pd.Series:
    """T8 for Python: comments and docstrings go, and so do lines left blank."""
    return codes.map(lambda c: None if c is None else "\n".join(x for x in _without_docstrings(c).split("\n") if x.strip()))


def token_length(text, ranks: dict[bytes, int] | None = None, pattern: str | None = None):
    """The number of byte-pair tokens under a vocabulary (its ranks and splitting pattern); T1 without one."""
    from collections.abc import Iterator

    from pyspark.sql import functions as F

    from .exprs import approx_tokens

    if not ranks or not pattern:
        return approx_tokens(text)

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for texts in parts:
            yield texts.map(lambda t: len(encode(t or ""))).astype("int32")

    count.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "int")(text)


def code_tokens(code: str | None) -> list[str]:
    """T5: words split at case changes, numbers and operators; block and statement marks are dropped."""
    text = re.sub(r"(?s)/\*.*?\*/|//[^\n]*", "", code or "")
    out: list[str] = []
    for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|[^\sA-Za-z0-9_]", text):
        if w in "{};:":
            continue
        out += [p.lower() for p in re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", w).split("_") if p] if re.match(r"[A-Za-z_]", w) else [w]
    return out


@arrow_udf("array<string>")
def tokenize_code(codes: pd.Series) -> pd.Series:
    return codes.map(code_tokens)


_KEYWORDS = {"if", "else", "for", "while", "do", "switch", "case", "return", "break", "continue", "goto", "sizeof", "default", "struct", "union", "enum", "typedef", "const", "static", "extern", "register", "volatile", "unsigned", "signed", "int", "char", "float", "double", "void", "long", "short", "inline", "null", "true", "false"}


@arrow_udf("string")
def symbolic_code(codes: pd.Series) -> pd.Series:
    """Functions become FUNC1.., other names VAR1.., literals STRING and NUMBER; keywords stay."""

    def one(code: str | None) -> str:
        names: dict[str, str] = {}
        n = {"FUNC": 0, "VAR": 0}
        out = []
        toks = re.findall(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|[A-Za-z_]\w*|\d+(?:\.\d+)?|\S', re.sub(r"(?s)/\*.*?\*/|//[^\n]*", "", code or ""))
        for i, t in enumerate(toks):
            if t[0] in "\"'":
                out.append("STRING")
            elif t[0].isdigit():
                out.append("NUMBER")
            elif re.match(r"[A-Za-z_]", t) and t.lower() not in _KEYWORDS:
                kind = "FUNC" if toks[i + 1 : i + 2] == ["("] else "VAR"
                if t not in names:
                    n[kind] += 1
                    names[t] = f"{kind}{n[kind]}"
                out.append(names[t])
            else:
                out.append(t)
        return " ".join(out)

    return codes.map(one)


@arrow_udf("array<int>")
def solid_prefix(texts: pd.Series) -> pd.Series:
    """For each character, how many solid ones (not ASCII white space) come up to and with it."""
    import numpy as np

    return texts.map(lambda t: None if t is None else np.cumsum([c not in " \t\n\r\x0b\x0c" for c in t], dtype=np.int32))
