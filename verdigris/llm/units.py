"""Byte-pair tokens of a text by cached white-space units.

The pre-tokenizer pattern splits before any white space that follows a non-space, and a run of white
space keeps only its last character, if a plain space, for the word after it. So a text falls into
units (` word`, `word`, or white space) whose tokens do not depend on their neighbours; a unit met
before costs one dictionary look-up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from . import common

# Unicode White_Space, as the tokenizer's \s has it (Python's own \s also takes \x1c-\x1f).
WS = "\t-\r \x85\xa0  -     　"
FAST = re.compile(r" ?\S+|\n")
RUNS = re.compile(f"[{WS}]+|[^{WS}]+")
#: Where white space follows a non-space, which no token crosses.
BOUNDARY = re.compile(f"(?<=[^{WS}])(?=[{WS}])")
CACHE_UNITS = 400_000
#: Characters of a long text that are turned into a list of ids at once.
STRETCH = 200_000


def split_units(text: str) -> list[str]:
    """The units of a text; joined, they give the text again."""
    if "\n\n" not in text:
        parts = FAST.findall(text)
        if sum(map(len, parts)) == len(text) and "\x1c" not in text:
            return parts
    runs = RUNS.findall(text)
    out: list[str] = []
    lead = ""
    for i, r in enumerate(runs):
        if not re.match(f"[{WS}]", r):
            out.append(lead + r)
            lead = ""
            continue
        if i == len(runs) - 1:
            out.append(r)
            continue
        lead = " " if r[-1] == " " else ""
        rest = r[:-1]
        if rest:
            out.append(rest)
        if not lead:
            out.append(r[-1])
    return out


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """A text in stretches of about `size` characters, whose ids do not depend on each other; joined, they give the text again."""
    a = 0
    while len(text) - a > size and (m := BOUNDARY.search(text, a + size)):
        yield text[a : m.end()]
        a = m.end()
    yield text[a:]


def encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[str], list[int]]:
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


class UnitCache(dict):
    """unit -> the number of its tokens.

    Emptied when full, so a worker's memory is bounded.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = CACHE_UNITS):
        super().__init__()
        self.encode, self.limit = encoder(ranks, pattern), limit

    def __missing__(self, unit: str):
        got = len(self.encode(unit))
        if len(unit) > 256:
            return got  # rare, and large to keep
        if len(self) >= self.limit:
            self.clear()
        self[unit] = got
        return got

    def of(self, us: list[str]) -> list:
        """What the units of a text give, in order."""
        return list(map(self.__getitem__, us))


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load(vocabulary: str | None) -> dict[bytes, int]:
    return common.load_ranks(vocabulary or common.tokenizer_path("byte_bpe_50k.tiktoken"))
