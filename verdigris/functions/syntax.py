"""Structure of source text: nested blocks, chunks of whole blocks, and where values flow.

Python source is read by its own parser. Other languages are read by a scanner that knows literals, comments,
brackets and statement ends: a statement ends at `;` or with its block, and a block's statements are its children.
Every tree covers its text without gaps, so chunks laid end to end give the text again.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

import pandas as pd

from .lazy import arrow_udf

# Fixed value: literals and comments of C-like languages, an open one up to the end.
LITERAL_OR_COMMENT = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?""", re.S)
#: Blocks beyond this depth belong to the statement around them.
DEPTH = 100
_SPACE = frozenset(" \t\n\r\x0b\x0c")


@dataclass
class Node:
    """A stretch [start, end) of the text; children lie in it in order."""

    start: int
    end: int
    children: list[Node] = field(default_factory=list)


def bracket_tree(text: str) -> Node:
    """Statements and blocks of a C-like text, as deep as they nest."""
    root = Node(0, len(text))
    open_blocks: list[Node] = [root]  # the blocks around the present place
    begun = [0]  # where the present statement of each began
    i, round_depth, deep = 0, 0, 0
    while i < len(text):
        c = text[i]
        if c in "/\"'`" and (m := LITERAL_OR_COMMENT.match(text, i)):
            i = m.end()
            continue
        if c in "([":
            round_depth += 1
        elif c in ")]":
            round_depth = max(0, round_depth - 1)
        elif c == "{" and len(open_blocks) > DEPTH:
            deep += 1
        elif c == "}" and deep:
            deep -= 1
        elif c == "{":
            statement = Node(begun[-1], len(text))
            open_blocks[-1].children.append(statement)
            open_blocks.append(statement)
            begun.append(i + 1)
            round_depth = 0
        elif c == "}" and len(open_blocks) > 1:
            if text[begun[-1] : i].strip():
                open_blocks[-1].children.append(Node(begun[-1], i))
            begun.pop()
            done = open_blocks.pop()
            done.end = begun[-1] = i + 1
            round_depth = 0
        elif c == ";" and not round_depth:
            open_blocks[-1].children.append(Node(begun[-1], i + 1))
            begun[-1] = i + 1
        i += 1
    if text[begun[-1] :].strip():
        open_blocks[-1].children.append(Node(begun[-1], len(text)))
    return root


def python_tree(text: str) -> Node | None:
    """Statements of Python source, decorators with what they decorate; None if it does not parse."""
    try:
        parsed = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    at = [0]
    for line in text.split("\n"):
        at.append(at[-1] + len(line) + 1)

    def node(x: ast.stmt) -> Node:
        first = min([x.lineno, *(d.lineno for d in getattr(x, "decorator_list", []))])
        inner = [c for part in ("body", "handlers", "orelse", "finalbody") for c in getattr(x, part, []) if hasattr(c, "lineno")]
        return Node(at[first - 1], min(len(text), at[x.end_lineno]), [node(c) for c in sorted(inner, key=lambda c: c.lineno)])

    root = Node(0, len(text))
    for x in parsed.body:
        n = node(x)
        if root.children and n.start < root.children[-1].end:  # statements on one line
            root.children[-1].end = max(root.children[-1].end, n.end)
            root.children[-1].children = []
        else:
            root.children.append(n)
    return root


def cover(node: Node) -> list[Node]:
    """The children with what lies between them, each stretch given to the child after it, the rest to the last."""
    kids = [c for c in node.children if c.end > node.start and c.start < node.end]
    out, at = [], node.start
    for c in kids:
        if c.end <= at:
            continue
        out.append(Node(at, c.end, c.children))
        at = c.end
    if at < node.end and out:
        out.append(Node(at, node.end)) if node.end - at > 1 else setattr(out[-1], "end", node.end)
    return out


def solid(text: str) -> int:
    return sum(c not in _SPACE for c in text)


def windows(text: str, node: Node, limit: int) -> list[tuple[int, int]]:
    """Stretches of whole blocks of at most `limit` solid characters, in order and without gaps.

    Neighbours fill a window as long as they fit; a block beyond the limit is entered, and its first and last
    windows do not join what is around it; a block without children is cut between lines, a longer line stays whole.
    """
    if solid(text[node.start : node.end]) <= limit:
        return [(node.start, node.end)]
    parts = cover(node)
    if len(parts) == 1 and parts[0].start == node.start and parts[0].end == node.end:
        parts = cover(parts[0])
    if not parts:
        cuts = [node.start, *(node.start + m.end() for m in re.finditer("\n", text[node.start : node.end])), node.end]
        parts = [Node(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
    out: list[tuple[int, int]] = []
    size = 0  # of the last window, while it may grow
    for p in parts:
        n = solid(text[p.start : p.end])
        if n > limit and (p.children or "\n" in text[p.start : p.end - 1]) and (p.start, p.end) != (node.start, node.end):
            out += windows(text, p, limit)
            size = limit + 1
        elif out and size + n <= limit:
            out[-1] = (out[-1][0], p.end)
            size += n
        else:
            out.append((p.start, p.end))
            size = n
    return joined(text, out, limit)


def joined(text: str, spans: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Neighbours that fit together become one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and solid(text[out[-1][0] : b]) <= limit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def chunks(text: str | None, limit: int, language: str | None = None) -> list[tuple[str, int, int, str]]:
    """(text, first line, last line, source) of chunks; source is `ast:<language>`, or `blocks` where no parser reads it."""
    if not text or not text.strip():
        return []
    tree = python_tree(text) if language == "python" else None
    how = "ast:python" if tree else "blocks"
    out = []
    for a, b in windows(text, tree or bracket_tree(text), limit):
        lead = len(text[a:b]) - len(text[a:b].lstrip("\n"))
        first = text.count("\n", 0, a + lead) + 1
        body = text[a:b].strip("\n")
        if body.strip():
            out.append((body, first, first + body.count("\n"), how))
    return out


# ---- where values flow ----------------------------------------------------------------------

_WORD = re.compile(r"[A-Za-z_]\w*")
# Words that are no variables.
_RESERVED = set("if else for while do switch case return break continue goto sizeof default struct union enum typedef const static extern register volatile unsigned signed int char float double void long short inline bool new delete this null true false try catch throw class public private protected auto var let function import from in of not and or".split())
_ASSIGN = re.compile(r"(?<![=!<>+\-*/%&|^])([+\-*/%&|^]|<<|>>)?=(?!=)")


def variables(text: str) -> list[tuple[int, str]]:
    """(offset, name) of the variables of a text, in order: words that are no keyword, call, member or literal."""
    blank = re.sub(r"(?m)^[ \t]*#[^\n]*", lambda m: " " * len(m[0]), LITERAL_OR_COMMENT.sub(lambda m: " " * len(m[0]), text))
    out = []
    for m in _WORD.finditer(blank):
        before, after = blank[: m.start()].rstrip(), blank[m.end() :].lstrip()
        if m[0].lower() in _RESERVED or after.startswith("(") or before.endswith((".", "->")) or _WORD.match(after) and not before.endswith(("=", "(", ",", "return")):
            continue
        out.append((m.start(), m[0]))
    return out


def data_flow(text: str | None) -> list[tuple[int, str, list[int]]]:
    """(offset, name, offsets its value may come from) of every variable of a C-like text.

    Statements are followed in order. An assigned variable comes from the variables of the right side, a read one
    from its last definitions. Each branch of an if begins from the state before it, and what follows has the definitions
    of all branches that may have run; a loop's block is followed until its turns define nothing new.
    """
    text = text or ""
    found: dict[int, tuple[str, set[int]]] = {}

    def read(a: int, b: int, state: dict[str, set[int]]) -> list[int]:
        seen = []
        for at, name in variables(text[a:b]):
            sources = found.setdefault(a + at, (name, set()))[1]
            sources |= state.get(name, set())
            state.setdefault(name, {a + at})
            seen.append(a + at)
        return seen

    def plain(a: int, b: int, state: dict[str, set[int]]) -> None:
        m = _ASSIGN.search(LITERAL_OR_COMMENT.sub(lambda m: " " * len(m[0]), text[a:b]))
        if not m:
            read(a, b, state)
            return
        right = read(a + m.end(), b, state)
        targets = variables(text[a : a + m.start()])
        for at, name in targets[:-1]:
            read(a + at, a + at + len(name), state)
        if targets:
            at, name = targets[-1]
            sources = found.setdefault(a + at, (name, set()))[1]
            sources |= set(right) | (state.get(name, set()) if m[1] else set())
            state[name] = {a + at}

    State = dict[str, set[int]]
    back: dict[int, State] = {}  # by loop: what its turns have defined so far

    def copy(state: State) -> State:
        return {k: set(v) for k, v in state.items()}

    def join(into: State, *others: State) -> State:
        for other in others:
            for k, v in other.items():
                into.setdefault(k, set()).update(v)
        return into

    def block(n: Node, state: State) -> State:
        """The state after the head and the block, from a state that stays as it is."""
        after = copy(state)
        plain(n.start, n.children[0].start if n.children else n.end, after)
        run(n.children, after)
        return after

    def run(nodes: list[Node], state: State) -> None:
        base: State | None = None  # before an if, for its else
        for n in nodes:
            if not n.children and "{" not in text[n.start : n.end]:
                plain(n.start, n.end, state)
                base = None
                continue
            words = _WORD.findall(text[n.start : n.children[0].start if n.children else n.end])
            kind = words[0] if words else ""
            if kind == "else" and base is not None:
                after = block(n, base)
                taken.append(after)
                if words[1:2] == ["if"]:
                    join(state, after)
                else:  # one of the branches has run: what only the state before held is gone
                    state.clear()
                    join(state, *taken)
                    base = None
                continue
            base = None
            if kind in ("for", "while", "do"):
                after = block(n, join(copy(state), back.get(n.start, {})))
                join(back.setdefault(n.start, {}), after)
                join(state, after)
            elif kind == "if":
                base = copy(state)
                plain(n.start, n.children[0].start if n.children else n.end, base)
                taken = [block(n, state)]
                join(state, base, *taken)
            elif kind in ("switch", "case", "catch", "else"):
                join(state, block(n, state))
            else:
                after = block(n, state)
                state.clear()
                state.update(after)

    nodes = bracket_tree(text).children
    while True:  # a pass over the text brings a loop's definitions back to its head; the last one finds nothing new
        known = {k: copy(v) for k, v in back.items()}
        run(nodes, {})
        if back == known:
            break
    return [(at, name, sorted(sources - {at})) for at, (name, sources) in sorted(found.items())]


@arrow_udf("array<struct<at:int,name:string,sources:array<int>>>")
def flow(codes: pd.Series) -> pd.Series:
    """G6, G8 as a column."""
    return codes.map(lambda c: [{"at": a, "name": n, "sources": s} for a, n, s in data_flow(c)])
