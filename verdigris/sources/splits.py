"""Files whose records may hold line breaks, read by many tasks: quoted CSV and JSON arrays.

Spark's text source cuts a file into byte ranges at a separator (line ends; closing braces). What a range means
depends on the state at its start (inside a quoted field; inside a string, and how deep), so a first pass
gives each range as a function from start state to end state, a scan over the ranges of a file, one row each, composes
them, and a second pass reads every range from its true state. Records that lie in one range never move; pieces of a
record that spans ranges are put together by one shuffle of those pieces. Spark's own parsers take the records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Of the second pass's rows: a whole record; a record's middle, last and first piece; the first piece of a file's first record.
WHOLE, MIDDLE, LAST, FIRST, OPENING = range(5)


class Csv:
    """Lines. inside: in a quoted field (quotes are doubled, a quote counts at a field's start alone)."""

    separator = "\n"

    def __init__(self, sep: str = ",", quote: str = '"'):
        self.sep, self.quote = sep, quote

    def step(self, line: str, inside: int) -> tuple[int, int]:
        """State after the line, and by how much it went deeper (never)."""
        sep, quote, i = self.sep, self.quote, 0
        if quote not in line:
            return inside, 0
        while True:
            if inside:
                i = line.find(quote, i)
                while i >= 0 and line.startswith(quote, i + 1):
                    i = line.find(quote, i + 2)
                if i < 0:
                    return 1, 0
                inside = 0
            elif line.startswith(quote, i):
                inside, i = 1, i + 1
                continue
            i = line.find(sep, i)
            if i < 0:
                return 0, 0
            i += len(sep)

    def rests(self, inside: int, depth: int) -> bool:
        return not inside

    def record(self, text: str, file: str, first: bool) -> str | None:
        """None for a file's header and blank lines."""
        text = text.removesuffix("\r")
        return None if first or not text else text

    def at_end(self, text: str, file: str, first: bool) -> str | None:
        """Of the last piece of a file, in whatever state."""
        return self.record(text, file, first)

    def cut_off(self, file: str) -> None:
        """A file may end within a field."""


class JsonArray:
    """What lies between closing braces. inside: in a string; depth: open brackets and braces."""

    separator = "}"
    STRING, OPEN, REST = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL), re.compile(r'"(?:[^"\\]|\\.)*\Z', re.DOTALL), re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
    HEAD, NEXT = re.compile(r"\s*\[[\s,]*(?=\{)"), re.compile(r"[\s,]*(?=\{)")
    EMPTY, END = re.compile(r"\s*\[[\s,]*\]\s*"), re.compile(r"[\s,]*\]\s*")

    def step(self, piece: str, inside: int) -> tuple[int, int]:
        if inside:
            m = self.REST.match(piece)
            if not m:
                return 1, 0  # the brace belongs to the string
            piece = piece[m.end() :]
        piece = self.STRING.sub("", piece)
        m = self.OPEN.search(piece)
        if m:
            piece = piece[: m.start()]
        deeper = piece.count("{") + piece.count("[") - piece.count("]")
        return (1, deeper) if m else (0, deeper - 1)

    def rests(self, inside: int, depth: int) -> bool:
        return not inside and depth <= 1

    def record(self, text: str, file: str, first: bool) -> str:
        """An object without what stands before it, which may be the array's start or a comma."""
        m = (self.HEAD if first else self.NEXT).match(text)
        if m:
            return text[m.end() :] + "}"
        if first and not text.lstrip().startswith("["):
            raise ValueError(f"{file} is not a JSON array")
        raise ValueError(f"Unexpected content after the array in {file}" if not first and text.lstrip(" \t\r\n,").startswith("]") else f"{file} holds an element that is no object")

    def at_end(self, text: str, file: str, first: bool) -> None:
        """The last piece is the array's end, which no brace follows."""
        if (self.EMPTY if first else self.END).fullmatch(text):
            return None
        if first and not text.lstrip().startswith("["):
            raise ValueError(f"{file} is not a JSON array")
        raise ValueError(f"Unexpected content after the array in {file}" if self.END.match(text) else f"Incomplete JSON array in {file}")

    def cut_off(self, file: str) -> None:
        raise ValueError(f"Incomplete JSON array in {file}")


Machine = Csv | JsonArray


def pieces(spark: SparkSession, path: str | list[str], machine: Machine) -> DataFrame:
    """file, start (of the byte range) and value: the file's text between separators, in order within a range."""
    text = spark.read.option("lineSep", machine.separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """(file, start, values) of stretches of one byte range, in order."""
    for b in batches:
        files, starts, a = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
        values = b.column(2).to_pylist()
        for z in range(1, len(values) + 1):
            if z == len(values) or starts[z] != starts[a] or files[z] != files[a]:
                yield files[a], starts[a], values[a:z]
                a = z


def end_states(cut: DataFrame, machine: Machine) -> DataFrame:
    """file, start and, for start state 0 and 1, the end state and change of depth of each byte range."""

    def run(batches):
        def row():
            return pa.RecordBatch.from_pylist([{"file": at[0], "start": at[1], "to0": state[0][0], "deeper0": state[0][1], "to1": state[1][0], "deeper1": state[1][1]}], schema=schema)

        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("to0", pa.int32()), ("deeper0", pa.int64()), ("to1", pa.int32()), ("deeper1", pa.int64())])
        at, state = None, [(0, 0), (1, 0)]
        for file, start, values in ranges(batches):
            if at != (file, start):
                if at:
                    yield row()
                at, state = (file, start), [(0, 0), (1, 0)]
            for v in values:
                (a, x), (b, y) = state
                ta, dx = machine.step(v, a)
                tb, dy = (ta, dx) if a == b else machine.step(v, b)
                state = [(ta, x + dx), (tb, y + dy)]
        if at:
            yield row()

    return cut.mapInArrow(run, "file string, start long, to0 int, deeper0 long, to1 int, deeper1 long")


def start_states(ends: DataFrame) -> dict[tuple[str, int], tuple[int, int, bool]]:
    """(inside, depth, whether it is its file's last) at the start of each byte range.

    A row a range comes to the driver, as many as the entries of Spark's own list of file splits.
    """
    found: dict[tuple[str, int], tuple[int, int, bool]] = {}
    file, inside, depth = None, 0, 0
    for r in sorted(ends.collect()):
        if r["file"] != file:
            file, inside, depth = r["file"], 0, 0
        elif before:
            found[before] = (*found[before][:2], False)
        before = (file, r["start"])
        found[before] = (inside, depth, True)
        inside, depth = (r["to1"], depth + r["deeper1"]) if inside else (r["to0"], depth + r["deeper0"])
    return found


def read_ranges(cut: DataFrame, machine: Machine, states: dict[tuple[str, int], tuple[int, int, bool]]) -> DataFrame:
    """file, start, kind and text of whole records and of pieces of those that span byte ranges."""
    shared = cut.sparkSession.sparkContext.broadcast(states)
    ddl = "file string, start long, kind int, text string"
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])

    def run(batches):
        known, sep, rests, step = shared.value, machine.separator, machine.rests, machine.step
        out, size = [], 0
        at = held = None  # the range, and its latest piece, which may be its last

        def begun(where):
            nonlocal at, held, inside, depth, last, open_, lead, fresh
            if where not in known:
                raise ValueError("the files or their splits changed while they were read")
            at, held, (inside, depth, last) = where, None, known[where]
            lead = not rests(inside, depth)  # reading on a record of an earlier range
            open_, fresh = [], where[1] == 0

        def take(v):
            """One piece that isn't its file's last."""
            nonlocal inside, depth, open_, lead, fresh
            inside, more = step(v, inside)
            depth += more
            if not open_ and not lead and rests(inside, depth):
                text = machine.record(v, at[0], fresh)
                fresh = False
                return None if text is None else (WHOLE, text)
            open_.append(v)
            if not rests(inside, depth):
                return None
            text, kind, open_, lead = sep.join(open_), (LAST if lead else WHOLE), [], False
            if kind == WHOLE:
                text = machine.record(text, at[0], fresh)
                fresh = False
            return None if text is None else (kind, text)

        def ended():
            """What the end of a range leaves."""
            if at is None:
                return None
            if not last:
                got = take(held)
                return got or ((MIDDLE if lead else OPENING if fresh else FIRST, sep.join(open_)) if open_ else None)
            text = sep.join([*open_, held])
            if lead:
                machine.cut_off(at[0])
                return LAST, text
            text = machine.at_end(text, at[0], fresh)
            return None if text is None else (WHOLE, text)

        inside = depth = 0
        last = lead = fresh = False
        open_: list[str] = []

        def flushed():
            nonlocal out, size
            made, out, size = out, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

        def put(got, more=None):
            nonlocal size
            if got:
                out.append((*at, *got))
                size += len(got[1])

        for file, start, values in ranges(batches):
            if at != (file, start):
                put(ended())
                begun((file, start))
            for v in values:
                if held is not None:
                    put(take(held))
                    if size > 4_000_000 or len(out) > 10_000:
                        yield flushed()
                held = v
        put(ended())
        if out:
            yield flushed()

    return cut.mapInArrow(run, ddl)


def records(spark: SparkSession, path: str | list[str], machine: Machine) -> DataFrame:
    """value: the text of every record of the files; none for files without text."""
    cut = pieces(spark, path, machine)
    states = start_states(end_states(cut, machine))
    read = read_ranges(cut, machine, states)
    out = read.where(F.col("kind") == WHOLE).select(F.col("text").alias("value"))
    if all(machine.rests(inside, depth) for inside, depth, _ in states.values()):
        return out
    begins = F.col("kind") >= FIRST
    nth = F.sum(begins.cast("int")).over(Window.partitionBy("file").orderBy("start", "kind"))  # a range ends a record before it begins one
    parts = read.where(F.col("kind") != WHOLE).withColumn("nth", nth)  # two rows a byte range at most
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "text"))), lambda x: x["text"])
    spanning = parts.groupBy("file", "nth").agg(F.array_join(texts, machine.separator).alias("text"), (F.max("kind") == OPENING).alias("first"))
    record = F.udf(lambda text, file, first: machine.record(text, file, first), "string", useArrow=False)("text", "file", "first")
    return out.unionByName(spanning.select(record.alias("value")).where("value is not null"))


def read_csv_splits(spark: SparkSession, path: str | list[str], sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """As the multi-line reader (header, all strings, doubled quotes, blank fields null), in parallel within a file."""
    names = spark.read.options(header=True, multiLine=True, escape='"', sep=sep, inferSchema=False).csv(path).columns
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    row = F.from_csv("value", ddl, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"})
    df = records(spark, path, Csv(sep)).select(row.alias("row")).select("row.*")
    return df.select(*columns) if columns else df


def scan_json_array(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """The objects of one array a file, in parallel within a file; as text where no schema is given.

    Commas and white space between elements are skipped. A file that is no array, an element that is no
    object, content after the array and an array that doesn't end fail the job. Files without text give no rows.
    """
    df = records(spark, path, JsonArray())
    return df if schema is None else df.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")
