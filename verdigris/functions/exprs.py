"""Scalar expressions: lenient casts, safe division, tags and flags, text clean-up, token counts, vectors.

All are Column expressions, so they stay in generated code; none is a UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- casts and arithmetic -------------------------------------------------------------------


def lenient_int(x, default=None) -> Column:
    """P5: the trimmed text as int, else the default."""
    return F.coalesce(F.trim(_c(x).cast("string")).try_cast("int"), F.lit(default).cast("int"))


def lenient_float(x, default=None) -> Column:
    """The trimmed text as double; blank and malformed text give the default."""
    return F.coalesce(F.nullif(F.trim(_c(x).cast("string")), F.lit("")).try_cast("double"), F.lit(default).cast("double"))


def safe_div(a, b) -> Column:
    """A / b as double, 0.0 where b is zero or null."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def confidence(p) -> Column:
    """max(p, 1 - p)."""
    return F.greatest(_c(p), 1 - _c(p))


def judged_confidence(pred, p) -> Column:
    """P for a positive call, 1 - p for a negative one."""
    return F.when(_c(pred) == 1, _c(p)).otherwise(1 - _c(p))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def softmax2(a, b) -> Column:
    """V5: the second class's share of a two-way softmax."""
    return sigmoid(_c(b) - _c(a))


def decide(p, threshold: float = 0.5, tie_positive: bool = False) -> Column:
    """V4: 1 above the threshold (at it too, on request), else 0."""
    hit = _c(p) >= threshold if tie_positive else _c(p) > threshold
    return hit.cast("int")


# ---- flags ----------------------------------------------------------------------------------


def error_kind(label, pred) -> Column:
    """Correct, FP, FN or unknown."""
    lab, p = _c(label), _c(pred)
    return F.when(lab == p, "correct").when((lab == 0) & (p == 1), "FP").when((lab == 1) & (p == 0), "FN").otherwise("unknown")


def change_flags(label, small, judged) -> dict[str, Column]:
    """P10: who is wrong, and whether the review changed, fixed or introduced an error."""
    lab, s, j = _c(label), _c(small), _c(judged)
    return {
        "judge_wrong": (j != lab).cast("int"),
        "small_wrong": (s != lab).cast("int"),
        "changed": (s != j).cast("int"),
        "fixed": ((s != lab) & (j == lab)).cast("int"),
        "introduced": ((s == lab) & (j != lab)).cast("int"),
    }


# Status and provenance names.
KEPT, REJECTED, NOT_REVIEWED, MISSED = "true_positive_kept_by_llm", "true_positive_rejected_by_llm", "true_positive_not_reviewed_by_llm", "missed_by_original_model"
UNREVIEWED_NEGATIVE, OVERRIDE, MISSING_REVIEW = "small_model_unreviewed_negative", "reviewer_override_positive_subset", "small_model_positive_missing_reviewer"
HIGH_CONFIDENCE, LOW_OVERRIDE, LOW_FALLBACK = "small_model_high_confidence", "llm_low_confidence_override", "small_model_low_confidence_fallback"


def positive_case_status(label, original, final, reviewed) -> Column:
    """What became of an actual positive; null for negatives."""
    seen = F.when(~_c(reviewed), NOT_REVIEWED).when(_c(final) == 1, KEPT).otherwise(REJECTED)
    return F.when(_c(label) == 1, F.when(_c(original) == 1, seen).otherwise(MISSED))


def decision_source(original, review) -> Column:
    """Where the final call comes from."""
    return F.when(_c(original) != 1, UNREVIEWED_NEGATIVE).when(_c(review).isNull(), MISSING_REVIEW).otherwise(OVERRIDE)


# ---- identifiers ----------------------------------------------------------------------------

# Fixed values.
LANGUAGE_NAMES = {
    "c": "cpp", "c++": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "java": "java",
    "c#": "csharp", "csharp": "csharp", "cs": "csharp",
    "python": "python", "py": "python",
    "typescript": "typescript", "ts": "typescript",
    "javascript": "javascript", "js": "javascript",
    "php": "php",
}

# What marks a language in code.
PHP_TAG = r"(?m)^\s*<\?php"
PYTHON_DEF = r"(?m)^\s*def\s+\w+\s*\(|^\s*class\s+\w+.*:"
PHP_STATIC = r"\b(public|private|protected)\s+static\s+function\b"
PHP_FUNCTION = r"(?m)^\s*function\s+\w+\s*\("
CLASS = r"(?m)^\s*(public|private|protected)?\s*class\s+\w+"
CSHARP = r"\b(Console|List<|IEnumerable<|namespace)\b"
JAVA = r"\b(import\s+java\.|public\s+(class|interface|enum)\b)"
SCRIPT = r"\b(function|const|let|var)\b"
TYPED = r":\s*[A-Za-z_][A-Za-z0-9_<>\[\]\|]*"
CPP = r"#include\s*<|\bstd::\w+"
NAMESPACE = r"\bnamespace\s+\w+"


def cwe_or_null_text(cwe) -> Column:
    """A missing or empty class as the text "null", for export."""
    return F.coalesce(F.nullif(_c(cwe), F.lit("")), F.lit("null"))


def normalize_cwe(cwe) -> Column:
    """Bare number or name; null for the classes without information."""
    t = F.trim(_c(cwe))
    bare = F.regexp_replace(F.regexp_replace(t, "(?i)^NVD-CWE-", ""), "(?i)^CWE-?", "")
    return F.when(t.rlike("(?i)noinfo|other|unknown"), None).otherwise(bare)


def cwe_spellings(number) -> Column:
    """The spellings under which a class may be stored."""
    n = _c(number)
    return F.array(n, F.concat(F.lit("CWE-"), n), F.concat(F.lit("NVD-CWE-"), n))


def normalize_language(name) -> Column:
    """Alias to language, null for others."""
    m = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.try_element_at(m, F.lower(F.trim(_c(name))))


def infer_language(code) -> Column:
    """The first rule that the opening 3000 characters meet, else null."""
    head = F.substring(_c(code), 1, 3000)
    has, lit = head.rlike, head.contains
    in_class = has(CLASS) & (lit(";") | lit("{"))
    return (
        F.when(has(PHP_TAG), "php")
        .when(has(PYTHON_DEF), "python")
        .when(has(PHP_STATIC) | (has(PHP_FUNCTION) & lit("$")), "php")
        .when(in_class & ((lit("namespace ") & lit("using ")) | has(CSHARP)), "csharp")
        .when(has(JAVA), "java")
        .when(has(SCRIPT) & (lit("=>") | has(TYPED)), "typescript")
        .when(has(CPP) | (has(NAMESPACE) & lit("::")), "cpp")
    )


def is_before(value) -> Column:
    """Tri-state truth of a text flag."""
    v = F.lower(F.trim(_c(value).cast("string")))
    return F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False)


def pair_key(signature, name) -> Column:
    """P20: signature where there is one, else name."""
    sig = F.trim(F.coalesce(_c(signature), F.lit("")))
    return F.when(sig != "", F.concat(F.lit("sig::"), sig)).otherwise(F.concat(F.lit("name::"), F.trim(F.coalesce(_c(name), F.lit("")))))


def pair_id(*parts) -> Column:
    """Parts joined by `::`; a null part reads None."""
    return F.concat_ws("::", *[F.coalesce(_c(p).cast("string"), F.lit("None")) for p in parts])


# ---- text -----------------------------------------------------------------------------------


def prompt(template: str, fields: dict[str, Column | str]) -> Column:
    """A template with {placeholders} replaced in turn."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(_c(kv[1]).cast("string"), F.lit(""))), fields.items(), F.lit(template))


# Output-format tails of a prompt.
FORMAT_TAILS = (r"(?is)\nOutput in JSON format:\s*\{.*?\}\s*$", r"(?is)\nReturn only 0 or 1\.?\s*$", r"(?is)\nOutput requirements:\s*\{.*?\}\s*$")


def strip_format_blocks(text) -> Column:
    """Drops the output-format tail of a prompt."""
    return F.trim(reduce(lambda t, tail: F.regexp_replace(t, tail, ""), FORMAT_TAILS, F.trim(_c(text))))


def collapse_space(text) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def tag_of(name, place: int = 2, sep: str = "_") -> Column:
    """The part of a name at a place, null where it has fewer."""
    return F.try_element_at(F.split(_c(name), sep), F.lit(place))


def normalize_newlines(text) -> Column:
    """P25: CRLF and CR become LF; escaped newlines are unescaped only where there is no real one."""
    t = F.regexp_replace(_c(text), "\r\n?", "\n")
    un = F.replace(F.replace(t, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    return F.when(t.contains("\n"), t).otherwise(un)


def lines_of(text) -> Column:
    """Lines after newline normalisation; one trailing newline adds no line."""
    t = F.regexp_replace(F.coalesce(_c(text), F.lit("")), "\r\n?", "\n")
    t = F.regexp_replace(t, "\n$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n"))


def preview(text, n: int) -> Column:
    """P30."""
    return F.substring(_c(text), 1, n)


def approx_tokens(text) -> Column:
    """Words plus single other marks."""
    return F.regexp_count(_c(text), F.lit(r"(?U)\w+|[^\w\s]"))


def identifiers(text) -> Column:
    """The set of lower-cased identifiers."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))


def jaccard(a, b) -> Column:
    """T4: 0 where either set is empty."""
    x, y = _c(a), _c(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)).cast("double"))


def strip_c_comments(text) -> Column:
    """Closed block comments and line comments."""
    return F.regexp_replace(_c(text), r"/\*[\s\S]*?\*/|//[^\n]*", "")


# The clean-up steps, in order.
CLEAN_STEPS = [
    (r"[^A-Za-z0-9(),!?\'\`]", " "),
    (r"\'s", " 's"),
    (r"\'ve", " 've"),
    (r"n\'t", " n't"),
    (r"\'re", " 're"),
    (r"\'d", " 'd"),
    (r"\'ll", " 'll"),
    (r",", " , "),
    (r"!", " ! "),
    (r"\(", r" \\( "),
    (r"\)", r" \\) "),
    (r"\?", r" \\? "),
    (r"\s{2,}", " "),
]


def clean_text(text) -> Column:
    """Spaced punctuation, lower case."""
    return F.lower(F.trim(reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), CLEAN_STEPS, _c(text))))


def correct_spacing(text, pairs=((" .", "."), (" ,", ","), (" !", "!"), (" ?", "?"), (" '", "'"), ("( ", "("), (" )", ")"))) -> Column:
    """Literal replacements in order."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, _c(text))


def binary_label(response) -> tuple[Column, Column]:
    """(label, how it was found) of a reviewer's reply: the first JSON object in it, the quoted field, the whole text, its last line."""
    t = F.trim(F.coalesce(_c(response), F.lit("")))
    # the object is looked for anywhere, also in a fence: all from the first bracket to the last, of any depth, else the
    # first object that nests once
    whole = F.try_variant_get(F.try_parse_json(F.regexp_extract(t, r"(?s)(\{.*\})", 1)), "$.vulnerable", "string")
    block = F.regexp_extract(t, r"(?s)(\{(?:[^{}]|\{[^{}]*\})*\})", 1)
    obj = F.lower(F.trim(F.coalesce(whole, F.when(block != "", F.get_json_object(block, "$.vulnerable")))))
    field = F.regexp_extract(F.lower(t), r'"vulnerable"\s*:\s*"?(yes|no|true|false|0|1)"?', 1)
    last = F.trim(F.regexp_extract(t, r"([^\n]*)$", 1))

    def bit(c: Column) -> Column:
        v = F.lower(c)
        return F.when(v.isin("yes", "true", "1"), 1).when(v.isin("no", "false", "0"), 0)

    def named(b: Column, name: str) -> Column:
        return F.when(b == 1, f"{name}.yes").when(b == 0, f"{name}.no")

    label = F.coalesce(bit(obj), bit(field), bit(t), bit(last))
    how = F.coalesce(F.when(bit(obj).isNotNull(), "json.vulnerable"), F.when(bit(field).isNotNull(), "regex.vulnerable"), named(bit(t), "exact"), named(bit(last), "last_line"))
    return label, how


def first_char_label(reply) -> Column:
    """M3: the label that a generated reply begins with, null for any other beginning."""
    return F.substring(F.ltrim(_c(reply)), 1, 1).try_cast("int")


def percent(x) -> Column:
    """A share as text with one decimal."""
    return F.concat(F.format_string("%.1f", _c(x).cast("double") * 100), F.lit("%"))


def number_text(x) -> Column:
    """Whole numbers without decimals, others with four."""
    v = _c(x).cast("double")
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(F.format_string("%.4f", v))


def xml_text(x) -> Column:
    """Text that is safe inside an XML element."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), _c(x))


# Short model names.
MODEL_ALIASES = {
    "llama2": "meta-llama/Llama-2-7b-hf",
    "codellama": "codellama/CodeLlama-7b-hf",
    "llama3": "meta-llama/Meta-Llama-3-8B",
    "llama3.1": "meta-llama/Llama-3.1-8B",
    "llama3.2": "meta-llama/Llama-3.2-1B",
}


def model_name(alias) -> Column:
    """The full name of a short one; others stay."""
    a = _c(alias)
    m = F.create_map(*[F.lit(x) for kv in MODEL_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(F.trim(a))), a)


def error_summary(text, n: int = 200) -> Column:
    """T14."""
    return F.substring(collapse_space(text), 1, n)


def start_line(location) -> Column:  # the pattern is a fixed value
    """The line number of a `line:col-line:col` location."""
    return F.nullif(F.regexp_extract(_c(location), r"\b(\d+):\d+-\d+:\d+\b", 1), F.lit("")).cast("int")


def solid_chars(text) -> Column:
    """Characters other than ASCII white space."""
    return F.length(F.regexp_replace(_c(text), "[ \t\n\r\x0b\x0c]", ""))


# ---- vectors --------------------------------------------------------------------------------


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    """V1: Euclidean length, 1e-12 at least."""
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))


def unit(a) -> Column:
    n = norm(a)
    return F.transform(_c(a), lambda x: x.cast("double") / n)


def cosine(a, b) -> Column:
    """V2."""
    return dot(a, b) / (norm(a) * norm(b))


# ---- intervals ------------------------------------------------------------------------------


def overlaps_any(start, end, ranges) -> Column:
    """Does [start, end] meet any range of the array (structs of start and end)?"""
    return F.exists(_c(ranges), lambda r: (_c(start) <= r["end"]) & (r["start"] <= _c(end)))


def merge_ranges(ranges) -> Column:
    """Overlapping or adjacent [start, end] ranges become one; the array's order does not matter.

    Nulls come last. A range that covers nothing (no end, or one before its start) joins the one that reaches it, else it stays
    as it is; one without start stays only if nothing has an end.
    """
    end = lambda x: F.when(x["start"].isNotNull(), x["end"])
    keyed = F.transform(_c(ranges), lambda x: F.struct(x["start"].isNull().alias("a"), x["start"].alias("start"), end(x).isNull().alias("b"), end(x).alias("end")))
    r = F.transform(F.array_sort(keyed), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    empty = F.slice(r, 1, 0)

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))
        meets = (x["start"] <= last["end"] + 1) | (x["start"].isNull() & F.exists(acc, lambda y: y["end"].isNotNull()))
        return F.when(F.size(acc) == 0, F.array(x)).when(meets, grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(r, empty, step)


def pad_or_cut(ids, length: int, pad: int = 0) -> Column:
    """Exactly `length` elements."""
    x = _c(ids)
    return F.concat(F.slice(x, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(x))))


def hash_split(key, seed: str = "42", train: int = 80, validate: int = 90) -> Column:
    """Train, validate or test by the first 32 bits of an MD5."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}::"), _c(key).cast("string"))), 1, 8), 16, 10).cast("long") % 100
    return F.when(h < train, "train").when(h < validate, "validate").otherwise("test")


def shuffle_key(key, seed: str = "42") -> Column:
    """A reproducible random order."""
    return F.md5(F.concat(F.lit(f"{seed}::"), _c(key).cast("string")))
