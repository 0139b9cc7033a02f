"""Job table: state transitions, crash recovery, and facts read off output paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import upsert

# Fixed values.
STATES = {"queued": {"running", "stopped"}, "running": {"completed", "failed", "stopped"}, "completed": set(), "failed": set(), "stopped": set()}
SUFFIXES = ("_lora_ablation", "_lora_imbalance", "_lora", "_imbalance")
SCHEMA = "job_id string, job_type string, status string, params_json string, created_at timestamp, updated_at timestamp, return_code int, error_message string"


def allowed(before: Column, after: Column) -> Column:
    """R2: is the transition legal?"""
    ok = F.lit(False)
    for a, bs in STATES.items():
        for b in bs:
            ok = ok | ((before == a) & (after == b))
    return F.coalesce(ok, F.lit(False))


def apply_transitions(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """R2, K8: events (job_id, status, updated_at, return_code, error_message) that are legal from the present state win by time."""
    legal = events.alias("e").join(jobs.alias("j"), "job_id").where(allowed(F.col("j.status"), F.col("e.status")))
    changed = legal.select("job_id", "j.job_type", "e.status", "j.params_json", "j.created_at", "e.updated_at", "e.return_code", "e.error_message")
    return upsert(jobs, changed, "job_id", "updated_at")


def recover(jobs: DataFrame, now: Column) -> DataFrame:
    """R2: what was queued or running when the service died has failed."""
    lost = F.col("status").isin("queued", "running")
    return jobs.withColumns({"status": F.when(lost, "failed").otherwise(F.col("status")), "error_message": F.when(lost, "interrupted by restart").otherwise(F.col("error_message")), "updated_at": F.when(lost, now).otherwise(F.col("updated_at"))})


def run_of_path(path: Column) -> dict[str, Column]:
    """Category, model, dataset, length and ratio of outputs/<category>/<dataset>_<length>[_<ratio>]/<file>."""
    category = F.regexp_extract(path, r"outputs/([^/]+)/", 1)
    run = F.regexp_extract(path, r"outputs/[^/]+/([^/]+)/", 1)
    suffix = F.regexp_extract(category, "(" + "|".join(SUFFIXES) + ")$", 1)
    form = r"^(.*?)_(\d+-\d+|\d+)(?:_([0-9.]+))?$"
    return {
        "category": F.nullif(category, F.lit("")),
        "model": F.nullif(F.regexp_replace(category, "(" + "|".join(SUFFIXES) + ")$", ""), F.lit("")),
        "action": F.nullif(F.regexp_replace(suffix, "^_", ""), F.lit("")),
        "dataset": F.nullif(F.regexp_extract(run, form, 1), F.lit("")),
        "length": F.nullif(F.regexp_extract(run, form, 2), F.lit("")),
        "ratio": F.nullif(F.regexp_extract(run, form, 3), F.lit("")).try_cast("double"),
    }


def options(paths: DataFrame, column: str = "path") -> DataFrame:
    """The distinct lengths and ratios on offer per dataset."""
    facts = paths.select(*[c.alias(n) for n, c in run_of_path(F.col(column)).items()])
    return facts.where("dataset is not null").select("dataset", "length", "ratio").distinct()


def newest_first(jobs: DataFrame, n: int) -> DataFrame:
    """O8, O5."""
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(n)


def safe_path(root: str, relative: str) -> str:
    """The path below root; anything that would leave it is refused."""
    import posixpath

    full = posixpath.normpath(posixpath.join(root, relative))
    if full != root.rstrip("/") and not full.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{relative!r} leaves {root!r}")
    return full


def latest_checkpoint(paths: DataFrame, column: str = "path") -> DataFrame:
    """Q7: per output folder, the checkpoint folder epoch-<n> of the greatest n."""
    p = F.col(column)
    n = F.nullif(F.regexp_extract(p, r"/epoch-(\d+)/?$", 1), F.lit("")).cast("long")
    return paths.select(F.regexp_replace(p, r"/epoch-\d+/?$", "").alias("folder"), n.alias("epoch")).where("epoch is not null").groupBy("folder").agg(F.max("epoch").alias("epoch"))


def catalogue(paths: DataFrame, column: str = "path") -> DataFrame:
    """What the service lists: every output file with its run's facts and its kind."""
    p = F.col(column)
    facts = run_of_path(p)
    kind = F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1))
    return paths.select(p.alias("path"), *[c.alias(n) for n, c in facts.items()], F.element_at(F.split(p, "/"), -1).alias("file"), F.nullif(kind, F.lit("")).alias("kind"))


def log_tail(lines: DataFrame, n: int, line: str = "line") -> DataFrame:
    """The last n lines of a job's log, in order."""
    return lines.orderBy(F.desc(line)).limit(n).orderBy(line)


def expand(value, environment: dict[str, str], strict: bool = True):
    """${NAME} and $NAME in texts of a nested configuration; an unknown name is an error, or empty if not strict."""
    import re

    def one(m: re.Match) -> str:
        name = m[1] or m[2]
        if strict and name not in environment:
            raise KeyError(f"{name} is not set")
        return environment.get(name, "")

    if isinstance(value, dict):
        return {k: expand(v, environment, strict) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, environment, strict) for v in value]
    return re.sub(r"\$\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)", one, value) if isinstance(value, str) else value
