"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, token-id shards.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents. Near-dedup takes five-word shingles at a
similarity of 0.8; mixing keeps every document and fixes their order. A stored table has no order, so the last
stage, which returns one row per shard, takes the same order again from keys and sources and packs along it.

Every stage takes empty tables (and gives an empty one), nulls in any column, extra columns of any name (which
the last one does not read), repeated rows, and texts of any length; the stages say what becomes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import binary_output, common, decontaminate, mixing, near_dedup, quality_rules

SHARDS_MIXED = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what a quality rule rejects; null and empty texts have too few words, repeated rows are judged alike."""
    return quality_rules.passing(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id in each group of near copies; null and empty texts and null ids are nobody's copy."""
    return near_dedup.deduplicate(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget; null and empty texts hold none."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones too, in the interleaved order of the target weights; a null source is a source."""
    return mixing.in_mixed_order(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride shards of token ids in training order: mixed, and permuted within windows of SHARDS_MIXED shards.

    A null or empty text contributes its end id.
    """
    mixed = mixing.mix(docs.select("doc_id", "source", "text"))
    return binary_output.materialise(mixed, order="mix_order", window=SHARDS_MIXED * binary_output.PER_SHARD)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token_output", shards),
]

#: The stages hash, tokenise and encrypt order in ways SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            common.drop_written(last)  # the stage after it is stored now
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
