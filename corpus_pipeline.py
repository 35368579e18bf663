"""Documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it as
Parquet in the shared folder, deletes what the stage itself has read and staged,
and hands the reread table to the next. All stages but the last return the columns of
``documents``, whatever other columns there are and whatever their names.

Defined cases, of every stage: null text counts as empty; an empty table gives
an empty one. Null ids and repeated rows: ``quality_rules`` judges row by row
(empty texts fail the base rule, so they go); ``near_duplicates`` keeps one row
of those that repeat an id and every row without one; ``decontaminate`` and
``mix_sources`` treat rows of one id and text alike; ``shard`` gives each row a
place of its own, null ids first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.decontaminate import uncontaminated
from quarry.llm.mixing import mixed_rows
from quarry.llm.rules import rule_filter
from quarry.llm.sharding import assign_shards
from quarry.llm.simhash import keep_one
from quarry.llm.text import byte_size, crc
from quarry.plans.staging import discard, scope, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    return rule_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each SimHash group."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of any benchmark item."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with ``size``, ``text_crc32``, ``shard`` and ``slot``; the table's own columns of these names get ``_`` in front."""
    new = ("size", "text_crc32", "shard", "slot")
    own = [F.col(f"`{c}`").alias("_" * (c in new) + c) for c in docs.columns]
    sized = docs.select(*own, (byte_size(F.col("text")) + 1).alias("size"), crc(F.col("text")).alias("text_crc32"))
    return assign_shards(sized).select("row.*", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: The first stage learns its rules, which SQL cannot express; ``tests/llm/test_pipeline.py`` holds the whole against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has read and staged is deleted once its result is written."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with scope() as whole:
        for name, function in STAGES:
            with scope() as own:
                docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
                own.keep(docs)
            if written is not None:
                discard(written)
            written = docs
        whole.keep(docs)
    return docs
