"""Contiguous shards of equal byte size.

Method: documents are put in order of ``doc_id`` (ties: content), global prefix
sums of their sizes come from per-partition totals, and the order is cut at
equal targets: a document goes to the shard in which its middle byte lies.
Shards are therefore contiguous and differ from the target by at most one
document at each end.

Only ids, tie breakers and sizes are sorted. Where the rows carry more, each
looks its place up by the file and line it is stored in, so long texts are
shuffled once and never sorted.

Law ``bytes`` cuts the order of ids, and equal texts may lie anywhere in it, so
groups of equal texts are not kept together: a group may hold a third of all
bytes, which no shard of an eighth could take, so either the sizes or the groups
would have to give way.

Defined cases: null text counts as empty (size 1), null ids come first, repeated
rows are placed one after the other, an empty table gives no rows, and extra
columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.prefix import prefix_sums
from quarry.llm.text import byte_size, crc, located
from quarry.plans.staging import new_path, stage

N_SHARDS = 8


def places(slim: DataFrame, order: list[str], n_shards: int = N_SHARDS) -> DataFrame:
    """``slim`` with ``shard`` and ``slot``, in the order of some of its columns; sizes are in ``_size``."""
    placed = prefix_sums(slim.withColumn("_one", F.lit(1).cast("long")), order, {"_before": "_size", "_index": "_one"}, name="shards")
    total = int(slim.agg(F.sum("_size")).first()[0] or 1)
    cut = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(2 * _before + _size) * {n_shards}L div {2 * total}L").cast("int")))
    first = cut.groupBy("shard").agg(F.min("_index").alias("_first"))  # a row for each shard
    return cut.join(F.broadcast(first), "shard").select(*slim.columns, "shard", (F.col("_index") - F.col("_first")).alias("slot"))


def assign_shards(df: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", size_col: str = "size", tie_cols: tuple[str, ...] = ("text_crc32",)) -> DataFrame:
    """(row, shard, slot): each row of ``df`` as a struct, its shard (int) and its place in it (long, gapless from 0)."""
    names = [id_col, *tie_cols]
    keys = [F.col(f"`{c}`").alias(f"_k{k}") for k, c in enumerate(names)]
    order, size = [f"_k{k}" for k in range(len(keys))], F.col(f"`{size_col}`").cast("long").alias("_size")
    if set(df.columns) <= {*names, size_col}:  # nothing to look up
        slim = stage(df.select(*keys, size), "shard-sizes")
        back = {**{c: F.col(f"_k{k}") for k, c in enumerate(names)}, size_col: F.col("_size")}
        return places(slim, order, n_shards).select(F.struct(*[back[c].alias(c) for c in df.columns]).alias("row"), "shard", "slot")
    rows = located(df)
    slim = stage(rows.select(*[F.col("row")[c].alias(f"_k{k}") for k, c in enumerate(names)], F.col("row")[size_col].cast("long").alias("_size"), "_file", "_at"), "shard-sizes")
    found = stage(places(slim, [*order, "_file", "_at"], n_shards).select("_file", "_at", "shard", "slot"), "shard-places")
    return rows.join(found.hint("merge"), ["_file", "_at"]).select("row", "shard", "slot")  # a place for each row: never broadcast


def write_shards(placed: DataFrame, path: str | None = None) -> str:
    """Write the result of ``assign_shards`` as one folder for each shard, rows in order of their slots."""
    path = path or new_path(placed.sparkSession, "shard-files", lasting=True)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to shards 0 to 7 under the law ``bytes``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", (byte_size(F.col("text")) + 1).alias("size"), crc(F.col("text")).alias("text_crc32"))
    return assign_shards(sized).select("row.*", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
