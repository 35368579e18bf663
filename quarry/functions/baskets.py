"""Baskets, jobs and stored results of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import mining
from quarry.plans.staging import new_path
from quarry.sources.store import ResultStore


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as uncertain baskets of brands: tid, item, quantity, probability."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("item"))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy((F.col("l_orderkey") + 1).alias("tid"), "item")
    return rows.agg(F.sum("l_quantity").cast("int").alias("quantity"), (1 - 5 * F.max("l_discount")).alias("probability"))


def profits(tx: DataFrame) -> DataFrame:
    return tx.select("item").distinct().select("item", ((F.col("item") * 7) % 13 - 4).cast("double").alias("profit"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the shape of mining jobs."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("PENDING")
    return o.select(F.col("o_orderkey").cast("long").alias("job_id"), status.alias("status"), (F.col("o_custkey") % 10 + 1).cast("int").alias("k"), F.floor("o_totalprice").cast("long").alias("execution_time_ms"), F.col("o_orderdate").cast("date").alias("created_on"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined single items and pairs as results of five jobs, ranked within their job."""
    tx = transactions(spark, sf_dir)
    mined = mining.mine_topk(tx, profits(tx), 1 << 20, 0.0, max_size=2)
    rows = mined.select((F.col("items")[0] % 5).alias("job_id"), "items", "size", F.round("expected_utility", 4).alias("expected_utility"), F.round("probability", 6).alias("probability"), "support")
    order = Window.partitionBy("job_id").orderBy(F.desc("expected_utility"), F.desc("probability"), "size", "items")
    return rows.withColumn("rank", F.row_number().over(order))


_STORES: dict[tuple[str, str], str] = {}


def store(spark: SparkSession, sf_dir: str) -> ResultStore:
    """The store of ``results``: written once for each session and table, anew if it is gone."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _STORES:
        found = ResultStore(spark, _STORES[key])
        if not found.versions().isEmpty():
            return found
    made = ResultStore(spark, new_path(spark, "results", lasting=True))
    made.replace(results(spark, sf_dir))
    _STORES[key] = made.path
    return made


def stored(spark: SparkSession, sf_dir: str, job_id: int | None = None) -> DataFrame:
    """Stored results of one job or of all."""
    found = store(spark, sf_dir).results(job_id)
    return found.withColumn("job_id", F.col("job_id").cast("int"))
