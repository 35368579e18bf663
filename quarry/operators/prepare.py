"""From transactions and profits to level-1 elements.

``tx``: tid, item, quantity, probability (one row for each tid and item);
``profit``: item, profit. Losses stay in the baskets but count neither in the
transaction-weighted utility nor in the remaining utility.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import LOG_FLOOR


def item_utility(tx: DataFrame, profit: DataFrame) -> DataFrame:
    """tid, item, profit, u, p for items of known profit."""
    return tx.join(profit, "item").select("tid", "item", "profit", (F.col("profit") * F.col("quantity")).alias("u"), F.col("probability").alias("p"))


def gain(u: str = "u") -> F.Column:
    return F.when(F.col("profit") > 0, F.col(u)).otherwise(0.0)


def rtu(e: DataFrame) -> DataFrame:
    return e.groupBy("tid").agg(F.sum(gain()).alias("rtu"))


def transaction_utility(e: DataFrame) -> DataFrame:
    return e.groupBy("tid").agg(F.sum("u").alias("tu"))


def rtwu(e: DataFrame) -> DataFrame:
    """item, rtwu: one shuffle by transaction, then a partial sum by item."""
    weighted = e.withColumn("rtu", F.sum(gain()).over(Window.partitionBy("tid")))
    return weighted.filter("p > 0").groupBy("item").agg(F.sum("rtu").alias("rtwu"))


def ranked_items(weights: DataFrame) -> DataFrame:
    """item, rtwu, rank and path_rank; the window is over items only."""
    by_weight, by_path = Window.orderBy("rtwu", "item"), Window.orderBy(F.desc("rtwu"), F.asc("item"))
    return weights.select("item", "rtwu", (F.row_number().over(by_weight) - 1).alias("rank"), (F.row_number().over(by_path) - 1).alias("path_rank"))


def elements(e: DataFrame, ranks: DataFrame) -> DataFrame:
    """Level 1: tid, item, rank, path_rank, rtwu, u, rem, lp; and of the later items what their
    probabilities leave of ``rem`` (rem_p) and the largest of these (p_max)."""
    known = e.filter((F.col("p") > 0) & (F.ln("p") > LOG_FLOOR)).join(ranks, "item")
    later = Window.partitionBy("tid").orderBy("rank").rowsBetween(1, Window.unboundedFollowing)
    return known.select("tid", "item", "rank", "path_rank", "rtwu", "u", F.coalesce(F.sum(gain()).over(later), F.lit(0.0)).alias("rem"), F.ln("p").alias("lp"), F.coalesce(F.sum(gain() * F.col("p")).over(later), F.lit(0.0)).alias("rem_p"), F.coalesce(F.max("p").over(later), F.lit(0.0)).alias("p_max"))
