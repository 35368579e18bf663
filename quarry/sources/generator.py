"""Seeded synthetic data sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GeneratorConfig:
    transactions: int = 1000
    items: int = 100
    min_size: int = 2
    max_size: int = 10
    min_quantity: int = 1
    max_quantity: int = 5
    min_probability: float = 0.3
    max_probability: float = 1.0
    min_profit: float = -10.0
    max_profit: float = 50.0
    negative_ratio: float = 0.1
    zipf: float | None = None
    seed: int = 42

    def __post_init__(self):
        if not 1 <= self.min_size <= self.max_size <= self.items:
            raise ValueError("sizes must lie between 1 and the number of items")


#: The standard suite's numbers of transactions and items, and sizes.
PRESETS = {
    "small": GeneratorConfig(100, 20),
    "medium": GeneratorConfig(10_000, 100),
    "large": GeneratorConfig(100_000, 500),
    "dense": GeneratorConfig(5_000, 50, 10, 25),
    "sparse": GeneratorConfig(10_000, 1000, 2, 5),
}


def zipf_cdf(spark: SparkSession, items: int, exponent: float = 1.5) -> DataFrame:
    """item, cdf: share of picks that fall on this item or a smaller one."""
    mass = spark.range(1, items + 1).select(F.col("id").cast("int").alias("item"), (1 / F.pow(F.col("id").cast("double"), F.lit(exponent))).alias("w"))
    upto = F.sum("w").over(Window.orderBy("item").rowsBetween(Window.unboundedPreceding, 0))
    return mass.select("item", (upto / F.sum("w").over(Window.partitionBy())).alias("cdf"))


def _rand(c: GeneratorConfig, *keys) -> F.Column:
    """A uniform number that depends on the seed and the keys alone, not on the partitioning."""
    return F.pmod(F.xxhash64(F.lit(c.seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def generate_transactions(spark: SparkSession, c: GeneratorConfig) -> DataFrame:
    """tid, item, quantity, probability: distinct items, uniform or by Zipf's law.

    Few items of many are drawn one by one, and the first different ones are
    taken. Where that leaves a transaction short, and where items have weights or
    a good part of them is taken, every item gets a random key and the smallest win.
    """
    tids = spark.range(1, c.transactions + 1).select(F.col("id").alias("tid"))
    sized = tids.withColumn("n", F.floor(_rand(c, F.lit("n"), "tid") * (c.max_size - c.min_size + 1) + c.min_size).cast("int"))
    weight = F.pow(F.col("item").cast("double"), F.lit(-(c.zipf or 0.0)))  # exponential races: key / weight

    def by_keys(rows: DataFrame) -> DataFrame:
        keys = rows.select("tid", "n", F.explode(F.sequence(F.lit(1), F.lit(c.items))).alias("item")).withColumn("key", -F.ln(1 - _rand(c, F.lit("i"), "tid", "item")) / weight)
        picked = keys.groupBy("tid", "n").agg(F.array_sort(F.collect_list(F.struct("key", "item"))).alias("x"))
        return picked.select("tid", F.explode(F.slice("x", F.lit(1), F.col("n"))).alias("x")).select("tid", F.col("x.item").alias("item"))

    if c.zipf or c.max_size * 4 >= c.items:
        chosen = by_keys(sized)
    else:
        one = lambda j: F.floor(_rand(c, F.lit("d"), "tid", j) * c.items + 1).cast("int")
        drawn = sized.withColumn("x", F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("n") * 2 + 8), one)))
        whole = drawn.filter(F.size("x") >= F.col("n")).select("tid", F.explode(F.slice("x", F.lit(1), F.col("n"))).alias("item"))
        chosen = whole.unionByName(by_keys(drawn.filter(F.size("x") < F.col("n")).select("tid", "n")))
    quantity = F.floor(_rand(c, F.lit("q"), "tid", "item") * (c.max_quantity - c.min_quantity + 1) + c.min_quantity).cast("int")
    probability = F.round(_rand(c, F.lit("p"), "tid", "item") * (c.max_probability - c.min_probability) + c.min_probability, 4)
    return chosen.select("tid", "item", quantity.alias("quantity"), probability.alias("probability"))


def generate_profits(spark: SparkSession, c: GeneratorConfig) -> DataFrame:
    """item, profit: a share of ``negative_ratio`` below zero."""
    r = _rand(c, F.lit("v"), "item")
    value = F.when(_rand(c, F.lit("s"), "item") < c.negative_ratio, r * c.min_profit).otherwise(r * c.max_profit)
    return spark.range(1, c.items + 1).select(F.col("id").cast("int").alias("item")).withColumn("profit", F.round(value, 2))


def transaction_lines(tx: DataFrame) -> DataFrame:
    """tid, line: the text form of transactions."""
    entry = F.concat_ws(":", F.col("item").cast("string"), F.col("quantity").cast("string"), F.format_string("%.2f", "probability"))
    return tx.groupBy("tid").agg(F.array_join(F.array_sort(F.collect_list(F.struct("item", entry.alias("t"))))["t"], " ").alias("line"))


def write_suite(spark: SparkSession, folder: str, presets: dict[str, GeneratorConfig] = PRESETS) -> list[str]:
    """Write the transactions and profits of every preset as text below ``folder``; the names of what was written."""
    out = []
    for name, c in presets.items():
        transaction_lines(generate_transactions(spark, c)).orderBy("tid").select("line").write.text(f"{folder}/{name}_database")
        generate_profits(spark, c).select(F.concat_ws(" ", F.col("item").cast("string"), F.col("profit").cast("string")).alias("line")).write.text(f"{folder}/{name}_profits")
        out += [f"{name}_database", f"{name}_profits"]
    return out
