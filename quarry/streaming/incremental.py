"""Sums of single items over a stream of transactions.

RTWU, expected utility, the sum of log probabilities and the support of an item are sums
over transactions, so a micro-batch adds its own to them. Each batch's sums are a folder
named by the batch id, written by overwriting: a batch that is repeated after a failure
replaces what it wrote before and never counts twice. ``compact`` folds batches into a
base version, which counts from the moment that the log names it.

A transaction has to arrive within one batch, as lines of a file do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.columns import LOG_FLOOR
from quarry.operators import prepare
from quarry.plans.staging import drop_path
from quarry.sources.store import Log

SUMS = "item int, rtwu double, eu double, slp double, support long"
TX = "tid long, item int, quantity int, probability double"


def item_sums(tx: DataFrame, profit: DataFrame) -> DataFrame:
    """Columns of ``SUMS`` for the given transactions."""
    e = prepare.item_utility(tx, profit)
    held = F.col("p") > F.exp(F.lit(LOG_FLOOR))
    own = e.filter("p > 0").groupBy("item").agg(F.sum(F.when(held, F.col("u") * F.col("p")).otherwise(0.0)).alias("eu"), F.sum(F.when(held, F.ln("p")).otherwise(0.0)).alias("slp"), F.count_if(held).alias("support"))
    return prepare.rtwu(e).join(own, "item").select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in SUMS.split(", "))])


class IncrementalState:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, f"{self.path}/log")

    def add(self, batch: DataFrame, batch_id: int, profit: DataFrame) -> None:
        """The sums of one batch in place of what this batch wrote before."""
        item_sums(batch, profit).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")

    def start(self, stream: DataFrame, profit: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Fold a streaming frame of transactions into the state."""
        return stream.writeStream.foreachBatch(lambda df, n: self.add(df, n, profit)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()

    def _base(self) -> tuple[int, str | None]:
        row = self.log.read("at long, upto long, version string").orderBy(F.desc("at")).first()
        return (row["upto"], row["version"]) if row else (-1, None)

    def _parts(self) -> DataFrame:
        upto, version = self._base()
        batches = self.spark.read.schema(f"{SUMS}, batch long").parquet(f"{self.path}/batches").filter(F.col("batch") > upto).drop("batch")
        return batches if version is None else batches.unionByName(self.spark.read.schema(SUMS).parquet(f"{self.path}/base/{version}"))

    def items(self) -> DataFrame:
        """(item, rtwu, expected_utility, probability, support) over all batches."""
        sums = self._parts().groupBy("item").agg(*[F.sum(c).alias(c) for c in ("rtwu", "eu", "slp", "support")])
        return sums.select("item", "rtwu", F.col("eu").alias("expected_utility"), (1 - F.exp("slp")).alias("probability"), "support")

    def compact(self, upto: int) -> None:
        """Fold the batches up to an id that the stream has finished into the base, and delete them."""
        before, old = self._base()
        version = uuid.uuid4().hex
        done = self.spark.read.schema(f"{SUMS}, batch long").parquet(f"{self.path}/batches").filter(F.col("batch").between(before + 1, upto))
        ids = [r["batch"] for r in done.select("batch").distinct().collect()]
        parts = done.drop("batch") if old is None else done.drop("batch").unionByName(self.spark.read.schema(SUMS).parquet(f"{self.path}/base/{old}"))
        sums = parts.groupBy("item").agg(*[F.sum(c).alias(c) for c in ("rtwu", "eu", "slp", "support")])
        sums.write.parquet(f"{self.path}/base/{version}")
        self.log.append([{"upto": upto, "version": version}])
        for n in ids:
            drop_path(self.spark, f"{self.path}/batches/batch={n}")
        if old is not None:
            drop_path(self.spark, f"{self.path}/base/{old}")
