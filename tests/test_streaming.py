import random

from pyspark.sql import functions as F

from quarry.operators import mining
from quarry.plans.staging import scope
from quarry.streaming.incremental import TX, IncrementalState


def data(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = [(t, i, rng.randint(1, 4), rng.choice([1.0, 0.5, 0.25, 0.0])) for t in range(n) for i in rng.sample(range(1, 8), rng.randint(1, 5))]
    return spark.createDataFrame(rows, TX), spark.createDataFrame([(i, float(i - 3)) for i in range(1, 8)], "item int, profit double")


def expected(tx, profit):
    rows = mining.level_one(tx, profit)
    facts = mining.level_statistics(tx, profit, 1).select(F.col("items")[0].alias("item"), "expected_utility", "probability", "support")
    return facts.join(rows.select("item", "rtwu").distinct(), "item").select("item", "rtwu", "expected_utility", "probability", "support")


def values(df):
    return sorted(tuple(round(x, 9) for x in r) for r in df.collect())


def test_stream_equals_batch_also_after_repeats_and_compaction(spark, tmp_path):
    tx, profit = data(spark)
    tx.repartition(5, "tid").write.parquet(str(tmp_path / "in"))
    state = IncrementalState(spark, str(tmp_path / "state"))
    stream = spark.readStream.schema(TX).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = state.start(stream, profit, str(tmp_path / "checkpoint"))
    query.awaitTermination()
    want = values(expected(tx, profit))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 5 and values(state.items()) == want
    # a batch that comes once more, as after a failure between its write and its commit
    again = spark.read.parquet(str(tmp_path / "in")).filter(F.col("tid") < 9)
    state.add(again, 77, profit)
    once = values(state.items())
    state.add(again, 77, profit)
    assert values(state.items()) == once != want
    state.compact(2)
    assert values(state.items()) == once and not (tmp_path / "state/batches/batch=1").exists() and (tmp_path / "state/batches/batch=3").exists()
    state.compact(77)
    assert values(state.items()) == once and len(list((tmp_path / "state/base").iterdir())) == 1
    # the stream goes on from its own checkpoint
    more, _ = data(spark, 20, 9)
    more = more.withColumn("tid", F.col("tid") + 1000)
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with scope():
        state.start(spark.readStream.schema(TX).parquet(str(tmp_path / "in")), profit, str(tmp_path / "checkpoint")).awaitTermination()
    assert (tmp_path / "state/batches/batch=5").exists()


def test_compaction_waits_for_its_entry(spark, tmp_path):
    """A compaction that fails before its entry changes nothing."""
    tx, profit = data(spark, 10)
    state = IncrementalState(spark, str(tmp_path))
    state.add(tx, 0, profit)
    before = values(state.items())
    state.log.append = None
    try:
        state.compact(0)
    except TypeError:
        pass
    assert values(IncrementalState(spark, str(tmp_path)).items()) == before == values(expected(tx, profit))
