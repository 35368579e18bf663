"""Partitioned reads from an embedded database that lives in this process's memory."""

import datetime
import random

import pytest

from quarry.operators import mining
from quarry.sources import jdbc

TX, PROFIT = "tid long, item int, quantity int, probability double", "item int, profit double"


@pytest.fixture
def database(spark, tmp_path):
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    return f"jdbc:derby:memory:quarry_{random.getrandbits(64):x};create=true"


def put(df, url, table):
    df.coalesce(1).write.jdbc(url, table, mode="overwrite")


def same(a, b):
    return sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))


def test_ranges_hold_every_row(spark, database):
    rows = [(k, f"t{k % 7}", datetime.date(2020, 1, 1) + datetime.timedelta(k % 90)) for k in range(-150, 350)]
    rows += [(None, "no key", None), (5, None, None), (5, "t5", datetime.date(2020, 1, 6))]  # null, shared and repeated keys
    df = spark.createDataFrame(rows, "k long, text string, day date")
    put(df, database, "things")
    for key, rows_each in (("k", 50), ("day", 100), (None, 50)):
        read = jdbc.read_table(spark, database, "things", key, rows=rows_each)
        assert same(read, df.toDF(*read.columns))
        assert (read.rdd.getNumPartitions() > 3) == (key is not None)
    assert jdbc.read_table(spark, database, "things", "k", rows=1, connections=6).rdd.getNumPartitions() == 6


def test_decimal_keys_and_ranges_of_few_rows(spark, database):
    df = spark.range(40).selectExpr("CAST(id / 4 - 3 AS decimal(12, 2)) AS k", "id")
    put(df, database, "decimals")
    read = jdbc.read_table(spark, database, "decimals", "k", rows=8)
    assert same(read, df.toDF(*read.columns)) and read.rdd.getNumPartitions() == 5


def test_tables_that_take_one_task(spark, database):
    empty, nulls, one = (spark.createDataFrame(x, "k int, v string") for x in ([], [(None, "a")] * 9, [(3, "a")] * 9))
    for name, df in (("empty_table", empty), ("null_keys", nulls), ("one_key", one)):
        put(df, database, name)
        read = jdbc.read_table(spark, database, name, "k", rows=2)
        assert same(read, df.toDF(*read.columns)) and read.rdd.getNumPartitions() == 1
    with pytest.raises(ValueError, match="no column"):
        jdbc.read_table(spark, database, "one_key", "missing")


def test_filters_and_columns_reach_the_database(spark, database):
    put(spark.range(100).selectExpr("id AS k", "id * 2 AS v", "'x' AS unread"), database, "pushed")
    read = jdbc.read_table(spark, database, "pushed", "k", rows=30).filter("k >= 90").select("v")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual" in plan and "unread" not in plan.lower()
    assert sorted(r[0] for r in read.collect()) == list(range(180, 200, 2))


def test_search_on_a_table(spark, database):
    rng = random.Random(4)
    rows = [(t, i, rng.randint(1, 4), rng.choice((1.0, 0.8, 0.5))) for t in range(1, 60) for i in rng.sample(range(1, 9), 4)]
    tx = spark.createDataFrame(rows, TX)
    profit = spark.createDataFrame([(i, float(i - 2)) for i in range(1, 9)], PROFIT)
    put(tx.withColumnRenamed("tid", "TID"), database, "baskets")
    read = jdbc.read_transactions(spark, database, "baskets", rows=50)
    assert read.schema.simpleString() == tx.schema.simpleString() and read.rdd.getNumPartitions() == 5
    assert mining.mine_topk(read, profit, 5).collect() == mining.mine_topk(tx, profit, 5).collect()
