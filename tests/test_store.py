import os
import threading
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.operators.jobs import CANCELLED, Jobs
from quarry.sources.store import RESULT, Log, ResultStore


def rows(spark, job, n, first=0):
    return spark.range(n).select(F.lit(job).alias("job_id"), F.array((F.col("id") % 50).cast("int"), (F.col("id") % 50 + 50).cast("int")).alias("items"), F.lit(2).alias("size"), (n - F.col("id") + first).cast("double").alias("expected_utility"), F.lit(0.5).alias("probability"), F.lit(1).cast("long").alias("support"), (F.col("id") + 1).cast("int").alias("rank"))


def files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_replace_and_delete_are_whole(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    assert store.results().count() == 0 and store.results(1).count() == 0
    store.replace(rows(spark, 1, 5).unionByName(rows(spark, 2, 6)))
    before = files(tmp_path)
    store.replace(rows(spark, 1, 7))
    count = lambda: {r["job_id"]: r["count"] for r in store.results().groupBy("job_id").count().collect()}
    assert count() == {1: 7, 2: 6} and set(before) & set(files(tmp_path))  # job 2 still lies in the first version
    store.delete([2])
    assert count() == {1: 7} and not set(before) & set(files(tmp_path)) and store.results(2).count() == 0
    assert store.containing(1, 3).count() == 1 and store.search(1, "53").count() == 1
    store.delete([1, 99])
    assert files(tmp_path) == [] and count() == {}


def test_a_failed_write_leaves_the_old_result(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    store.replace(rows(spark, 1, 5))
    before = sorted(files(tmp_path))
    broken = rows(spark, 1, 100).withColumn("support", F.when(F.col("rank") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("support")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        store.replace(broken)
    assert store.results(1).count() == 5 and sorted(files(tmp_path)) == before


def test_writers_do_not_lose_entries(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    threads = [threading.Thread(target=lambda k=k: [log.append([{"job_id": k, "version": f"{k}-{i}"}]) for i in range(4)]) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = log.read("at long, job_id long, version string").collect()
    assert sorted(r["at"] for r in found) == list(range(1, 17)) and len({r["version"] for r in found}) == 16
    assert not [x for x in os.listdir(tmp_path) if x.startswith("_")]


def test_a_page_reads_the_row_groups_of_its_ranks(spark, tmp_path, monkeypatch):
    from quarry.sources import store as module

    monkeypatch.setattr(module, "ROW_GROUP", 4096)
    store = ResultStore(spark, str(tmp_path))
    store.replace(rows(spark, 1, 60_000).coalesce(1))
    assert [r["rank"] for r in store.page(1, 300, 20).collect()] == list(range(6001, 6021))
    hit = total = 0
    for f in files(tmp_path / "data"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index("rank") if "rank" in meta.schema.names else None
        for g in range(meta.num_row_groups):
            x = next(meta.row_group(g).column(c) for c in range(meta.num_columns) if meta.row_group(g).column(c).path_in_schema == "rank")
            total += 1
            hit += x.statistics.min <= 6020 and x.statistics.max >= 6001
    assert at is not None and hit == 1 < total
    plan = store.page(1, 300, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(rank,6001)" in plan and "LessThanOrEqual(rank,6020)" in plan


def test_indexes_are_read_by_their_keys(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    store.replace(rows(spark, 1, 500).unionByName(rows(spark, 2, 90)))
    plan = store.containing(1, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "item#" in plan and "(item" in plan
    assert [r["rank"] for r in store.containing(2, 57).collect()] == [8, 58] and store.containing(2, 57).columns == [x.split()[0] for x in RESULT.split(", ")]
    every = store.results(1).collect()
    for text in ("7,5", "493", "0000", "x", "5"):
        want = sorted(r["rank"] for r in every if text in ",".join(map(str, r["items"])) or text in f"{r['expected_utility']:.4f}")
        assert [r["rank"] for r in store.search(1, text).collect()] == want, text


def frames(spark, n=6):
    tx = spark.createDataFrame([(t, i, 1 + t % 3, 0.9) for t in range(20) for i in range(1, n)], "tid long, item int, quantity int, probability double")
    return tx, spark.createDataFrame([(i, float(i)) for i in range(1, n)], "item int, profit double")


def test_jobs_record_their_states_and_results(spark, tmp_path):
    jobs = Jobs(spark, str(tmp_path))
    jobs.run(7, *frames(spark), 4, 0.3)
    row = jobs.table().first()
    assert (row["job_id"], row["status"], row["k"], row["itemsets_found"]) == (7, "COMPLETED", 4, 4) and row["execution_time_ms"] > 0
    assert [r["rank"] for r in jobs.store.results(7).orderBy("rank").collect()] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        jobs.run(8, *frames(spark), 0, 0.3)
    assert jobs.status(8) == "FAILED" and jobs.cancel(7) is False and jobs.cancel(99) is False
    jobs.delete([7])
    assert jobs.store.results(7).count() == 0 and jobs.status(7) is None


def test_cancel_ends_the_tasks_of_a_running_search(spark, tmp_path):
    jobs, (tx, profit) = Jobs(spark, str(tmp_path)), frames(spark)
    started = tmp_path / "started"

    def slow(batches):
        for batch in batches:
            started.touch()
            time.sleep(40)
            yield batch

    waiting = tx.mapInArrow(slow, tx.schema)
    errors = []

    def work():
        try:
            jobs.run(5, waiting, profit, 3, 0.3)
        except Exception as error:
            errors.append(str(error))

    thread = threading.Thread(target=work)
    thread.start()
    until = time.time() + 60
    while not started.exists() and time.time() < until:
        time.sleep(0.1)
    began = time.time()
    assert jobs.cancel(5) is True
    thread.join(60)
    assert not thread.is_alive() and time.time() - began < 25 and errors
    assert jobs.status(5) == "FAILED" and jobs.table().first()["error_message"] == CANCELLED and jobs.store.results(5).count() == 0
    until = time.time() + 30
    while spark.sparkContext.statusTracker().getActiveStageIds() and time.time() < until:
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveStageIds()
