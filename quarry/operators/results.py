"""Queries over stored results (``job_id, items, size, expected_utility, probability, support, rank``) and jobs
(``job_id, status, k, execution_time_ms, created_on``)."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import items_json, items_key


def by_job(results: DataFrame, job_id: int) -> DataFrame:
    return results.filter(F.col("job_id") == job_id)


def by_rank(results: DataFrame, job_id: int) -> DataFrame:
    return by_job(results, job_id).orderBy("rank")


def by_utility(results: DataFrame, job_id: int) -> DataFrame:
    return by_job(results, job_id).orderBy(F.desc("expected_utility"), "rank")


def high_utility(results: DataFrame, job_id: int, threshold: float) -> DataFrame:
    return by_job(results, job_id).filter(F.col("expected_utility") >= threshold).orderBy("rank")


def by_size(results: DataFrame, job_id: int, size: int) -> DataFrame:
    return by_job(results, job_id).filter(F.col("size") == size).orderBy("rank")


def containing(results: DataFrame, job_id: int, item: int) -> DataFrame:
    return by_job(results, job_id).filter(F.array_contains("items", item)).orderBy("rank")


def containing_text(results: DataFrame, job_id: int, item: str) -> DataFrame:
    """Itemsets whose JSON holds the text anywhere, so that 1 also finds 12."""
    return by_job(results, job_id).filter(F.contains(items_json(F.col("items")), F.lit(item))).orderBy("rank")


def search(results: DataFrame, job_id: int, pattern: str) -> DataFrame:
    """Itemsets whose items or whose utility (four places) contain the pattern as text."""
    text = lambda c: F.contains(c, F.lit(pattern))
    return by_job(results, job_id).filter(text(items_key(F.col("items"))) | text(F.format_string("%.4f", "expected_utility"))).orderBy("rank")


def search_utility_probability(results: DataFrame, min_utility: float, min_probability: float, page: int, size: int) -> DataFrame:
    found = results.filter((F.col("expected_utility") >= min_utility) & (F.col("probability") >= min_probability))
    return found.orderBy(F.desc("expected_utility"), F.desc("probability"), "job_id", "rank").offset(page * size).limit(size)


def page_of(results: DataFrame, job_id: int, page: int, size: int) -> DataFrame:
    return by_rank(results, job_id).offset(page * size).limit(size)


def page_totals(results: DataFrame, job_id: int, size: int) -> DataFrame:
    """total_elements and total_pages of a job's results."""
    return by_job(results, job_id).agg(F.count("*").alias("total_elements"), F.ceil(F.count("*") / size).cast("int").alias("total_pages"))


def job_topk(results: DataFrame, job_id: int, k: int) -> DataFrame:
    return by_utility(results, job_id).limit(k)


def global_topk(results: DataFrame, k: int) -> DataFrame:
    return results.orderBy(F.desc("expected_utility"), F.desc("probability"), "job_id", "rank").limit(k)


def value_statistics(results: DataFrame, column: str, digits: int) -> DataFrame:
    """MIN, MAX and AVG of a column for each job."""
    return results.groupBy("job_id").agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"), F.round(F.avg(column), digits).alias("avg_value"))


def size_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("job_id", "size").agg(F.count("*").alias("n")).orderBy("job_id", "size")


def counts(results: DataFrame, threshold: float | None = None) -> DataFrame:
    found = results if threshold is None else results.filter(F.col("expected_utility") >= threshold)
    return found.groupBy("job_id").agg(F.count("*").alias("n"))


def with_job(results: DataFrame, jobs: DataFrame) -> DataFrame:
    return results.join(jobs, "job_id")


def without_job(results: DataFrame, job_ids: DataFrame) -> DataFrame:
    return results.join(job_ids, "job_id", "left_anti")


def jobs_by_status(jobs: DataFrame, status: str) -> DataFrame:
    return jobs.filter(F.col("status") == status)


def jobs_page(jobs: DataFrame, page: int, size: int) -> DataFrame:
    return jobs.orderBy(F.desc("created_on"), "job_id").offset(page * size).limit(size)


def jobs_since(jobs: DataFrame, today: str, days: int) -> DataFrame:
    return jobs.filter(F.col("created_on") >= F.date_sub(F.lit(today).cast("date"), days))


def jobs_by_k(jobs: DataFrame, k: int) -> DataFrame:
    return jobs.filter(F.col("k") == k)


def jobs_in_time(jobs: DataFrame, low: int, high: int) -> DataFrame:
    return jobs.filter((F.col("status") == "COMPLETED") & F.col("execution_time_ms").between(low, high))


def slowest_or_fastest(jobs: DataFrame, n: int, fastest: bool) -> DataFrame:
    time = F.col("execution_time_ms")
    return jobs.filter(F.col("status") == "COMPLETED").orderBy(time.asc() if fastest else time.desc(), "job_id").limit(n)


def job_flags(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", F.round(F.col("execution_time_ms") / 1000.0, 3).alias("execution_seconds"), F.col("status").isin("COMPLETED", "FAILED").alias("is_completed"), (F.col("status") == "RUNNING").alias("is_running"))


def job_statistics(jobs: DataFrame) -> DataFrame:
    done = F.when(F.col("status") == "COMPLETED", F.col("execution_time_ms"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return jobs.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("COMPLETED", "FAILED", "RUNNING", "PENDING")],
        F.round(F.coalesce(F.avg(done), F.lit(0.0)), 3).alias("avg_ms"), zero(F.sum(done)).alias("sum_ms"), zero(F.max(done)).alias("max_ms"), zero(F.min(done)).alias("min_ms"),
    )


def per_job_statistics(results: DataFrame) -> DataFrame:
    return results.groupBy("job_id").agg(F.count("*").alias("n"), F.max("expected_utility").alias("max_utility"), F.min("expected_utility").alias("min_utility"), F.max("probability").alias("max_probability"), F.min("probability").alias("min_probability"), F.max("size").alias("max_size"))


def new_job_id() -> str:
    """``job_``, the milliseconds of now and eight random digits."""
    return f"job_{time.time_ns() // 1_000_000}_{uuid.uuid4().hex[:8]}"


def pruning_rates(levels: DataFrame) -> DataFrame:
    """Of all levels together: itemsets evaluated, going on and given up, joins met and dropped, and the shares of all of them."""
    sums = levels.agg(*[F.sum(c).alias(c) for c in ("evaluated", "kept", "met", "dropped")])
    share = lambda c, whole: F.round(F.when(F.col(whole) > 0, c / F.col(whole)).otherwise(0.0), 6)
    given_up = F.col("evaluated") - F.col("kept")
    return sums.select("evaluated", "kept", given_up.alias("pruned"), share(F.col("kept"), "evaluated").alias("kept_share"), share(given_up, "evaluated").alias("pruned_share"), "met", "dropped", share(F.col("met") - F.col("dropped"), "met").alias("join_success"))


def cancelled(jobs: DataFrame, job_id: int) -> DataFrame:
    """The job, if still open, as failed; the running work is stopped by its Spark job tag."""
    open_ = (F.col("job_id") == job_id) & F.col("status").isin("PENDING", "RUNNING")
    return jobs.withColumns({"status": F.when(open_, "FAILED").otherwise(F.col("status")), "error_message": F.when(open_, "Job cancelled by user")})
