"""Mining jobs: run under a tag of their own, recorded step by step, stopped by their tag.

A job's records are entries of a log (``store.Log``), the last of which holds: PENDING when it
is asked for, RUNNING, then COMPLETED once its results are in the store, or FAILED with
the message. All Spark jobs of the search carry the job's tag, so ``cancel`` ends their tasks.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.mining import mine
from quarry.sources import sinks
from quarry.sources.store import Log, ResultStore

RECORD = "at long, job_id long, status string, k int, min_probability double, itemsets_found long, execution_time_ms long, error_message string"
CANCELLED = "Job cancelled by user"


class Jobs:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.store, self.log = ResultStore(spark, f"{path}/results"), Log(spark, f"{path}/jobs")

    def table(self) -> DataFrame:
        """The last record of every job. A cancellation holds if the job was open when it came, whatever its
        thread wrote after that, until the job is asked for again."""
        in_order = Window.partitionBy("job_id").orderBy("at")
        runs = self.log.read(RECORD).withColumns({"run": F.sum(F.when(F.col("status") == "PENDING", 1).otherwise(0)).over(in_order), "before": F.lag("status").over(in_order)})
        cancel = F.col("error_message").eqNullSafe(F.lit(CANCELLED))
        held = runs.filter(~cancel | F.col("before").isin("PENDING", "RUNNING"))
        last = F.max_by(F.struct(*[x.split()[0] for x in RECORD.split(", ")[2:]], "at"), F.struct("run", cancel, "at"))
        return held.groupBy("job_id").agg(last.alias("r")).select("job_id", "r.*")

    def status(self, job_id: int) -> str | None:
        row = self.table().filter(F.col("job_id") == job_id).select("status").first()
        return row and row["status"]

    def _record(self, job_id: int, status: str, **more) -> int:
        return self.log.append([{"job_id": job_id, "status": status} | more])

    def run(self, job_id: int, tx: DataFrame, profit: DataFrame, k: int, min_prob: float, semantics: str = "exact") -> None:
        """Mine and store; blocks, so that callers choose their thread. Errors are recorded and raised."""
        asked, tag, began = {"k": k, "min_probability": min_prob}, self.tag(job_id), time.time()
        spent = lambda: int((time.time() - began) * 1000)
        self._record(job_id, "PENDING", **asked)
        self.spark.sparkContext.addJobTag(tag)
        self.spark.sparkContext.setInterruptOnCancel(True)  # tasks that wait are woken, not only asked
        try:
            self._record(job_id, "RUNNING", **asked)
            top = mine(tx, profit, k, min_prob, semantics).topk
            found = top.count()
            if self.status(job_id) == "FAILED":
                raise RuntimeError(CANCELLED)
            if found:
                self.store.replace(sinks.result_entities(top, F.lit(job_id)))
            elif self.status(job_id) is not None:
                self.store.delete([job_id])
            self._record(job_id, "COMPLETED", itemsets_found=found, execution_time_ms=spent(), **asked)
        except Exception as error:
            message = str(error) or "Unknown error"
            self._record(job_id, "FAILED", error_message=message if len(message) <= 1000 else f"{message[:997]}...", execution_time_ms=spent(), **asked)
            raise
        finally:
            self.spark.sparkContext.setInterruptOnCancel(False)
            self.spark.sparkContext.removeJobTag(tag)

    @staticmethod
    def tag(job_id: int) -> str:
        return f"quarry-job-{job_id}"

    def cancel(self, job_id: int) -> bool:
        """Stop a job; whether it was still open. Neither the record nor the stop waits for a free slot of the cluster."""
        at = self._record(job_id, "FAILED", error_message=CANCELLED)
        self.spark.sparkContext.cancelJobsWithTag(self.tag(job_id))
        return not self.table().filter((F.col("job_id") == job_id) & (F.col("at") == at)).isEmpty()

    def delete(self, job_ids: list[int]) -> None:
        """Jobs leave the table with their results."""
        self.store.delete(job_ids)
        self.log.append([{"job_id": j, "status": None} for j in job_ids])
