"""Results of jobs in a folder: atomic to replace and delete, indexed, read by pages.

``data/version=V/job_id=J`` holds what one write left of a job, sorted by rank in small row
groups, and ``items`` and ``grams`` beside it the inverted indexes. A version counts from the
moment that an entry of the log names it: entries are single files, put in place by a
rename that never overwrites. Readers fold the log, so they see a job's old or new results
whole, whatever writers do or however they fail; versions that no entry names are invisible.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import items_key
from quarry.plans.staging import drop_path

#: Bytes of a row group, and characters of an index gram.
ROW_GROUP, GRAM = 1 << 20, 3
LOG = "at long, job_id long, version string"
RESULT = "job_id long, items array<int>, size int, expected_utility double, probability double, support long, rank int"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


class Log:
    """Entries of a folder, numbered by order; an entry is there whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _hadoop(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm, where, where.getFileSystem(conf), conf

    def append(self, rows: list[dict]) -> int:
        """Add an entry of rows, each with the entry's number ``at``; the number."""
        jvm, where, fs, conf = self._hadoop()
        fs.mkdirs(where)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        while True:
            taken = [int(n) for x in fs.listStatus(where) if (n := x.getPath().getName().removesuffix(".json")).isdigit()]
            at = max(taken, default=0) + 1
            draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_{uuid.uuid4().hex}")
            out = fs.create(draft)
            out.write(bytearray("".join(json.dumps(r | {"at": at}) + "\n" for r in rows), "utf-8"))
            out.close()
            try:
                context.rename(fs.makeQualified(draft), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{at:012d}.json")), none)
                return at
            except Exception as error:  # another writer was first: the next number
                fs.delete(draft, False)
                if "FileAlreadyExists" not in str(error):
                    raise

    def read(self, schema: str) -> DataFrame:
        _, where, fs, _ = self._hadoop()
        if not fs.exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(self.path)


class ResultStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, f"{self.path}/log")

    def versions(self) -> DataFrame:
        """(job_id, version) that counts now."""
        last = self.log.read(LOG).groupBy("job_id").agg(F.max(F.struct("at", "version")).alias("last"))
        return last.select("job_id", F.col("last.version").alias("version")).filter("version is not null")

    def replace(self, results: DataFrame) -> list[int]:
        """Put the results of the jobs in ``results`` in place of those they had; the jobs."""
        version = uuid.uuid4().hex
        try:
            rows = results.select(*[F.col(c).cast(t.split(" ", 1)[1]).alias(c) for c, t in zip(NAMES, RESULT.split(", "), strict=True)])
            sorted_ = rows.repartitionByRange("job_id", "rank").sortWithinPartitions("job_id", "rank")
            sorted_.write.option("parquet.block.size", ROW_GROUP).partitionBy("job_id").parquet(f"{self.path}/data/version={version}")
            written = self.spark.read.schema(RESULT).parquet(f"{self.path}/data/version={version}")
            by_item = written.select("job_id", F.explode("items").alias("item"), "rank")
            by_item.sort("item", "job_id", "rank").write.parquet(f"{self.path}/items/version={version}")
            by_gram = written.select("job_id", "rank", F.explode(F.array_distinct(F.concat(*[grams(x) for x in texts()]))).alias("gram"))
            by_gram.sort("gram", "job_id", "rank").write.parquet(f"{self.path}/grams/version={version}")
            jobs = sorted(r["job_id"] for r in written.select("job_id").distinct().collect())  # a row for each job of this write
        except BaseException:
            self._drop([version])
            raise
        old = self._of(jobs)
        self.log.append([{"job_id": j, "version": version} for j in jobs])
        self._collect(old)
        return jobs

    def delete(self, jobs: list[int]) -> None:
        """The jobs' results are gone with one entry of the log; their files go after it."""
        old = self._of(jobs)
        self.log.append([{"job_id": j, "version": None} for j in jobs])
        for job, version in old.items():
            drop_path(self.spark, f"{self.path}/data/version={version}/job_id={job}")
        self._collect(old)

    def _of(self, jobs: list[int]) -> dict[int, str]:
        return {r["job_id"]: r["version"] for r in self.versions().filter(F.col("job_id").isin(jobs)).collect()}

    def _collect(self, old: dict[int, str]) -> None:
        """Delete versions that no job has any more."""
        used = {r["version"] for r in self.versions().filter(F.col("version").isin([*old.values()])).select("version").distinct().collect()}
        self._drop([v for v in set(old.values()) if v not in used])

    def _drop(self, versions: list[str]) -> None:
        for version in versions:
            for part in ("data", "items", "grams"):
                drop_path(self.spark, f"{self.path}/{part}/version={version}")

    def _table(self, part: str, schema: str, job_id: int | None) -> DataFrame:
        """Rows of a part that count: of one job from its own folder, of all by a join that prunes versions."""
        live = self.versions()
        if job_id is not None:
            version = self._of([job_id]).get(job_id)
            if version is None:
                return self.spark.createDataFrame([], schema)
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}/version={version}").filter(F.col("job_id") == job_id)
        if live.isEmpty():
            return self.spark.createDataFrame([], schema)
        every = self.spark.read.schema(f"{schema}, version string").parquet(f"{self.path}/{part}")
        return every.join(live, ["job_id", "version"], "left_semi").drop("version")

    def results(self, job_id: int | None = None) -> DataFrame:
        """Columns of ``RESULT``: of one job, or of all."""
        return self._table("data", RESULT, job_id).select(*NAMES)

    def page(self, job_id: int, page: int, size: int) -> DataFrame:
        """Ranks are 1, 2, 3, so a page is a range of them, which row groups outside it need not be read for."""
        return self.results(job_id).filter(F.col("rank").between(page * size + 1, (page + 1) * size)).orderBy("rank")

    def containing(self, job_id: int, item: int) -> DataFrame:
        """Itemsets with an item, their ranks taken from the index."""
        ranks = self._table("items", "job_id long, item int, rank int", job_id).filter(F.col("item") == item).select("rank")
        return self.results(job_id).join(ranks, "rank", "left_semi").select(*NAMES).orderBy("rank")

    def search(self, job_id: int, pattern: str) -> DataFrame:
        """Itemsets whose items or utility (four places) hold the pattern as text; from three characters on by the index of grams."""
        found = self.results(job_id)
        if len(pattern) >= GRAM:
            asked = list(dict.fromkeys(pattern[k : k + GRAM] for k in range(len(pattern) - GRAM + 1)))
            held = self._table("grams", "job_id long, rank int, gram string", job_id).filter(F.col("gram").isin(asked)).groupBy("rank").agg(F.count("*").alias("n"))
            found = found.join(held.filter(F.col("n") == len(asked)).select("rank"), "rank", "left_semi")
        hits = [F.contains(x, F.lit(pattern)) for x in texts()]
        return found.filter(hits[0] | hits[1]).select(*NAMES).orderBy("rank")


def texts() -> list[Column]:
    """What a text search looks at."""
    return [items_key(F.col("items")), F.format_string("%.4f", "expected_utility")]


def grams(text: Column) -> Column:
    return F.when(F.length(text) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substr(text, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))
