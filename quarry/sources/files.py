"""A catalogue of data files, kept up to date without reading them again.

``refresh`` lists a folder (names, sizes and times; no content) and hashes only files that are
new or changed, each by one task in pieces of bounded size, as MD5 is a chain. Rows go to a log of
entries, so a listing or a search reads the catalogue and no file.

A write of Spark leaves a file in parts, ``part-00000-<write>-c000.txt`` and so on. The parts of one
write in one folder are one file: their bytes follow each other by number, and its name has ``*``
for the numbers. So a large file is written by many tasks, and no task has to collect it. A
single part is a file of its own name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.staging import drop_path
from quarry.sources.store import Log

ENTRY = "at long, file_path string, file_name string, file_type string, file_size long, checksum string, modified_us long, deleted boolean"
COLUMNS = ("file_name", "file_type", "file_path", "file_size", "checksum", "uploaded_at")
#: Bytes read at a time.
PIECE = 4 << 20
#: The name of a part of a file: its number, the write, the number within its task, the suffix.
PART = "^part-([0-9]+)-(.+)-c([0-9]+)([.].*)?$"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, file_name, file_type, file_size, modified_us, parts) of the files below a path; ``file_type`` is the folder they lie in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    at = F.split("path", "/")
    rows = files.select("path", F.element_at(at, -1).alias("name"), F.array_join(F.slice(at, 1, F.size(at) - 1), "/").alias("folder"), F.element_at(at, -2).alias("file_type"), "length", F.unix_micros("modificationTime").alias("modified"))
    number = lambda k: F.regexp_extract("name", PART, k).try_cast("long")
    whole = F.when(F.rlike("name", F.lit(PART)), F.regexp_replace("name", PART, "part-*-$2-c*$4")).otherwise(F.col("name"))
    place = F.struct(number(1).alias("task"), number(3).alias("count"), "path", "name")
    found = rows.filter(~F.startswith("name", F.lit("_"))).groupBy("folder", "file_type", whole.alias("whole")).agg(F.array_sort(F.collect_list(place)).alias("parts"), F.sum("length").alias("file_size"), F.max("modified").alias("modified_us"))
    name = F.when(F.size("parts") == 1, F.col("parts")[0]["name"]).otherwise(F.col("whole"))
    return found.select(F.concat_ws("/", "folder", name).alias("file_path"), name.alias("file_name"), "file_type", "file_size", "modified_us", F.col("parts.path").alias("parts"))


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the name in it; listings write local paths with one slash and keep blanks."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")


def hashed(files: DataFrame) -> DataFrame:
    """``files`` without ``parts`` and with ``checksum``, the MD5 of their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                digest = hashlib.md5(usedforsecurity=False)
                for path in parts:
                    where, name = opened(path)
                    with where.open_input_stream(name) as stream:
                        while piece := stream.read(PIECE):
                            digest.update(piece)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["_path", "checksum"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = files.select("file_path", "parts").repartition(n).mapInArrow(run, "_path string, checksum string")
    return files.join(sums, F.col("file_path") == F.col("_path")).drop("_path", "parts")


def drop_file(spark: SparkSession, path: str) -> None:
    """Delete a listed file, all its parts."""
    folder, _, name = path.rpartition("/")
    if not name.startswith("part-*-"):
        drop_path(spark, path)
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = re.compile(re.escape(name).replace(r"\*", "[0-9]+"))
    for x in fs.listStatus(where) if fs.exists(where) else ():
        if own.fullmatch(x.getPath().getName()):
            fs.delete(x.getPath(), False)


class FileCatalogue:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Log(spark, path)

    def _last(self) -> DataFrame:
        names = [x.split()[0] for x in ENTRY.split(", ")[2:]]
        last = self.log.read(ENTRY).groupBy("file_path").agg(F.max_by(F.struct(*names), "at").alias("r"))
        return last.select("file_path", "r.*").filter("not deleted")

    def refresh(self, folder: str) -> int:
        """Enter the files below ``folder`` that are new or have another size or time; how many."""
        known = self._last().select("file_path", "file_size", "modified_us")
        fresh = listed(self.spark, folder).join(known, ["file_path", "file_size", "modified_us"], "left_anti")
        rows = [r.asDict() | {"deleted": False} for r in hashed(fresh).collect()]  # slim rows of the new files
        if rows:
            self.log.append(rows)
        return len(rows)

    def files(self, file_type: str | None = None, name: str | None = None, after: str | None = None) -> DataFrame:
        """Entries by type, by name, or modified after a time (UTC), all of them optional."""
        found = self._last().withColumn("uploaded_at", F.timestamp_micros("modified_us"))
        for column, value in (("file_type", file_type), ("file_name", name)):
            found = found if value is None else found.filter(F.col(column) == value)
        if after is not None:
            found = found.filter(F.col("uploaded_at") > F.lit(after).cast("timestamp"))
        return found.select(*COLUMNS)

    def delete(self, name: str) -> int:
        """Delete the files of a name, and their entries; how many."""
        gone = [r["file_path"] for r in self.files(name=name).select("file_path").collect()]
        for path in gone:
            drop_file(self.spark, path)
        if gone:
            self.log.append([{"file_path": p, "deleted": True} for p in gone])
        return len(gone)
