"""Transactions from text; profits from text, CSV or JSON; checks on both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.columns import DEFAULT_PROBABILITY
from quarry.plans.staging import drop_path
from quarry.sources.files import hashed, listed

#: File formats by suffix.
FORMATS = {"txt": "text", "csv": "csv", "json": "json", "bin": "binary"}

#: Blocks of input files whose counts the driver may hold.
BLOCKS = 1_000_000


def detect_format(name: str) -> str:
    return FORMATS.get(name.rpartition(".")[2].lower() if "." in name else "", "text")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """tid, line: lines that are neither blank nor comments, numbered from 1 in file order.

    Tasks read one block of a file each. A first pass counts the lines of every block, and
    the counts of the blocks before (a row for each block, summed by one small window) are
    what its own lines begin with; the second pass counts on from there as it reads. No line
    is shuffled or sorted.
    """
    raw = spark.read.text(path).select(F.btrim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    raw = raw.filter((F.length("line") > 0) & ~F.startswith("line", F.lit("#")))
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("offset"))
    rows = offsets.limit(BLOCKS + 1).collect()
    if len(rows) > BLOCKS:  # the table of blocks joins instead, which moves slim rows of places alone
        return _numbered_by_join(raw, offsets)
    places = {(r["file"], r["block"]): r["offset"] for r in rows}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
            of = files.indices.to_numpy()
            new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (blocks[1:] != blocks[:-1]))))
            tids = np.empty(batch.num_rows, np.int64)
            for low, high in zip(new, [*new[1:], batch.num_rows], strict=True):
                own = (files.dictionary[int(of[low])].as_py(), int(blocks[low]))
                if own != key:
                    key, at = own, places[own]
                tids[low:high] = at + 1 + np.arange(high - low)
                at += int(high - low)
            yield pa.RecordBatch.from_arrays([pa.array(tids), batch.column(0)], ["tid", "line"])

    return raw.mapInArrow(run, "tid long, line string")


def _numbered_by_join(raw: DataFrame, offsets: DataFrame) -> DataFrame:
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return raw.withColumn("at", F.monotonically_increasing_id()).withColumn("n", inside).join(offsets, ["file", "block"]).select((F.col("offset") + F.col("n")).cast("long").alias("tid"), "line")


def parse_transactions(lines: DataFrame) -> DataFrame:
    """tid, item, quantity, probability of valid entries ``item:quantity[:probability]``; the last of an item wins.

    A transaction is a line, so all of this happens within a row: entries are sorted by item
    and place, and one followed by the same item goes.
    """
    def entry(text: Column, at: Column) -> Column:
        x = F.split(F.regexp_replace(text, ":+$", ""), ":")
        probability = F.when(F.size(x) == 2, F.lit(DEFAULT_PROBABILITY)).otherwise(F.get(x, 2).try_cast("double"))
        fits = F.size(x).between(2, 3)
        return F.when(fits, F.struct(F.get(x, 0).try_cast("int").alias("item"), at.alias("at"), F.get(x, 1).try_cast("int").alias("quantity"), probability.alias("probability")))

    valid = lambda e: e.isNotNull() & e["item"].isNotNull() & (e["quantity"] > 0) & e["probability"].between(0, 1) & ~F.isnan(e["probability"])
    found = F.array_sort(F.filter(F.transform(F.split("line", "\\s+"), entry), valid))
    last = F.transform(F.array(found), lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i + 1)["item"] != e["item"], F.lit(True))))[0]
    return lines.select("tid", F.explode(last).alias("e")).select("tid", "e.item", "e.quantity", "e.probability")


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    tx = parse_transactions(numbered_lines(spark, path))
    if tx.isEmpty():
        raise ValueError("Transaction database is empty")
    return tx


def _last(pairs: DataFrame) -> DataFrame:
    """item, profit: valid pairs, the last of an item wins."""
    typed = pairs.select("tid", F.expr("try_cast(item AS INT)").alias("item"), F.expr("try_cast(profit AS DOUBLE)").alias("profit"))
    return typed.filter("item is not null and profit is not null").groupBy("item").agg(F.max_by("profit", "tid").alias("profit"))


def read_profits(spark: SparkSession, path: str) -> DataFrame:
    """Profit table in the format that the suffix names."""
    kind = detect_format(path)
    if kind == "json":
        whole = spark.read.text(path, wholetext=True)
        table = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("item", "profit")).select(F.lit(0).alias("tid"), F.btrim("item").alias("item"), "profit")
    else:
        lines = numbered_lines(spark, path)
        x = F.split("line", "," if kind == "csv" else "\\s+")
        cut = lines.select("tid", F.transform(x, lambda y: F.btrim(y)).alias("x"), F.get(x, 0).alias("head"))
        cut = cut.filter(F.size("x") >= 2) if kind == "csv" else cut.filter(F.size("x") == 2)
        if kind == "csv":  # a first field that is not all digits makes the first row a header
            cut = cut.filter(~((F.col("tid") == 1) & ~F.col("head").rlike("^[0-9]+$")))
        table = cut.select("tid", F.col("x")[0].alias("item"), F.col("x")[1].alias("profit"))
    out = _last(table)
    if out.isEmpty():
        raise ValueError("Profit table is empty")
    return out


def profit_validation(profit: DataFrame) -> DataFrame:
    return profit.agg(F.count("*").alias("n_items"), F.count_if(F.col("profit") < 0).alias("n_negative"))


def database_stats(tx: DataFrame) -> DataFrame:
    sizes = tx.groupBy("tid").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_transactions"), F.sum("n").alias("n_entries"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.round(F.avg("n"), 6).alias("avg_size"))


def dataset_metadata(tx: DataFrame) -> DataFrame:
    return tx.agg(F.countDistinct("tid").alias("transaction_count"), F.countDistinct("item").alias("item_count"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """file_name, file_path, file_size, file_type, checksum (MD5, read in pieces) of the files below a path."""
    return hashed(listed(spark, path)).select("file_name", "file_path", "file_size", "file_type", "checksum")


def list_files(spark: SparkSession, path: str, file_type: str | None = None) -> DataFrame:
    """``checksums`` of the files of one type (the folder they lie in) or of all."""
    found = listed(spark, path)
    found = found if file_type is None else found.filter(F.col("file_type") == file_type)
    return hashed(found).select("file_name", "file_path", "file_size", "file_type", "checksum")


def delete_files(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the session's file systems; a missing one is no error."""
    drop_path(spark, path)


def validate_file(spark: SparkSession, path: str, kind: str = "database") -> dict:
    """valid, message and counts of one file."""
    try:
        found = dataset_metadata(read_transactions(spark, path)) if kind == "database" else profit_validation(read_profits(spark, path))
        return {"valid": True, "message": "", **found.first().asDict()}
    except Exception as error:  # the report is the result, whatever was wrong
        return {"valid": False, "message": str(error)[:200]}
