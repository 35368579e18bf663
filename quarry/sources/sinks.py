"""Exports and stored results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import braces, items_json, truncated
from quarry.operators.mining import answer_order


def ranked(topk: DataFrame) -> DataFrame:
    """At most k rows, so one window over all of them is small."""
    return topk.withColumn("rank", F.row_number().over(Window.orderBy(*answer_order())))


def csv_rows(topk: DataFrame) -> DataFrame:
    return ranked(topk).select(F.col("rank").alias("Rank"), braces(F.col("items")).alias("Itemset"), F.format_string("%.6f", "expected_utility").alias("Utility"), F.format_string("%.6f", "probability").alias("Probability"), F.col("support").alias("Support"))


def text_lines(topk: DataFrame) -> DataFrame:
    line = F.format_string("%d. %s EU=%.4f P=%.4f S=%d", "rank", braces(F.col("items")), "expected_utility", "probability", "support")
    return ranked(topk).select("rank", line.alias("line"))


def json_rows(topk: DataFrame) -> DataFrame:
    value = F.to_json(F.struct("rank", "items", F.round("expected_utility", 4).alias("expectedUtility"), F.round("probability", 6).alias("probability"), "support"))
    return ranked(topk).select("rank", value.alias("value"))


def json_document(topk: DataFrame, statistics: list[dict], timestamp: Column) -> DataFrame:
    """One row with one JSON object: ``timestamp``, ``topKItemsets`` and ``statistics`` (an entry for each level)."""
    sets = json_rows(topk).agg(F.array_sort(F.collect_list(F.struct("rank", "value")))["value"].alias("sets"))  # at most k
    parts = [F.lit('{"timestamp":"'), F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('","topKItemsets":['), F.array_join("sets", ","), F.lit(f'],"statistics":{json.dumps(statistics)}}}')]
    return sets.select(F.concat(*parts).alias("value"))


#: The widths, rules and labels of the console tables.
CONSOLE_HEAD, CONSOLE_ROW, CONSOLE_RULE = "%-5s %-30s %12s %12s %8s", "%-5d %-30s %12.4f %12.4f %8d", "-" * 70
CONSOLE_NAMES = ("Rank", "Itemset", "Utility", "Probability", "Support")
CONSOLE_NONE = "No itemsets found meeting the criteria."
CONSOLE_BAR, CONSOLE_TITLE = "=" * 80, "MINING CONFIGURATION"
CONSOLE_LABELS = {"transactions": "Database Size:        %,d transactions", "items": "Number of Items:      %,d items", "k": "Top-K Target:         %d itemsets", "min_prob": "Min Probability:      %.4f", "memory_mb": "Available Memory:     %,d MB", "threads": "Thread Pool Size:     %d threads", "start": "Start Time:           %s"}


def console_lines(topk: DataFrame) -> DataFrame:
    """rank, line: a console table; its header has rank -1, the rule below it 0, itemsets are cut at 30 characters."""
    rows = ranked(topk).select("rank", F.format_string(CONSOLE_ROW, "rank", truncated(braces(F.col("items")), 30), "expected_utility", "probability", "support").alias("line"))
    head = [(-1, CONSOLE_HEAD % CONSOLE_NAMES), (0, CONSOLE_RULE)]
    front = topk.agg(F.count("*").alias("n")).select(F.explode(F.when(F.col("n") > 0, F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(x).alias("line")) for k, x in head])).otherwise(F.array(F.struct(F.lit(0).alias("rank"), F.lit(CONSOLE_NONE).alias("line"))))).alias("x"))
    return front.select("x.*").unionByName(rows)


def console_configuration(tx: DataFrame, k: int, min_prob: float, start: Column) -> DataFrame:
    """at, line: what a search is asked for, with the sizes of its transactions and of the session."""
    context = tx.sparkSession.sparkContext
    memory = context._jvm.java.lang.Runtime.getRuntime().maxMemory() // (1 << 20)
    sizes = tx.agg(F.countDistinct("tid").alias("transactions"), F.countDistinct("item").alias("items"))
    values = {"transactions": F.col("transactions"), "items": F.col("items"), "k": F.lit(k), "min_prob": F.lit(float(min_prob)), "memory_mb": F.lit(memory), "threads": F.lit(context.defaultParallelism), "start": F.date_format(start, "yyyy-MM-dd HH:mm:ss")}
    title = " " * ((len(CONSOLE_BAR) - len(CONSOLE_TITLE)) // 2) + CONSOLE_TITLE
    lines = [F.lit(CONSOLE_BAR), F.lit(title), F.lit(CONSOLE_BAR), *[F.format_string(f, values[c]) for c, f in CONSOLE_LABELS.items()], F.lit(CONSOLE_BAR)]
    return sizes.select(F.posexplode(F.array(*lines)).alias("at", "line"))


def export(topk: DataFrame, path: str, kind: str) -> None:
    """Write as csv, json or text."""
    if kind == "csv":
        csv_rows(topk).coalesce(1).write.option("header", True).csv(path)
    elif kind == "json":
        json_rows(topk).select("value").coalesce(1).write.text(path)
    elif kind == "text":
        text_lines(topk).orderBy("rank").select("line").coalesce(1).write.text(path)
    else:
        raise ValueError(f"no export of kind {kind}")


def result_entities(topk: DataFrame, job_id: Column) -> DataFrame:
    """Stored form of a job's answers: the columns that every query on results reads, and the entity's own names beside them."""
    return ranked(topk).select(job_id.alias("job_id"), "items", "size", items_json(F.col("items")).alias("items_json"), F.col("size").alias("itemset_size"), "expected_utility", "probability", "support", "rank")
