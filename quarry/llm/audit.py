"""Audit of how five filters act together, for every order in which they may run.

Each document is a mask of the filters that it fails. For every part and label
class, 32 signed parity sums are taken: sum S adds a document, or subtracts it
if it fails an odd number of the filters in S. They are one partial aggregate of
32 numbers, and a Walsh-Hadamard inversion turns them exactly into the number of
documents of each mask. All 120 orders are then sums over these 32 cells, and a
filter's Shapley value needs no orders at all: of the filters that a document
fails each is the first in equally many orders, so it gets 120 / failures.

Equal texts are found by a 128-bit digest in aggregates of slim rows, first by
id and then by digest; no text is shuffled, and a group of copies is combined
before it moves, however large.

Defined cases: null text is empty, null language is the part ''; documents
without an id repeat nobody and have no label; rows that repeat an id and a
text are not copies of each other; of several labels of one id a 1 wins;
labels of no document are ignored; an empty table has no parts and gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.text import full_text, let, words

#: The filters, in the order of their bits, and how many masks and orders there are.
FILTERS = "ABCDE"
MASKS, ORDERS = 1 << len(FILTERS), ["".join(x) for x in permutations(FILTERS)]
#: Production parameters: fewest words, least share of different words and largest share of capitals in hundredths.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
SYMBOLS = "[#$%&*|]"


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def own_failures(text: Column) -> Column:
    """The mask of the filters that a text fails by itself, which are all but E."""
    def of(w: Column) -> Column:
        few = F.size(w) < MIN_WORDS
        dull = 100 * F.size(F.array_distinct(w)) < MIN_DISTINCT * F.size(w)
        return F.when(few, _bit("A")).otherwise(0) + F.when(dull, _bit("B")).otherwise(0)

    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    loud = 100 * capitals.cast("long") > MAX_CAPITALS * F.length(text).cast("long")
    return let(words(text), of) + F.when(loud, _bit("C")).otherwise(0) + F.when(text.rlike(SYMBOLS), _bit("D")).otherwise(0)


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n): how many documents of a part and label class fail just the filters of ``mask``."""
    text = full_text(F.col("text"))
    digest = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
    rows = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("lang", F.lit("")).alias("part"), own_failures(text).alias("own"), *digest)
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marked = labels.groupBy(F.col("doc_id").alias("_id")).agg(one("quality"), one("toxic"))
    met = rows.join(marked, F.col("_doc") == F.col("_id"), "left").drop("_id")
    cell = ["k1", "k2", "part", "own", "good", "toxic"]
    met = met.select("_doc", "k1", "k2", "part", "own", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    by_id = met.groupBy("_doc", *cell).agg(F.count("*").alias("n"))
    # of each cell: all of its rows, those without an id, and those of its smallest id
    cells = by_id.groupBy(*cell).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_doc").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("_doc").isNotNull(), F.struct("_doc", "n"))).alias("first"))
    least = cells.groupBy("k1", "k2").agg(F.min("first._doc").alias("least"))
    placed = cells.join(least, ["k1", "k2"]).withColumn("fresh", F.col("nameless") + F.when(F.col("first._doc") == F.col("least"), F.col("first.n")).otherwise(0))
    both = F.explode(F.array(F.struct(F.col("own").alias("mask"), F.col("fresh").alias("n")), F.struct((F.col("own") + _bit("E")).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))).alias("x")
    return placed.select("part", "good", "toxic", both).select("part", "good", "toxic", "x.mask", "x.n")


def parity_sums(counted: DataFrame) -> DataFrame:
    """(part, good, toxic, w): ``w[S]`` adds n with the sign of the parity of the failures within S."""
    sign = lambda s: F.when(F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2 == 0, F.col("n")).otherwise(-F.col("n"))
    sums = counted.groupBy("part", "good", "toxic").agg(*[F.sum(sign(s)).alias(f"w{s}") for s in range(MASKS)])
    return sums.select("part", "good", "toxic", F.array(*[f"w{s}" for s in range(MASKS)]).alias("w"))


def mask_cells(sums: DataFrame) -> DataFrame:
    """(part, cells): the inversion; ``cells[mask]`` holds the number of documents, of good and of toxic ones."""
    signs = F.array(*[F.array(*[F.lit(-1 if (m & s).bit_count() % 2 else 1).cast("long") for s in range(MASKS)]) for m in range(MASKS)])
    dot = lambda row: (F.aggregate(F.zip_with(F.col("w"), row, lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b) / MASKS).cast("long")
    each = sums.select("part", "good", "toxic", F.posexplode(F.transform(signs, dot)).alias("mask", "n"))
    if_ = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    by_mask = each.groupBy("part", "mask").agg(F.sum("n").alias("n"), if_("good").alias("good"), if_("toxic").alias("toxic"))
    return by_mask.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))  # 32 of a part


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step, with the counts of the filter of that step."""
    orders = F.explode(F.array(*[F.struct(F.lit(x).alias("filter_order"), F.array(*[F.lit(_bit(f)) for f in x]).alias("bits")) for x in ORDERS])).alias("o")
    cells = mask_cells(parity_sums(failure_counts(docs, labels))).select("part", "cells", orders).select("part", "cells", "o.*")
    steps = cells.select("part", "cells", "filter_order", "bits", F.posexplode("bits").alias("at", "own"))
    steps = steps.withColumns({"step": F.col("at") + 1, "before": F.aggregate(F.slice("bits", F.lit(1), F.col("at")), F.lit(0), lambda a, b: a + b)}).withColumn("upto", F.col("before") + F.col("own"))
    zero = F.lit(0).cast("long")
    total = lambda when, value: F.aggregate("cells", zero, lambda a, c: a + F.when(when(c["mask"]), value(c)).otherwise(0).cast("long"))
    has = lambda m, c: m.bitwiseAND(F.col(c)) != 0
    here = lambda m: has(m, "own") & ~has(m, "before")
    n = lambda c: c["n"]
    return steps.select(
        "part", "filter_order", "step", total(lambda m: ~has(m, "upto"), n).alias("kept"), total(here, n).alias("removed"), total(lambda m: has(m, "own") & has(m, "before"), n).alias("redundant"), total(lambda m: m == F.col("own"), n).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"), total(here, lambda c: c["toxic"]).alias("toxic_lost"), total(lambda m: has(m, "own"), lambda c: c["n"] * (len(ORDERS) / F.bit_count(c["mask"]))).alias("shapley"),
    )


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' failures of the five filters, in all orders."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
