"""Mixing sources to target weights.

Method: each document gets a hash-random key (of the seed, its id and its
content); within each source the documents are range-sorted by that key and
distributed prefix sums of their token counts are cut at the source's budget.
A budget above the source's size first takes the whole source as an epoch and
then cuts what is left. A document is taken whole: the one at the cut is in if
its middle token is, so a source misses its target by half a document at most.

Only keys and sizes are sorted. What is taken of a source is a beginning of its
order, so the last key that is in, one for each source, decides for every
document where it lies, and texts are not shuffled.

Targets: sources in code point order, null last, weigh ``weights`` in turn and
share ``share`` times all tokens; a target stops at ``cap`` times its source's
size and the excess is shared again by weight until none is above.

Defined cases: null text has size 0 and is never taken, null sources form one
source, rows of one id and text have equal keys and are taken or left alike, an
empty table gives no rows, extra columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.prefix import prefix_sums
from quarry.llm.text import full_text, word_count
from quarry.plans.staging import stage

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2.0, "mix-1"


def group_key(source: Column) -> Column:
    """A key without nulls that keeps code point order and puts null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From one row for each source (``_group``, ``source_size``) the tokens to take (``target``).

    Water filling: a source is capped once the level (tokens for each unit of
    weight) reaches cap * size / weight. Sources in order of that ratio, the
    prefix sums of limits and weights give the level at which each one would
    settle, and the first that stays below its limit sets the level of all
    that are left. Three sorts by range, whatever the number of sources.
    """
    one = sizes.withColumn("_one", F.lit(1).cast("long"))
    turned = prefix_sums(one, ["_group"], {"_turn": "_one"}, name="sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_turn") % len(weights) + 1).cast("int"))
    table = turned.select("_group", "source_size", weight.alias("_weight"), (F.col("source_size") * cap).alias("_limit")).withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    whole = table.agg(F.sum("source_size"), F.sum("_weight")).first()
    total, weights_sum = share * float(whole[0] or 0), float(whole[1] or 0)
    settled = prefix_sums(table, ["_ratio", "_group"], {"_below": "_limit", "_used": "_weight"}, name="levels")
    level = (F.lit(total) - F.col("_below")) / (F.lit(weights_sum) - F.col("_used"))
    first = settled.withColumn("_level", level).filter(F.col("_level") < F.col("_ratio")).agg(F.min_by("_level", F.struct("_ratio", "_group"))).first()[0]  # one row
    target = F.col("_limit") if first is None else F.least(F.col("_limit"), F.col("_weight") * F.lit(max(0.0, first)))
    return table.select("_group", "source_size", target.alias("target"))


def row_key(id_col: str, text_col: str, seed: str) -> Column:
    return F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(full_text(F.col(text_col)).cast("binary"))).cast("binary"))


def cuts(keyed: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(_group, source_size, target, _epochs, _last) for rows (_group, _key, _size): whole epochs, and the last key of the rest.

    Rows of one key count as one in the order, with the sum of their sizes.
    """
    slim = stage(keyed.select("_group", "_key", "_size"), "mix-keys")
    targets = stage(source_targets(slim.groupBy("_group").agg(F.sum("_size").alias("source_size")), weights, share, cap), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("_epochs", epochs)
    order = slim.filter("_size > 0").groupBy("_group", "_key").agg(F.sum("_size").alias("_size"))
    summed = prefix_sums(order, ["_key"], {"_before": "_size"}, group="_group", name="mix")
    inside = F.col("_before") + F.col("_size") / 2 <= F.col("target") - F.col("_epochs") * F.col("source_size")
    last = summed.join(targets, "_group").filter(inside).groupBy("_group").agg(F.max("_key").alias("_last"))
    return stage(targets.join(last, "_group", "left"), "mix-cuts")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str = "size", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """(row, source_size, target, copies): each row of ``df`` as a struct, and how often it is taken.

    ``size_col`` must hold the token counts. ``text_col`` only breaks ties between ids.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    keyed = df.select(row, group_key(F.col(source_col)).alias("_group"), row_key(id_col, text_col, seed).alias("_key"), F.col(size_col).cast("long").alias("_size"))
    met = keyed.join(cuts(keyed, weights, share, cap), "_group")  # a row for each source
    copies = F.when(F.col("_size") > 0, F.col("_epochs") + F.coalesce(F.col("_key") <= F.col("_last"), F.lit(False)).cast("long")).otherwise(0).cast("long")
    return met.select("row", "source_size", "target", copies.alias("copies"))


def mixed_rows(df: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, with the columns of ``df``."""
    names = {k: options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole")
    sized = df.select(row, *[F.col(f"`{v}`").alias(k) for k, v in names.items()], word_count(F.col(f"`{names['text_col']}`")).alias("size"))
    taken = mix(sized, **{**options, **{k: k for k in names}, "size_col": "size"}).filter("copies > 0")
    return taken.select("row.whole", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("whole.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words at weights 3, 1, 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    sized = stage(docs.select("doc_id", "source", word_count(text).alias("size"), F.md5(full_text(text).cast("binary")).alias("_digest")), "mix-sizes")
    return mix(sized, text_col="_digest").select("row.doc_id", "row.size", "source_size", "target", (F.col("row.size") * F.col("copies")).alias("taken"))
