"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has a bit set where over half of its shingles' hashes
have it. Fingerprints at most ``RADIUS`` bits apart link; documents are grouped
by the components of these links. Equal fingerprints are one node whatever the
number of documents, so copies are never paired.

The hashes are made by Spark's own xxhash64; only the 64 bit counts of each
document are taken in NumPy, over Arrow's flat arrays.

Defined cases: texts without words have fingerprint zero and form one class,
null ids are fingerprinted like others but never name a component unless the
whole component lacks ids, repeated rows share a component, an empty table
gives no rows, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.text import LOWER, UPPER, full_text, let, words
from quarry.plans.staging import stage

SHINGLE, RADIUS = 3, 3
#: Members of a bucket above which they are linked through neighbours, not pair by pair.
FULL_BUCKET = 256
#: Hashes whose bits are unpacked at a time: 64 bytes for each.
CHUNK = 1 << 18


def lowered_words(text: Column) -> Column:
    full = full_text(text)
    return words(F.when(F.length(full) == F.octet_length(full), F.lower(full)).otherwise(F.translate(full, UPPER, LOWER)))


def shingle_codes(text: Column, k: int = SHINGLE) -> Column:
    """XXH64 with seed 42 of each shingle of ``k`` words, repeats included."""
    one = lambda w: F.array(F.xxhash64(F.array_join(w, " ")))
    many = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)])))
    return let(lowered_words(text), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < k, one(w)).otherwise(many(w)))


def majority_bits(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each list of codes the 64 bits that are set in over half of them."""
    n = len(offsets) - 1
    counts = np.zeros((n, 64), np.int64)
    for low in range(int(offsets[0]), int(offsets[-1]), CHUNK):
        high = min(low + CHUNK, int(offsets[-1]))
        bits = np.unpackbits(codes[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = int(np.searchsorted(offsets, low, "right")) - 1
        last = int(np.searchsorted(offsets, high, "left"))
        owners = np.arange(first, last)
        starts = np.maximum(offsets[first:last], low) - low
        full = np.minimum(offsets[first + 1 : last + 1], high) - low > starts  # lists without codes own nothing
        counts[owners[full]] += np.add.reduceat(bits, starts[full], axis=0, dtype=np.int64)
    sizes = np.diff(offsets)[:, None]
    return np.packbits(counts * 2 > sizes, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row, as a signed long."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            codes = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).view(np.uint64)
            fps = majority_bits(codes, lists.offsets.to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, shingle_codes(F.col(text_col)).alias("codes")).mapInArrow(reduce, f"`{id_col}` {kind}, fp long")


def _flipped(value: Column, bits: int) -> Column:
    """``value`` itself and each value at one bit's distance."""
    return F.array(value, *[value.bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(bits)])


def links(fps: DataFrame, full_bucket: int = FULL_BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that give their 3-bit graph's components.

    Each fingerprint is indexed under both halves. Two within three bits agree
    in a half up to one bit, so the ball of radius 1 around each half is probed;
    of two halves one bit apart only that with the bit set needs to probe, by
    clearing it. What a probe fetches is verified over all 64 bits.

    A bucket of more than ``full_bucket`` fingerprints is not paired: within it
    the other halves meet at common neighbours z. Members at most one bit from
    z are at most two apart, a member one bit from z and one two bits from z
    are at most three apart, so all of these link to the smallest of the first
    kind - every pair within three bits shares such a z, and rows stay linear.
    """
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    halves = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).cast("tinyint").alias("seg"), F.shiftrightunsigned("fp", 32).alias("half"), low.alias("other")), F.struct(F.lit(1).cast("tinyint").alias("seg"), low.alias("half"), F.shiftrightunsigned("fp", 32).alias("other")))).alias("x")).select("fp", "x.*")
    index = stage(halves, "simhash-index")
    cleared = F.filter(F.array(*[F.when(F.col("half").bitwiseAND(F.lit(1 << b).cast("long")) != 0, F.col("half").bitwiseXOR(F.lit(1 << b).cast("long"))) for b in range(32)]), lambda x: x.isNotNull())
    probes = index.select("seg", F.explode(F.concat(F.array("half"), cleared)).alias("half"), F.col("fp").alias("a"))
    full = stage(index.groupBy("seg", "half").count().filter(F.col("count") > full_bucket).select("seg", "half"), "simhash-full")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    table = index.select("seg", "half", F.col("fp").alias("b"))
    if full.isEmpty():
        return probes.join(table, ["seg", "half"]).filter(near & (F.col("a") != F.col("b"))).select("a", "b")
    paired = probes.join(table.join(full, ["seg", "half"], "left_anti"), ["seg", "half"]).filter(near & (F.col("a") != F.col("b"))).select("a", "b")
    # rows of full buckets: (bucket, fingerprint, its other half, is it a member)
    met = index.select(F.col("fp").alias("_fp"), "seg", F.col("half").alias("_half"), "other")
    asked = met.select("_fp", "seg", "_half", "other", F.explode(_flipped(F.col("_half"), 32)).alias("half")).join(full, ["seg", "half"])
    asked = stage(asked.select("seg", "half", F.col("_fp").alias("fp"), "other", (F.col("half") == F.col("_half")).alias("member")), "simhash-asked")
    close = asked.withColumn("z", F.explode(_flipped(F.col("other"), 32)))
    far = asked.filter("member").withColumn("z", F.explode(F.array(*[F.col("other").bitwiseXOR(F.lit((1 << i) | (1 << j)).cast("long")) for i in range(32) for j in range(i)])))
    centre = close.filter("member").groupBy("seg", "half", "z").agg(F.min("fp").alias("b"))
    stars = close.unionByName(far).join(centre, ["seg", "half", "z"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return paired.unionByName(stars.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full_bucket: int = FULL_BUCKET) -> DataFrame:
    """(id, fp, component_id): every row with the smallest id that its fingerprint's links reach."""
    marked = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    first = stage(marked.groupBy("fp").agg(F.min(id_col).alias("first_id")), "fingerprint-classes")
    found = stage(components(links(first.select("fp"), full_bucket), name="simhash-links"), "simhash-components")
    root = first.join(found, first["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = stage(root.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return marked.join(classes, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that lead their near-duplicate group, one for each group.

    Rows that repeat the leading id are reduced to one as well; rows without
    an id stay, as they can't be told to be the same document.
    """
    kept = near_duplicates(docs, id_col, text_col).filter(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(id_col).agg(F.count("*").alias("n"))
    kept = stage(kept, "simhash-kept")
    leaders = docs.join(kept.select(id_col).hint("merge"), id_col, "left_semi")  # a row for each document: never broadcast
    if not kept.filter("n > 1").isEmpty():
        repeated = kept.filter("n > 1").select(id_col)
        leaders = leaders.join(repeated, id_col, "left_anti").unionByName(leaders.join(repeated, id_col, "left_semi").dropDuplicates([id_col]))
    return leaders.unionByName(docs.filter(F.col(id_col).isNull()))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and near-duplicate component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
