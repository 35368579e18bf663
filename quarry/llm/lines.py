"""Fuzzy line deduplication by MinHash.

Lines are the pieces of a text between line feeds. All that hold more than
white space are compared, with runs of white space as one space and none at
the ends; equal ones (by 128-bit digest) are one class from the start, so copies
cost one partial aggregate. A class's shingles are the ``SHINGLE`` bytes of
UTF-8 that begin at each of its characters; a shorter line is one shingle. Its
signature is the minima of ``BANDS`` x ``ROWS`` hashes of its shingles, a hash of
each ``ROWS`` of them is a band. At similarity 0.8 two lines agree in a band with
a chance of 98.6 %.

The members of a bucket all meet one of them, its centre, so copies of one line with
small changes cost a row each. Where a bucket holds members unlike its centre, those meet
all others of the bucket, each pair exactly: both sides are cut into tiles of known size, and
a task counts the common shingles of two tiles by matrix products of their incidence.
Jaccard distance is a metric, so members whose distances from the centre differ by
more than the limit need no count. A task returns a link for each line, not for each pair, so rows
stay near linear; no cap is set on a bucket. Links merge components at the end. Two
similar lines are lost only if they share no band; the tests hold that against all pairs. The
first line of each component (by document, text, place) is kept.

Shingles of eight bytes are whole numbers, so the sets are exact. They are made
in NumPy from Arrow's buffers, since rows or lambdas for every character of the
corpus cost SQL functions more than the operator's whole budget (figures in the
README). Grouping, joins and components are Spark's; no text but that of lines
that meet others is shuffled.

Defined cases: null text has no lines; null ids come last and lose to any id;
rows that share an id or lack one are told apart by their text, and rows equal
in both get equal results, as one document; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.text import full_text
from quarry.llm.tokens import mixed
from quarry.plans.staging import discard, stage

SHINGLE, SIMILARITY = 8, 0.8
BANDS, ROWS = 6, 3
#: Lines and bytes of a tile, and shingles whose incidence is multiplied at a time.
TILE, TILE_BYTES, COLUMNS = 512, 1 << 18, 4096
#: Bytes of text worked on at a time, and shingles whose hashes are held at a time.
CHUNK_BYTES, CHUNK = 4 << 20, 1 << 15
#: Odd multipliers of the hashes of a signature.
FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def normalised(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and content of the lines that hold more than white space; runs of it are one space."""
    for pos, line in enumerate(text.split(b"\n")):
        if bare := b" ".join(line.split()):
            yield pos, bare


def line_shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all lines, repeats included, and where each line's begin.

    Lines shorter than a shingle are filled with a byte that UTF-8 never has.
    """
    full = [x.ljust(SHINGLE, b"\xff") for x in lines]
    data = np.frombuffer(b"".join(full), np.uint8)
    ends = np.cumsum([len(x) for x in full])
    every = np.ndarray((len(data) - SHINGLE + 1,), "<u8", data, strides=(1,))
    begins = np.zeros(len(data) + 1, np.int8)
    begins[ends - (SHINGLE - 1)] += 1
    begins[ends] -= 1
    begins = np.cumsum(begins[: len(every)], dtype=np.int8) == 0
    begins &= (data[: len(every)] & 0xC0) != 0x80  # bytes within a character
    at = np.flatnonzero(begins)
    return every[at], np.searchsorted(at, np.concatenate(([0], ends[:-1])))


def signatures(lines: list[bytes]) -> np.ndarray:
    """A row for each line: its bands."""
    shingles, starts = line_shingles(lines)
    ends = np.append(starts[1:], len(shingles))
    low = np.full((len(lines), BANDS * ROWS), np.uint64(0xFFFFFFFFFFFFFFFF))
    first = 0
    while first < len(lines):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, "right")))
        for begin in range(int(starts[first]), int(ends[last - 1]), CHUNK):  # more than once only for one long line
            stop = int(ends[last - 1]) if last > first + 1 else min(begin + CHUNK, int(ends[last - 1]))
            codes = mixed(shingles[begin:stop])
            at = np.maximum(starts[first:last], begin) - begin
            for k, factor in enumerate(FACTORS):
                low[first:last, k] = np.minimum(low[first:last, k], np.minimum.reduceat(codes * factor, at))
            if last > first + 1:
                break
        first = last
    bands = np.zeros((len(lines), BANDS), np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            bands[:, b] = mixed(bands[:, b] ^ low[:, b * ROWS + r] ^ np.uint64(b + 1))
    return bands


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``CHUNK_BYTES``."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_BYTES:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def line_rows(docs: DataFrame, with_bands: bool = False) -> DataFrame:
    """(doc_id, text_key, pos, key) of the lines that are compared, and ``bands`` if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            for low, high in _parts(texts):
                rows, places, keys, own, numbers = [], [], [], [], {}
                for k in range(low, high):
                    for pos, line in normalised(texts[k]):
                        key = hashlib.blake2b(line, digest_size=16).digest()
                        if with_bands and key not in numbers:
                            numbers[key] = len(own)
                            own.append(line)
                        rows.append(k)
                        places.append(pos)
                        keys.append(key)
                if not rows:
                    continue
                take = pa.array(rows)
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(places, pa.int32()), pa.array(keys, pa.binary())]
                if with_bands:
                    packed = signatures(own)[[numbers[x] for x in keys]].tobytes()
                    offsets = np.arange(len(keys) + 1, dtype=np.int32) * (8 * BANDS)
                    columns.append(pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "pos", "key", "bands"][: len(columns)])

    kind = dict(docs.dtypes)["doc_id"]
    return keyed(docs).select("doc_id", "text_key", "text").mapInArrow(run, f"doc_id {kind}, text_key long, pos int, key binary" + ", bands binary" * with_bands)


def keyed(docs: DataFrame) -> DataFrame:
    text = full_text(F.col("text"))
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))


def line_classes(docs: DataFrame) -> DataFrame:
    """Staged (id, key, n, first, bands): different lines."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "pos")).alias("first")
    grouped = line_rows(docs, True).groupBy("key").agg(F.min("bands").alias("bands"), F.count("*").alias("n"), first)
    return stage(grouped.withColumn("id", F.monotonically_increasing_id()), "line-classes")


def line_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Staged (id, line): the lines themselves of some classes, from their first places."""
    wanted = classes.groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.text_key").alias("_key")).agg(F.collect_list(F.struct("first.pos", "id")).alias("wanted"))  # of one text
    rows = keyed(docs)
    met = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))).select("doc_id", "text_key", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary()).to_pylist()
            for low, high in _parts(texts):
                ids, lines = [], []
                for text, wanted in zip(texts[low:high], batch.column(1).slice(low, high - low).to_pylist(), strict=True):
                    own = text.split(b"\n")
                    for x in wanted:
                        ids.append(x["id"])
                        lines.append(b" ".join(own[x["pos"]].split()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.binary())], ["id", "line"])

    return stage(met.select("text", "wanted").mapInArrow(run, "id long, line binary").dropDuplicates(["id"]), "line-texts")


def whole(line: bytes) -> np.ndarray:
    """The shingle set of a line."""
    return pd.unique(line_shingles([line])[0])


def judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Staged (a, b, similarity) of whole shingle sets; many pairs may share ``a``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, x, found = None, None, []
            a, lines_a, lines_b = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                if a[k] != last:
                    last, x = a[k], whole(lines_a[k].as_py())
                y = whole(lines_b[k].as_py())
                common = len(x) + len(y) - len(pd.unique(np.concatenate((x, y))))
                found.append(common / (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    side = lambda c: texts.select(F.col("id").alias(c), F.col("line").alias(f"line_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "line_a", "line_b")
    return stage(both.mapInArrow(run, "a long, b long, similarity double"), "line-judged")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of one side shares with each of the other."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x])) for x in (left, right)]
    shared = np.intersect1d(sides[0][0], sides[1][0])
    places = []
    for codes, owner in sides:
        at = np.minimum(np.searchsorted(shared, codes), max(0, len(shared) - 1))
        some = shared[at] == codes if len(shared) else np.zeros(len(codes), bool)
        order = np.argsort(at[some], kind="stable")
        places.append((at[some][order], owner[some][order]))
    for low in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - low)
        blocks = []
        for (at, owner), n in zip(places, (len(left), len(right)), strict=True):
            part = slice(*np.searchsorted(at, (low, low + width)))
            block = np.zeros((n, width), np.float32)
            block[owner[part], at[part] - low] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


def tile_links(ids: tuple[np.ndarray, np.ndarray], near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from each line with a neighbour to the smallest id that ``near`` (rows, columns) reaches."""
    labels = [x.copy() for x in ids]
    none = np.int64(np.iinfo(np.int64).max)
    while True:
        first = np.minimum(labels[0], np.where(near, labels[1][None, :], none).min(axis=1, initial=none))
        second = np.minimum(labels[1], np.where(near, first[:, None], none).min(axis=0, initial=none))
        if (first == labels[0]).all() and (second == labels[1]).all():
            break
        labels = [first, second]
    a, b = np.concatenate(ids), np.concatenate(labels)
    return a[a != b], b[a != b]


def tiled(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links of the members of open buckets (bucket, id, similarity to the centre, unlike), every pair of them with one unlike judged."""
    sized = members.join(texts.select("id", F.octet_length("line").alias("bytes")), "id")
    tiles = lambda c: F.greatest(F.ceil(F.count_if(c) / TILE), F.ceil(F.sum(F.when(c, F.col("bytes"))) / TILE_BYTES)).cast("int")
    counts = sized.groupBy("bucket").agg(tiles(F.col("unlike")).alias("asks"), tiles(F.lit(True)).alias("offers"))
    rows = sized.join(counts, "bucket").join(texts, "id")
    place = lambda n: F.pmod(F.xxhash64("id", "bucket"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ("bucket", "id", "line", "similarity", "unlike")
    left = rows.filter("unlike").select(*kept, place("asks").alias("ask"), "offers").select(*kept, "ask", every("offers").alias("offer"))
    right = rows.select(*[F.col(c).alias(c) for c in kept], place("offers").alias("offer"), "asks").select(*kept, every("asks").alias("ask"), "offer")

    def run(asked: pa.Table, offered: pa.Table) -> pa.Table:
        ids = [t["id"].to_numpy() for t in (asked, offered)]
        out = (np.zeros(0, np.int64),) * 2
        if len(ids[0]) and len(ids[1]):
            far = [1 - t["similarity"].to_numpy() for t in (asked, offered)]
            unlike = offered["unlike"].to_numpy().astype(bool)
            open_ = np.abs(far[0][:, None] - far[1][None, :]) <= 1 - SIMILARITY + 1e-9
            open_ &= ~unlike[None, :] | (ids[1][None, :] > ids[0][:, None])
            rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if len(rows) and len(columns):
                sets = [[whole(t["line"][int(k)].as_py()) for k in some] for t, some in ((asked, rows), (offered, columns))]
                common = common_counts(*sets)
                sizes = [np.array([len(x) for x in side], np.float64) for side in sets]
                near = common >= SIMILARITY * (sizes[0][:, None] + sizes[1][None, :] - common) - 1e-9
                out = tile_links((ids[0][rows], ids[1][columns]), near & open_[np.ix_(rows, columns)])
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    keys = ("bucket", "ask", "offer")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "a long, b long")


def _keys() -> Column:
    """A row for each band."""
    return F.explode(F.array(*[F.xxhash64(F.lit(b), F.substr("bands", F.lit(8 * b + 1), F.lit(8))) for b in range(BANDS)])).alias("bucket")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links that connect all similar classes that share a band."""
    rows = classes.select("id", _keys())
    buckets = rows.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("high")).filter("centre < high").drop("high")
    met = stage(rows.join(buckets, "bucket"), "line-met")
    if met.isEmpty():
        return classes.sparkSession.createDataFrame([], "a long, b long")
    texts = line_texts(docs, classes.select("id", "first").join(met.select("id").distinct(), "id", "left_semi"))
    first = judged(met.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), texts)
    like = F.col("similarity") >= SIMILARITY - 1e-9
    known = met.join(first.select(F.col("a").alias("centre"), F.col("b").alias("id"), "similarity"), ["centre", "id"]).select("bucket", "id", "similarity", (~like).alias("unlike"))
    known = stage(known, "line-known")
    discard(met)
    # nothing is left to find where one member alone is unlike the centre and none is like it
    open_ = known.groupBy("bucket").agg(F.count_if("unlike").alias("n"), F.count("*").alias("all")).filter("n >= 1 and all >= 2").select("bucket")
    second = stage(tiled(known.join(open_, "bucket", "left_semi"), texts).distinct(), "line-tiles")
    discard(known, texts)
    return first.filter(like).select("a", "b").unionByName(second)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos): lines that repeat, exactly or nearly, a line kept elsewhere."""
    classes = line_classes(docs)
    found = components(links(docs, classes), name="line-links")
    rooted = classes.select("id", "key", "n", "first").join(found, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    keep = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("rows")).filter("rows > 1")
    affected = stage(rooted.join(keep, "root").select("key", "keep"), "line-keep")
    met = line_rows(docs).join(affected, "key")
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_key") == F.col("keep.text_key")) & (F.col("pos") == F.col("keep.pos"))
    return met.filter(~kept).select("doc_id", "text_key", "pos")


def with_removed(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """``columns`` of every row, and ``gone``: the places of its removed lines in order, never null."""
    gone = removed_lines(docs).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("gone")).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    rows = docs.select(*columns, F.col("doc_id").alias("_id"), F.xxhash64(full_text(F.col("text"))).alias("_text_key"))
    met = rows.join(gone, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")), "left")
    return met.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>"))).drop("_doc", "_key", "_id", "_text_key")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every row's text without its removed lines."""
    met = with_removed(docs, [F.col("doc_id"), F.col("text")])
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return met.select("doc_id", F.when(F.size("gone") == 0, F.col("text")).otherwise(kept).alias("text"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the numbers of their lines that repeat others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines")
    met = with_removed(docs, [F.col("doc_id"), n_lines])
    return met.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.transform("gone", lambda x: x.cast("string")), ",").alias("removed"))
