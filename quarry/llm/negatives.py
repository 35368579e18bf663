"""Hard negatives by a k-nearest-neighbour join over Voronoi cells.

Vectors become whole numbers, and a last coordinate brings all of them to the length of
the longest, so that the nearest to an anchor (whose own last coordinate is 0) is the one
of the largest inner product. Every vector lies in the cell of its nearest pivot, every
anchor in the group of its own. From the distances of a group's anchors to a pivot and
of a vector to that pivot follow bounds of their score; a vector goes only to the
groups that its bounds admit.

A search runs twice. At home, each group meets the vectors that are nearest to its own
pivot, which gives every anchor a score that its answers have to reach; then the group
meets the others that may still reach it. The same search serves positives (the best of
the same label) and negatives (for every positive, the best of other labels within a
window below the positive's score).

Where a group and its vectors meet, both are cut into slices of known size: every slice
of anchors meets every slice of vectors in a task's memory, as blocks of a matrix
product, and hands on its best few. No group is held by one task, however many vectors
are equal. Pivots (at most ``PIVOTS`` rows) and a few bounds for each group are all that the
driver sees; pivots are those rows of the table whose ids have the smallest hashes, and they
decide about the work alone, never about the result.

Defined cases: rows whose id, label, vector or a component is null take no part, nor
do those with a component that is not finite or whose whole number leaves 32 bits; vectors shorter than others
count as filled with zeros; of rows that share an id the one of the smallest label and
vector takes part; an empty table, or one without anchors, gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.staging import discard, stage

SCALE, LABELS, EVERY = 256, 10, 100
POSITIVES, NEGATIVES = 5, 5
#: Negatives score at least so many hundredths of their positive.
WINDOW = 80
#: Cells; anchors for which there is one group (at most ``PIVOTS``); rows of a slice of anchors and of one of vectors.
PIVOTS, GROUP, ASKED, SLICE = 64, 256, 1024, 16_384
#: Rows of a block of the matrix product.
BLOCK = 128
LOWEST, HIGHEST = -(1 << 62), 1 << 62
QUERY = "anchor_id long, label int, vec binary, grp int, key long, low long, high long"
FOUND = "anchor_id long, key long, vec_id long, score long"


def whole_vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows of (vec_id, embedding, label) that take part; their whole numbers, flat, with offsets; squared lengths."""
    lists = batch.column(1)
    ok = np.array(lists.is_valid()) & np.array(batch.column(0).is_valid()) & np.array(batch.column(2).is_valid())
    lists = lists.filter(pa.array(ok))
    values = lists.flatten()
    numbers = np.floor(SCALE * values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))  # null turns into nan
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(numbers) < 2.0**31)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])
    fine = total(bad) == 0
    numbers[bad] = 0
    rows = np.flatnonzero(ok)[fine]
    numbers = numbers[np.repeat(fine, sizes)]
    sizes = sizes[fine]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return rows, numbers.astype(np.int64), offsets, total(numbers * numbers).astype(np.float64) if len(numbers) else np.zeros(len(rows))


def matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows of 64-bit floats, filled with zeros."""
    out = np.zeros((len(packed), width))
    sizes = {len(x) for x in packed}
    if sizes == {4 * width}:
        out[:] = np.frombuffer(b"".join(packed), "<i4").reshape(-1, width)
    else:
        for k, x in enumerate(packed):
            out[k, : len(x) // 4] = np.frombuffer(x, "<i4")
    return out


def distinct_ids(table: DataFrame) -> DataFrame:
    """(vec_id, embedding, label), one row for each id."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("int").alias("label")).filter("vec_id is not null and label is not null and embedding is not null")
    again = stage(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "vector-repeats")
    if again.isEmpty():
        return rows
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    one = rows.join(again, "vec_id").filter(sound).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x")).select("vec_id", "x.embedding", "x.label")
    return rows.join(again, "vec_id", "left_anti").unionByName(one)


class Space:
    """Pivots, the length that all vectors are brought to, and what bounds follow from them."""

    def __init__(self, width: int, longest: float, pivots: list[bytes], groups: int):
        self.width, self.longest, self.groups = width, longest, groups
        own = matrix(pivots, width)
        self.pivots = np.hstack([own, np.sqrt(np.maximum(0, longest - (own * own).sum(axis=1)))[:, None]])

    def distances(self, vectors: np.ndarray, anchors: bool) -> np.ndarray:
        """From each vector to each pivot; an anchor has no last coordinate."""
        squares = (vectors * vectors).sum(axis=1)
        last = np.zeros(len(vectors)) if anchors else np.sqrt(np.maximum(0, self.longest - squares))
        lengths = squares + last * last
        return np.sqrt(np.maximum(0, lengths[:, None] + self.longest - 2 * (np.hstack([vectors, last[:, None]]) @ self.pivots.T)))

    def score_bounds(self, near: np.ndarray, far: np.ndarray, low_square: np.ndarray, high_square: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score (vectors, groups) of vectors at ``distance`` from their pivot, which is ``near`` to ``far`` from the anchors."""
        slack = 1e-6 * (self.longest + 1)
        least = np.maximum(0, np.maximum(near - distance[:, None], distance[:, None] - far))
        most = far + distance[:, None]
        return (low_square + self.longest - most * most) / 2 - slack, (high_square + self.longest - least * least) / 2 + slack


def space_of(rows: DataFrame) -> tuple[Space, int] | None:
    """The space of a table and how many anchors it has; None without any."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, _, offsets, squares = whole_vectors(batch)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[places]
            if len(places):
                yield pa.RecordBatch.from_pydict({"n": [int((ids % EVERY == 0).sum())], "width": [int(np.diff(offsets).max())], "longest": [float(squares.max())]})

    n, width, longest = rows.mapInArrow(measure, "n long, width long, longest double").agg(F.sum("n"), F.max("width"), F.max("longest")).first()
    if not n:
        return None
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * PIVOTS).toArrow()  # some may take no part
    packed = []
    for batch in drawn.to_batches():
        _, numbers, offsets, _ = whole_vectors(batch)
        packed += [numbers[a:b].astype("<i4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    packed = list(dict.fromkeys(packed))[:PIVOTS] or [b""]
    return Space(width, longest, packed, max(1, min(len(packed), n // GROUP))), n


def placed(rows: DataFrame, space: Space) -> DataFrame:
    """Staged (vec_id, label, vec, cell, distance, home): every row's cell, and the group whose pivot is nearest to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, numbers, offsets, _ = whole_vectors(batch)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[places].astype(np.int64)
            labels = batch.column(2).to_numpy(zero_copy_only=False)[places].astype(np.int64)
            labels = np.where(ids % 7 == 0, (labels + 1) % LABELS, labels)
            packed = [numbers[a:b].astype("<i4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            far = space.distances(matrix(packed, space.width), False)
            cell = far.argmin(axis=1) if len(far) else np.zeros(0, int)
            home = far[:, : space.groups].argmin(axis=1) if len(far) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels.astype(np.int32)), pa.array(packed, pa.binary()), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell]), pa.array(home.astype(np.int32))], ["vec_id", "label", "vec", "cell", "distance", "home"])

    return stage(rows.mapInArrow(run, "vec_id long, label int, vec binary, cell int, distance double, home int"), "vectors")


def grouped_anchors(vectors: DataFrame, space: Space) -> tuple[DataFrame, list]:
    """Staged (anchor_id, label, vec, grp), and for each group the nearest and farthest of its anchors to every pivot and their squared lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = matrix(batch.column(2).to_pylist(), space.width)
            far = space.distances(own, True)
            group = far[:, : space.groups].argmin(axis=1) if len(far) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group.astype(np.int32)), pa.array(list(far), pa.list_(pa.float64())), pa.array((own * own).sum(axis=1))], ["anchor_id", "label", "vec", "grp", "far", "square"])

    rows = vectors.filter(F.col("vec_id") % EVERY == 0).select("vec_id", "label", "vec")
    found = stage(rows.mapInArrow(run, "anchor_id long, label int, vec binary, grp int, far array<double>, square double"), "anchors")
    bounds = [f(F.col("far")[j]).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(len(space.pivots))]
    reach = found.groupBy("grp").agg(F.min("square"), F.max("square"), *bounds).collect()  # a row for each group
    return found.drop("far", "square"), reach


def _sliced(key: Column, counts: dict[int, int], size: int) -> tuple[Column, Column]:
    """How many slices a row's group has, and the row's own."""
    slices = F.element_at(F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, -(-n // size))]), F.col("grp"))
    return slices, F.pmod(F.xxhash64(key), slices).cast("int")


def meet(queries: DataFrame, vectors: DataFrame, space: Space, best: int, same: bool) -> DataFrame:
    """The ``best`` answers of every query among the vectors of its group, from every pair of slices."""
    size = lambda df: {r["grp"]: r["count"] for r in df.groupBy("grp").count().collect()}  # noqa: E731  a row for each group
    asked, offered = size(queries), size(vectors)
    both = asked.keys() & offered.keys()
    if not both:
        return queries.sparkSession.createDataFrame([], FOUND)
    asked, offered = {g: asked[g] for g in both}, {g: offered[g] for g in both}
    of_asked, asks = _sliced(F.col("anchor_id"), asked, ASKED)
    of_offered, offers = _sliced(F.col("vec_id"), offered, SLICE)
    in_both = F.col("grp").isin(*both)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = queries.filter(in_both).withColumn("asks", asks).withColumn("offers", every(of_offered))
    right = vectors.filter(in_both).withColumn("offers", offers).withColumn("asks", every(of_asked)).select("vec_id", "label", "vec", "grp", "asks", "offers")
    width, exact = space.width, space.longest < 2.0**53

    def join(asked: pa.Table, offered: pa.Table) -> pa.Table:
        none = {"anchor_id": [], "key": [], "vec_id": [], "score": []}
        out = {k: [np.zeros(0, np.int64)] for k in none}
        if asked.num_rows and offered.num_rows:
            asked, offered = asked.sort_by("anchor_id"), offered.sort_by("vec_id")
            column = lambda t, c: t[c].to_numpy()
            have = matrix(offered["vec"].to_pylist(), width)
            ids, labels = column(offered, "vec_id"), column(offered, "label")
            if not exact:
                have = have.astype(np.int64)
            anchors, keys, lows, highs, own = (column(asked, c) for c in ("anchor_id", "key", "low", "high", "label"))
            packed = asked["vec"].to_pylist()
            for at in range(0, len(anchors), BLOCK):
                part = slice(at, at + BLOCK)
                first, back = np.unique(anchors[part], return_index=True, return_inverse=True)[1:]
                some = matrix([packed[at + k] for k in first], width).astype(have.dtype)
                scores = (some @ have.T)[back].astype(np.int64)
                fit = (scores >= lows[part, None]) & (scores <= highs[part, None]) & (ids[None, :] != anchors[part, None])
                fit &= (labels[None, :] == own[part, None]) if same else (labels[None, :] != own[part, None])
                scores[~fit] = LOWEST - 1
                if scores.shape[1] > best:
                    fit &= scores >= np.partition(scores, -best, axis=1)[:, -best][:, None]
                row, col = np.nonzero(fit)
                order = np.lexsort((col, -scores[row, col], row))  # columns lie by id
                row, col = row[order], col[order]
                begin = np.searchsorted(row, row)
                keep = np.arange(len(row)) - begin < best
                row, col = row[keep], col[keep]
                for name, value in (("anchor_id", anchors[part][row]), ("key", keys[part][row]), ("vec_id", ids[col]), ("score", scores[row, col])):
                    out[name].append(value)
        return pa.table({k: pa.array(np.concatenate(v), pa.int64()) for k, v in out.items()})

    keys = ["grp", "asks", "offers"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(join, FOUND)


def first_of(found: DataFrame, best: int) -> DataFrame:
    """The ``best`` answers of every query, with ``rank``; what a task knows to be too far down is not shuffled."""
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def routed(vectors: DataFrame, space: Space, reach: list, wanted: dict[int, tuple[int, int]]) -> DataFrame:
    """Rows of ``vectors`` with ``grp``: a row for each group but their own whose wanted scores they may have."""
    groups = [r for r in reach if r["grp"] in wanted]
    p = len(space.pivots)
    own = np.array([r["grp"] for r in groups], np.int32)
    low_square, high_square = (np.array([r[c] for r in groups], float) for c in (1, 2))
    near, far = (np.array([r[3 + k * p : 3 + (k + 1) * p] for r in groups], float).reshape(-1, p) for k in (0, 1))
    low, high = (np.array([wanted[g][k] for g in own], float) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance, home = (batch.column(k).to_numpy() for k in (3, 4, 5))
            least, most = space.score_bounds(near[:, cell].T, far[:, cell].T, low_square, high_square, distance)
            row, col = np.nonzero((most >= low) & (least <= high) & (home[:, None] != own))
            taken = batch.select([0, 1, 2]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(own[col])], ["vec_id", "label", "vec", "grp"])

    return vectors.mapInArrow(run, "vec_id long, label int, vec binary, grp int")


def search(queries: DataFrame, vectors: DataFrame, space: Space, reach: list, best: int, same: bool) -> DataFrame:
    """Staged (anchor_id, key, vec_id, score, rank): the first ``best`` answers of each query of ``QUERY``."""
    home = vectors.withColumnRenamed("home", "grp").select("vec_id", "label", "vec", "grp")
    first = stage(first_of(meet(queries, home, space, best, same), best), "hard-home")
    floor = first.filter(F.col("rank") == best).select(F.col("anchor_id").alias("_a"), F.col("key").alias("_k"), F.col("score").alias("floor"))
    raised = queries.join(floor, (F.col("anchor_id") == F.col("_a")) & (F.col("key") == F.col("_k")), "left").drop("_a", "_k")
    raised = stage(raised.withColumn("low", F.greatest("low", "floor")).drop("floor"), "hard-queries")
    wanted = {r["grp"]: (r["low"], r["high"]) for r in raised.groupBy("grp").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # a row for each group
    if space.groups == 1:
        return first
    others = stage(routed(vectors, space, reach, wanted), "hard-routed")
    out = stage(first_of(first.drop("rank").unionByName(meet(raised, others, space, best, same)), best), "hard-found")
    discard(first, raised, others)
    return out


def hard_negatives(table: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for a table of (vec_id, embedding, label)."""
    rows = distinct_ids(table)
    known = space_of(rows)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if known is None:
        return table.sparkSession.createDataFrame([], schema)
    space, _ = known
    vectors = placed(rows, space)
    anchors, reach = grouped_anchors(vectors, space)
    bare = F.lit(0).cast("long")
    best = search(anchors.select("*", bare.alias("key"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")), vectors, space, reach, positives, True)
    pairs = best.select(F.col("anchor_id").alias("_a"), F.col("vec_id").alias("key"), F.col("score").alias("high"))
    rest = "pmod(high, 100)"
    least = F.expr(f"(high - {rest}) div 100 * {WINDOW} + ({rest} * {WINDOW} + 99) div 100")  # the share rounded up, without products beyond 64 bits
    asked = anchors.join(pairs, F.col("anchor_id") == F.col("_a")).withColumn("low", least).select("anchor_id", "label", "vec", "grp", "key", "low", "high")
    asked = stage(asked, "hard-asked")
    found = search(asked, vectors, space, reach, negatives, False)
    scored = found.join(pairs.select("_a", F.col("key").alias("_k"), F.col("high").alias("positive_score")), (F.col("anchor_id") == F.col("_a")) & (F.col("key") == F.col("_k")))
    return scored.select("anchor_id", F.col("key").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of the whole table."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
