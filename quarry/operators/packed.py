"""Transactions as one row each, and the passes of the search over them.

``pack`` writes (tid, rtu, items, u, p): a transaction's items beside each other, by one
shuffle on the transaction. Every later step maps over these rows, so no step joins
on the transaction again. A pass adds up in NumPy what a task has seen and Spark sums the
partial results by key: items (``single_sums``), pairs (``pair_sums``), and items behind a
prefix (``child_sums``). ``root_rows`` and ``grown`` make conditional databases: rows
(cls, u, lp, codes, us, lps) hold what a transaction has of a prefix and the items that
may still follow, in the order of enumeration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import LOG_FLOOR
from quarry.plans.staging import stage

PACKED = "tid long, rtu double, items array<int>, u array<double>, p array<double>"
ROWS = "cls int, u double, lp double, codes array<int>, us array<double>, lps array<double>"
SINGLES = "item int, eu double, slp double, n long, bound double, weight double, rest double, dropped long"
PAIRS = "item_a int, item_b int, eu double, slp double, n long, bound double, weight double, rest double, dropped long"
#: Pairs worked on at a time, and the most cells of a table of sums that is kept for a whole task.
CHUNK, CELLS = 1 << 17, 1 << 20
#: List elements of transactions worked on at a time.
ELEMENTS = 1 << 18


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def pack(e: DataFrame) -> DataFrame:
    """Staged ``PACKED`` rows of (tid, item, u, p); items without probability count in ``rtu`` alone.

    Rows of one transaction are packed where they are read, and what several tasks hold
    of it is put together after the shuffle, so a row moves for each transaction and task.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(4)]
            if len(columns[0]):
                order = np.argsort(columns[0], kind="stable")
                yield _packed(*[x[order] for x in columns])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch])
            if not table.num_rows:
                continue
            table = table.combine_chunks()
            tid = table["tid"].to_numpy()
            last = int(np.searchsorted(tid, tid[-1]))  # the last transaction may go on in the next batch
            rest = table.slice(last).to_batches()[0]
            if last:
                yield _merged(table.slice(0, last))
        if rest is not None:
            yield _merged(pa.Table.from_batches([rest]))

    n = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = e.select(F.col("tid").cast("long").alias("tid"), F.col("item").cast("int").alias("item"), F.col("u").cast("double").alias("u"), F.col("p").cast("double").alias("p"))
    return stage(rows.mapInArrow(read, PACKED).repartition(n, "tid").sortWithinPartitions("tid").mapInArrow(merge, PACKED), "packed")


def _packed(tid: np.ndarray, item: np.ndarray, u: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    first = np.flatnonzero(np.concatenate(([True], tid[1:] != tid[:-1])))
    some = p > 0
    offsets = np.concatenate(([0], np.cumsum(np.add.reduceat(some.astype(np.int64), first))))
    return pa.RecordBatch.from_arrays([pa.array(tid[first]), pa.array(np.add.reduceat(np.maximum(u, 0), first)), lists(item[some], offsets, pa.int32()), lists(u[some], offsets, pa.float64()), lists(p[some], offsets, pa.float64())], ["tid", "rtu", "items", "u", "p"])


def _merged(table: pa.Table) -> pa.RecordBatch:
    """One row for each run of equal transactions; their lists lie beside each other already."""
    batch = table.combine_chunks().to_batches()[0]
    tid = batch.column(0).to_numpy()
    first = np.flatnonzero(np.concatenate(([True], tid[1:] != tid[:-1])))
    sizes = batch.column(2).value_lengths().to_numpy().astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(np.add.reduceat(sizes, first))))
    return pa.RecordBatch.from_arrays([pa.array(tid[first]), pa.array(np.add.reduceat(batch.column(1).to_numpy(), first)), *[lists(batch.column(k).flatten().to_numpy(), offsets, t) for k, t in ((2, pa.int32()), (3, pa.float64()), (4, pa.float64()))]], ["tid", "rtu", "items", "u", "p"])


def weights(packs: DataFrame) -> DataFrame:
    """(item, rtwu): the utility of the transactions that hold an item."""
    return packs.select("rtu", F.explode("items").alias("item")).groupBy("item").agg(F.sum("rtu").alias("rtwu"))


@dataclass
class Items:
    """The items in ascending rank, with what the search knows of them; ``code`` is the order of enumeration."""

    item: np.ndarray
    code: np.ndarray
    alive: np.ndarray
    root: np.ndarray

    @staticmethod
    def of(item: np.ndarray, rtwu: np.ndarray, path: bool) -> Items:
        order = np.lexsort((item, rtwu))
        item, rtwu = item[order], rtwu[order]
        code = np.arange(len(item), dtype=np.int32)
        if path:
            code = np.empty(len(item), np.int32)
            code[np.lexsort((item, -rtwu))] = np.arange(len(item), dtype=np.int32)
        return Items(item, code, np.ones(len(item), bool), np.ones(len(item), bool))

    def by_code(self) -> np.ndarray:
        out = np.empty(len(self.item), np.int32)
        out[self.code] = self.item
        return out

    def ranks(self, items: np.ndarray) -> np.ndarray:
        order = np.argsort(self.item)
        return order[np.minimum(np.searchsorted(self.item[order], items), len(order) - 1)] if len(order) else items


def pieces(batches: Iterator[pa.RecordBatch], column: str = "items") -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``ELEMENTS`` elements of a list, as transactions may be long; a row stays whole."""
    for batch in batches:
        upto = np.cumsum(batch[column].value_lengths().to_numpy().astype(np.int64))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + ELEMENTS, "right")))
            yield batch.slice(low, high - low)
            low = high


class Block:
    """The living items of some transactions, flat and by ascending rank, with what comes later in each."""

    def __init__(self, batch: pa.RecordBatch, items: Items):
        sizes = batch.column(2).value_lengths().to_numpy().astype(np.int64)
        raw = [batch.column(k).flatten().to_numpy() for k in (2, 3, 4)]
        rank, lp = items.ranks(raw[0]), np.log(raw[2])
        floor = lp > LOG_FLOOR
        keep = floor & items.alive[rank] if len(rank) else floor
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.fallen = rank[~floor]
        owner, rank, u, p, lp = (x[keep] for x in (owner, rank, raw[1], raw[2], lp))
        order = np.argsort(owner * (len(items.item) + 1) + rank, kind="stable")
        self.owner, self.rank, self.u, self.p, self.lp = (x[order] for x in (owner, rank, u, p, lp))
        self.end = np.searchsorted(self.owner, self.owner, "right")
        self.rtu = batch.column(1).to_numpy()[self.owner]
        self.rem, self.rem_p, self.p_max = later(self.owner, self.end, self.u, self.p)


def later(owner: np.ndarray, end: np.ndarray, u: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of what follows each element in its row: gains, gains by their own probability, the largest probability."""
    at = np.arange(len(owner))
    gain = np.maximum(u, 0)
    total = lambda x: (c := np.concatenate(([0.0], np.cumsum(x))))[end] - c[at + 1]
    step = 2.0 * (owner[-1] - owner) if len(owner) else owner.astype(float)
    best = np.maximum.accumulate((p + step)[::-1])[::-1]
    after = np.zeros(len(owner))
    inner = np.flatnonzero(at + 1 < end)
    after[inner] = np.minimum(1.0, best[inner + 1] - step[inner] + 1e-9)
    return total(gain), total(gain * p), after


def growth(u: np.ndarray, p: np.ndarray, rem: np.ndarray, rem_p: np.ndarray, p_max: np.ndarray) -> np.ndarray:
    """What an element adds to the bound of its itemset (``columns.growth_bound``)."""
    return np.minimum(np.maximum(0, u + rem), np.maximum(0, u) * p_max + rem_p) * p


def parted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers, whose sums are exact, and what they leave; so long sums keep their last places in any order."""
    whole = np.rint(x)
    return whole, x - whole


def summed(names: tuple[str, ...]) -> list[Column]:
    """Sums of partial sums; ``eu`` takes in its ``rest``."""
    return [(F.sum("eu") + F.sum("rest") if c == "eu" else F.sum(c)).alias(c) for c in names]


def single_sums(packs: DataFrame, items: Items) -> DataFrame:
    """Sums of every item over all transactions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(items.item)
        out = np.zeros((7, m))
        for batch in pieces(batches):
            b = Block(batch, items)
            eu, rest = parted(b.u * b.p)
            for k, x in enumerate((eu, b.lp, None, growth(b.u, b.p, b.rem, b.rem_p, b.p_max), b.rtu * b.p, rest)):
                out[k] += np.bincount(b.rank, x, m)
            out[6] += np.bincount(b.fallen, minlength=m)
        some = np.flatnonzero(out[2] + out[6])
        yield pa.RecordBatch.from_arrays([pa.array(items.item[some].astype(np.int32)), *[pa.array(out[k][some] if k not in (2, 6) else out[k][some].astype(np.int64)) for k in range(7)]], ["item", "eu", "slp", "n", "bound", "weight", "rest", "dropped"])

    return packs.mapInArrow(run, SINGLES).groupBy("item").agg(*summed(("eu", "slp", "n", "bound", "weight", "dropped"))).filter("n > 0")


def pairs_of(b: Block, root: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of two items of one transaction, the first of them in ``root``; about ``chunk`` pairs at a time, all of a first item together."""
    begins = np.flatnonzero(root[b.rank])
    sizes = b.end[begins] - begins - 1
    begins, sizes = begins[sizes > 0], sizes[sizes > 0]
    upto, low = np.cumsum(sizes), 0
    while low < len(begins):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + chunk, "right")))
        own, n = begins[low:high], sizes[low:high]
        yield np.repeat(own, n), np.repeat(own + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
        low = high


def pair_sums(packs: DataFrame, items: Items, path: bool) -> DataFrame:
    """Sums of every pair that some transaction holds, ``item_a`` of the lower rank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = np.flatnonzero(items.alive)
        place = np.cumsum(items.alive) - 1
        m = len(live)
        table = np.zeros((7, m * m)) if m * m <= CELLS else None

        def rows(keys: np.ndarray, sums: list[np.ndarray]) -> pa.RecordBatch:
            whole = (2, 6)
            return pa.RecordBatch.from_arrays([pa.array(items.item[live[keys // m]].astype(np.int32)), pa.array(items.item[live[keys % m]].astype(np.int32)), *[pa.array(x.astype(np.int64) if k in whole else x) for k, x in enumerate(sums)]], ["item_a", "item_b", "eu", "slp", "n", "bound", "weight", "rest", "dropped"])

        for batch in pieces(batches):
            b = Block(batch, items)
            total = np.bincount(b.owner, np.maximum(b.u, 0))[b.owner] if len(b.owner) else b.u
            cell = place[b.rank]
            for i, j in pairs_of(b, items.root):
                lp, u, p, x = b.lp[i] + b.lp[j], b.u[i] + b.u[j], b.p[i] * b.p[j], i if path else j
                key = cell[i] * m + cell[j]
                fallen = lp <= LOG_FLOOR
                dropped = fallen.any()
                if dropped:
                    p[fallen], lp[fallen] = 0.0, 0.0
                eu, rest = parted(u * p)
                values = [eu, lp, 1.0 - fallen if dropped else 1.0, growth(u, p, b.rem[x], b.rem_p[x], b.p_max[x]), total[i] * p, rest, fallen.astype(float) if dropped else 0.0]
                if table is not None:
                    for k, v in enumerate(values[: 6 + dropped]):
                        np.add.at(table[k], key, v)
                else:
                    order = np.argsort(key, kind="stable")
                    key = key[order]
                    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    yield rows(key[first], [np.add.reduceat(np.broadcast_to(v, key.shape)[order], first) for v in values])
        if table is not None:
            some = np.flatnonzero(table[2] + table[6])
            yield rows(some, list(table[:, some]))

    sums = packs.mapInArrow(run, PAIRS).groupBy("item_a", "item_b")
    return sums.agg(*summed(("eu", "slp", "n", "bound", "weight", "dropped")))


def _batch(cls: np.ndarray, u: np.ndarray, lp: np.ndarray, codes: np.ndarray, us: np.ndarray, lps: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return pa.RecordBatch.from_arrays([pa.array(cls.astype(np.int32)), pa.array(u), pa.array(lp), lists(codes.astype(np.int32), offsets, pa.int32()), lists(us, offsets, pa.float64()), lists(lps, offsets, pa.float64())], ["cls", "u", "lp", "codes", "us", "lps"])


def root_rows(packs: DataFrame, items: Items, classes: np.ndarray, live: np.ndarray) -> DataFrame:
    """Conditional databases of single items: ``classes[rank]`` names a root's class (-1: none), ``live`` has the sorted
    keys (rank of the root * items + rank) of the pairs that a result may hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(items.item)
        for batch in pieces(batches):
            b = Block(batch, items)
            for i, j in pairs_of(b, classes >= 0):
                key = b.rank[i] * m + b.rank[j]
                at = np.searchsorted(live, key)
                good = live[np.minimum(at, len(live) - 1)] == key if len(live) else np.zeros(len(key), bool)
                i, j = i[good], j[good]
                if len(i):
                    code = items.code[b.rank[j]]
                    order = np.lexsort((code, i))
                    i, j, code = i[order], j[order], code[order]
                    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
                    head = i[first]
                    yield _batch(classes[b.rank[head]], b.u[head], b.lp[head], code, b.u[j], b.lp[j], np.diff(np.append(first, len(i))))

    return packs.mapInArrow(run, ROWS)


class Rows:
    """Rows of conditional databases, flat."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        if isinstance(batch, pa.Table):
            batch = batch.combine_chunks()
        column = lambda c: x.combine_chunks() if isinstance(x := batch[c], pa.ChunkedArray) else x
        self.cls, self.base_u, self.base_lp = (column(c).to_numpy() for c in ("cls", "u", "lp"))
        sizes = column("codes").value_lengths().to_numpy().astype(np.int64)
        self.code, self.u, self.lp = (column(c).flatten().to_numpy() for c in ("codes", "us", "lps"))
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.end = np.cumsum(sizes)[self.owner] if len(sizes) else self.owner


def child_sums(rows: DataFrame) -> DataFrame:
    """(cls, code, eu, slp, n, bound, later, dropped) of the items behind every prefix."""
    names = ("eu", "slp", "n", "bound", "later", "dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "codes"):
            r = Rows(batch)
            if not len(r.code):
                continue
            lp, u = r.base_lp[r.owner] + r.lp, r.base_u[r.owner] + r.u
            kept = lp > LOG_FLOOR
            p = np.where(kept, np.exp(lp), 0.0)
            bound = growth(u, p, *later(r.owner, r.end, r.u, np.exp(r.lp)))
            eu, rest = parted(u * p)
            values = (eu, np.where(kept, lp, 0.0), kept.astype(np.int64), bound, (r.end - np.arange(len(r.code)) - 1) * kept, (~kept).astype(np.int64), rest)
            key = r.cls[r.owner].astype(np.int64) << 32 | r.code
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sums = [np.add.reduceat(v[order], first) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array((key[first] >> 32).astype(np.int32)), pa.array((key[first] & 0xFFFFFFFF).astype(np.int32)), *map(pa.array, sums)], ["cls", "code", *names, "rest"])

    found = rows.mapInArrow(run, "cls int, code int, eu double, slp double, n long, bound double, later long, dropped long, rest double")
    return found.groupBy("cls", "code").agg(*summed(names))


def grown(rows: DataFrame, keys: np.ndarray, classes: np.ndarray) -> DataFrame:
    """Rows of longer prefixes: ``keys`` (sorted, class << 32 | code) become the classes beside them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "codes"):
            r = Rows(batch)
            key = r.cls[r.owner].astype(np.int64) << 32 | r.code
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            lp = r.base_lp[r.owner] + r.lp
            hit = np.flatnonzero((keys[at] == key) & (lp > LOG_FLOOR) & (np.arange(len(key)) + 1 < r.end)) if len(keys) else np.zeros(0, int)
            for low in range(0, len(hit), 1 << 16):
                own = hit[low : low + (1 << 16)]
                sizes = r.end[own] - own - 1
                flat = np.repeat(own + 1 - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
                yield _batch(classes[at[own]], (r.base_u[r.owner] + r.u)[own], lp[own], r.code[flat], r.u[flat], r.lp[flat], sizes)

    return rows.mapInArrow(run, ROWS)
