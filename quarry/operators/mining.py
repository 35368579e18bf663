"""Top-k itemsets by expected utility.

``exact`` enumerates each itemset once, items in ascending rank, and prunes by
``growth_bound``, which no superset in the subtree exceeds.
``path`` also asks that every single item and every prefix of the discovery
path reaches the minimum probability.

The search maps over packed transactions (``packed``): sums of single items, then of
all pairs that may matter, which raise the threshold before any prefix goes on. What
remains is cut into prefix classes. A class whose conditional database is small is
searched depth first by one task (``depth``); a larger one is split by a longer prefix, as
often as it takes, so no task is given more than ``CLASS_SIZE`` elements. The driver holds a
row for each item, pair and class that goes on, if these are at most ``ITEMS``, ``PAIRS`` and
``CLASSES``; beyond that the search joins level by level (``search_by_joins``), where nothing but the
best ``k`` and a few counts reaches the driver. Both give the same answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry.functions.columns import EPSILON, LOG_FLOOR, at_least, existential_probability, expected_utility, growth_bound, upper_bound
from quarry.operators import packed, prepare
from quarry.operators.depth import Search, reaches
from quarry.plans.staging import scope, stage

#: What the driver may hold, and the elements that a task may search by itself (some 280 bytes each at the peak).
ITEMS, PAIRS, CLASSES, CLASS_SIZE = 1_000_000, 2_000_000, 200_000, 200_000


def answer_order() -> list:
    """Utility, then probability, both falling; then size and items."""
    return [F.desc("expected_utility"), F.desc("probability"), F.asc("size"), F.asc("items")]


@dataclass
class Level:
    """``met``: how often a transaction brought a prefix and an item together; ``dropped``: how often that fell below the log floor."""

    size: int
    itemsets: int
    kept: int
    threshold: float
    met: int = 0
    dropped: int = 0


@dataclass
class Mined:
    topk: DataFrame
    levels: list[Level] = field(default_factory=list)

    def statistics(self) -> DataFrame:
        """A row for each level: itemsets evaluated and kept, the threshold after it, the share pruned, joins met and dropped, the share of joins that held."""
        share = lambda part, whole: part / whole if whole else 0.0
        rows = [(x.size, x.itemsets, x.kept, float(x.threshold), share(x.itemsets - x.kept, x.itemsets), x.met, x.dropped, share(x.met - x.dropped, x.met)) for x in self.levels]
        return self.topk.sparkSession.createDataFrame(rows, "size int, evaluated long, kept long, threshold double, pruned_share double, met long, dropped long, join_success double")


def level_one(tx: DataFrame, profit: DataFrame) -> DataFrame:
    e = prepare.item_utility(tx, profit)
    return prepare.elements(e, prepare.ranked_items(prepare.rtwu(e)))


def statistics(rows: DataFrame, rem: str = "rem") -> DataFrame:
    """items, size, expected_utility, probability, support, bound."""
    stats = rows.groupBy("path").agg(expected_utility().alias("expected_utility"), existential_probability().alias("probability"), F.count("*").alias("support"), upper_bound(rem).alias("bound"))
    return stats.withColumn("items", F.array_sort("path")).withColumn("size", F.size("path"))


def extend(rows: DataFrame, singles: DataFrame, ahead) -> DataFrame:
    """One more item of the same transaction; ``ahead`` is the condition on x (later item)."""
    x = singles.select("tid", F.col("item").alias("x_item"), F.col("rank").alias("x_rank"), F.col("path_rank").alias("x_path"), F.col("rtwu").alias("x_rtwu"), F.col("u").alias("x_u"), F.col("rem").alias("x_rem"), F.col("lp").alias("x_lp"))
    met = rows.join(x, "tid").filter(ahead & (F.col("lp") + F.col("x_lp") > LOG_FLOOR))
    return met.select("tid", F.array_append("path", F.col("x_item")).alias("path"), "root_rank", "root_rem", F.col("x_rank").alias("rank"), F.col("x_path").alias("path_rank"), (F.col("u") + F.col("x_u")).alias("u"), F.col("x_rem").alias("rem"), (F.col("lp") + F.col("x_lp")).alias("lp"))


def roots(singles: DataFrame) -> DataFrame:
    return singles.select("tid", F.array("item").alias("path"), F.col("rank").alias("root_rank"), F.col("rem").alias("root_rem"), "rank", "path_rank", "u", "rem", "lp")


TOP_SCHEMA = "items array<int>, size int, expected_utility double, probability double, support long"


LATER = ("rem", "rem_p", "p_max")


def _grown(base: DataFrame, singles: DataFrame, ahead, path: bool) -> DataFrame:
    """Rows of ``base`` with one more item of the same transaction, keyed by (node, item).

    What may still come is what comes after the new item, for ``path`` after the first one.
    """
    names = ("rank", "path_rank", "rtwu", "u", "lp", *LATER)
    x = singles.select("tid", "item", *[F.col(c).alias(f"x_{c}") for c in names])
    met = base.join(x, "tid").filter(ahead)
    return met.select("tid", "node", "item", "root_rank", F.col("x_rank").alias("rank"), F.col("x_path_rank").alias("path_rank"), *[F.col(c if path else f"x_{c}").alias(c) for c in LATER], (F.col("u") + F.col("x_u")).alias("u"), (F.col("lp") + F.col("x_lp")).alias("lp"))


class Best:
    """The best ``k`` answers so far."""

    def __init__(self, k: int, min_prob: float):
        self.k, self.min_prob, self.rows, self.items = k, min_prob, [], None

    @property
    def threshold(self) -> float:
        return self.rows[-1][2] if len(self.rows) == self.k else 0.0

    def take(self, answers: DataFrame) -> None:
        """``answers``: columns of ``TOP_SCHEMA``; the rows that qualify, at most ``k``, come to the driver."""
        fit = answers.filter((F.col("expected_utility") >= 0) & at_least(F.col("probability"), self.min_prob) & at_least(F.col("expected_utility"), self.threshold))
        new = [tuple(r) for r in fit.orderBy(*answer_order()).limit(self.k).collect()]
        merged = {tuple(r[0]): r for r in [*new, *self.rows]}
        self.rows = sorted(merged.values(), key=lambda r: (-r[2], -r[3], r[1], r[0]))[: self.k]


def mine(tx: DataFrame, profit: DataFrame, k: int, min_prob: float, semantics: str = "exact", max_size: int | None = None) -> Mined:
    """The top ``k`` with at least ``min_prob``, and a record of each level. Its stages are deleted when it returns."""
    if k < 1 or not 0 <= min_prob <= 1 or semantics not in ("exact", "path"):
        raise ValueError("k must be positive, min_prob within 0 and 1, semantics exact or path")
    best, path, spark = Best(k, min_prob), semantics == "path", tx.sparkSession
    with scope():
        e = prepare.item_utility(tx, profit)
        packs = packed.pack(e)
        levels = search_by_prefixes(packs, best, path, max_size or 1 << 30)
        if levels is None:
            levels = search_by_joins(level_one(tx, profit), best, path, max_size)
        return Mined(spark.createDataFrame(best.rows, TOP_SCHEMA), levels)


def _joined() -> list[Column]:
    """What the write of a table of sums observes."""
    return [F.count_if(F.col("n") > 0).alias("itemsets"), F.sum(F.col("n") + F.col("dropped")).alias("met"), F.sum("dropped").alias("dropped")]


def _observed(seen: Observation, written: DataFrame) -> dict[str, int]:
    """The metrics of ``_joined``; a plan that turned out empty observes nothing."""
    return {"itemsets": 0, "met": 0, "dropped": 0} if written.isEmpty() else seen.get


def _answers(sums: DataFrame, items: Column, size: int) -> DataFrame:
    return sums.select(F.array_sort(items).alias("items"), F.lit(size).alias("size"), F.col("eu").alias("expected_utility"), (1 - F.exp("slp")).alias("probability"), F.col("n").alias("support"))


def search_by_prefixes(packs: DataFrame, best: Best, path: bool, max_size: int) -> list[Level] | None:
    """Levels of the search over packed transactions; None if the driver would have to hold too much."""
    weights = packed.weights(packs).limit(ITEMS + 1).toPandas()
    if len(weights) > ITEMS:
        return None
    items = packed.Items.of(weights["item"].to_numpy(np.int32), weights["rtwu"].to_numpy(), path)
    best.items = items
    singles = stage(packed.single_sums(packs, items), "singles")
    best.take(_answers(singles, F.array("item"), 1))
    known = singles.select("item", "n", "bound", "weight", "dropped", "slp").toPandas()  # at most ITEMS rows
    rank = items.ranks(known["item"].to_numpy(np.int32))
    column = lambda c: np.bincount(rank, known[c], len(items.item))
    n, bound, weight, probable = column("n"), column("bound"), column("weight"), 1 - np.exp(column("slp")) >= best.min_prob - EPSILON
    may = (n > 0) & (probable if path else True)
    first = Level(1, int((n > 0).sum()), 0, 0.0, int(n.sum() + known["dropped"].sum()), int(known["dropped"].sum()))
    levels = [first]
    items.alive, items.root = may & reaches(weight, best.threshold), may & reaches(bound, best.threshold)
    if max_size > 1 and items.root.any():
        seen = Observation("pairs")
        counted = packed.pair_sums(packs, items, path)
        pairs = stage(counted.observe(seen, *_joined()), "pairs")
        joined = _observed(seen, pairs)
        pairs = pairs.filter("n > 0")
        best.take(_answers(pairs, F.array("item_a", "item_b"), 2))
        second = Level(2, joined["itemsets"], 0, best.threshold, joined["met"], joined["dropped"])
        levels += [second] if second.met else []
        items.alive, items.root = items.alive & reaches(weight, best.threshold), items.root & reaches(bound, best.threshold)
        slack = lambda c: F.col(c) >= best.threshold - EPSILON - 1e-9 * abs(best.threshold)
        good = slack("bound") & at_least(1 - F.exp("slp"), best.min_prob) if path else slack("bound")
        live = pairs.filter(slack("weight")).select("item_a", "item_b", "n", good.alias("good")).limit(PAIRS + 1).toPandas()
        if len(live) > PAIRS:
            return None
        a, b = (items.ranks(live[c].to_numpy(np.int32)) for c in ("item_a", "item_b"))
        use = items.root[a] & items.alive[b]
        live, a, b = live[use], a[use], b[use]
        second.kept = int(live["good"].sum())
        if second.kept and max_size > 2:
            found = search_classes(packs, items, a, b, live, best, path, max_size)
            if found is None:
                return None
            levels += found
    first.threshold, first.kept = best.threshold if max_size == 1 else levels[min(1, len(levels) - 1)].threshold, int(items.root.sum())
    if len(levels) == 1:
        first.threshold = best.threshold
    return levels


def search_classes(packs: DataFrame, items: packed.Items, a: np.ndarray, b: np.ndarray, live: pd.DataFrame, best: Best, path: bool, max_size: int) -> list[Level] | None:
    """Depth-first search below the pairs ``a``, ``b`` (ranks) that go on; large classes are split first."""
    count = len(items.item)
    good = live["good"].to_numpy(bool)
    size = np.bincount(a, live["n"], count)
    roots = np.flatnonzero(np.bincount(a, good, count) > 0)
    classes = np.full(count, -1)
    classes[roots] = np.arange(len(roots))
    prefixes = [(int(items.code[r]),) for r in roots]
    rows = packed.root_rows(packs, items, classes, np.sort((a * count + b)[good | np.isin(a, roots)]))
    small, large = ([c for c, r in enumerate(roots) if (size[r] <= CLASS_SIZE) == fits] for fits in (True, False))
    levels: dict[int, list[int]] = {}
    if small:
        depth_first(rows, small, prefixes, best, path, max_size, True, levels)
    length, by_code = 2, items.by_code()
    item_of = packs.sparkSession.createDataFrame(pd.DataFrame({"code": np.arange(count, dtype=np.int32), "item": by_code}))
    while large:
        # the sums of what follows the prefixes that are too large, then rows of one item more
        rows, seen = stage(only(rows, large, len(prefixes)), "classes"), Observation(f"level {length}")
        sums = stage(packed.child_sums(rows).observe(seen, *_joined()), "children")
        joined = _observed(seen, sums)
        sums = sums.filter("n > 0")
        if length > 2:  # pairs were counted before
            named = packs.sparkSession.createDataFrame(pd.DataFrame({"cls": np.array(large, np.int32), "front": [[int(by_code[x]) for x in prefixes[c]] for c in large]}), "cls int, front array<int>")
            best.take(_answers(sums.join(item_of, "code").join(named, "cls"), F.array_append("front", F.col("item")), length))
        bound = F.col("bound") >= best.threshold - EPSILON - 1e-9 * abs(best.threshold)
        kept = sums.filter(bound & at_least(1 - F.exp("slp"), best.min_prob) if path else bound)
        children = kept.select("cls", "code", "later").limit(CLASSES + 1).toPandas().sort_values(["cls", "code"]).reset_index(drop=True)
        if len(children) > CLASSES:
            return None
        if length > 2:
            level = levels.setdefault(length, [0, 0, 0, 0])
            for k, x in enumerate((joined["itemsets"], len(children), joined["met"], joined["dropped"])):
                level[k] += x
        if not len(children) or length >= max_size:
            break
        keys = children["cls"].to_numpy(np.int64) << 32 | children["code"].to_numpy(np.int64)
        prefixes = [(*prefixes[c], int(x)) for c, x in zip(children["cls"], children["code"], strict=True)]
        rows = packed.grown(rows, keys, np.arange(len(keys), dtype=np.int32))
        later = children["later"].to_numpy()
        small, large = np.flatnonzero(later <= CLASS_SIZE).tolist(), np.flatnonzero(later > CLASS_SIZE).tolist()
        if small:
            depth_first(rows, small, prefixes, best, path, max_size, False, levels)
        length += 1
    return [Level(n, x[0], x[1], best.threshold, x[2], x[3]) for n, x in sorted(levels.items()) if x[2]]


SEARCHED = "size int, codes array<int>, eu double, ep double, n long, itemsets long, kept long, met long, dropped long"


def only(rows: DataFrame, some: list[int], count: int) -> DataFrame:
    """The rows of some of ``count`` classes."""
    if len(some) == count:
        return rows
    chosen = np.zeros(count, bool)
    chosen[some] = True

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(chosen[batch.column(0).to_numpy()]))

    return rows.mapInArrow(picked, packed.ROWS)


def depth_first(rows: DataFrame, small: list[int], prefixes: list, best: Best, path: bool, max_size: int, known: bool, levels: dict[int, list[int]]) -> None:
    """Search the classes in ``small``, each in one task; answers go to ``best``, counts to ``levels``."""
    start, k, min_prob = [r[2] for r in best.rows], best.k, best.min_prob

    def run(table: pa.Table) -> pa.Table:
        own = packed.Rows(table)
        search = Search(prefixes[int(own.cls[0])], start, k, min_prob, path, max_size, known)
        search.run(own)
        out = [(len(x), list(x), eu, ep, n, None, None, None, None) for x, eu, ep, n in search.results()]
        out += [(size, None, None, None, None, *x) for size, x in search.levels.items()]
        names = ("size", "codes", "eu", "ep", "n", "itemsets", "kept", "met", "dropped")
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), *[pa.int64()] * 5)
        return pa.table({c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(zip(names, kinds, strict=True))})

    found = stage(only(rows, small, len(prefixes)).groupBy("cls").applyInArrow(run, SEARCHED), "searched")
    spark = rows.sparkSession
    flat = found.filter("codes is not null").withColumn("id", F.monotonically_increasing_id())
    by_code = best.items.by_code()
    item_of = spark.createDataFrame(pd.DataFrame({"code": np.arange(len(by_code), dtype=np.int32), "item": by_code}))
    named = flat.select("id", "size", "eu", "ep", "n", F.explode("codes").alias("code")).join(item_of, "code").groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items"), *[F.first(c).alias(c) for c in ("size", "eu", "ep", "n")])
    best.take(named.select("items", "size", F.col("eu").alias("expected_utility"), F.col("ep").alias("probability"), F.col("n").alias("support")))
    for r in found.filter("codes is null").groupBy("size").agg(*[F.sum(c) for c in ("itemsets", "kept", "met", "dropped")]).collect():
        level = levels.setdefault(r[0], [0, 0, 0, 0])
        for i in range(4):
            level[i] += r[i + 1]


def search_by_joins(singles: DataFrame, best: Best, path: bool, max_size: int | None) -> list[Level]:
    """The search level by level, each one a join on the transaction id.

    An itemset is a number while it is searched: rows carry that of their prefix
    and the last item, and only the table of itemsets knows the items. A level
    writes its itemsets, and the rows of those that go on; what it met and dropped is
    observed by the first of these jobs.
    """
    singles = stage(singles, "elements")
    rows = singles.select("tid", F.lit(0).cast("long").alias("node"), "item", F.col("rank").alias("root_rank"), "rank", "path_rank", *LATER, "u", "lp")
    kept, size, levels = None, 1, []
    while not rows.isEmpty():
        seen = Observation(f"join {size}")
        met = rows.observe(seen, F.count("*").alias("met"), F.count_if(F.col("lp") <= LOG_FLOOR).alias("dropped"))
        sums = met.filter(F.col("lp") > LOG_FLOOR).groupBy("node", "item").agg(expected_utility().alias("expected_utility"), existential_probability().alias("probability"), F.count("*").alias("support"), growth_bound().alias("bound"))
        named = sums.withColumn("path", F.array("item")) if kept is None else sums.join(kept.select(F.col("id").alias("node"), F.col("path").alias("_path")), "node").withColumn("path", F.array_append("_path", F.col("item"))).drop("_path")
        stats = stage(named.withColumn("id", F.monotonically_increasing_id()), "itemsets")
        best.take(stats.select(F.array_sort("path").alias("items"), F.size("path").alias("size"), "expected_utility", "probability", "support"))
        good = at_least(F.col("bound"), best.threshold)
        if path:
            good = good & at_least(F.col("probability"), best.min_prob)
        total, count = stats.agg(F.count("*"), F.count_if(good)).first()
        levels.append(Level(size, total, count, best.threshold, seen.get["met"], seen.get["dropped"]))
        if not count or size == max_size:
            return levels
        kept = stats.filter(good)
        base = rows.filter(F.col("lp") > LOG_FLOOR).join(kept.select("node", "item", "id"), ["node", "item"]).drop("node", "item").withColumnRenamed("id", "node")
        if size > 1:
            base = stage(base, "elements")
        elif path:  # every single item has to be probable, whatever it may grow to itself
            singles = singles.join(stats.filter(at_least(F.col("probability"), best.min_prob)).select("item"), "item", "left_semi")
        ahead = F.col("x_rank") > F.col("rank")
        if path:
            ahead = F.col("x_rank") > F.col("root_rank")
            if size > 1:
                ahead = ahead & (F.col("x_path_rank") > F.col("path_rank"))
        rows = stage(_grown(base, singles, ahead & (F.col("x_rtwu") >= best.threshold - EPSILON), path), "grown")
        size += 1
    return levels


def mine_topk(tx: DataFrame, profit: DataFrame, k: int = 10, min_prob: float = 0.3, semantics: str = "exact", max_size: int | None = None) -> DataFrame:
    """items, size, expected_utility, probability, support - at most ``k`` rows."""
    return mine(tx, profit, k, min_prob, semantics, max_size).topk.orderBy(*answer_order())


def level_statistics(tx: DataFrame, profit: DataFrame, size: int) -> DataFrame:
    """Statistics of all itemsets of one size, nothing pruned."""
    singles = level_one(tx, profit)
    rows = roots(singles)
    for _ in range(size - 1):
        rows = extend(rows, singles, F.col("x_rank") > F.col("rank"))
    return statistics(rows)
