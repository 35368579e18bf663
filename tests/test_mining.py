import itertools
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import depth, mining, packed

TX, PROFIT = "tid long, item int, quantity int, probability double", "item int, profit double"


def data(seed, transactions=40, items=9, most=7, chances=(1.0, 0.9, 0.6, 0.35)):
    rng = random.Random(seed)
    rows = [(t, i, rng.randint(1, 4), rng.choice(chances)) for t in range(1, transactions + 1) for i in rng.sample(range(1, items + 1), rng.randint(1, most))]
    return rows, {i: float(rng.randint(-4, 9)) for i in range(1, items + 1)}


def brute(rows, profit, k, min_prob, path, max_size=99):
    """Every itemset that the semantics reach, by their definitions."""
    tx = {}
    for t, i, q, p in rows:
        tx.setdefault(t, {})[i] = (q * profit[i], p)
    rtu = {t: sum(max(0, u) for u, _ in row.values()) for t, row in tx.items()}
    rtwu = {i: sum(rtu[t] for t, row in tx.items() if i in row and row[i][1] > 0) for i in profit}

    def facts(items):
        found = [row for row in tx.values() if all(i in row and row[i][1] > 0 for i in items) and sum(math.log(row[i][1]) for i in items) > -700]
        chance = [math.prod(row[i][1] for i in items) for row in found]
        return sum(sum(row[i][0] for i in items) * c for row, c in zip(found, chance, strict=True)), 1 - math.prod(chance), len(found)

    rank = sorted(profit, key=lambda i: (rtwu[i], i))
    by_path = sorted(profit, key=lambda i: (-rtwu[i], i))
    good = lambda items: facts(items)[1] >= min_prob - 1e-10
    out = []
    for n in range(1, min(len(profit), max_size) + 1):
        for items in itertools.combinations(sorted(profit), n):
            eu, ep, support = facts(items)
            if not support or eu < 0 or ep < min_prob - 1e-10:
                continue
            root = min(items, key=rank.index)
            way = [root, *sorted((i for i in items if i != root), key=by_path.index)]
            if path and not (all(good((i,)) for i in items) and all(good(tuple(way[:k])) for k in range(1, n + 1))):
                continue
            out.append((-round(eu, 6), -round(ep, 6), n, list(items), support))
    return [(x[3], -x[0], -x[1], x[4]) for x in sorted(out)[:k]]


def found(spark, rows, profit, k, min_prob, path, max_size=None):
    got = mining.mine_topk(spark.createDataFrame(rows, TX), spark.createDataFrame(list(profit.items()), PROFIT), k, min_prob, "path" if path else "exact", max_size).collect()
    return [(r["items"], round(r["expected_utility"], 6), round(r["probability"], 6), r["support"]) for r in got]


@pytest.mark.parametrize("limits", [{}, {"CLASS_SIZE": 6}, {"CLASS_SIZE": 0}, {"ITEMS": 0}, {"PAIRS": 0}, {"CLASS_SIZE": 6, "CLASSES": 3}])
@pytest.mark.parametrize("path", [False, True])
def test_every_way_gives_the_same_answer(spark, monkeypatch, limits, path):
    """Classes of any size, split as often as it takes, and joins where the driver would hold too much."""
    for name, value in limits.items():
        monkeypatch.setattr(mining, name, value)
    for seed, k, min_prob in ((1, 12, 0.3), (2, 40, 0.0))[:: -1 if path else 1][: 1 + (not limits)]:
        rows, profit = data(seed)
        assert found(spark, rows, profit, k, min_prob, path) == brute(rows, profit, k, min_prob, path), (limits, seed)


def test_sizes_and_underflow(spark, monkeypatch):
    rows, profit = data(5, chances=(1.0, 0.9, 1e-200, 0.0, 1e-305))
    for limits in ({}, {"CLASS_SIZE": 0}, {"ITEMS": 0}):
        for name, value in ({"CLASS_SIZE": 4_000_000, "ITEMS": 1_000_000} | limits).items():
            monkeypatch.setattr(mining, name, value)
        for size in (1, 2, 3):
            assert found(spark, rows, profit, 9, 0.0, False, size) == brute(rows, profit, 9, 0.0, False, size), (limits, size)
    monkeypatch.undo()
    levels = mining.mine(spark.createDataFrame(rows, TX), spark.createDataFrame(list(profit.items()), PROFIT), 500, 0.0).levels
    assert levels[0].dropped > 0 and levels[1].dropped > 0 and [x.size for x in levels] == list(range(1, len(levels) + 1))


def test_no_stage_is_left_behind(spark, tmp_path):
    rows, profit = data(3)
    spark.conf.set("spark.quarry.local.checkpoint.dir", f"file://{tmp_path}")
    try:
        assert found(spark, rows, profit, 5, 0.3, False)
    finally:
        spark.conf.unset("spark.quarry.local.checkpoint.dir")
    assert not [x for x in tmp_path.rglob("*") if x.is_file()]


def test_dense_table_against_joins(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(t, i, rng.randint(1, 5), round(rng.uniform(0.3, 1), 4)) for t in range(3000) for i in rng.sample(range(1, 31), rng.randint(10, 18))]
    profit = {i: round(rng.uniform(-10, 50), 2) for i in range(1, 31)}
    for path in (False, True):
        want = found(spark, rows, profit, 25, 0.3, path)
        monkeypatch.setattr(mining, "CLASS_SIZE", 20_000)
        assert found(spark, rows, profit, 25, 0.3, path) == want
        monkeypatch.setattr(mining, "ITEMS", 0)
        assert found(spark, rows, profit, 25, 0.3, path) == want and max(len(x[0]) for x in want) > 1
        monkeypatch.undo()


def test_packing_joins_what_tasks_hold_apart(spark):
    rows = [(t % 7, i, float(i), 0.0 if i == 3 else 0.5) for t in range(7) for i in range(1, 6)]
    e = spark.createDataFrame(rows, "tid long, item int, u double, p double").repartition(6)
    got = {r["tid"]: (r["rtu"], sorted(zip(r["items"], r["u"], r["p"], strict=True))) for r in packed.pack(e).collect()}
    assert got == {t: (15.0, [(i, float(i), 0.5) for i in (1, 2, 4, 5)]) for t in range(7)}


def test_pairs_come_whole_whatever_the_chunk():
    sizes = [5, 1, 4, 0, 6]
    ids = np.arange(1, 7, dtype=np.int32)
    flat = np.concatenate([ids[:n] for n in sizes])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5)), pa.array(np.ones(5)), *[packed.lists(x, np.concatenate(([0], np.cumsum(sizes))), t) for x, t in ((flat, pa.int32()), (flat * 1.0, pa.float64()), (np.full(len(flat), 0.5), pa.float64()))]], ["tid", "rtu", "items", "u", "p"])
    items = packed.Items.of(ids, np.arange(6.0), False)
    block = packed.Block(batch, items)
    want = [(i, j) for i in range(len(block.rank)) for j in range(i + 1, block.end[i])]
    for chunk in (1, 3, 1000):
        parts = list(packed.pairs_of(block, items.root, chunk))
        assert [(int(i), int(j)) for a, b in parts for i, j in zip(a, b, strict=True)] == want
        firsts = [set(a.tolist()) for a, _ in parts]
        assert all(not x & y for x, y in itertools.combinations(firsts, 2))


def test_what_comes_later():
    owner, end = np.array([0, 0, 0, 2, 2]), np.array([3, 3, 3, 5, 5])
    u, p = np.array([1.0, -2.0, 4.0, 5.0, 6.0]), np.array([0.5, 0.25, 0.75, 1.0, 0.1])
    rem, rem_p, p_max = packed.later(owner, end, u, p)
    assert rem.tolist() == [4.0, 4.0, 0.0, 6.0, 0.0] and np.allclose(rem_p, [3.0, 3.0, 0, 0.6, 0]) and np.allclose(p_max, [0.75, 0.75, 0, 0.1, 0], atol=1e-8)


def test_threshold_leaves_room_for_rounding():
    assert depth.reaches(100.0 - 1e-8, 100.0) and not depth.reaches(99.99, 100.0) and depth.reaches(0.0, 0.0)


def test_pieces_keep_rows_whole(monkeypatch):
    sizes = [5, 1, 4, 0, 6, 9]
    flat = np.arange(sum(sizes), dtype=np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6)), pa.array(np.ones(6)), packed.lists(flat, np.concatenate(([0], np.cumsum(sizes))), pa.int32())], ["tid", "rtu", "items"])
    for limit, most in ((1, 6), (6, 5), (1000, 1)):
        monkeypatch.setattr(packed, "ELEMENTS", limit)
        parts = list(packed.pieces([batch]))
        assert sum(x.num_rows for x in parts) == 6 and [v for x in parts for v in x.column(2).flatten().to_pylist()] == flat.tolist()
        assert all(x.num_rows == 1 or len(x.column(2).flatten()) <= limit for x in parts) and len(parts) <= most


def test_a_task_searches_its_largest_class_in_little_memory():
    """Four tasks share an executor, so what one holds of the largest class it may be given stays far below a quarter of its Python."""
    n, width = mining.CLASS_SIZE // 8, 8
    codes = np.tile(np.arange(1, width + 1, dtype=np.int32), n)
    tracemalloc.start()
    rows = packed.Rows(packed._batch(np.zeros(n), np.ones(n), np.full(n, -0.1), codes, np.ones(n * width), np.full(n * width, -0.1), np.full(n, width)))
    search = depth.Search((0,), [], 5, 0.0, False, 3, False)
    search.run(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert search.results() and search.levels[2][0] == width and peak < 200e6, (peak, search.levels)


def test_prefixes_of_long_transactions_are_summed_and_grown_in_pieces(spark, monkeypatch):
    batch = packed._batch(np.zeros(6), np.ones(6), np.zeros(6), np.tile(np.arange(1, 5), 6), np.ones(24), np.full(24, -0.5), np.full(6, 4))
    frame = spark.createDataFrame([tuple(r.values()) for r in batch.to_pylist()], packed.ROWS).coalesce(1)
    seen = []
    for limit in (1000, 8):
        monkeypatch.setattr(packed, "ELEMENTS", limit)
        sums = sorted(tuple(round(x, 9) for x in r) for r in packed.child_sums(frame).collect())
        grown = sorted(map(str, packed.grown(frame, np.array([1, 2]), np.array([0, 1])).collect()))
        seen.append((sums, grown))
    assert seen[0] == seen[1] and len(seen[0][0]) == 4 and len(seen[0][1]) == 12
    most = max(len(x["codes"].flatten()) for x in packed.pieces([batch], "codes"))
    assert most == 8


def test_long_sums_keep_their_last_places(spark):
    """An export shows six decimals, also of sums over very many transactions and in whatever order they come."""
    n = 200_000
    u, p = np.arange(n) % 977 + 1000.3, (0.95, 0.85)
    packs = spark.range(n, numPartitions=1).selectExpr("id as tid", "0D as rtu", "array(1, 2) as items", "array(id % 977 + 1000.3D, id % 977 + 1000.3D) as u", "array(0.95D, 0.85D) as p")
    items = packed.Items.of(np.array([1, 2], np.int32), np.array([1.0, 2.0]), False)
    near = lambda got, values: abs(got - math.fsum(values)) <= 2 * np.spacing(got)
    assert all(near(r["eu"], u * p[r["item"] - 1]) for r in packed.single_sums(packs, items).collect())
    assert near(packed.pair_sums(packs, items, False).first()["eu"], (u + u) * (p[0] * p[1]))
    lp = np.log(np.full(n, 0.85))
    rows = packed._batch(np.zeros(n), u, np.log(np.full(n, 0.95)), np.full(n, 2, np.int32), u, lp, np.ones(n, np.int64))
    search = depth.Search((1,), [], 5, 0.0, False, 2, False)
    search.run(packed.Rows(rows))
    assert near(search.results()[0][1], (u + u) * np.exp(np.log(0.95) + lp))
