import math
import random

import pytest

from quarry.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """All scores of every anchor, in plain Python."""
    taken = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.setdefault(i, []).append((label, v))
    rows = {}
    for i, found in taken.items():
        label, v = min(found)
        rows[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(x)) for x in v])
    out = []
    for a in sorted(i for i in rows if i % 100 == 0):
        label, own = rows[a]
        scores = sorted((-sum(x * y for x, y in zip(own, v, strict=False)), i, other) for i, (other, v) in rows.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:5]:
            good = [(t, n) for t, n, other in scores if other != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, k, n, -s, -t) for k, (t, n) in enumerate(good, 1)]
    return out


def mined(spark, rows, schema=SCHEMA):
    return sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, schema)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(n, seed, width=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    f32 = lambda x: float(int(x * 4096)) / 4096  # noqa: E731  exact as float and as double
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [f32(x + rng.gauss(0, 0.15)) for x in c], rng.randrange(4)))
    return rows


def ties(rows):
    """A third of the vectors are one, and others are copies with other labels."""
    rng = random.Random(1)
    return [(i, rows[3][1] if i % 3 == 0 else v, rng.randrange(3)) for i, v, _ in rows]


@pytest.mark.parametrize("group, sizes", [(4, (3, 50)), (10_000, (1024, 16_384))])
def test_against_all_pairs(spark, monkeypatch, group, sizes):
    """Many small groups and slices, and one."""
    monkeypatch.setattr(negatives, "GROUP", group)
    monkeypatch.setattr(negatives, "ASKED", sizes[0])
    monkeypatch.setattr(negatives, "SLICE", sizes[1])
    monkeypatch.setattr(negatives, "BLOCK", 2)
    for rows in (clustered(2500, 3), ties(clustered(1500, 4))):
        want = brute(rows)
        assert mined(spark, rows) == sorted(want) and len(want) > 100


def test_bounds_spare_groups_and_lose_none(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP", 4)
    rows = spark.createDataFrame(clustered(3000, 8), SCHEMA)
    space, n = negatives.space_of(negatives.distinct_ids(rows))
    assert n == 30 and space.groups == 7
    vectors = negatives.placed(rows, space)
    anchors, reach = negatives.grouped_anchors(vectors, space)
    all_scores = {g["grp"]: (negatives.LOWEST, negatives.HIGHEST) for g in reach}
    every = negatives.routed(vectors, space, reach, all_scores).count()
    best = {g["grp"]: (int(g[2] * 0.98), negatives.HIGHEST) for g in reach}
    few = negatives.routed(vectors, space, reach, best)
    assert few.count() < 0.7 * every
    kept = {(r["grp"], r["vec_id"]) for r in few.collect()} | {(r["home"], r["vec_id"]) for r in vectors.collect()}
    whole = lambda b: negatives.matrix([b], space.width)[0]
    for a in anchors.collect():
        for v in vectors.collect():
            if whole(a["vec"]) @ whole(v["vec"]) >= best[a["grp"]][0]:
                assert (a["grp"], v["vec_id"]) in kept


def test_edge_rows(spark):
    base = clustered(300, 5)
    odd = [(None, [1.0] * 6, 1), (301, None, 1), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (303, [float("nan")] * 6, 1), (304, [float("inf")] * 6, 1), (305, [0.5] * 6, None), (306, [], 2), (307, [0.5, 0.25], 2), (100, base[100][1], base[100][2]), (200, [0.25] * 6, 0), (308, [1e30] * 6, 1)]
    want = sorted(brute([r for r in base + odd if r[0] != 308]))
    assert mined(spark, base + odd) == want and len(want) > 20
    extra = spark.createDataFrame(base, SCHEMA).selectExpr("*", "1 AS grp", "'x' AS home", "2 AS score", "3 AS rank")
    assert sorted(tuple(r) for r in negatives.hard_negatives(extra).collect()) == sorted(brute(base))


def test_empty_and_without_anchors(spark):
    for rows in ([], [(1, [1.0], 1), (2, [1.0], 2)], [(0, None, 1)], [(0, [1.0, 2.0], 1)]):
        assert mined(spark, rows) == []


def test_whole_numbers_beyond_53_bits(spark):
    rows = [(i, [float(2**20 + i * 4096), float(2**21 + (i * 37 % 11) * 256.0)], i % 2) for i in range(201)]
    assert mined(spark, rows) == sorted(brute(rows))
