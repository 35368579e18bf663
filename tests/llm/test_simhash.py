import random
from itertools import combinations

import xxhash

from quarry.llm import simhash
from tests.llm.helpers import LOWER, roots, words


def brute(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one two"), (5, "x " * 5000)]
    for i in range(10, 60):
        base = rng.choices(vocabulary, k=200)
        for c in range(3):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(200)] = "Changed"
            rows.append((i * 10 + c, " ".join(copy)))
    return rows


def check(spark, rows, full_bucket):
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp2", simhash.F.lit(1)), full_bucket=full_bucket).collect()
    fps = {i: brute(t) for i, t in rows}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == fps
    linked = [(a, b) for a, b in combinations(fps, 2) if bin(fps[a] ^ fps[b]).count("1") <= 3]
    assert len(linked) > 20
    assert {r["doc_id"]: r["component_id"] for r in got} == roots(fps, linked)


def test_components_match_brute_force(spark):
    check(spark, corpus(), 256)


def test_full_buckets_give_the_same_components(spark):
    check(spark, corpus(), 1)


def test_links_of_dense_fingerprints(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    linked = [(a, b) for a, b in combinations(signed, 2) if bin((a ^ b) % (1 << 64)).count("1") <= 3]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = roots(signed, linked)
    for full_bucket in (1000, 3):
        got = [(r["a"], r["b"]) for r in simhash.links(frame, full_bucket).collect()]
        assert roots(signed, got) == want


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "q r s t u"), (7, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1) for r in simhash.keep_one(rows).collect()) == [-1, 1, 7]


def test_lists_longer_than_a_chunk(monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "CHUNK", 5)
    rng = np.random.default_rng(1)
    codes, offsets = rng.integers(0, 1 << 63, 40, dtype=np.uint64), np.array([0, 0, 13, 14, 14, 14, 33, 40, 40])
    got = simhash.majority_bits(codes, offsets)
    for k in range(8):
        own = [int(x) for x in codes[offsets[k] : offsets[k + 1]]]
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))
