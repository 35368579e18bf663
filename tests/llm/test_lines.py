import random
from itertools import combinations

import numpy as np
import pytest

from quarry.llm import lines
from tests.llm.helpers import roots

DOCS = "doc_id long, text string"


def shingles(line):
    """The bytes from each character on, as the operator defines them."""
    raw = " ".join(line.split(" ")).encode()
    if len(raw) < lines.SHINGLE:
        return {raw}
    return {raw[i : i + lines.SHINGLE] for i in range(len(raw) - lines.SHINGLE + 1) if raw[i] & 0xC0 != 0x80}


def bare(line):
    return b" ".join(line.encode().split()).decode()


def brute(rows):
    """Places of the lines that go, all similar pairs linked."""
    places = [((d is None, d or 0), t, i, bare(x)) for d, t in rows for i, x in enumerate((t or "").split("\n")) if bare(x)]
    sets = {x: shingles(x) for *_, x in places}
    linked = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root, first = roots(list(sets), linked), {}
    for d, _, i, x in sorted(places):
        first.setdefault(root[x], (d, i))
    return {(d, i) for d, _, i, x in places if first[root[x]] != (d, i)}, linked


def removed(spark, rows, **options):
    frame = spark.createDataFrame(rows, DOCS)
    return {((r["doc_id"] is None, r["doc_id"] or 0), r["pos"]) for r in lines.removed_lines(frame, **options).collect()}


def corpus():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghé日", k=rng.randint(3, 8))) for _ in range(400)]
    base = [rng.choices(vocabulary, k=40) for _ in range(12)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(4):
            w = list(rng.choice(base))
            if rng.random() < 0.6:
                w[rng.randrange(40)] = "changed"
            text.append(" ".join(w))
        rows.append((d, "\n".join([*text, "short", ""])))
    return [*rows, (100, None), (101, ""), (102, " \t\n\n"), (103, "x" * 30_000), (104, "x" * 30_001 + "\n" + "y z " * 9_000)]


def test_components_match_brute_force(spark):
    rows = corpus()
    want, linked = brute(rows)
    assert len(linked) > 50
    got = removed(spark, rows)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_families_and_chains_against_all_pairs(spark):
    """Families whose members differ more and more: far ones are linked by those between alone, and some by none."""
    rng = random.Random(4)
    rows = []
    for family in range(12):
        words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(30)]
        other = list(words)
        for d in range(12):
            words[rng.randrange(30)] = f"changed{family}{d}"
            rows.append((100 * family + d, " ".join(words)))
        for d in range(12, 24):
            rows.append((100 * family + d, " ".join(w if rng.random() < 0.85 else f"{rng.random():.9f}" for w in other)))
    want, linked = brute(rows)
    got = removed(spark, rows)
    assert len(linked) > 200 and got <= want and len(got) >= 0.97 * len(want), (len(got), len(want))


def test_exact_copies_and_edge_rows(spark):
    line = "the very same line of more than twenty characters"
    frame = spark.createDataFrame([(1, f"{line}\nx\n{line}"), (2, line), (None, line), (3, None)], DOCS)
    assert {(r["doc_id"], r["pos"]) for r in lines.removed_lines(frame).collect()} == {(1, 2), (2, 0), (None, 0)}
    assert {(r["doc_id"], r["text"]) for r in lines.dedup_lines(frame).collect()} == {(1, f"{line}\nx"), (2, ""), (None, ""), (3, None)}
    assert lines.removed_lines(frame.limit(0)).count() == 0
    assert lines.removed_lines(spark.createDataFrame([(1, "nothing here"), (2, "repeats at all")], DOCS)).count() == 0


def test_rows_that_share_or_lack_an_id_lose_no_other_line(spark):
    rows = [(None, "a first unique line\nthe line that is shared"), (None, "the line that is shared\na second unique line"), (7, "one more unique line\nthe line that is shared"), (7, "the line that is shared\nthe last unique line"), (8, "alone\nthe line that is shared"), (8, "alone\nthe line that is shared")]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "'x' AS pos", "1 AS gone", "2 AS text_key")
    left = sorted((r["doc_id"] or 0, r["text"]) for r in lines.dedup_lines(frame).collect())
    kept = "\n".join(x for _, x in left)
    for unique in ("a first unique line", "a second unique line", "one more unique line", "the last unique line", "alone"):
        assert unique in kept
    assert kept.count("the line that is shared") == 1 and len(left) == 6
    assert [x for d, x in left if d == 8] == ["alone", "alone"]  # equal rows are one document


def test_different_lines_stay(spark):
    kept = ["https://cdn.example.com/assets/logo-large.png", "https://cdn.example.com/scripts/checkout.js", "https://example.net/zulu/q", "https://example.com/alpha/r", "commit 0123456789abcdef0123456789abcdef01234567", "commit 0123456789abfedcba9876543210fedcba987654", "日本語の長い行には空白がありませんので一つの語です", "日本語の長い行には空白がありますとは限らないのです", "for (int i = 0; i < n; i++) {", "for (int j = 1; j <= m; j++) {", "\x00", "\x00\x00"]
    assert removed(spark, list(enumerate(kept))) == set()


def test_short_lines_are_compared(spark):
    rows = [(1, "Les.\n\n \t\nAnd ornd.\nx"), (2, "Les.\n\n \t\n And  ornd.\ny"), (3, "x\n\nLes!\nthis is a short line of words"), (4, "this is a short  line of words\nLes."), (5, "this is a small fence of wood")]
    assert {(d[1], i) for d, i in removed(spark, rows)} == {(2, 0), (2, 3), (3, 0), (4, 0), (4, 1)}


def test_recall_against_brute_force():
    """Bands find similar lines of 3 to 15 words as often as their similarity says, each pair being whole lines."""
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    pairs = []
    for n in [3, 5, 7, 10, 12, 15] * 800:
        w = [letters(rng.randint(3, 8)) for _ in range(n)]
        pairs.append((" ".join(w), " ".join([*w[:-1], letters(rng.randint(1, 3))])))
    pairs = [(a, b, len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))) for a, b in pairs]
    pairs = [x for x in pairs if x[2] >= 0.8]
    bands = lines.signatures([x.encode() for a, b, _ in pairs for x in (a, b)])
    met = (bands[::2] == bands[1::2]).any(axis=1).mean()
    want = sum(1 - (1 - j**lines.ROWS) ** lines.BANDS for *_, j in pairs) / len(pairs)
    assert len(pairs) > 1000 and met >= 0.98 and abs(met - want) < 4 * (want * (1 - want) / len(pairs)) ** 0.5 + 0.002, (met, want)


def test_signatures_do_not_depend_on_chunks(monkeypatch):
    rows = [b"a" * 5000, b"xy", "é日 long ".encode() * 300, bytes(range(65, 91)) * 90]
    want = lines.signatures(rows)
    monkeypatch.setattr(lines, "CHUNK", 64)
    assert (lines.signatures(rows) == want).all()
    assert [set(x.tobytes() for x in lines.line_shingles([r])[0]) == shingles(r.decode()) for r in rows if len(r) >= 8] == [True] * 3


def family(seed, n, share):
    """Lines of one template of 30 words, each word changed with a chance of ``share``."""
    rng = random.Random(seed)
    letters = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    words = [letters() for _ in range(30)]
    return [(d, " ".join(letters() if rng.random() < share else w for w in words)) for d in range(n)]


@pytest.mark.parametrize("seed, n, share", [(1, 1500, 0.06), (2, 1500, 0.10), (3, 3000, 0.06)])
def test_large_families_of_a_template(spark, seed, n, share):
    rows = family(seed, n, share)
    sets = [np.unique(lines.line_shingles([t.encode()])[0]) for _, t in rows]
    sizes = np.array([len(x) for x in sets])
    common = lines.common_counts(sets, sets)
    near = common >= 0.8 * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    linked = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    root = roots(list(range(n)), linked)
    want = {d for d in range(n) if root[d] != d}
    got = {d[1] for d, _ in removed(spark, rows)}
    assert len(want) > n // 5 and got <= want and len(got) >= 0.98 * len(want), (len(got), len(want))


def test_common_counts_and_tile_links(monkeypatch):
    rng = random.Random(2)
    left, right = ([np.array(rng.sample(range(60), rng.randint(1, 30)), np.uint64) for _ in range(n)] for n in (7, 9))
    want = [[len({*x.tolist()} & {*y.tolist()}) for y in right] for x in left]
    for width in (4096, 5):
        monkeypatch.setattr(lines, "COLUMNS", width)
        assert lines.common_counts(left, right).tolist() == want
    near = np.array([[rng.random() < 0.15 for _ in range(9)] for _ in range(7)])
    ids = np.arange(20, 27), np.arange(30, 39)
    linked = [(20 + i, 30 + j) for i, j in zip(*np.nonzero(near), strict=True)]
    a, b = lines.tile_links(ids, near)
    assert roots([*range(20, 27), *range(30, 39)], linked) == roots([*range(20, 27), *range(30, 39)], list(zip(a.tolist(), b.tolist(), strict=True)))


def test_small_tiles_find_the_same(spark, monkeypatch):
    rows = family(5, 300, 0.08)
    once = removed(spark, rows)
    monkeypatch.setattr(lines, "TILE", 7)
    assert removed(spark, rows) == once and len(once) > 20
    monkeypatch.setattr(lines, "TILE_BYTES", 500)
    assert removed(spark, rows) == once
