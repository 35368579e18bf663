import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from quarry.llm import languages

SCHEMA = "doc_id long, text string, lang string"
VOICES = {"aa": "the and of ing ther sion", "bb": "der die ung schön ß mit", "cc": "ля не что это ый"}


def corpus(n=240, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(VOICES))
        parts = VOICES[lang].split()
        rows.append((i, " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 60))), lang))
    return rows


def taught(rows):
    return [(t, lang) for i, t, lang in rows if t is not None and lang is not None and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)]


def trees(rows):
    """By language and context: how often each byte follows."""
    out = defaultdict(lambda: defaultdict(Counter))
    for text, lang in taught(rows):
        raw = languages.PAD + text.encode()
        for at in range(languages.ORDER, len(raw)):
            for k in range(languages.ORDER + 1):
                out[lang][raw[at - k : at]][raw[at]] += 1
    return out


def code_length(tree, text):
    raw, bits = languages.PAD + text.encode(), 0.0
    for at in range(languages.ORDER, len(raw)):
        for k in range(languages.ORDER, -1, -1):
            seen = tree.get(raw[at - k : at])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if raw[at] in seen:
                bits -= math.log2(seen[raw[at]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths_match_plain_trees(spark, monkeypatch):
    rows = corpus()
    model, plain = languages.learn(spark.createDataFrame(rows, SCHEMA)), trees(rows)
    assert model.languages == sorted(VOICES)
    texts = [t for _, t, _ in rows[:40]] + ["", "zzz qqq 123 \x00\x7f", "ля the ß " * 300, "é", "the", "日本語のテキスト"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = np.array([[code_length(plain[x], t) for x in model.languages] for t in texts])
    for chunk in (1 << 18, 257, 64):
        monkeypatch.setattr(languages, "CHUNK", chunk)
        assert np.allclose(languages.code_lengths(model, data, offsets), want, rtol=1e-5, atol=1e-3), chunk


def test_counts_do_not_depend_on_merges(spark, monkeypatch):
    frame = spark.createDataFrame(corpus(), SCHEMA)
    once = {tuple(r) for r in languages.gram_counts(frame).collect()}
    plain = Counter((lang, int.from_bytes((languages.PAD + t.encode())[k : k + 4], "big")) for t, lang in taught(corpus()) for k in range(len(t.encode())))
    assert once == {(*k, n) for k, n in plain.items()}
    held = languages.Counts()
    monkeypatch.setattr(languages, "MERGE", 5)
    for _ in range(4):
        held.add("x", np.array([3, 1, 3], np.uint32))
    held.merge()
    assert held.done["x"][0].tolist() == [1, 3] and held.done["x"][1].tolist() == [4, 8]


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**32, 5000, dtype=np.uint32))
    table = languages.Lookup.of(keys, np.zeros((len(keys), 1)))
    assert (table.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 2**32, 5000, dtype=np.uint32), keys)
    assert (table.find(other) == -1).all()


def test_held_out_rows_are_told(spark):
    rows = corpus(400, 9)
    found = {r["doc_id"]: r for r in languages.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    out = [(lang, found[i]["lang_pred"]) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2 and len(t) > 20]
    assert len(out) > 50 and sum(a == b for a, b in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_labels_of_rows_do_not_enter_predictions(spark):
    rows = corpus(120)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    frame = lambda lang: spark.createDataFrame([r for r in rows if r not in held] + [(i, t, lang) for i, t, _ in held], SCHEMA)
    of = lambda f: {r["doc_id"]: r[1:] for r in languages.identify(f).collect()}
    assert of(frame("aa")) == of(frame(None))


def test_edge_rows(spark):
    rows = corpus(60) + [(None, "the and of", "aa"), (500, None, "aa"), (501, "", "bb"), (502, "12 34 !?", "bb"), (503, "the thing", None), (503, "the thing", None), (504, "the ther " * 60_000, None)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'q' AS letters", "1 AS score", "2 AS gram")
    got = [tuple(r)[:3] for r in languages.identify(frame).collect()]
    assert len(got) == len(rows)
    by = {i: (lang, score) for i, lang, score in got}
    assert by[500] == by[501] == by[502] == ("und", 0.0) and by[503][0] == by[504][0] == "aa" and got.count((503, *by[503])) == 2
    assert languages.identify(frame.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "some text", None), (2, None, None)], SCHEMA)
    assert {tuple(r)[1:3] for r in languages.identify(nothing).collect()} == {("und", 0.0)}


def test_the_most_frequent_grams_stay(spark, monkeypatch):
    monkeypatch.setattr(languages, "MAX_GRAMS", 50)
    monkeypatch.setattr(languages, "MAX_LANGUAGES", 2)
    rows = corpus()
    model = languages.learn(spark.createDataFrame(rows, SCHEMA))
    sizes = Counter()
    for t, lang in taught(rows):
        sizes[lang] += len(t.encode())
    assert model.languages == sorted(x for x, _ in sizes.most_common(2))
    for j, lang in enumerate(model.languages):
        every = Counter((languages.PAD + t.encode())[k : k + 4] for t, x in taught(rows) if x == lang for k in range(len(t.encode())))
        stay = {g for g, n in every.items() if sum(m >= n for m in every.values()) <= 50}
        assert 0 < len(stay) <= 50 and {int.from_bytes(g, "big") for g in stay} <= {*model.full.keys.tolist()}


def test_every_gram_and_language_counts(spark, monkeypatch):
    """Whatever a model may hold, verdicts are those of the whole trees of all languages."""
    rows = corpus(120) + [(900, None, None), (901, "", None), (902, "12 34 !?", None), (903, "日本語 ß ля the", None), (903, "日本語 ß ля the", None), (None, "der ung ding " * 30_000, None)]
    frame, plain = spark.createDataFrame(rows, SCHEMA), trees(rows)
    want = []
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            want.append((i, "und", 0.0))
            continue
        rates = {x: code_length(plain[x], t) / len(t.encode()) for x in plain}
        best = min(rates, key=lambda x: (rates[x], x))
        want.append((i, best, 1 / sum(2 ** ((rates[best] - r) * languages.SHARPNESS) for r in rates.values())))
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for grams, several, cells in ((50, 64, 1 << 22), (200_000, 2, 1 << 22), (1, 1, 1 << 22), (200_000, 64, 100)):
        monkeypatch.setattr(languages, "MAX_GRAMS", grams)
        monkeypatch.setattr(languages, "MAX_LANGUAGES", several)
        monkeypatch.setattr(languages, "MAX_CELLS", cells)
        monkeypatch.setattr(languages, "SLICE", 200)
        got = order([tuple(r)[:3] for r in languages.identify(frame).collect()])
        assert [r[:2] for r in got] == [r[:2] for r in order(want)], (grams, several)
        assert np.allclose([r[2] for r in got], [r[2] for r in order(want)], atol=1e-4), (grams, several)
        again = [r[2] for r in got if r[0] == 903]
        assert len(again) == 2 and again[0] == again[1]
