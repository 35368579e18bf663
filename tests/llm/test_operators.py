"""Operators against plain Python on small tables with nulls, empty and long texts, ties and copies."""

import hashlib
import math
import random
import re
import struct
from collections import Counter
from decimal import Decimal
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from quarry.llm import decontaminate, factorisation, mixing, pii, rules, sharding, substrings, tokens, warc
from quarry.llm.text import byte_size, crc, word_count
from tests.llm.helpers import LOWER, words

DOCS = "doc_id long, text string, source string, size string"  # ``size`` clashes with a computed column


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(120)]
    shared = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(4)]
    rows = [(1000, None, None, "x"), (1001, "", "a", "x"), (1002, " \t\n", "b", "x"), (None, "no id " * 20, "a", "x"), (1003, "w " * 3000, None, "x")]
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(1, 80)))
        if rng.random() < 0.5:
            text += rng.choice([" ", "\n"]) + rng.choice(shared)
        rows.append((i, text, rng.choice(["a", "a", "b", "ü", None]), "x"))
    return rows + [(500, rows[-1][1], "a", "x"), (501, rows[-1][1], "b", "x")]


def test_pii_base_spans(spark):
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"), ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(s):
        return sum((lambda v: v - 9 if v > 9 else v)(int(c) * (2 if i % 2 else 1)) for i, c in enumerate(reversed(s))) % 10 == 0

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    rng = random.Random(2)
    texts = [None, "", "a@b.c_d@e.f.g", "x" * 30_000, "1" * 30_000, "é@ a@b.co 😀 1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.1 +1 (017) 555-7713.", "4111 1111 1111 1111 4111111111111112 +49 30 1234567) x", "a@b.co " * 700]
    texts += ["".join(rng.choices("ab@.+-_ 0123456789()é\n", k=rng.randint(1, 200))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in frame.select("doc_id", pii.span_text(pii.entity_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(patterns) for m in re.finditer(p, t or "") if ok(kind, m.group()))
        assert got[i] == ",".join(f"{patterns[k][0]}:{a}:{b}" for a, k, b in spans), (i, t)


def revealing(seed=3):
    """Texts in which some words come with an e-mail address most of the time, copies and near copies among them."""
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    some = lambda: " ".join(rng.choices(vocabulary, k=7))
    rows = [f"{some()} {rng.choice(['ward', 'desk', 'door'])} here" for i in range(900)]
    for i in range(120):
        rows.append(f"{some()} {'patient' if i % 8 else 'ward'} case {i % 3}k9 {some()} of me{i}@mail.example.com" + (f" at 10.0.{i}.7" if i % 3 else ""))
    rows += [f"dear reader this letter tells what our archive keeps please answer me{i}@mail.example.com soon" for i in range(60)]
    return rows + ["patient without any"] + ["", " - "] + rows[-70:-50]


def disclosed(texts):
    """(term, kind) to disclosure, in plain Python over the different texts and over their classes."""
    patterns = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 1: r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"}

    def minima(bare):
        every = [w.lower().encode() for w in re.findall(r"[^\W_]+", bare)]
        shingles = [every[i : i + 5] for i in range(len(every) - 4)] if len(every) > 5 else [[b" ".join(every)]]
        codes = []
        for shingle in shingles:
            code = 42
            for w in shingle:
                code = xxhash.xxh64_intdigest(w, code)
            codes.append(code)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return [min(signed(xxhash.xxh64_intdigest(struct.pack("<Q", c), xxhash.xxh64_intdigest(struct.pack("<i", k), 42))) for c in codes) for k in range(pii.CLASSINGS)]

    held = []
    for t in set(texts):
        kinds = {k for k, p in patterns.items() if re.search(p, t)}
        bare = re.sub(patterns[1], " ", re.sub(patterns[0], " ", t))
        held.append((kinds, {w.lower() for w in re.findall(r"[^\W_]+", bare) if len(w) > 1}, minima(bare)))
    tests = len({w for _, ws, _ in held for w in ws}) * len(patterns)
    out, z = {}, NormalDist().inv_cdf(1 - pii.ERROR / tests)
    for k in patterns:
        rate = sum(k in kinds for kinds, *_ in held) / len(held)
        for term in {w for kinds, ws, _ in held if k in kinds for w in ws}:
            least = math.inf
            for classing in [None, *range(pii.CLASSINGS)]:
                evidence = {}
                for i, (kinds, ws, near) in enumerate(held):
                    if term in ws:
                        key = i if classing is None else near[classing]
                        evidence[key] = evidence.get(key, False) or k in kinds
                total, share = len(evidence), sum(evidence.values()) / len(evidence)
                low = (share + z * z / (2 * total) - z * math.sqrt(share * (1 - share) / total + z * z / (4 * total * total))) / (1 + z * z / total)
                least = min(least, math.log2(low / rate) / -math.log2(rate))
            out[(term, k)] = least
    return {x: d for x, d in out.items() if d >= 0.6}


def test_pii_disclosure_matches_brute_force(spark):
    texts = revealing()
    want = disclosed(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS base", "'y' AS k1")
    got = {(r["term"], r["kind"]): r["disclosure"] for r in pii.disclosing_terms(pii.with_entities(docs), 0.6).collect()}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert want[("patient", 0)] >= pii.GENERALISE and not {t for t, _ in want} & {"com", "mail", "example", "ward"}
    assert not {t for t, _ in want} & {"dear", "reader", "letter", "archive"}  # one letter sent sixty times


def test_pii_copies_do_not_change_the_verdict(spark):
    texts = revealing()
    some = [t for t in texts if "patient" in t and "@" in t][:1]

    def verdict(rows, everywhere=True):
        docs = spark.createDataFrame([(texts.index(t), t) for t in rows], "doc_id long, text string")
        return {r["doc_id"]: (r["added"], r["clean"]) for r in pii.sanitise(docs, everywhere).collect()}

    once, often = verdict(texts), verdict(texts + some * 60)
    assert once == often
    where, bare = texts.index(some[0]), texts.index("patient without any")
    assert "patient" not in once[where][1] and "[EMAIL]" in once[where][1] and once[where][0]
    assert once[0] == ([], None)
    ward = next(i for i, t in enumerate(texts) if "ward case" in t)
    assert "ward" in once[ward][1]  # a word of other texts too
    assert "patient" not in once[bare][1] and "without any" in once[bare][1]
    narrow = verdict(texts, everywhere=False)
    assert narrow[bare] == ([], None) and narrow[where] == once[where]


def test_pii_added_spans_match_plain_python(spark):
    """Every occurrence of a disclosing term that touches no entity, beside entities too; none else."""
    odd = ["patientme7@mail.example.com", "\u00e9\u00e9me8@mail.example.com patient", "Patient.10.0.1.7 PATIENT", "patient10.0.1.7 at", "impatient patient_patient", "patient " * 700]
    texts = revealing() + odd
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = {r["term"] for r in pii.disclosing_terms(pii.with_entities(docs)).collect()}
    assert "patient" in terms
    seen = 0
    for r in pii.sanitise(docs).collect():
        text, base = texts[r["doc_id"]], [(x["start"], x["end"]) for x in r["base"]]
        found = [m.span() for m in re.finditer(r"[^\W_]+", text) if m.group().lower() in terms]
        assert [(x["start"], x["end"]) for x in r["added"]] == [(a, b) for a, b in found if not any(s < b and a < e for s, e in base)], text
        seen += len(r["added"])
    assert seen > 700


def test_pii_chance_terms_do_not_disclose(spark):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        words = [f"t{rng.randrange(2000)}x" for _ in range(5)]  # about seven texts each
        rows.append((i, " ".join(words) + (f" at 10.0.{i % 250}.{i // 250}" if i % 25 == 0 else "")))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.disclosing_terms(pii.with_entities(frame)).filter("term <> 'at'").count() == 0
    assert pii.corrected_z(1) < pii.corrected_z(1000) < pii.corrected_z(10**9) < 8


def test_pii_edge_rows(spark):
    rows = [(None, "call +1 (017) 555-7713"), (1, None), (1, "a@b.co"), (1, "a@b.co"), (2, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, len(r["base"]), r["clean"] or "") for r in pii.sanitise(frame).collect())
    assert got == [(0, 1, "call [PHONE]"), (1, 0, ""), (1, 1, "[EMAIL]"), (1, 1, "[EMAIL]"), (2, 0, "")]
    assert pii.sanitise(frame.limit(0)).count() == 0


def test_rules_statistics(spark):
    rows = corpus() + [(2000, "a b c a b c a b c\nline\nline\n\nx #$ | <", "a", "x")]
    got = {(r["doc_id"], r["text"]): r["stats"] for r in rules.with_statistics(spark.createDataFrame(rows, DOCS).select("doc_id", "text")).collect()}
    for i, t, *_ in rows:
        w = words(t)
        counts, hit = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2)), set()
        for k in range(len(w) - 2):
            if counts[tuple(w[k : k + 3])] > 1:
                hit |= {k, k + 1, k + 2}
        lines = [x for x in (t or "").split("\n") if words(x)]
        s = got[(i, t)]
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)), (i, t)


def test_rules_learn_and_keep_clean_texts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"word{rng.randint(0, 5000)}{'***' if i % 4 == 0 else ''}" for _ in range(80)), "a", "x") for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)] + [(None, 1), (9999, 0), (1, None)], "doc_id long, quality int")
    kept = rules.rule_filter(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(200) if i % 4}
    assert rules.rule_filter(docs, labels.limit(0)).count() == 200 and rules.rule_filter(docs.limit(0), labels).count() == 0


def test_substrings(spark):
    rows = corpus(3) + [(7, "only this row of id seven", "a", "x")]
    window, first = substrings.WINDOW, {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    want = []
    for i, t, *_ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    got = [tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(rows, DOCS), with_text=False).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(x[2] for x in want) > 300
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_substrings_without_repeats(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)), "a", "x") for i in range(3)] + [(7, None, "a", "x"), (8, "one", "a", "x")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, DOCS))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got.collect()) == [(0, 40, 0), (1, 40, 0), (2, 40, 0), (7, 0, 0), (8, 1, 0)]


def test_substrings_of_words_that_differ_in_one_place(spark):
    """Long words that polynomials modulo 2^64 cannot tell apart: Thue-Morse and its complement."""
    morse = "".join("ab"[bin(k).count("1") % 2] for k in range(1 << 11))
    other = morse.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{morse} {rest}", "a", "x"), (2, f"{other} {rest}", "a", "x"), (3, f"{rest} {morse}", "a", "x")]
    assert [r["n_removed"] for r in substrings.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()] == [0, 0, 0]


def test_word_hashes():
    rng = random.Random(8)
    texts = ["", "a", "ab cd", "é 日本 " * 40, "x" * 5000 + " " + "x" * 4999 + "y", *(" ".join("".join(rng.choices("ab\x00", k=rng.randint(1, 30))) for _ in range(200)) for _ in range(3))]
    data, offsets = tokens.flat_text(pa.array(texts))
    starts, ends, _ = tokens.word_bounds(data, offsets)
    for seed in tokens.SEEDS:
        got = {}
        for h, a, b in zip(tokens.word_hashes(data, starts, ends, seed).tolist(), starts, ends, strict=True):
            assert got.setdefault(data[a:b].tobytes(), h) == h
        assert len(set(got.values())) == len(got) > 300


def test_sharding(spark):
    docs = spark.createDataFrame(corpus(5), DOCS).withColumn("bytes", byte_size(F.col("text")) + 1).withColumn("text_crc32", crc(F.col("text")))
    docs = docs.selectExpr("*", "'mine' AS shard", "'own' AS slot", "'f' AS _file", "1 AS _index", "2 AS row", "3 AS _k0")
    docs = docs.union(docs.filter("doc_id = 500"))
    out = [r.asDict(recursive=True) for r in sharding.assign_shards(docs, 4, size_col="bytes").collect()]
    assert len(out) == docs.count() and all(set(r["row"]) == set(docs.columns) and (r["row"]["shard"], r["row"]["slot"], r["row"]["_file"]) == ("mine", "own", "f") for r in out)
    got = [r["row"] | {"shard": r["shard"], "slot": r["slot"]} for r in out]
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    order = sorted(got, key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"]))
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in order)
    assert sharding.assign_shards(docs.limit(0), size_col="bytes").count() == 0
    slim = docs.select("doc_id", "bytes", "text_crc32")
    assert sorted((r["shard"], r["slot"]) for r in sharding.assign_shards(slim, 4, size_col="bytes").collect()) == sorted((r["shard"], r["slot"]) for r in got)
    back = spark.read.parquet(sharding.write_shards(sharding.assign_shards(docs, 4, size_col="bytes")))
    assert sorted((r["shard"], r["slot"]) for r in back.collect()) == sorted((r["shard"], r["slot"]) for r in got)


def test_mixing(spark):
    rows = corpus(6, 200)
    docs = spark.createDataFrame(rows, DOCS).withColumn("tokens", word_count(F.col("text"))).selectExpr("*", "'t' AS target", "9 AS copies", "'g' AS _group")
    out = [r.asDict(recursive=True) for r in mixing.mix(docs, size_col="tokens").collect()]
    assert len(out) == docs.count() and all((r["row"]["target"], r["row"]["copies"], r["row"]["_group"]) == ("t", 9, "g") for r in out)
    got = [r["row"] | {k: r[k] for k in ("source_size", "target", "copies")} for r in out]
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["tokens"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Decimal([3, 1, 2][k % 3]) for k, s in enumerate(order)}
    target, open_, left = {}, list(order), Decimal(sum(sizes.values())) * Decimal("1.5")
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        target.update({s: weight[s] * level for s in open_})
        if not over:
            break
        for s in over:
            target[s], left = Decimal(2 * sizes[s]), left - 2 * sizes[s]
            open_.remove(s)
    longest = max(r["tokens"] for r in got)
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert abs(own[0]["target"] - float(target[s])) < 1e-6 and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["tokens"] * r["copies"] for r in own) - own[0]["target"]) <= longest / 2 + 1 and max(r["copies"] for r in own) <= 2
    mixed = mixing.mixed_rows(spark.createDataFrame(rows, DOCS).selectExpr("*", "1.5 AS target", "'c' AS copies"))
    assert mixed.columns == ["doc_id", "text", "source", "size", "target", "copies"] and mixed.filter("copies <> 'c' or target <> 1.5").count() == 0 and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mixed_rows(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mixed_rows(spark.createDataFrame([(1, None, None, "x"), (2, " ", "a", "x")], DOCS)).count() == 0


def test_warc_round_trip(spark):
    rows = [(5, "u5", "<p>é</p>", "x"), (3, "u3", "<p>é</p>", "x"), (9, "u 9\r\n", None, "x"), (10, None, "", "x"), (11, "u", "long " * 200_000, "x"), (None, "n", "<p>é</p>", "x"), (12, "u", "WARC/1.1\r\n\r\nin the text\r\n\r\n", "x")]
    index = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), frame_bytes=64)
    back = {r["page_id"]: r for r in warc.read_records(index.select("bundle").distinct()).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in back.items()} == {5: ("revisit", 3), 3: ("response", None), 9: ("response", None), 10: ("revisit", 9), 11: ("response", None), None: ("revisit", 3), 12: ("response", None)}
    assert all(back[i]["payload_bytes"] == len((h or "").encode()) and back[i]["payload_digest"] == warc.base32_sha1((h or "").encode()) for i, _, h, _ in rows)
    for r in index.collect():
        fields, block = warc.fetch_record(r)
        assert warc.page_of(fields["WARC-Record-ID"]) == r["page_id"]
        if r["page_id"] == 12:
            assert block.endswith(b"WARC/1.1\r\n\r\nin the text\r\n\r\n")
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_repeated_ids(spark):
    rows = [(5, "u", "one"), (5, "u", "two"), (5, "u", "two"), (3, "u", "one"), (8, "u", "two"), (None, "u", "six"), (None, "u", "six")]
    index = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert len({r["record_id"] for r in index.collect()}) == len(rows)
    back = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in warc.read_records(index.select("bundle").distinct()).collect())
    assert back == [(0, "response", 0), (0, "response", 0), (3, "response", 0), (5, "response", 0), (5, "response", 0), (5, "revisit", 3), (8, "revisit", 5)]


def test_decontamination(spark):
    rows, bench = corpus(8), [(1, None), (2, "!!"), (3, "Short-item, of 5")]
    rng = random.Random(8)
    for k in range(4, 12):
        source = words(rng.choice(rows)[1])
        bench.append((k, " ".join(source[:14])))
    rows.append((2001, "x SHORT item of 5 y; short item of 6", "a", "x"))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for k, t in bench:
        w = split(t)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    want = []
    for i, t, *_ in rows:
        w, hit, items = split(t), set(), set()
        for key, owners in windows.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit |= set(range(k, k + len(key)))
                    items |= owners
        want.append((i, len(w), len(hit), sorted(items)))
    got = decontaminate.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(bench, "item_id long, text string")).select("doc_id", "n_words", "n_hit", "item_ids")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want)) and any(x[3] for x in want)
    assert decontaminate.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "item_id long, text string")).filter("n_hit > 0").count() == 0


def test_factorisation_held_out(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 300)}{'$$$' if i % 3 == 0 else ''}" for _ in range(60)), "a", "x") for i in range(400)] + [(900, None, "a", "x"), (901, "", "a", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(200)], "doc_id long, quality int")
    machine = factorisation.fit(*factorisation.training_rows(docs, labels))
    got = {r["doc_id"]: r["score"] for r in factorisation.scored(docs, machine).collect()}
    assert len(got) == len(rows) and all(0 <= x <= 1 for x in got.values())
    assert sum((got[i] >= 0.7) == (i % 3 != 0) for i in range(200, 400)) >= 195
    plain = factorisation.fit(*factorisation.training_rows(docs, labels.limit(0)))
    assert factorisation.scored(docs.limit(0), plain).count() == 0


def test_factorisation_pairs_match_the_double_loop():
    rng = np.random.default_rng(3)
    machine = factorisation.Machine(0.3, rng.standard_normal(12).astype(np.float32), rng.standard_normal((12, 4)).astype(np.float32))
    for x in rng.standard_normal((5, 12)).astype(np.float32):
        pairs = sum(float(machine.factors[i] @ machine.factors[j]) * float(x[i]) * float(x[j]) for i in range(12) for j in range(i))
        assert abs(float(machine.logit(x[None])[0]) - (0.3 + float(x @ machine.linear) + pairs)) < 1e-4


def test_factorisation_features():
    texts = ["", "One two TWO; $$ 12\n\nOne two TWO; $$ 12\n x|y", "é " * 300, "a", " \n\t"]
    data, offsets = tokens.flat_text(pa.array(["skipped", *texts]).slice(1))
    got = factorisation.features(data, offsets)
    lower = lambda w: w.encode().translate(bytes(factorisation.LOWER))
    for x, t in zip(got, texts, strict=True):
        w, raw = words(t), t.encode()
        counts = Counter(int(tokens.word_hashes(np.frombuffer(lower(v), np.uint8), np.array([0]), np.array([len(v.encode())]))[0] % np.uint64(factorisation.BUCKETS)) for v in w)
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()))
        assert all(abs(x[b] - (math.log1p(counts[b]) / norm if b in counts else 0)) < 1e-5 for b in range(factorisation.BUCKETS))
        solid, lines = max(1, len(b"".join(raw.split()))), [v for v in raw.split(b"\n") if v]
        share = lambda chars: math.sqrt(sum(c in chars.encode() for c in raw) / solid)
        expected = factorisation.BUCKETS * -math.expm1(-len(w) / factorisation.BUCKETS)
        want = {"log_words": math.log1p(len(w)) / 5, "log_bytes": math.log1p(len(raw)) / 8, "bytes_per_word": min(solid / max(1, len(w)), 40) / 10, "symbols": share("#*$%&<>"), "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share("0123456789"), "marks": share(".,;:!?"), "bars": share("|"), "distinct": len(counts) / max(expected, 1), "lines_per_word": min(len(lines) / max(1, len(w)), 1), "equal_lines": (len(lines) - len(set(lines))) / max(1, len(lines))}
        assert all(abs(x[factorisation.BUCKETS + k] - want[name]) < 1e-5 for k, name in enumerate(factorisation.STATISTICS)), t


def test_factorisation_training_bound_and_repeated_rows(spark):
    rows = [(i, f"some words {i}", "a", "x") for i in range(40)] * 2
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (3, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, DOCS)
    x, y = factorisation.training_rows(docs, labels, bound=10)
    assert len(x) == len(y) == 10
    scores = {}
    for r in factorisation.scored(docs, factorisation.fit(x, y)).collect():
        scores.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(v) == 1 for v in scores.values())


def test_factorisation_extra_columns_and_edge_rows(spark, tmp_path):
    """Columns of the names it computes change nothing; null, empty and long texts get a score."""
    rng = random.Random(5)
    rows = [(i, (" ".join(rng.choices(["clean", "calm", "prose"] if i % 3 else ["!!!", "BUY", "$$"], k=30)))) for i in range(90)]
    rows += [(90, None), (91, ""), (92, "calm " * 40_000), (None, "calm prose"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    clashing = {c: F.lit(7) for c in ("y", "_y", "score", "at", "x", "quality", "held_out", "predicted")}

    def result(name, docs, labels):
        for table, df in (("documents", docs), ("labels", labels)):
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        return sorted(map(tuple, factorisation.op2_quality(spark, f"{tmp_path}/{name}").collect()), key=repr)

    plain = result("plain", docs, labels)
    assert result("clashing", docs.withColumns(clashing), labels.withColumns({c: v for c, v in clashing.items() if c != "quality"})) == plain
    assert len(plain) == len(rows) and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.7) for r in plain)
    score = {r[0]: r[2] for r in plain}
    assert score[92] > 0.5 > score[0] and len([r for r in plain if r[0] == 3]) == 2
