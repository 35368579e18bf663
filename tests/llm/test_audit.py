import random
import re
from itertools import permutations

from quarry.llm import audit
from tests.llm.helpers import words

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def failures(rows):
    """The set of filters that each row fails, by their definitions."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = words(t)
        own = set()
        own |= {"A"} if len(w) < 200 else set()
        own |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        own |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        own |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        out.append(own)
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed = failures(rows)
    out = {}
    for part in {lang or "" for *_, lang in rows}:
        own = [(i, f) for (i, _, lang), f in zip(rows, failed, strict=True) if (lang or "") == part]
        gone_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                before = len([x for x in own if f in x[1]]) - len(gone)
                left = [x for x in left if f not in x[1]]
                gone_by[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), before, sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f]
        for key, x in out.items():
            if key[0] == part:
                x[6] = gone_by[x[6]] if isinstance(x[6], str) else x[6]
    return {k: tuple(x) for k, x in out.items()}


def audited(docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in audit.audit(docs, labels).collect()}


def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghé日", k=rng.randint(2, 8))) for _ in range(600)]
    rows = []
    for i in range(160):
        n = rng.choice([0, 5, 199, 200, 201, 260])
        w = rng.choices(vocabulary[: rng.choice([30, 600])], k=n)
        if rng.random() < 0.3:
            w = [x.upper() for x in w]
        if rng.random() < 0.3 and w:
            w[0] = rng.choice(["#", "a$", "|"])
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w), rng.choice(["en", "de", None])))
    rows += [(200 + k, rows[3 + k % 4][1], rng.choice(["en", "fr"])) for k in range(60)]  # copies, in other parts too
    rows += [(None, rows[3][1], "en"), (None, None, "en"), (300, None, ""), (301, "", None), (301, "", None), (0, rows[0][1], "xx"), (302, "word " * 40_000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 320, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_against_every_order(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS part", "'x' AS n", "2 AS own", "3 AS k1").repartition(5)
    got = audited(docs, spark.createDataFrame(labels, LABELS).selectExpr("*", "'y' AS text", "1 AS _doc"))
    assert got == brute(rows, labels) and len(got) == 600 * len({lang or "" for *_, lang in rows})


def test_parity_sums_invert_exactly(spark):
    counted = spark.createDataFrame([("p", False, False, m, (m * 7919) % 23 + 10**12) for m in range(32)] + [("p", True, False, 5, 3), ("q", True, True, 31, 1)], "part string, good boolean, toxic boolean, mask int, n long")
    cells = {r["part"]: [tuple(x) for x in r["cells"]] for r in audit.mask_cells(audit.parity_sums(counted)).collect()}
    assert cells["p"] == [(m, (m * 7919) % 23 + 10**12 + 3 * (m == 5), 3 * (m == 5), 0) for m in range(32)]
    assert cells["q"] == [(m, int(m == 31), int(m == 31), int(m == 31)) for m in range(32)]


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audited(docs, labels) == {}
    one = audited(spark.createDataFrame([(1, None, None)], DOCS), labels)
    assert len(one) == 600 and one["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and one["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)
