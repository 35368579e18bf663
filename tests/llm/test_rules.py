"""The rule learner against sequential covering over plain rows."""

import random
from math import log2

import pytest

from quarry.llm import rules

#: Values of each statistic; each is frequent enough to be a quantile.
VALUES = range(6)


def rows_of(seed, n=240):
    """(values, bad, aside): two rejecting conjunctions, one single condition, and wrong labels."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        x = tuple(rng.choice(VALUES) for _ in rules.FEATURES)
        bad = (x[0] <= 1 and x[1] > 3) or (x[2] > 3 and x[3] <= 1) or x[6] == 5
        out.append((x, bad != (rng.random() < 0.03), rng.random() < 0.33))
    return out


def covering(rows):
    """Rules as lists of (feature number, above, threshold), and how many conditions were pruned."""
    thresholds = [[(a + b) / 2 for a, b in zip(seen, seen[1:], strict=False)] for seen in (sorted({x[f] for x, *_ in rows}) for f in range(len(rules.FEATURES)))]
    holds = lambda x, c: (x[c[0]] > c[2]) == c[1]
    tally = lambda some: (sum(r[1] for r in some), sum(not r[1] for r in some))
    found, pruned, left = [], 0, list(rows)
    while len(found) < rules.MAX_RULES:
        inside, grown = [r for r in left if not r[2]], []
        while len(grown) < rules.MAX_CONDITIONS and all(tally(inside)):
            bad, good = tally(inside)
            best, gain = None, 1e-9
            for f, cuts in enumerate(thresholds):
                for cut in cuts:
                    for above in (False, True):
                        p, n = tally([r for r in inside if holds(r[0], (f, above, cut))])
                        if p >= rules.MIN_COVER and (g := p * (log2(p / (p + n)) - log2(bad / (bad + good)))) > gain:
                            best, gain = (f, above, cut), g
            if best is None:
                break
            grown.append(best)
            inside = [r for r in inside if holds(r[0], best)]
        prefixes = [grown[:k] for k in range(1, len(grown) + 1)]
        covered = lambda rule: [r for r in left if all(holds(r[0], c) for c in rule)]

        def worth(rule):
            p, n = tally([r for r in covered(rule) if r[2]])
            return round((p - n) / max(1, p + n), 3)

        if not prefixes:
            break
        rule = max(prefixes, key=worth)  # the shortest of the best
        right, wrong = tally(covered(rule))
        if right < rules.MIN_COVER or right < rules.MIN_PRECISION * (right + wrong):
            break
        found.append(rule)
        pruned += len(grown) - len(rule)
        gone = {id(r) for r in covered(rule)}
        left = [r for r in left if id(r) not in gone]
    return found, pruned


def frame(spark, rows):
    stats = ", ".join(f"{f}: double" for f in rules.FEATURES)
    return spark.createDataFrame([(tuple(map(float, x)), bad, aside) for x, bad, aside in rows], f"stats struct<{stats}>, bad boolean, aside boolean")


@pytest.mark.parametrize("seed", [2, 4, 6])
def test_learner_matches_plain_covering(spark, seed):
    rows = rows_of(seed)
    for f in range(len(rules.FEATURES)):
        assert min(sum(x[f] == v for x, *_ in rows) for v in VALUES) > len(rows) / rules.BINS  # every value is a quantile
    want, pruned = covering(rows)
    learned = rules.learn_rules(frame(spark, rows))
    assert [[(rules.FEATURES.index(c.feature), c.above, c.threshold) for c in rule] for rule in learned.rules] == want
    assert len(want) > 1 and max(map(len, want)) > 1 and pruned  # growth, order and pruning all took part


def test_list_is_one_ordered_expression(spark):
    rows = rows_of(2, 120)
    df = frame(spark, rows)
    make = lambda *conditions: tuple(rules.Condition(rules.FEATURES[f], above, t) for f, above, t in conditions)
    learned = rules.Rules((make((0, True, 2.5), (1, False, 3.5)), make((0, True, 3.5)), make((2, False, 0.5))))
    first = lambda x: 1 if x[0] > 2.5 and x[1] <= 3.5 else 2 if x[0] > 3.5 else 3 if x[2] <= 0.5 else None
    got = df.select("stats", learned.rejecting(df["stats"]).alias("rule")).collect()
    assert [r["rule"] for r in got] == [first(r["stats"]) for r in got] and {r["rule"] for r in got} == {1, 2, 3, None}


def test_rows_of_one_kind_teach_nothing(spark):
    for bad in (True, False):
        assert rules.learn_rules(frame(spark, [((1,) * 7, bad, k % 3 == 0) for k in range(9)])).rules == ()
    assert rules.learn_rules(frame(spark, [((1,) * 7, True, False)]).limit(0)).rules == ()
