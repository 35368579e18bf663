"""Quality rules learned as a decision list.

Statistics of each text come from SQL functions alone. Sequential covering
then learns an ordered list of threshold conjunctions that reject: a rule
grows by the condition of the largest FOIL gain, is pruned to the prefix that
does best on rows set aside, and the rows it covers leave the table. The list
becomes one ordered ``CASE WHEN`` expression.

All counting is grouped aggregation: values are replaced by their bin between
quantiles, and each growth step reads one histogram of at most
features x bins x 2 rows. The driver therefore holds no data rows, whatever
the number of labels.

Defined cases: null text has no words and fails the base rule; labels that are
null, contradict each other or belong to no document teach nothing; without
labels of both kinds no rule is learned and only the base rule decides;
repeated rows get equal results; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.text import SPACE_CHARS, crc, full_text, is_held_out, let, words
from quarry.plans.staging import stage

MIN_WORDS, WINDOW = 50, 3
BINS, MAX_CONDITIONS, MAX_RULES = 64, 3, 12
#: A rule must be right at least so often, and cover at least so many rejected rows.
MIN_PRECISION, MIN_COVER = 0.9, 3
FEATURES = ("n_words", "chars_per_word", "symbols_per_word", "repeat_share", "dup_line_share", "upper_share", "words_per_line")


def repeated_words(w: Column, k: int = WINDOW) -> Column:
    """How many words lie in windows of ``k`` that the list holds twice or more.

    Each window's hash has its low bits replaced by the position, so one sort of
    longs brings equal windows together; only those whose high bits meet are
    then compared as text. The count is a sweep over the sorted positions.
    """

    def windows(bits: int) -> Column:
        mask = F.lit((1 << bits) - 1).cast("long")
        code = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]).bitwiseAND(F.lit(-(1 << bits)).cast("long")).bitwiseOR(i.cast("long"))
        codes = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - k), code))
        # numbers of the codes that share their high bits with the one before
        again = lambda s: F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.shiftrightunsigned(F.get(s, i).bitwiseXOR(F.get(s, i - 1)), bits) == 0)
        both = lambda s: let(F.when(F.size(s) > 1, again(s)).otherwise(F.array().cast("array<int>")), lambda d: F.transform(F.array_union(d, F.transform(d, lambda i: i - 1)), lambda i: F.get(s, i).bitwiseAND(mask).cast("int")))
        return let(codes, both)

    close = F.when(F.size(w) < (1 << 22), windows(22)).otherwise(windows(31))
    named = F.sort_array(F.transform(close, lambda p: F.struct(F.array_join(F.slice(w, p + 1, k), " ").alias("s"), p.alias("p"))))
    equal = lambda n: F.transform(F.filter(n, lambda x, i: F.coalesce(x["s"] == F.get(n, i - 1)["s"], F.lit(False)) | F.coalesce(x["s"] == F.get(n, i + 1)["s"], F.lit(False))), lambda x: x["p"])
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    sweep = F.aggregate(F.sort_array(let(named, equal)), zero, lambda acc, p: F.struct((p + k).alias("end"), (acc["n"] + F.least(F.lit(k), p + k - acc["end"])).alias("n")), lambda acc: acc["n"])
    return F.when(F.size(w) < k, F.lit(0)).otherwise(sweep).cast("long")


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``stats``: base counts and the shares that rules may ask for."""
    text = full_text(F.col(text_col))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    counted = df.withColumn("stats", F.struct(
        let(words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("r"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
        count("[#*$%&|<>]").alias("symbols"), count("[A-Z]").alias("upper"),
    ))
    s = F.col("stats")
    share = lambda a, b: (a / F.greatest(b, F.lit(1).cast("long"))).cast("double")
    return counted.withColumn("stats", F.struct(
        s["w"]["n"].alias("n_words"), s["w"]["chars"].alias("word_chars"), s["symbols"].alias("n_symbols"), s["l"]["d"].alias("n_dup_lines"), s["w"]["r"].alias("n_repeat_words"),
        share(s["w"]["chars"], s["w"]["n"]).alias("chars_per_word"), share(s["symbols"], s["w"]["n"]).alias("symbols_per_word"), share(s["w"]["r"], s["w"]["n"]).alias("repeat_share"),
        share(s["l"]["d"], s["l"]["n"]).alias("dup_line_share"), share(s["upper"], s["w"]["chars"]).alias("upper_share"), share(s["w"]["n"], s["l"]["n"]).alias("words_per_line"),
    ))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (stats["n_repeat_words"] * 100 > stats["n_words"] * 50)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        return stats[self.feature] > F.lit(self.threshold) if self.above else stats[self.feature] <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rules:
    """An ordered list of conjunctions; the first that holds rejects."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejecting(self, stats: Column) -> Column:
        """Number of the first rule that holds, from 1; null if none does."""
        out = F
        for k, rule in enumerate(self.rules, 1):
            held = F.lit(True)
            for c in rule:
                held = held & c.column(stats)
            out = out.when(held, F.lit(k))
        return out if self.rules else F.lit(None).cast("int")

    def kept(self, stats: Column) -> Column:
        return ~base_failed(stats) & self.rejecting(stats).isNull()

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) or "reject nothing"


def labelled(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Training rows (``stats``, ``bad``, ``aside``): labelled, not held out, and past the base rule."""
    agreed = labels.filter(F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"), F.max("quality").alias("_q")).filter("quality = _q").select(id_col, "quality")
    rows = stats.select(id_col, "stats").filter(~is_held_out(F.col(id_col)) & ~base_failed(F.col("stats"))).join(agreed, id_col)
    return rows.select("stats", (F.col("quality") == 0).alias("bad"), (crc(F.concat(F.lit("aside"), F.col(id_col).cast("string"))) % 3 == 0).alias("aside"))


def learn_rules(rows: DataFrame, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER, max_rules: int = MAX_RULES) -> Rules:
    """Sequential covering over rows of ``labelled``."""
    points = [k / BINS for k in range(BINS + 1)]
    found = rows.agg(*[F.percentile_approx(F.col("stats")[f], points, 10_000).alias(f) for f in FEATURES]).first()
    seen_at = {f: sorted(set(found[f] or [])) for f in FEATURES}
    cuts = {f: [(a + b) / 2 for a, b in zip(x, x[1:], strict=False)] for f, x in seen_at.items()}  # halfway, so that a value just beside the known ones doesn't tip
    place = lambda f: F.aggregate(F.array(*[F.lit(float(t)) for t in cuts[f]]) if cuts[f] else F.array().cast("array<double>"), F.lit(0), lambda acc, t: acc + (F.col("stats")[f] > t).cast("int"))
    table = stage(rows.select(F.array(*[place(f) for f in FEATURES]).alias("bins"), "bad", "aside").groupBy("bins", "bad", "aside").agg(F.count("*").alias("n")), "rule-bins")
    # a condition on bins: (feature number, above, cut number); above: bin > cut, else bin <= cut
    holds = lambda c: F.col("bins")[c[0]] > c[2] if c[1] else F.col("bins")[c[0]] <= c[2]
    rules: list[tuple[Condition, ...]] = []
    left = table
    while len(rules) < max_rules:
        grown: list[tuple[int, bool, int]] = []
        inside = left.filter(~F.col("aside"))
        while len(grown) < MAX_CONDITIONS:
            counts = inside.select("bad", "n", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin", "bad").agg(F.sum("n").alias("n")).collect()
            per: dict[int, dict[int, list[int]]] = {}
            for r in counts:
                per.setdefault(r["f"], {}).setdefault(r["bin"], [0, 0])[r["bad"]] += r["n"]
            whole = [sum(x[k] for x in per.get(0, {}).values()) for k in (0, 1)]
            if not whole[1] or not whole[0]:
                break
            before, best = log2(whole[1] / sum(whole)), (1e-9, None)
            for f, bins in sorted(per.items()):
                good = bad = 0
                for cut in sorted(bins)[:-1]:
                    good, bad = good + bins[cut][0], bad + bins[cut][1]
                    for above, p, n in ((False, bad, good), (True, whole[1] - bad, whole[0] - good)):
                        if p >= min_cover and (gain := p * (log2(p / (p + n)) - before)) > best[0]:
                            best = (gain, (f, above, cut))
            if best[1] is None:
                break
            grown.append(best[1])
            inside = inside.filter(holds(best[1]))
        if not grown:
            break
        held, sums = F.lit(True), []
        for k, c in enumerate(grown):
            held = held & holds(c)
            sums += [F.coalesce(F.sum(F.when(held & (F.col("bad") == b) & (F.col("aside") == a), F.col("n"))), F.lit(0)).alias(f"n{k}{int(b)}{int(a)}") for b in (True, False) for a in (True, False)]
        seen = left.agg(*sums).first()
        worth = lambda k: (seen[f"n{k}11"] - seen[f"n{k}01"]) / max(1, seen[f"n{k}11"] + seen[f"n{k}01"])
        size = max(range(len(grown)), key=lambda k: (round(worth(k), 3), -k)) + 1
        right, wrong = (seen[f"n{size - 1}{b}1"] + seen[f"n{size - 1}{b}0"] for b in (1, 0))
        if right < min_cover or right < min_precision * (right + wrong):
            break
        rule = grown[:size]
        rules.append(tuple(Condition(FEATURES[f], above, float(cuts[FEATURES[f]][cut])) for f, above, cut in rule))
        covered = F.lit(True)
        for c in rule:
            covered = covered & holds(c)
        left = left.filter(~covered)
    return Rules(tuple(rules))


def rule_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rule and the learned list keep, with their columns."""
    known = docs.select(id_col, text_col).filter(~is_held_out(F.col(id_col)))
    learned = learn_rules(stage(labelled(with_statistics(known, text_col).select(id_col, "stats"), labels, id_col), "rule-rows"))
    bare = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("_text"))
    return with_statistics(bare, "_text").filter(learned.kept(F.col("stats"))).select("row.*")


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their base counts and the verdict of the learned list."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    stats = stage(with_statistics(docs.select("doc_id", "text")).select("doc_id", "stats"), "rule-statistics")
    learned = learn_rules(stage(labelled(stats, labels), "rule-rows"))
    s = F.col("stats")
    base = [s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return stats.select("doc_id", *base, base_failed(s).alias("base_failed"), learned.kept(s).alias("kept"), learned.rejecting(s).alias("rule"))
