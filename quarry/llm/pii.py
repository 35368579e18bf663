"""Personal data and the terms that give it away.

Patterns find the protected entities (e-mail, IP, card, phone). A term that
occurs mostly where a kind of entity does reveals that kind: its pointwise
mutual information with the kind, as a share of the kind's own information,
is its disclosure. The share uses the lower end of Wilson's interval for
P(kind | term), so few observations never count as certainty; its quantile is
corrected for the number of terms and kinds tested, so chance terms do not grow
with the corpus. Terms are counted map-side before they are shuffled, so a
frequent word is a row for each task. Terms at ``GENERALISE`` or more are
generalised and those at ``REMOVE`` or more are removed, in every text or, if
asked for, only in texts that hold an entity of the kind.

Everything is SQL functions. Positions are counted in code points, from the
pieces between matches and a prefix sum in blocks, so many matches stay cheap.
Patterns are possessive and begin only where a match can begin, so that long
runs of digits or letters cost linear time.

Counts are over different texts: a term's joint count is the number of those
that hold both, its total that of those that hold it, a kind's rate its share of
them. Copies of a text so add nothing to the evidence, and each text is worked
on once. Nor do near copies: a term must also hold when texts that share the
smallest hash of their five-word shingles are one piece of evidence, under each
of four hashes. A term counts only outside the entities of a text: the pieces of
an e-mail address reveal nothing that the address does not.

Defined cases: null text is empty, null ids and repeated rows are reported row
by row, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quarry.llm.text import full_text, let, sha256_hex
from quarry.plans.staging import stage

#: Kinds in their order, and what may start and make up each.
KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = (
    f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "[0-9](?:[\\x20-]?[0-9])++",
    "\\+[0-9][\\x20().0-9-]+[0-9]",
)
#: What a text must hold for the pattern to be tried at all.
HINTS = ("@", "[0-9]\\.[0-9]", "(?:[0-9][\\x20-]?){14}", "\\+[0-9]")
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
GENERALISE, REMOVE = 0.8, 0.9
#: Chance that any term of the corpus is taken to disclose by luck alone.
ERROR = 0.05
#: Words of a shingle, and minima by which texts are classed as near copies.
SHINGLE, CLASSINGS = 5, 4
SPAN = "array<struct<start:int,kind:int,end:int>>"
STEP = 256


def running_starts(steps: Column) -> Column:
    """Exclusive prefix sums of an array of int, in blocks of ``STEP``."""
    def sums(x: Column, base: Column) -> Column:
        zero = F.struct(F.array().cast("array<int>").alias("out"), base.cast("int").alias("at"))
        return F.aggregate(x, zero, lambda acc, v: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), (acc["at"] + v).alias("at")), lambda acc: acc["out"])

    def blocked(s: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / STEP).cast("int")), lambda b: F.slice(s, b * STEP + 1, F.lit(STEP)))
        return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, sums(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)), F.lit(0)), sums)))

    return let(steps, lambda s: F.when(F.size(s) <= STEP, sums(s, F.lit(0))).otherwise(blocked(s)))


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of the leftmost non-overlapping matches."""
    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def placed(p: Column) -> Column:
        sized = F.zip_with(F.slice(p["between"], 1, F.size(p["found"])), p["found"], lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"), m.alias("found")))
        return let(sized, lambda z: F.zip_with(z, running_starts(F.transform(z, lambda x: x["b"] + x["m"])), lambda x, at: F.struct((at + x["b"]).alias("start"), (at + x["b"] + x["m"]).alias("end"), x["found"].alias("found"))))

    return let(parts, placed)


def _is(kind: int):
    return lambda x: x["kind"] == kind


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Digits from the right, every second doubled and its digits added."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n + 1 - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: int, m: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return m.rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$")
    if kind == 2:
        return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    return F.length(_digits(m)).between(10, 15)


def entity_spans(text: Column) -> Column:
    """The protected entities of a text, sorted by start and kind."""
    none = F.array().cast(SPAN)

    def of(kind: int) -> Column:
        hint = F.instr(text, "@") > 0 if kind == 0 else text.rlike(HINTS[kind])
        found = F.filter(located(text, PATTERNS[kind]), lambda x: _valid(kind, x["found"]))
        return F.when(hint, F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))).otherwise(none)

    return F.sort_array(F.concat(*[of(k) for k in range(len(KINDS))]))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def terms(text: Column) -> Column:
    """Different lower-cased words of two letters or digits or more."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "[^\\p{L}\\p{N}]+"), lambda x: F.length(x) > 1), lambda x: F.lower(x)))


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def with_entities(docs: DataFrame) -> DataFrame:
    """Staged (k1, k2, text, base): the different texts and their entities."""
    text = full_text(F.col("text"))
    each = docs.select(text.alias("text"), *text_keys(text)).groupBy("k1", "k2").agg(F.min("text").alias("text"))
    return stage(each.select("k1", "k2", "text", entity_spans(F.col("text")).alias("base")), "pii-entities")


def outside(text: Column, base: Column) -> Column:
    """The text with a space for each of its entities."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"])), F.lit(" ")).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))
    blanked = F.aggregate(base, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(base) == 0, text).otherwise(blanked)


def neighbourhoods(text: Column) -> Column:
    """``CLASSINGS`` minima over the hashes of a text's shingles: near copies agree in most of them."""
    lowered = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda x: F.length(x) > 0)
    codes = lambda w: F.when(F.size(w) <= SHINGLE, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)])))
    smallest = lambda c, k: F.array_min(F.transform(c, lambda x: F.xxhash64(F.lit(k), x)))
    return let(let(lowered, codes), lambda c: F.array(*[smallest(c, k) for k in range(CLASSINGS)]))


def corrected_z(tested: int, error: float = ERROR) -> float:
    """Quantile at which one of ``tested`` bounds fails with a chance of at most ``error`` (Bonferroni)."""
    return -NormalDist().inv_cdf(error / max(1, tested))


def disclosures(sums: DataFrame, whole: Row, z: float) -> DataFrame:
    """A row for each kind of ``sums`` (total, j0, j1, ...) with its disclosure at quantile ``z``; ``whole``: the same of all texts (n, k0, k1, ...)."""
    rates = [whole[f"k{k}"] / whole["n"] if whole["n"] else 0.0 for k in range(len(KINDS))]
    by_kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"j{k}").alias("joint"), F.lit(rates[k]).alias("rate")) for k in range(len(KINDS))]))
    kept = [c for c in sums.columns if c not in {f"j{k}" for k in range(len(KINDS))}]
    scored = sums.select(*kept, by_kind.alias("x")).select(*kept, "x.*").filter("joint > 0 and rate > 0 and rate < 1")
    share = F.col("joint") / F.col("total")
    low = (share + z * z / (2 * F.col("total")) - z * F.sqrt(share * (1 - share) / F.col("total") + z * z / (4 * F.col("total") * F.col("total")))) / (1 + z * z / F.col("total"))
    return scored.withColumn("disclosure", F.log2(low / F.col("rate")) / -F.log2("rate")).drop("rate")


def disclosing_terms(entities: DataFrame, least: float = GENERALISE) -> DataFrame:
    """(term, kind, joint, total, disclosure) of the terms at ``least`` or more."""
    return disclosing(entities, least)[0]


def disclosing(entities: DataFrame, least: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """The rows of ``disclosing_terms``, and staged (k1, k2, kinds, term): the texts that hold these terms outside their entities, others perhaps too.

    A term must reach ``least`` when texts are counted, and again under each of
    ``CLASSINGS`` classings of the texts by a shared minimum, where a class is one
    piece of evidence; its disclosure is the least of these.
    """
    n = entities.agg(F.count("*").alias("n"), *[F.count_if(F.exists("base", _is(k))).alias(f"k{k}") for k in range(len(KINDS))]).first()
    kinds = F.array_distinct(F.transform("base", lambda x: x["kind"])).alias("kinds")
    bare = outside(F.col("text"), F.col("base"))
    words = entities.select(kinds, F.explode(terms(bare)).alias("term"))
    sums = stage(words.groupBy("term").agg(F.count("*").alias("total"), *[F.count_if(F.array_contains("kinds", k)).alias(f"j{k}") for k in range(len(KINDS))]), "pii-terms")
    z = corrected_z(sums.count() * sum(0 < n[f"k{k}"] < n["n"] for k in range(len(KINDS))))
    plain = stage(disclosures(sums, n, z).filter(F.col("disclosure") >= least).select("term", "kind", "joint", "total", "disclosure"), "pii-plain")
    every = entities.select("k1", "k2", kinds, F.explode(terms(bare)).alias("term"))
    held = stage(every.join(plain.select("term").distinct(), "term", "left_semi"), "pii-held")
    asked = stage(held.select("k1", "k2").distinct(), "pii-asked")  # its size is known, so texts move only where it is large
    near = entities.join(asked, ["k1", "k2"], "left_semi").select("k1", "k2", bare.alias("bare")).select("k1", "k2", neighbourhoods(F.col("bare")).alias("near"))  # of these texts alone
    # outer, though never empty: else Spark adds a filter on the size of ``near`` and hashes every text below the semi-join to answer it
    met = held.join(near, ["k1", "k2"]).select("term", "kinds", F.posexplode_outer("near").alias("classing", "near"))
    classes = met.groupBy("term", "classing", "near").agg(*[F.max(F.array_contains("kinds", k).cast("long")).alias(f"j{k}") for k in range(len(KINDS))])
    counted = classes.groupBy("term", "classing").agg(F.count("*").alias("total"), *[F.sum(f"j{k}").alias(f"j{k}") for k in range(len(KINDS))])
    least_of = disclosures(counted, n, z).groupBy("term", "kind").agg(F.min("disclosure").alias("classed"))
    both = plain.join(least_of, ["term", "kind"]).withColumn("disclosure", F.least("disclosure", "classed"))
    return both.filter(F.col("disclosure") >= least).select("term", "kind", "joint", "total", "disclosure"), held


def with_terms(entities: DataFrame, disclosing: DataFrame, held: DataFrame, everywhere: bool = True) -> DataFrame:
    """(k1, k2, text, base, added) of the texts with findings; ``added``: (start, kind, end, removed) of revealing terms outside the entities.

    ``held`` (k1, k2, term) names the texts in which terms are looked for: a term that touches no
    entity is one of the text without them, so no other text can hold it. Unless
    ``everywhere``, a term counts only in texts with an entity of a kind it discloses.
    """
    asked = stage(held.join(disclosing.select("term").distinct(), "term", "left_semi").select("k1", "k2").distinct(), "pii-holders")  # its size is known, so texts move only where it is large
    apart = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    tokens = entities.join(asked, ["k1", "k2"], "left_semi").select("k1", "k2", F.array_distinct(F.transform("base", lambda x: x["kind"])).alias("kinds"), F.explode(F.filter(located(F.col("text"), "[\\p{L}\\p{N}]+"), lambda t: (F.length(t["found"]) > 1) & apart(t))).alias("t"))
    met = tokens.select("k1", "k2", "kinds", "t.start", "t.end", F.lower("t.found").alias("term")).join(disclosing, "term")
    if not everywhere:
        met = met.filter(F.array_contains("kinds", F.col("kind")))
    spans = met.groupBy("k1", "k2", "start", "end").agg(F.max("disclosure").alias("d"))
    added = spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", F.lit(TERM).alias("kind"), "end", (F.col("d") >= REMOVE).alias("removed")))).alias("added"))  # of one text
    none = F.array().cast("array<struct<start:int,kind:int,end:int,removed:boolean>>")
    rows = entities.join(stage(added, "pii-added"), ["k1", "k2"], "left")
    return rows.filter((F.size("base") > 0) | F.col("added").isNotNull()).withColumn("added", F.coalesce("added", none))


def redacted(text: Column, base: Column, added: Column) -> Column:
    """The text with entities and generalised terms named by kind and removed terms cut out."""
    all_spans = F.sort_array(F.concat(F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit(False).alias("removed"))), F.transform(added, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["removed"].alias("removed")))))
    names = F.array(*[F.lit(f"[{x.upper()}]") for x in (*KINDS, "term")])
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"])), F.when((x["start"] < acc["at"]) | x["removed"], F.lit("")).otherwise(F.get(names, x["kind"]))).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))
    return F.aggregate(all_spans, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def findings(docs: DataFrame, clean: Callable[[Column], Column], everywhere: bool = True) -> DataFrame:
    """(doc_id, base, added, clean) of every row; ``clean`` is applied to the redacted text, null where nothing was found."""
    entities = with_entities(docs)
    terms_found, held = disclosing(entities)
    marked = with_terms(entities, stage(terms_found, "pii-disclosing"), held, everywhere)
    found = stage(marked.select("k1", "k2", "base", "added", clean(redacted(F.col("text"), F.col("base"), F.col("added"))).alias("clean")), "pii-found")
    rows = docs.select("doc_id", *text_keys(full_text(F.col("text")))).join(found, ["k1", "k2"], "left")
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType))
    return rows.select("doc_id", none("base").alias("base"), none("added").alias("added"), "clean")


def sanitise(docs: DataFrame, everywhere: bool = True) -> DataFrame:
    """(doc_id, base, added, clean) of every row: the entities, the revealing terms and the redacted text.

    ``clean`` is null where nothing was found, so that the text stays as it is.
    """
    return findings(docs, lambda text: text, everywhere)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data, the terms that reveal it, and the redacted text's digest (null where nothing was found)."""
    found = findings(spark.read.parquet(f"{sf_dir}/documents.parquet"), sha256_hex)
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    spans = F.sort_array(F.concat("base", F.transform("added", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))))
    return found.select("doc_id", *counts, sha256_hex(span_text(F.col("base"))).alias("base_sha256"), span_text(spans).alias("spans"), F.col("clean").alias("clean_sha256"))
