"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes, counted over all
rows that may teach. A byte is coded in its longest known context: with
probability n(byte) / (n + d) where the context saw it (n occurrences, d different
bytes), else an escape of probability d / (n + d) is paid and the context gets one
byte shorter; below order 0 all 256 bytes are alike. Statistics are frozen, so the
code length of a text is the sum of a cost for each of its (ORDER + 1)-grams.
The language of the shortest code wins; ties go to the smaller name.

Counting: every task counts the grams of its rows in NumPy and Spark adds them up.
All shorter contexts follow from these counts, since each byte of a text, the first
ones behind a pad, ends one gram. Scoring: costs of all languages lie side by side in
a hash table, so one look-up a byte serves every language. The score is the winner's
share of the languages' probabilities, the mean probability of a byte for each language raised to the
power ``SHARPNESS``.

Every gram of every language counts. A table that tasks hold has a size known beforehand: at most ``MAX_LANGUAGES`` languages
(of more, each set has its own pass over the texts, and their verdicts are put together), of each of them ``MAX_GRAMS``
grams, and ``MAX_CELLS`` costs in all. If there are more, the table holds the most frequent grams of each language, with their costs by all counts,
and every other gram of a text goes, with how often it occurs there, to a join with its costs. These
come from slices of the counts: a gram abcd needs the counts of the grams with the same bc, and those of two bytes, which are few.

Defined cases: null text and text without a letter are `und` with score 0; rows
with null text or language teach nothing; if no row teaches, every text is `und`;
repeated rows get equal results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.text import full_text, is_held_out, located
from quarry.llm.tokens import flat_text
from quarry.plans.staging import discard, stage

ORDER, MAX_GRAMS, MAX_LANGUAGES, SHARPNESS = 3, 200_000, 64, 20.0
#: Bytes worked on at a time, and grams that a task keeps of a language before it merges them.
CHUNK, MERGE = 1 << 18, 1 << 22
#: Costs in the table of one model, and grams in a slice of the counts, unless more have the same middle.
MAX_CELLS, SLICE = 1 << 22, 1 << 17
#: Parts of a bit: sums over tasks are whole numbers of them, so they are equal in any order.
PARTS = 1 << 24
#: What precedes a text.
PAD = b"\n" * ORDER
UNKNOWN = "und"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray) -> np.ndarray:
    """The (ORDER + 1)-gram that ends at each byte after the pad, as a number."""
    out = np.zeros(len(data) - ORDER, np.uint32)
    for k in range(ORDER + 1):
        out = (out << np.uint32(8)) | data[k : len(data) - ORDER + k]
    return out


def coded(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``CHUNK`` bytes: first, last, the grams that end at their bytes and where each text's begin.

    A longer text comes alone, in several pieces.
    """
    first, count = 0, len(offsets) - 1
    while first < count:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        low, high = int(offsets[first]), int(offsets[last])
        if high - low > CHUNK:
            padded = np.concatenate((np.frombuffer(PAD, np.uint8), data[low:high]))
            for at in range(0, high - low, CHUNK):
                yield first, last, grams(padded[at : at + CHUNK + ORDER]), np.zeros(1, np.int64)
        elif high > low:
            sizes = np.diff(offsets[first : last + 1])
            place = np.arange(high - low) + ORDER * np.repeat(np.arange(len(sizes)), sizes)
            padded = np.full(high - low + ORDER * len(sizes), PAD[0], np.uint8)
            padded[place + ORDER] = data[low:high]
            yield first, last, grams(padded)[place], offsets[first:last] - low
        first = last


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


class Counts:
    """Gram counts of several languages, in bounded memory."""

    def __init__(self):
        self.done: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.waiting: dict[str, list[np.ndarray]] = {}
        self.held = 0

    def add(self, lang: str, codes: np.ndarray) -> None:
        self.waiting.setdefault(lang, []).append(codes)
        self.held += len(codes)
        if self.held >= MERGE:
            self.merge()

    def merge(self) -> None:
        for lang, codes in self.waiting.items():
            keys, counts = np.unique(np.concatenate(codes), return_counts=True)
            if lang in self.done:
                keys, counts = _added(np.concatenate((self.done[lang][0], keys)), np.concatenate((self.done[lang][1], counts)))
            self.done[lang] = keys, counts
        self.waiting, self.held = {}, 0


def gram_counts(docs: DataFrame) -> DataFrame:
    """Staged (lang, gram, n) over all rows that may teach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counts()
        for batch in batches:
            data, offsets = flat_text(batch.column(1))
            coding = batch.column(0).dictionary_encode()
            names, of = coding.dictionary.to_pylist(), coding.indices.to_numpy()
            for first, last, codes, starts in coded(data, offsets):
                which = np.repeat(of[first:last], np.diff(np.append(starts, len(codes))))
                for k in np.unique(which):
                    own.add(names[k], codes[which == k])
        own.merge()
        for lang, (keys, counts) in own.done.items():
            for low in range(0, len(keys), CHUNK):
                part = slice(low, low + CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part]), pa.string()), pa.array(keys[part].astype(np.int64)), pa.array(counts[part].astype(np.int64))], ["lang", "gram", "n"])

    taught = docs.filter(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    each = taught.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return stage(each.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")


@dataclass
class Lookup:
    """Rows of numbers under 32-bit keys, found by open addressing."""

    slots: np.ndarray
    keys: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, rows: np.ndarray) -> Lookup:
        rows = rows if len(rows) else np.zeros((1, rows.shape[1]), rows.dtype)  # what was not found reads the last one
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), _hashed(keys, bits)
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]  # of several the last one stays
            away = slots[at] != left
            left, at = left[away], (at[away] + 1) & ((1 << bits) - 1)
        return Lookup(slots, keys, rows)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for none."""
        bits = len(self.slots).bit_length() - 1
        at = _hashed(asked, bits)
        out = self.slots[at]
        open_ = np.flatnonzero(out >= 0)
        open_ = open_[self.keys[out[open_]] != asked[open_]]
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << bits) - 1)
            out[open_] = self.slots[at[open_]]
            open_ = open_[out[open_] >= 0]
            open_ = open_[self.keys[out[open_]] != asked[open_]]
        return out


def _hashed(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * FACTOR) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """Costs in bits. ``full``: known grams of all orders' bytes; ``escapes`` and ``shorter``: contexts of ``ORDER`` bytes, and
    grams of that length; ``low``: for every two bytes the cost of the second, escapes within and the one before it included.
    Of more grams than a table may hold, ``full`` has the most frequent ones and there is no ``escapes`` nor what follows it."""

    languages: list
    full: Lookup
    escapes: Lookup | None = None
    shorter: Lookup | None = None
    low: np.ndarray | None = None
    low_escapes: np.ndarray | None = None

    @property
    def whole(self) -> bool:
        return self.escapes is not None

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """(codes, languages): the code length of each gram's last byte in its context; NaN where a model that is not whole cannot tell."""
        found = self.full.find(codes)
        out = self.full.rows[found]
        missing = np.flatnonzero(found < 0)
        if len(missing) and not self.whole:
            out[missing] = np.nan
        elif len(missing):
            rest = codes[missing]
            escape = self.escapes.find(rest >> np.uint32(8))
            tail = rest & np.uint32(0xFFFFFF)
            short = self.shorter.find(tail)
            low = self.low_escapes[tail >> np.uint32(8)] + self.low[tail & np.uint32(0xFFFF)]
            out[missing] = np.where(escape[:, None] >= 0, self.escapes.rows[escape], 0) + np.where(short[:, None] >= 0, self.shorter.rows[short], low)
        return out


def _levels(table: dict, lengths: range) -> tuple[dict, dict]:
    """By gram length, for each language in order: grams (key, n), and contexts before them (key, n, d)."""
    levels, contexts = {}, {}
    for length in lengths:
        mask = np.uint32((1 << (8 * length)) - 1)
        levels[length] = [_added(table[x][0].astype(np.uint32) & mask, table[x][1].astype(np.int64)) for x in sorted(table)]
        contexts[length] = []
        for keys, n in levels[length]:
            heads, sums = _added(keys >> np.uint32(8), n)
            _, kinds = _added(keys >> np.uint32(8), np.ones(len(keys), np.int64))
            contexts[length].append((heads, sums, kinds))
    return levels, contexts


def low_costs(table: dict) -> np.ndarray:
    """Costs of all grams of two bytes, from counts of grams of two bytes or more."""
    levels, contexts = _levels(table, range(1, 3))
    below = np.zeros((0, len(table)))
    for length in (1, 2):
        size = 1 << (8 * length)
        out = np.zeros((size, len(table)), np.float32)
        for j, (heads, sums, kinds) in enumerate(contexts[length]):
            escape = np.zeros(size >> 8)
            escape[heads] = -np.log2(kinds / (sums + kinds))
            out[:, j] = np.repeat(escape, 256) + (np.tile(below[:, j], size >> 8) if len(below) else 8.0)
            keys, n = levels[length][j]
            at = np.searchsorted(heads, keys >> np.uint32(8))
            out[keys, j] = -np.log2(n / (sums[at] + kinds[at]))
        below = out
    return below


def build(table: dict[str, tuple[np.ndarray, np.ndarray]], low: np.ndarray | None = None) -> Model:
    """The frozen trees of all languages from their gram counts; with ``low``, the counts may be those of some middles alone."""
    names = sorted(table)
    total = len(names)
    low = low_costs(table) if low is None else low
    levels, contexts = _levels(table, range(3, ORDER + 2))

    def escape_rows(length: int) -> tuple[np.ndarray, np.ndarray]:
        """Escape costs of the contexts before grams of ``length`` bytes."""
        keys = np.unique(np.concatenate([x[0] for x in contexts[length]] or [np.zeros(0, np.uint32)]))
        rows = np.zeros((len(keys), total), np.float32)
        for j, (heads, sums, kinds) in enumerate(contexts[length]):
            rows[np.searchsorted(keys, heads), j] = -np.log2(kinds / (sums + kinds))
        return keys, rows

    def known(length: int, escapes: tuple[np.ndarray, np.ndarray], below) -> tuple[np.ndarray, np.ndarray]:
        """Costs of the grams of ``length`` bytes that any language holds."""
        keys = np.unique(np.concatenate([x[0] for x in levels[length]]))
        at = np.searchsorted(escapes[0], keys >> np.uint32(8))
        rows = escapes[1][at] + below(keys & np.uint32((1 << (8 * (length - 1))) - 1))
        for j in range(total):
            own, n = levels[length][j]
            heads, sums, kinds = contexts[length][j]
            k = np.searchsorted(heads, own >> np.uint32(8))
            rows[np.searchsorted(keys, own), j] = -np.log2(n / (sums[k] + kinds[k]))
        return keys, rows

    escape_keys, escape_values = escape_rows(3)
    low_escapes = np.zeros((1 << 16, total), np.float32)
    low_escapes[escape_keys] = escape_values
    three = known(3, (escape_keys, escape_values), lambda k: low[k])
    shorter = Lookup.of(*three)
    four = escape_rows(4)

    def under(keys: np.ndarray) -> np.ndarray:
        return three[1][np.searchsorted(three[0], keys)]  # a known gram's end is known

    return Model(names, Lookup.of(*known(4, four, under)), Lookup.of(*four), shorter, low, low_escapes)


def language_sets(counts: DataFrame) -> list[list[str]]:
    """All languages, those with the most bytes first, in sets that one model serves."""
    names = [r["lang"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()]
    return [sorted(names[k : k + MAX_LANGUAGES]) for k in range(0, len(names), MAX_LANGUAGES)]


def _table(counts: DataFrame, total: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts (j, gram, n) on the driver."""
    rows = counts.select("j", "gram", "n").toArrow().sort_by([("j", "ascending"), ("gram", "ascending")])
    of, keys, n = (rows[x].to_numpy() for x in ("j", "gram", "n"))
    return {j: (keys[of == j], n[of == j]) for j in range(total)}


@dataclass
class Learned:
    """A model of some languages, and what it was made of: counts (j, gram, n) and the costs of two bytes."""

    model: Model
    counts: DataFrame
    low: np.ndarray

    @staticmethod
    def of(counts: DataFrame, names: list[str]) -> Learned:
        total = len(names)
        place = (F.array_position(F.array(*map(F.lit, names)), F.col("lang")) - 1).cast("int").alias("j")
        known = counts.filter(F.col("lang").isin(names)).select(place, "gram", "n")
        most = MAX_CELLS // total
        kinds = known.agg(F.countDistinct("gram")).first()[0]
        if kinds <= most and max(r["count"] for r in known.groupBy("j").count().collect()) <= MAX_GRAMS:
            model = build(_table(known, total))
            model.languages = names
            return Learned(model, known, model.low)
        low = low_costs(_table(known.groupBy("j", F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.sum("n").alias("n")), total))
        # how many grams of a language are at least so frequent, from a row for each count that occurs; of a gram's ranks its best one counts
        upto = F.sum("grams").over(Window.partitionBy("j").orderBy(F.desc("n")))
        ranks = known.groupBy("j", "n").agg(F.count("*").alias("grams")).select("j", "n", upto.alias("rank"))
        best = stage(known.join(ranks, ["j", "n"]).groupBy("gram").agg(F.min("rank").alias("rank")), "language-ranks")
        limits = [MAX_GRAMS >> k for k in range(MAX_GRAMS.bit_length())]
        within = best.agg(*[F.count_if(F.col("rank") <= x) for x in limits]).first()
        limit = next((x for x, count in zip(limits, within) if count <= most), 0)
        often = best.filter(F.col("rank") <= limit)
        own = Learned(Model(names, Lookup.of(np.zeros(0, np.uint32), np.zeros((0, total), np.float32))), known, low)
        rows = own.costs(often).toArrow()
        own.model.full = Lookup.of(rows["gram"].to_numpy().astype(np.uint32), np.stack([rows[f"c{j}"].to_numpy() for j in range(total)], axis=1))
        return own

    def costs(self, asked: DataFrame) -> DataFrame:
        """(gram, c0, c1, ...): each asked gram once, with the cost of its last byte in every language by all counts.

        A slice holds all that was counted for its middles: at most 2 ** 16 asked grams of a middle, and as many of each language.
        """
        spark, total = asked.sparkSession, len(self.model.languages)
        asked = stage(asked.select("gram").distinct(), "language-asked")
        slices = min(1 << 16, 1 + (asked.count() + self.counts.count()) // SLICE)
        shared = spark.sparkContext.broadcast(self.low)  # a row for every two bytes, a column for each language of the set
        names = [f"c{j}" for j in range(total)]

        def run(asked: pa.Table, counts: pa.Table) -> pa.Table:
            of, keys, n = (counts[x].to_numpy() for x in ("j", "gram", "n"))
            model = build({j: (keys[of == j], n[of == j]) for j in range(total)}, shared.value)
            grams = asked["gram"].to_numpy()
            parts = [model.costs(grams[k : k + CHUNK].astype(np.uint32)) for k in range(0, len(grams), CHUNK)]
            rows = np.concatenate(parts) if parts else np.zeros((0, total), np.float32)
            return pa.table([pa.array(grams), *[pa.array(np.ascontiguousarray(rows[:, j])) for j in range(total)]], ["gram", *names])

        middle = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
        sliced = [x.withColumn("slice", F.pmod(F.xxhash64(middle), F.lit(slices))).groupBy("slice") for x in (asked, self.counts)]
        return sliced[0].cogroup(sliced[1]).applyInArrow(run, ", ".join(["gram long", *[f"{c} float" for c in names]]))


def learn(docs: DataFrame) -> Model | None:
    """The model of the first set of languages; None if no row teaches. ``identify`` asks all sets, and the counts for what is not in a model."""
    counts = gram_counts(docs)
    sets = language_sets(counts)
    return Learned.of(counts, sets[0]).model if sets else None


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits that each language takes for each text, a row for each text."""
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    for first, last, codes, starts in coded(data, offsets):
        ends = np.append(starts[1:], len(codes))
        full = np.flatnonzero(ends > starts)
        out[first + full] += np.add.reduceat(model.costs(codes), starts[full], axis=0, dtype=np.float64)
    return out


def judged(bits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the best language, its bits a byte, and how much all languages weigh when the best one weighs 1."""
    rates = bits / np.maximum(1, sizes)[:, None]
    least = rates.min(axis=1)
    return rates.argmin(axis=1), least, np.exp2((least[:, None] - rates) * SHARPNESS).sum(axis=1)


def _rest(codes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Different texts, and for each its different grams and how often they occur."""
    pairs, times = np.unique(texts.astype(np.int64) << 32 | codes, return_counts=True)
    first = np.flatnonzero(np.diff(pairs >> 32, prepend=-1))
    ends = pa.array(np.append(first, len(pairs)).astype(np.int32))
    return pairs[first] >> 32, *[pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (pairs & 0xFFFFFFFF, times)]


def coded_sums(texts: DataFrame, learned: Learned) -> DataFrame:
    """Staged (_file, _at, row, s0, s1, ...): the code length of every text in each language, in parts of a bit.

    Texts come as (_file, _at, doc_id, letters, text). Tasks add up what the model holds and hand on the other grams.
    """
    model, spark = learned.model, texts.sparkSession
    total, kind = len(model.languages), dict(texts.dtypes)["doc_id"]
    shared = spark.sparkContext.broadcast(model)  # bounded by MAX_LANGUAGES and MAX_CELLS
    fields = ["_file", "_at", "doc_id", "letters", "size", "own", "grams", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = flat_text(batch.column(4))
            count = len(offsets) - 1
            out = np.zeros((count, total))
            for first, _, codes, starts in coded(data, offsets):
                costs = model.costs(codes)
                sizes = np.diff(np.append(starts, len(codes)))
                away = np.flatnonzero(np.isnan(costs[:, 0]))
                if len(away):
                    costs[away] = 0
                    at, grams, times = _rest(codes[away], first + np.repeat(np.arange(len(sizes)), sizes)[away])
                    here = [batch.column(k).take(pa.array(at)) for k in (0, 1)]
                    empty = [pa.nulls(len(at), x) for x in (batch.column(2).type, pa.bool_(), pa.int64(), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*here, *empty, grams, times], fields)
                full = np.flatnonzero(sizes)
                out[first + full] += np.add.reduceat(costs, starts[full], axis=0, dtype=np.float64)
            ends = pa.array(np.arange(count + 1, dtype=np.int32) * total)
            own = pa.ListArray.from_arrays(ends, pa.array(np.rint(out * PARTS).astype(np.int64).ravel()))
            none = pa.nulls(count, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(np.diff(offsets)), own, none, none], fields)

    schema = f"_file string, _at long, doc_id {kind}, letters boolean, size long, own array<long>, grams array<long>, times array<long>"
    found = stage(texts.select("_file", "_at", "doc_id", "letters", "text").mapInArrow(run, schema), "language-parts")
    row = F.struct("doc_id", "letters", "size").alias("row")
    sums = found.filter("own is not null").select("_file", "_at", row, *[F.col("own")[j].alias(f"s{j}") for j in range(total)])
    if not model.whole:
        rest = found.filter("grams is not null").select("_file", "_at", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("_file", "_at", "x.*")
        costs = learned.costs(rest.select(F.col("grams").alias("gram")))
        priced = rest.join(costs, F.col("grams") == F.col("gram"))
        none = F.lit(None).cast(sums.schema["row"].dataType).alias("row")
        parts = [(F.col("times") * F.rint(F.col(f"c{j}").cast("double") * PARTS).cast("long")).alias(f"s{j}") for j in range(total)]
        each = sums.unionByName(priced.select("_file", "_at", none, *parts)).groupBy("_file", "_at")
        sums = each.agg(F.first("row", ignorenulls=True).alias("row"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(total)])
    out = stage(sums, "language-sums")
    discard(found)
    shared.destroy()
    return out


def verdicts(texts: DataFrame, learned: Learned) -> DataFrame:
    """(_file, _at, doc_id, letters, lang, least, weight) of every text by the languages of one model."""
    sums = coded_sums(texts, learned)
    names, kind = learned.model.languages, dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.stack([batch.column(k).to_numpy() for k in range(5, 5 + len(names))], axis=1) / PARTS
            best, least, weight = judged(bits, batch.column(4).to_numpy())
            langs = pa.array([names[k] for k in best], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], langs, pa.array(least), pa.array(weight)], ["_file", "_at", "doc_id", "letters", "lang", "least", "weight"])

    flat = sums.select("_file", "_at", "row.doc_id", "row.letters", "row.size", *[f"s{j}" for j in range(len(names))])
    return flat.mapInArrow(run, f"_file string, _at long, doc_id {kind}, letters boolean, lang string, least double, weight double")


def _answers(judged: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte); text without a letter is of no language."""
    told = lambda value, other: F.when(F.col("letters"), value).otherwise(F.lit(other))
    return judged.select("doc_id", told(F.col("lang"), UNKNOWN).alias("lang_pred"), told(1 / F.col("weight"), 0.0).alias("score"), told(F.col("least"), 0.0).alias("bits_per_byte"))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of every row."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    text = full_text(F.col("text"))
    letters = lambda text: text.rlike("\\p{L}").alias("letters")
    rows = docs.select("doc_id", text.alias("text"), letters(text))
    counts = gram_counts(docs)
    sets = language_sets(counts)
    if not sets:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    learned = Learned.of(counts, sets[0])
    if len(sets) > 1 or not learned.model.whole:
        text = full_text(F.col("row.text"))
        placed = located(docs).select("_file", "_at", "row.doc_id", letters(text), text.alias("text"))
        found = verdicts(placed, learned)
        if len(sets) > 1:
            for names in sets[1:]:
                found = found.unionByName(verdicts(placed, Learned.of(counts, names)))
            # a row for each set of languages; the weights are put together in the order of the sets' bits
            found = found.groupBy("_file", "_at").agg(F.first("doc_id").alias("doc_id"), F.first("letters").alias("letters"), F.min(F.struct("least", "lang")).alias("best"), F.sort_array(F.collect_list(F.struct("least", "weight"))).alias("all"))
            weight = F.aggregate("all", F.lit(0.0), lambda acc, x: acc + x["weight"] * F.pow(F.lit(2.0), (F.col("best.least") - x["least"]) * SHARPNESS))
            found = found.select("doc_id", "letters", "best.*", weight.alias("weight"))
        return _answers(found)
    shared = spark.sparkContext.broadcast(learned.model)  # bounded by MAX_LANGUAGES and MAX_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = flat_text(batch.column(1))
            best, least, weight = judged(code_lengths(own, data, offsets), np.diff(offsets))
            langs = pa.array([own.languages[k] for k in best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), langs, pa.array(least), pa.array(weight)], ["doc_id", "letters", "lang", "least", "weight"])

    return _answers(rows.mapInArrow(run, f"doc_id {kind}, letters boolean, lang string, least double, weight double"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their language, learned from the rows that are not held out."""
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
