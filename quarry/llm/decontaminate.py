"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item (an item with
fewer words, but not none, is one window). Tokens are shingles of ``SHINGLE``
words (fewer if the window is shorter), ordered by how often the corpus has
them. Exact containment asks for all of a window's tokens, so its prefix is one
token: the rarest. Documents meet the windows by that token alone; the token's
offset gives the place where the window would begin, the length and positional
bounds drop places outside the document, and what is left is verified word by
word in the document's own text.

Texts are read again only where a document met a window; for the rest the number
of words is all that is left to say.

Only hashes and positions pass through the join. The token list of the
benchmark is written to a table first, so Spark compares its size with the
broadcast threshold and shuffles both sides beyond it.

Defined cases: null text has no words, an item or document without words never
matches, null or repeated ids are told apart by the text (equal rows get equal
results), empty tables give no hits, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.text import LOWER, UPPER, full_text, let, packed_row, sha256_hex
from quarry.plans.staging import stage

WINDOW, SHINGLE = 10, 5
#: Fixed value: what separates words here, all of ASCII but digits and lower-case letters.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def alnum_words(text: Column) -> Column:
    """Words after A-Z are lower-cased; texts of ASCII alone take the faster way."""
    full = full_text(text)
    low = F.when(F.length(full) == F.octet_length(full), F.lower(full)).otherwise(F.translate(full, UPPER, LOWER))
    return F.array_remove(F.split(low, GAP), "")


def shingle_hashes(words: Column, k: int) -> Column:
    """One hash for each run of ``k`` words; ``words`` must be a lambda variable or a plain column."""
    at = lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), at)).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words): every window of every item."""
    cut = lambda w: F.when(F.size(w) == 0, F.array().cast("array<array<string>>")).when(F.size(w) <= window, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - window + 1), lambda i: F.slice(w, i, window)))
    return items.select("item_id", F.explode(let(alnum_words(F.col("text")), cut)).alias("words"))


def token_rows(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, text_key, n_words, pos, token): every shingle of every document."""
    arrays = lambda w: F.struct(F.size(w).alias("n_words"), F.array(*[shingle_hashes(w, k) for k in sizes]).alias("tokens"))
    hashed = docs.select("doc_id", F.xxhash64(full_text(F.col("text"))).alias("text_key"), let(alnum_words(F.col("text")), arrays).alias("x")).select("doc_id", "text_key", "x.*")
    if len(sizes) == 1:
        return hashed.select("doc_id", "text_key", "n_words", F.posexplode(F.col("tokens")[0]).alias("pos", "token"))
    return hashed.select("doc_id", "text_key", "n_words", F.explode("tokens").alias("tokens")).select("doc_id", "text_key", "n_words", F.posexplode("tokens").alias("pos", "token"))


def candidates(docs: DataFrame, windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, start, window_id): places where a window's rarest token lies in a document."""
    tokens = lambda w: F.when(F.size(w) >= shingle, shingle_hashes(w, shingle))
    for k in range(shingle - 1, 0, -1):
        tokens = lambda w, k=k, more=tokens: F.when(F.size(w) == k, shingle_hashes(w, k)).otherwise(more(w))
    tokened = stage(windows.select("window_id", F.size("words").alias("length"), F.posexplode(tokens(F.col("words"))).alias("offset", "token")), "window-tokens")
    sizes = sorted({min(shingle, r["length"]) for r in tokened.select(F.least(F.lit(shingle), "length").alias("length")).distinct().collect()}) or [shingle]  # at most ``shingle`` rows
    rows = token_rows(docs, sizes)
    wanted = stage(tokened.select("token").distinct(), "tokens")
    counts = rows.select("token").join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)), "token", "offset")
    prefix = tokened.join(counts, "token", "left").groupBy("window_id", "length").agg(F.min(order).alias("o")).select("window_id", "length", F.col("o.token").alias("token"), F.col("o.offset").alias("offset"))
    prefix = stage(prefix, "prefix-tokens")
    keys = stage(prefix.select("token").distinct(), "prefix-keys")
    met = rows.join(keys, "token")
    # the window must begin in the document and end in it
    placed = met.join(prefix, "token").filter("pos >= offset and pos - offset + length <= n_words")
    return placed.select("doc_id", "text_key", (F.col("pos") - F.col("offset")).alias("start"), "window_id")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """A row for each document: ``doc_id, text_key, n_words, n_hit, n_items, item_ids`` (strings, sorted)."""
    membership = stage(item_windows(items, window).withColumn("window_id", F.sha1(F.array_join("words", " ").cast("binary"))).distinct(), "windows")
    windows = membership.select("window_id", "words").distinct()
    found = candidates(docs, windows, shingle).join(windows, "window_id")
    by_doc = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "window_id", "words")).alias("found")).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    by_doc = stage(by_doc, "candidates")
    texts = docs.select("doc_id", "text", F.xxhash64(full_text(F.col("text"))).alias("text_key"))
    met = texts.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")))

    def verified(w: Column) -> Column:
        true = F.filter("found", lambda x: (F.slice(w, x["start"] + 1, F.size(x["words"])) == x["words"]))
        return F.transform(true, lambda x: F.struct(x["start"].alias("start"), F.size(x["words"]).alias("length"), x["window_id"].alias("window_id")))

    checked = met.select("doc_id", "text_key", let(alnum_words(F.col("text")), verified).alias("hits")).filter(F.size("hits") > 0).dropDuplicates(["doc_id", "text_key"])
    checked = stage(checked, "verified")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    cover = lambda acc, x: F.struct(F.greatest(acc["end"], x["start"] + x["length"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(acc["end"], x["start"]))).alias("n"))
    n_hit = F.aggregate(F.sort_array(F.transform("hits", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))), zero, cover, lambda acc: acc["n"])
    pairs = checked.select("doc_id", "text_key", F.explode(F.array_distinct(F.transform("hits", lambda x: x["window_id"]))).alias("window_id"))
    items_of = pairs.join(membership.select("window_id", "item_id"), "window_id").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    hit = stage(checked.select("doc_id", "text_key", n_hit.alias("n_hit")).join(items_of, same).select("_doc", "_key", "n_hit", "item_ids"), "contaminated")
    counted = docs.select("doc_id", F.xxhash64(full_text(F.col("text"))).alias("text_key"), F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(hit, same, "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "text_key", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def uncontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with their columns."""
    found = contamination(docs, items, window, shingle).filter("n_hit > 0").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    keyed = docs.select(packed_row(docs), F.col("doc_id").alias("_own"), F.xxhash64(full_text(F.col("text"))).alias("_text_key"))
    return keyed.join(stage(found, "hit"), F.col("_own").eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")), "left_anti").select("row.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all windows of ten words of the benchmark."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", sha256_hex(F.array_join("item_ids", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
