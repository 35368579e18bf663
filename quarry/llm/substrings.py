"""Exact substring deduplication by fixed-block anchors.

A window is ``WINDOW`` consecutive words. Reference blocks of ``BLOCK_WORDS``
words at positions 0, 7, 14, ... of every document are the index; every rolling
window of as many words is a probe. A window that two documents share holds a
whole reference block of either, so each probe that meets an index entry of
another document is an anchor, and anchors extend to the windows around them.
These windows meet by their own hash of 80 bits (every byte of every word passes
through a mixing step, so no two words or windows fall together by their form; a
pair of different windows does with a chance of 1e-24), the smallest document of
each keeps it, and adjacent windows found in others make up maximal repeats, whose
words are removed.

Nothing is paired. Probes travel as packed arrays, five bytes each, to the task
that owns their hash. A hash that a chunk holds in several documents is settled
in that chunk and sent once, so a passage that many documents share costs one
entry for each chunk, not for each document. Answers travel back packed, a row
for each pair of tasks, and are merged to one row for each document.
The texts themselves are shuffled once, by id; all three readings use that
shuffle.

Defined cases: null text has no words; rows without an id are neither compared
nor changed; rows that repeat an id are the same document, compared with others
only, each with its own text; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.tokens import SEEDS, flat_text, mixed, packed, rolling, unpacked, word_bounds, word_hashes

WINDOW, BLOCK_WORDS = 13, 7
CHUNK_BYTES = 8 << 20
PARTITION_BYTES = 16 << 20
FOUND_SCHEMA = "part int, found binary, docs binary, counts binary"
ENTRY_SCHEMA = "part int, settled int, hashes binary, checks binary, docs binary, counts binary, places binary"
ENTRY_ARROW = pa.schema([("part", pa.int32()), ("settled", pa.int32()), ("hashes", pa.binary()), ("checks", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])


def _partitions(df: DataFrame) -> int:
    """Shuffle partitions: the session's number, or more where the plan knows the input to be larger."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(conf, size // PARTITION_BYTES) if size < 1 << 60 else conf


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``CHUNK_BYTES``."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, to
        at = to


def _by_doc(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(docs) else np.zeros(0, np.int64)
    return docs[starts], np.diff(np.concatenate((starts, [len(docs)]))).astype(np.uint32)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys, and where each group starts in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        inorder = key[order]
        new[1:] |= inorder[1:] != inorder[:-1]
    return order, np.flatnonzero(new)


def _entries(parts: int, owner: np.ndarray, settled: np.ndarray, hashes: np.ndarray, checks: np.ndarray | None, docs: np.ndarray, places: np.ndarray | None) -> pa.RecordBatch:
    """A row for each part with its entries: settled ones first, then by document and place."""
    order = np.lexsort((~settled, owner))  # stable: documents and places stay in order
    owner, settled, hashes, docs = owner[order], settled[order], hashes[order], docs[order]
    checks = checks[order] if checks is not None else None
    places = places[order] if places is not None else None
    bounds = np.searchsorted(owner, np.arange(parts + 1))
    rows: list[tuple] = []
    for p in np.flatnonzero(np.diff(bounds)):
        low, high = bounds[p], bounds[p + 1]
        done = int(settled[low:high].sum())
        values, counts = _by_doc(docs[low + done : high])
        gaps = packed(np.diff(places[low + done : high].astype(np.int32), prepend=np.int32(0))) if places is not None else b""
        rows.append((int(p), done, packed(hashes[low:high]), packed(checks[low:high]) if checks is not None else b"", packed(values), packed(counts), gaps))
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), ENTRY_ARROW.types, strict=True)] if rows else [pa.array([], t) for t in ENTRY_ARROW.types], schema=ENTRY_ARROW)


def _bucket(docs: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(docs.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _by_bucket(parts: int, docs: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(bucket, values, ids, counts): found values packed by document, a row for each bucket of documents."""
    if not len(docs):
        return
    buckets = _bucket(docs, parts)
    order = np.lexsort((docs, buckets))
    docs, values, buckets = docs[order], values[order], buckets[order]
    for low, high in zip(starts := np.flatnonzero(np.diff(buckets, prepend=-1)), np.append(starts[1:], len(buckets)), strict=True):
        ids, counts = _by_doc(docs[low:high])
        yield int(buckets[low]), packed(values[low:high]), packed(ids), packed(counts)


def _answers(parts: int, docs: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Rows that pass through a resolver (``settled`` is -1): what was already found in a document."""
    rows = [(bucket, -1, found, b"", ids, counts, b"") for bucket, found, ids, counts in _by_bucket(parts, docs, values)]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), ENTRY_ARROW.types, strict=True)], schema=ENTRY_ARROW)


def _windows(data: np.ndarray, offsets: np.ndarray, k: int, seeds: tuple[int, ...] = SEEDS[:1]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of all runs of k words (one array for each seed), and row and place of each."""
    starts, ends, words = word_bounds(data, offsets)
    counts = np.diff(words)
    rows = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(len(starts)) - np.repeat(words[:-1], counts)
    whole = np.flatnonzero(places + k <= np.repeat(counts, counts))
    return [rolling(word_hashes(data, starts, ends, b), k, b)[whole] if len(whole) else np.zeros(0, np.uint64) for b in seeds], rows[whole], places[whole]


def _probe(parts: int, block: int):
    """Texts to entries: every rolling window of ``block`` words, with the place that tells index blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = flat_text(batch.column(1))
            for low, high in _chunks(offsets):
                (hashes,), rows, places = _windows(data, offsets[low : high + 1], block)
                docs = ids[low:high][rows]
                if not len(hashes):
                    continue
                order, starts = _groups(hashes)
                sizes = np.diff(np.append(starts, len(order)))
                differs = docs[order] != np.repeat(docs[order[starts]], sizes)
                shared = np.logical_or.reduceat(differs, starts)
                several = np.zeros(len(order), bool)
                several[order] = np.repeat(shared, sizes)
                if several.any():
                    yield _answers(parts, docs[several], places[several].astype(np.uint32))
                sent = ~several
                sent[order[starts[shared]]] = True
                keep = np.flatnonzero(sent)
                yield _entries(parts, (hashes[keep] >> np.uint64(32)) % np.uint64(parts), several[keep], hashes[keep].astype(np.uint32), None, docs[keep], places[keep])

    return run


def _read(batches: Iterator[pa.RecordBatch], hash_type, value_type):
    """All entries of a partition, and documents and values of what passes through."""
    parts, hashes, checks, docs, places, settled, own, through = [], [], [], [], [], [], [], []
    for batch in batches:
        for part, done, h, c, d, n, p in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            ids = np.repeat(unpacked(d, np.int64), unpacked(n, np.uint32))
            if done < 0:
                own.append(ids)
                through.append(unpacked(h, value_type))
                continue
            values = unpacked(h, hash_type)
            hashes.append(values)
            parts.append(np.full(len(values), part, np.uint64))
            flags = np.zeros(len(values), bool)
            flags[:done] = True
            settled.append(flags)
            docs += [np.zeros(done, np.int64), ids]
            if c:
                checks.append(unpacked(c, np.uint16))
            if p:
                places += [np.zeros(done, np.int64), np.cumsum(unpacked(p, np.int32), dtype=np.int64)]
            elif hash_type is np.uint32:
                places.append(np.zeros(len(values), np.int64))
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(parts, np.uint64), join(hashes, hash_type), join(checks, np.uint16), join(docs, np.int64), join(places, np.int64), join(settled, bool), join(own, np.int64), join(through, value_type)


def _found(parts: int, ids: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``FOUND_SCHEMA``."""
    rows = list(_by_bucket(parts, ids, values))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "found", "docs", "counts"])


def _merge(value_type):
    """All that was found in a bucket's documents, one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = [np.zeros(0, np.int64)], [np.zeros(0, value_type)]
        for batch in batches:
            for _, found, docs, counts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                ids.append(np.repeat(unpacked(docs, np.int64), unpacked(counts, np.uint32)))
                values.append(unpacked(found, value_type))
        docs, found = np.concatenate(ids), np.concatenate(values)
        order = np.lexsort((found, docs))
        docs, found = docs[order], found[order]
        ids, counts = _by_doc(docs)
        bounds = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        for at in range(0, len(ids), 4096):
            some = range(at, min(at + 4096, len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 4096]), pa.array([packed(found[bounds[k] : bounds[k + 1]]) for k in some], pa.binary())], ["doc_id", "found"])

    return run


def _anchors(parts_: int, block: int):
    """Entries to anchors: places whose hash an index block has and that two documents share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, hashes, _, docs, places, settled, own_docs, through = _read(batches, np.uint32, np.uint32)
        hit = np.zeros(len(hashes), bool)
        if len(hashes):
            order, starts = _groups((parts << np.uint64(32)) | hashes)
            sizes = np.diff(np.append(starts, len(order)))
            own, done = docs[order], settled[order]
            several = np.logical_or.reduceat(done | (own != np.repeat(own[starts], sizes)), starts)
            indexed = np.logical_or.reduceat(done | (places[order] % block == 0), starts)
            hit[order] = np.repeat((several & indexed & (sizes > 1)), sizes)
            hit &= ~settled
        yield from _found(parts_, np.concatenate((docs[hit], own_docs)), np.concatenate((places[hit].astype(np.uint32), through)))

    return run


def _extend(parts: int, window: int, block: int):
    """Anchored texts to entries: the windows around each anchor by their own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
            some = batch.take(pa.array(known))
            ids = some.column(0).to_numpy(zero_copy_only=False)
            data, offsets = flat_text(some.column(1))
            anchors = some.column(2)
            for low, high in _chunks(offsets):
                (hashes, checks), rows, places = _windows(data, offsets[low : high + 1], window, SEEDS)
                if not len(hashes):
                    continue
                first = np.searchsorted(rows, np.arange(high - low + 1))
                near = np.zeros(len(hashes) + 1, np.int64)
                for k in range(high - low):
                    count = first[k + 1] - first[k]
                    at = unpacked(anchors[low + k].as_py(), np.uint32).astype(np.int64)
                    begin, end = np.clip(at - (window - block), 0, count), np.clip(at + 1, 0, count)
                    np.add.at(near, first[k] + begin, 1)
                    np.add.at(near, first[k] + end, -1)
                keep = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                if not len(keep):
                    continue
                hashes, checks, docs = hashes[keep], (checks[keep] >> np.uint64(48)).astype(np.uint16), ids[low:high][rows[keep]]
                order, starts = _groups(hashes, checks, docs)  # the smallest document of a hash comes first
                same = np.zeros(len(order), bool)
                same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (checks[order][1:] == checks[order][:-1])
                leads = np.flatnonzero(~same)
                lead_doc = np.repeat(docs[order[leads]], np.diff(np.append(leads, len(order))))
                once = np.zeros(len(order), bool)
                once[starts] = True
                later = once & (docs[order] != lead_doc)
                if later.any():
                    yield _answers(parts, docs[order[later]], hashes[order[later]])
                sent = order[leads]
                sent = sent[np.argsort(docs[sent], kind="stable")]
                yield _entries(parts, (checks[sent].astype(np.uint64)) % np.uint64(parts), np.zeros(len(sent), bool), hashes[sent], checks[sent], docs[sent], None)

    return run


def _repeats(parts: int):
    """Entries to repeats: window hashes that a smaller document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hashes, checks, docs, _, _, own_docs, through = _read(batches, np.uint64, np.uint64)
        hit = np.zeros(len(hashes), bool)
        if len(hashes):
            order, starts = _groups(hashes, checks)
            sizes = np.diff(np.append(starts, len(order)))
            own = docs[order]
            hit[order] = own > np.repeat(np.minimum.reduceat(own, starts), sizes)
        yield from _found(parts, np.concatenate((docs[hit], own_docs)), np.concatenate((hashes[hit], through)))

    return run


def removal_masks(data: np.ndarray, offsets: np.ndarray, repeats: np.ndarray, window: int) -> np.ndarray:
    """For one text: which of its words lie in a window whose hash is among ``repeats``."""
    starts, ends, _ = word_bounds(data, offsets)
    gone = np.zeros(len(starts) + 1, np.int64)
    at = np.flatnonzero(np.isin(rolling(word_hashes(data, starts, ends), window), repeats))
    np.add.at(gone, at, 1)
    np.add.at(gone, at + window, -1)
    return np.cumsum(gone[:-1]) > 0


def _cut(window: int, with_text: bool):
    """Texts and their repeats to what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(1))
            counts, removed, digests, texts = [], [], [], []
            for k, found in enumerate(batch.column(2)):
                words = data[offsets[k] : offsets[k + 1]].tobytes().split()
                n = len(words)
                if found.is_valid:
                    values = unpacked(found.as_py(), np.uint64)
                    gone = removal_masks(data, offsets[k : k + 2], values, window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                counts.append(n)
                removed.append(n - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())] if with_text else columns, [*names, "kept_text"] if with_text else names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept_text`` of every row.

    ``doc_id`` must be of an integer type. ``window`` must be odd: blocks have (window + 1) / 2 words.
    """
    block = (window + 1) // 2
    parts = _partitions(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # one shuffle of the texts, read three times
    placed = texts.filter(F.col("doc_id").isNotNull()).repartition(parts, "doc_id")
    meet = lambda df: df.repartitionById(parts, F.col("part"))
    by_doc = lambda df, t: meet(df).mapInArrow(_merge(t), "doc_id long, found binary")
    anchors = by_doc(meet(placed.mapInArrow(_probe(parts, block), ENTRY_SCHEMA)).mapInArrow(_anchors(parts, block), FOUND_SCHEMA), np.uint32)
    around = placed.join(anchors, "doc_id", "left").select("doc_id", "text", "found")
    repeats = by_doc(meet(around.mapInArrow(_extend(parts, window, block), ENTRY_SCHEMA)).mapInArrow(_repeats(parts), FOUND_SCHEMA), np.uint64)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    known = placed.join(repeats, "doc_id", "left").select("doc_id", "text", "found").mapInArrow(_cut(window, with_text), schema)
    rest = texts.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("binary").alias("found"))
    return known.unionByName(rest.mapInArrow(_cut(window, with_text), schema))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the windows of 13 words that a smaller document has too."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
