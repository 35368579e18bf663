"""A factorisation machine that scores the quality of texts.

Inputs are hashed words, statistics of the text's structure and its length;
each pair of inputs interacts through low-rank factors. The sum over all pairs
costs linear time by (sum of v x)^2 - sum of (v x)^2.

Features are taken in NumPy from Arrow's flat buffers, a block of rows at a
time. The model is fitted on the driver, on at most ``MAX_TRAIN`` labelled rows
(those with the smallest hash of their id); every other step runs on all rows.

Defined cases: null text is scored as an empty one; labels that are null,
contradict each other or belong to no document teach nothing; without labels
of both kinds every row gets the share of ones; repeated rows get equal scores;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.text import is_held_out
from quarry.llm.tokens import SPACE, flat_text, word_bounds, word_hashes

BUCKETS, RANK, MAX_TRAIN, THRESHOLD = 1024, 8, 20_000, 0.7
#: Structure statistics, in the order of their columns after the hashed words.
STATISTICS = ("log_words", "log_bytes", "bytes_per_word", "symbols", "upper", "digits", "marks", "bars", "distinct", "lines_per_word", "equal_lines")
ROWS = 2048
CHUNK_BYTES = 4 << 20


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


#: The classes of bytes that are counted.
CLASSES = {"symbols": _class("#*$%&<>"), "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _class("0123456789"), "marks": _class(".,;:!?"), "bars": _class("|")}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true bytes of each text."""
    return np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[offsets])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of inputs for each text, as float32: word weights of norm 1, then the statistics."""
    n, low = len(offsets) - 1, int(offsets[0])
    own, at = data[low : int(offsets[-1])], offsets - low
    starts, ends, words = word_bounds(own, at)
    counts = np.diff(words)
    buckets = (word_hashes(LOWER[own], starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    x = np.bincount(np.repeat(np.arange(n), counts) * BUCKETS + buckets, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    used = (x > 0).sum(axis=1)
    x = np.log1p(x)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-6)
    sizes, some = np.diff(at), np.maximum(counts, 1)
    solid = np.maximum(sizes - _sums(SPACE[own], at), 1)
    shares = {k: _sums(c[own], at) / solid for k, c in CLASSES.items()}
    # lines: pieces between line feeds that are not blank at both ends
    feeds = np.flatnonzero(own == 10)
    begin = np.unique(np.concatenate((at[:-1], feeds + 1)))
    begin = begin[begin < len(own)]
    stop = np.minimum(np.append(begin[1:], len(own)), len(own))
    owner = np.searchsorted(at, begin, "right") - 1
    tail = own[stop - 1] == 10 if len(begin) else np.zeros(0, bool)
    full = stop - begin > tail
    begin, stop, owner, tail = begin[full], stop[full], owner[full], tail[full]
    lines = np.bincount(owner, minlength=n)
    codes = word_hashes(own, begin, stop - tail) if len(begin) else np.zeros(0, np.uint64)
    order = np.lexsort((codes, owner))
    again = np.zeros(len(order), bool)
    again[1:] = (codes[order][1:] == codes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    equal = np.bincount(owner[order][again], minlength=n)
    expected = BUCKETS * -np.expm1(-counts / BUCKETS)
    table = {"log_words": np.log1p(counts) / 5, "log_bytes": np.log1p(sizes) / 8, "bytes_per_word": np.minimum(solid / some, 40) / 10, "distinct": used / np.maximum(expected, 1), "lines_per_word": np.minimum(lines / some, 1), "equal_lines": equal / np.maximum(lines, 1)} | {k: np.sqrt(v) for k, v in shares.items()}
    return np.concatenate((x, np.stack([table[k] for k in STATISTICS], axis=1).astype(np.float32)), axis=1)


@dataclass(frozen=True)
class Machine:
    """Weights of a second-order factorisation machine with a logistic output."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        mixed = x @ self.factors
        return self.bias + x @ self.linear + 0.5 * ((mixed * mixed).sum(axis=1) - ((x * x) @ (self.factors * self.factors)).sum(axis=1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x).astype(np.float64), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.02, shrink: float = 1e-4, seed: int = 11) -> Machine:
    """Adam on the logistic loss, by mini-batches in a fixed order."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    theta = [np.array([np.log(share / (1 - share))], np.float32), np.zeros(width, np.float32), (rng.standard_normal((width, RANK)) * 0.02).astype(np.float32)]
    if not len(y) or y.min() == y.max():
        return Machine(float(theta[0][0]), theta[1], theta[2] * 0)
    mean, square, t = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta], 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for low in range(0, len(y), batch):
            some = order[low : low + batch]
            xs, t = x[some], t + 1
            w0, w, v = theta
            mixed = xs @ v
            z = w0[0] + xs @ w + 0.5 * ((mixed * mixed).sum(axis=1) - ((xs * xs) @ (v * v)).sum(axis=1))
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[some]).astype(np.float32) / len(some)
            grads = [err.sum(keepdims=True), xs.T @ err + shrink * w, xs.T @ (err[:, None] * mixed) - v * ((xs * xs).T @ err)[:, None] + shrink * v]
            for k, g in enumerate(grads):
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                theta[k] = theta[k] - rate / (1 + epoch / 5) * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(float(theta[0][0]), theta[1], theta[2])


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Inputs of a batch's texts, by runs of rows that fit in memory."""
    data, offsets = flat_text(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = min(at + ROWS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1))
        yield at, to, features(data, offsets[at : to + 1])
        at = to


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and labels of at most ``bound`` labelled rows that are not held out."""
    agreed = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).filter("y = _y").filter(~is_held_out(F.col("doc_id")))
    some = agreed.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(bound).select("doc_id", "y")
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``bound`` rows, more where ids repeat

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, x in _blocks(batch, 1):
                for row in x:
                    at = np.flatnonzero(row).astype(np.uint16)
                    rows.append((at.tobytes(), row[at].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "y", "at", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    got = met.select("doc_id", "text", F.col("y").cast("int")).mapInArrow(sparse, f"doc_id {kind}, y int, at binary, x binary").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "at", "x").limit(bound).collect()
    x = np.zeros((len(got), BUCKETS + len(STATISTICS)), np.float32)
    for k, r in enumerate(got):
        x[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["x"], np.float32)
    return x, np.array([r["y"] for r in got], np.float32)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [machine.score(x) for _, _, x in _blocks(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for quality by a machine fitted on rows that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    machine = fit(*training_rows(docs, labels))
    return scored(docs, machine).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
