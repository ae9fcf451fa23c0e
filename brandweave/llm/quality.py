"""Quality selection by importance resampling over hashed n-grams.

Two generative models count hashed one- and two-token runs in a fixed number of buckets: one over
target text (labelled as good), one over all raw text. A document's log weight is the sum over its
runs of the log ratio of the two models. Gumbel noise, fixed by the document's id, is added to the
log weights, and the top k are taken, which samples k documents without replacement in proportion
to their weights. Both the counts over raw text and the selection cover all documents; only the
labelled rows that the target model learns from are bounded, by ``max_labels``.

Tokens are runs of letters, digits and bytes from 80 up, or runs of other visible characters; case
counts, since shouting is a mark of poor text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brandweave.llm.common import SAME, SPACES, Scratch, hash_words, mix64, slices, small_batches, stored, table, tidy, utf8

BUCKETS = 1 << 14
#: The bound of the labelled sample: rows of labels in the order of a hash of their doc_id.
MAX_LABELS = 20_000
SEED = 4

KINDS = np.full(256, 2, dtype=np.uint8)
KINDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
KINDS[list(SPACES)] = 0


def hashed_runs(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all one- and two-token runs, and the text each is from."""
    tokens, n = hash_words(texts, KINDS, SAME)
    text = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        pairs = mix64(tokens[:-1] * np.uint64(0x9E3779B97F4A7C15) + tokens[1:]) if len(tokens) > 1 else tokens[:0]
    inside = text[1:] == text[:-1]
    runs = np.concatenate([tokens, pairs[inside]])
    return (runs % np.uint64(buckets)).astype(np.int64), np.concatenate([text, text[1:][inside]])


def labelled_sample(labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """At most ``max_labels`` (doc_id, quality), by a hash of doc_id; nulls are left out, and of
    different labels for one document the lowest holds."""
    clean = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)


@dataclass
class Weights:
    """Log ratio of the two models by bucket, and the log weight from which documents count as good."""

    ratio: np.ndarray
    threshold: float


def fit(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_labels: int = MAX_LABELS, smoothing: float = 1.0) -> Weights:
    """Counts both models in one pass over all documents.

    Two thirds of the labelled sample, by a hash of doc_id, are target text if good; the threshold is
    the log weight that parts the last third with the fewest errors. Without labelled good documents
    every ratio is 0 and every document counts as good.
    """
    with Scratch(documents.sparkSession) as scratch:
        return _fit(documents, scratch.kept(labelled_sample(labels, max_labels)), buckets, smoothing)


def _fit(documents: DataFrame, sample: DataFrame, buckets: int, smoothing: float) -> Weights:
    known = F.broadcast(sample)  # max_labels rows at most
    rows = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).join(known, "doc_id", "left")
    rows = rows.withColumn("tuning", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(3)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for part in slices(batches, 0):
            runs, text = hashed_runs(part.column(0).to_pylist(), buckets)
            target = np.array([bool(q) for q in part.column(1).to_pylist()], dtype=bool)
            raw += np.bincount(runs, minlength=buckets)
            good += np.bincount(runs[target[text]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(good[seen])], names=["bucket", "raw", "good"])

    counted = rows.select("text", (~F.col("tuning") & (F.col("quality") > 0)).alias("target")).mapInArrow(tidy(count), "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[counted["bucket"].to_numpy()], good[counted["bucket"].to_numpy()] = counted["raw"].to_numpy(), counted["good"].to_numpy()
    if not good.any():
        return Weights(np.zeros(buckets), 0.0)
    # Add-smoothing towards the raw model, so that buckets unseen in a small target sample stay near it.
    share = (raw + smoothing) / (raw.sum() + smoothing * buckets)
    ratio = np.log((good + smoothing * buckets * share) / (good.sum() + smoothing * buckets)) - np.log(share)
    scored = rows.where("quality is not null and tuning").select(F.struct("doc_id", "text", "quality").alias("row"), F.lit(0.0).alias("noise"))
    pairs = _scored(scored, ratio).select("row.quality", "log_weight").toArrow()
    return Weights(ratio, best_threshold(pairs["log_weight"].to_numpy(), pairs["quality"].to_numpy() > 0))


def best_threshold(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut, halfway between two weights, below which errors against the labels are fewest."""
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order]
    errors = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([np.cumsum(~good[::-1])[::-1], [0]])
    cuts = np.flatnonzero(np.concatenate([[True], weights[1:] > weights[:-1], [True]])) if len(weights) else np.array([0])
    best = cuts[int(np.argmin(errors[cuts]))]
    if best == 0:
        return -np.inf
    return float(weights[-1] + 1) if best == len(weights) else float((weights[best - 1] + weights[best]) / 2)


def _scored(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(row, noise) with ``log_weight`` and ``key``, their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field("text").cast(pa.binary()).fill_null(b"")
            for part in slices([pa.RecordBatch.from_arrays([*batch.columns, texts], names=["row", "noise", "bytes"])], 2):
                runs, text = hashed_runs(part.column(2).to_pylist(), len(ratio))
                weight = np.bincount(text, weights=ratio[runs], minlength=part.num_rows).astype(float)  # of no runs, it counts whole numbers
                key = weight + part.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(weight), pa.array(key)], names=["row", "noise", "log_weight", "key"])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema, T.StructField("log_weight", T.DoubleType()), T.StructField("key", T.DoubleType())]))


def gumbel(seed: int = SEED) -> Column:
    """Standard Gumbel noise by a hash of doc_id and text."""
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11)
    return -F.log(-F.log((bits.cast("double") + 0.5) / float(1 << 53)))


def kth_largest(keys: DataFrame, k: int, buckets: int = 4096, few: int = 10_000) -> float:
    """The k-th largest of a stored or kept column ``key``, by narrowing histograms; 1 <= k <= rows."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    inside, left = keys, k
    while low < high:
        width = (high - low) / buckets
        if width <= 0 or low + width == low:
            break
        number = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(buckets - 1))
        rows = sorted(inside.groupBy(number.alias("number")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect(), key=lambda r: -r.number)
        for row in rows:
            if left <= row.n:
                break
            left -= row.n
        low, high = row.low, row.high
        inside = keys.where(F.col("key").between(low, high))
        if row.n <= few:
            return sorted((r.key for r in inside.select("key").collect()), reverse=True)[left - 1]
    return low


def select(documents: DataFrame, weights: Weights, k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key and kept, of every document.

    ``k`` documents of the largest keys are kept; by default as many as have a log weight of the
    fitted threshold or more. Rows with the k-th key are all kept. Null and empty texts have weight
    0; repeated rows share their key. An empty input gives an empty result.
    """
    scored = stored(_keys(documents, weights, seed), "scored")
    least = _least(scored, weights, k)
    return scored.withColumn("kept", F.col("key") >= F.lit(least))


def _keys(documents: DataFrame, weights: Weights, seed: int) -> DataFrame:
    rows = small_batches(documents).select(F.struct("doc_id", "text").alias("row"), gumbel(seed).alias("noise"))
    return _scored(rows, weights.ratio).select("row.doc_id", "log_weight", "key")


def _least(scored: DataFrame, weights: Weights, k: int | None) -> float:
    """The k-th largest key, or that of as many as have the fitted log weight."""
    total, good = scored.agg(F.count(F.lit(1)), F.count(F.when(F.col("log_weight") >= weights.threshold, 1))).first()
    k = min(total, good if k is None else k)
    return kth_largest(scored, k) if k else float("inf")


def keep(documents: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED, **options) -> DataFrame:
    """The documents that the selection keeps, with their own columns."""
    weights = fit(documents, labels, **options)
    with Scratch(documents.sparkSession) as scratch:
        least = _least(scratch.kept(_keys(documents, weights, seed)), weights, k)
    rows = small_batches(documents).select(F.struct("*").alias("row"), gumbel(seed).alias("noise"))
    return _scored(rows, weights.ratio).where(F.col("key") >= F.lit(least)).select("row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log weight and whether it is kept."""
    documents = table(spark, sf_dir, "documents")
    weights = fit(documents, table(spark, sf_dir, "labels"))
    return select(documents, weights)
