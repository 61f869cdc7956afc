"""Importance resampling for quality: hashed n-gram models of target and raw text.

The target model counts hashed one- and two-word grams of labelled good documents, the raw
model those of all documents. A document's log weight is the sum over its grams of the
logarithm of the ratio of their probabilities. Adding Gumbel noise to log weights and taking the
largest is sampling without replacement in proportion to the weights; as many documents are kept as
the labels say are good, in proportion.

The ids of the labelled good documents are a sample of at most TARGET_ROWS (by hash of the id), so
that they can be sent to every task; counts of raw text and weights cover all documents. A task
sums counts into BUCKETS numbers before anything is shuffled. The models are two arrays of
BUCKETS numbers.

Defined results: texts without words have log weight 0; a null doc_id has no label and noise of
its own; a label counts as good only if all rows of its doc_id say so; repeated rows have equal
keys, and ties at the cut are broken by doc_id; without good labels all log weights are 0 and
nothing is left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.text import WordHashes, global_rank, mixed, per_text, words_of
from skygauge.session import ship_package

BUCKETS = 1 << 18
TARGET_ROWS = 50_000
PSEUDO_COUNT = 20.0
SEED = "resample"


def gram_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of all words and of all pairs of neighbouring words."""
    pairs = mixed(hashes[:-1] * np.uint64(31) + hashes[1:])
    return (np.concatenate([mixed(hashes), pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, good in zip(batch.column("text"), batch.column("good").to_pylist(), strict=True):
            buckets = gram_buckets(hashes.of(words_of(text.as_py())))
            own = np.bincount(buckets, minlength=BUCKETS) if len(buckets) > BUCKETS // 8 else None
            for row in (0, 1)[: 1 + bool(good)]:
                if own is None:
                    np.add.at(counts[row], buckets, 1)
                else:
                    counts[row] += own
    used = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], names=["bucket", "raw", "target"]
    )


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_ids whose labels all say good and not toxic, at most TARGET_ROWS."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(F.coalesce(good, F.lit(False))).alias("good"))
        .filter("good")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TARGET_ROWS)
        .select("doc_id", "good")
    )


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log of target over raw probability for each bucket.

    Raw counts are scaled to the target's total; then both are smoothed alike.
    """
    ship_package(docs.sparkSession)
    marked = docs.select("doc_id", "text").join(F.broadcast(good_ids(labels)), "doc_id", "left")
    rows = (
        marked.select("text", "good")
        .mapInArrow(_count_batches, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()
    )
    counts = np.zeros((2, BUCKETS))
    counts[:, rows["bucket"].astype(int)] = rows[["raw", "target"]].to_numpy(float).T
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    raw = counts[0] * (counts[1].sum() / counts[0].sum())
    return np.log((counts[1] + PSEUDO_COUNT) / (raw + PSEUDO_COUNT))


def kept_share(labels: DataFrame) -> float:
    """Share of labelled rows that are good; 1 without any label."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    found = labels.agg(F.avg(F.coalesce(good, F.lit(False)).cast("double"))).first()[0]
    return 1.0 if found is None else found


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept; ``share`` of the documents is kept."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels))
    share = kept_share(labels) if share is None else share

    def start():
        hashes = WordHashes()
        values = ratios.value

        def weights(texts):
            all_ = [gram_buckets(hashes.of(words_of(t))) for t in texts]
            return [(len(b), float(values[b].sum())) for b in all_]

        return weights

    scored = per_text(docs.select("doc_id", "text"), start, {"n_grams": "long", "log_weight": "double"})
    bits = F.xxhash64(F.lit(SEED), F.coalesce("doc_id", F.lit(-1)))
    uniform = (F.shiftrightunsigned(bits, 11).cast("double") + 0.5) / float(1 << 53)
    keyed = scored.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))
    ranked = global_rank(keyed, [F.desc("key"), F.col("doc_id").asc_nulls_last()], "rank")
    size = ranked.agg(F.count("*")).first()[0]
    none = not (ratios.value != 0).any()
    return ranked.withColumn("kept", F.lit(none) | (F.col("rank") < round(share * size))).drop("rank")
