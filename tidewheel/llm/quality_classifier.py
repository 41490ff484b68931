"""Quality classification by importance resampling.

Two generative models of hashed word n-grams, one of target texts (labelled good
and not toxic) and one of all raw texts, give each document the logarithm of its
importance weight, the sum over its n-grams of log(target / raw).  Gumbel noise
keyed by the document's id is added, and the documents with the highest sums, as
many as asked for, are a sample without replacement by weight.

The target model is fitted on a bounded sample of the labelled rows
(``TARGET_ROWS``); the raw model and the scores cover all documents.  What goes to
the driver are the models, of ``BUCKETS`` numbers each, and histograms that narrow
down the lowest sum that is kept.

Tokens: runs of word characters, and runs of other characters but white space,
ASCII letters lower-cased; n-grams: tokens and pairs of neighbours.

Edge cases: a null or empty text has no n-grams and weight 0; a null ``doc_id``
gets noise like any other and stays null; repeated rows are scored each and kept
or left together; labels that are null or name no document say nothing; without
target rows all weights are 0; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, mix, odd_multipliers, store, table, utf8

BUCKETS = 1 << 14
TARGET_ROWS = 20_000  #: labelled rows that the target model is fitted on, at most
#: Kept beyond the share of good rows among the labelled ones: noise reorders rows near the threshold, and at the bare
#: share every bad row that it lifts over would push a good one out.
MARGIN = 0.05
PRIOR = 1.0  #: added to each bucket, spread by the raw model for the target
SEED = 7
BINS = 2048
FEW = 10_000  #: rows that are ordered at once

_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")
_PAIR = odd_multipliers(2, 61)


def features(text: bytes, hashes: WordHashes, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every token and pair of neighbours."""
    h = hashes.of(_TOKEN.findall(text.lower()))
    both = np.concatenate([mix(h), mix(h[:-1] * _PAIR[0] + h[1:] * _PAIR[1])])
    return (both % np.uint64(buckets)).astype(np.int64)


def _counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, target): one row for each bucket and task at most."""

    def run(batches):
        hashes = WordHashes()
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                for text, good in zip(part.column("text").to_pylist(), part.column("good").to_pylist(), strict=True):
                    n = np.bincount(features(text, hashes, buckets), minlength=buckets)
                    raw += n
                    if good:
                        target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    parts = texts.mapInArrow(run, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target / raw) of every bucket, both smoothed."""
    p = (raw + PRIOR) / (raw.sum() + PRIOR * len(raw))
    q = (target + PRIOR * len(raw) * p) / (target.sum() + PRIOR * len(raw))
    return np.log(q) - np.log(p)


def log_weights(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(id, log_weight) of every row of ``docs``."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("good_id")).where("good_id is not null").distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(target_rows)
    text = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    marked = text.join(F.broadcast(good), F.col("id") == F.col("good_id"), "left").select("text", F.col("good_id").isNotNull().alias("good"))
    counts = _counts(marked, buckets).toPandas()  # one row for each bucket
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(raw, target))

    def run(batches):
        hashes, r = WordHashes(), ratio.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                w = [float(r[features(t, hashes, buckets)].sum()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w, pa.float64())], ["id", "log_weight"])

    return text.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, log_weight double")


def lowest_kept(scored: DataFrame, k: int, bins: int = BINS, few: int = FEW) -> tuple[float, object] | None:
    """(score, id) of the k-th row by falling score, then id, of ``scored`` (id, score); None for k < 1.

    Histograms narrow the range down until few rows are left to order.
    """
    if k < 1:
        return None
    rest, above = scored, 0
    for _ in range(20):
        low, high, n = rest.agg(F.min("score"), F.max("score"), F.count("*")).first()
        if n <= few or low == high:
            break
        place = F.least(F.floor((F.col("score") - low) / F.lit((high - low) / bins)), F.lit(bins - 1))
        counts = {r["place"]: r["n"] for r in rest.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}
        for at in sorted(counts, reverse=True):
            if above + counts[at] >= k:
                break
            above += counts[at]
        rest = rest.where(place == at)
    k -= above
    if n > few:  # equal scores: by id, in the same way where ids are numbers
        known, number = rest.where("id is not null"), rest.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double")
        if k > (there := known.count()):
            return low, None
        place, below = F.col("id").cast("double"), 0
        for _ in range(20 if number else 0):
            first, last, there = known.agg(F.min(place), F.max(place), F.count("*")).first()
            if there <= few or first == last:
                break
            at = F.least(F.floor((place - first) / F.lit((last - first) / bins)), F.lit(bins - 1))
            counts = {r["at"]: r["n"] for r in known.groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect()}
            for chosen in sorted(counts):
                if below + counts[chosen] >= k:
                    break
                below += counts[chosen]
            known = known.where(at == chosen)
        rest, k = known, k - below
    row = rest.orderBy(F.desc("score"), F.asc_nulls_last("id")).limit(k).agg(F.min("score").alias("score"), F.max_by("id", F.struct(-F.col("score"), F.col("id").isNull(), "id")).alias("id")).first()
    return row["score"], row["id"]


def resample(docs: DataFrame, labels: DataFrame, *, share: float | None = None, margin: float = MARGIN, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row for each row of ``docs``: its id, ``log_weight``, ``gumbel`` and ``kept``.

    share: of the rows that are kept; by default that of good rows among the
    labelled ones and ``margin`` more.
    """
    weights = log_weights(docs, labels, id_col=id_col, text_col=text_col, buckets=buckets, target_rows=target_rows)
    # 52 bits of a hash, as a number between 0 and 1
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    scored, _ = store(weights.withColumn("gumbel", -F.log(-F.log(uniform))).withColumn("score", F.col("log_weight") + F.col("gumbel")), "weights")
    if share is None:
        good, all_ = labels.where("quality is not null").agg(F.sum((F.col("quality") == 1).cast("long")), F.count("*")).first()
        share = min(1.0, good / all_ + margin) if all_ else 1.0
    last = lowest_kept(scored.select("id", "score"), round(share * scored.count()))
    if last is None:
        kept = F.lit(False)
    else:
        score, id_ = last
        upto = F.lit(True) if id_ is None else F.coalesce(F.col("id") <= F.lit(id_), F.lit(False))
        kept = (F.col("score") > score) | ((F.col("score") == score) & upto)
    return scored.select(F.col("id").alias(id_col), "log_weight", "gumbel", kept.alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
