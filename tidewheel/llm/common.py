"""Shared pieces: words, hashes, and rows told apart by bit tables of fixed size."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import discard, store, work_dir  # noqa: F401  the operators take them from here

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(name: str = "text") -> Column:
    """The text as UTF-8 bytes, an empty string for null."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


BITS = 1 << 25  #: of a bit table


def near(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` with a column ``near``: false only if its key (a number) isn't in ``wanted`` (key).

    The keys become a bit table of fixed size, BITS / 64 rows at most, which is
    broadcast, so that most rows are told apart without a shuffle.  The fuller the
    table, the more rows are called near; a join with ``wanted`` settles those.
    """
    bit = F.pmod(F.xxhash64("key"), F.lit(BITS))
    words = wanted.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("__bits"))
    own = rows.withColumn("__bit", F.pmod(F.xxhash64(key), F.lit(BITS))).withColumn("__word", (F.col("__bit") / 64).cast("int"))
    held = F.coalesce(F.getbit("__bits", (F.col("__bit") % 64).cast("int")) == 1, F.lit(False))
    return own.join(F.broadcast(words), "__word", "left").select(*rows.columns, held.alias("near"))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers, from hashes of a seed."""
    return np.array([xxhash.xxh3_64_intdigest(f"m{i}", seed=seed) | 1 for i in range(n)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (an invertible finaliser)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


_SHINGLE = {n: odd_multipliers(n, 11) for n in range(1, 17)}


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` words, in order; with fewer words, one for all of them; none for none."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    w = min(n, width)
    total = np.full(n - w + 1, np.uint64(w))
    for i, m in enumerate(_SHINGLE[w]):
        total += hashes[i : n - w + 1 + i] * m
    return mix(total)
