"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some token positions of a short span and ignore the others, so
a seed survives substitutions at ignored places.  Test and training seeds are
joined by hash, and around each hit the aligned texts are compared token by
token: a run in which matches outweigh substitutions (1 against 2) and that has
enough matches is an overlap.

Benchmark items with equal tokens are one class.  A bit table of fixed size over
the seeds of all classes goes to the tasks; documents pass by once, and those
with a seed in it are written down, with those seeds, for the join.  A larger
benchmark fills the table and more seeds reach the join, which alone decides.
Both joins that follow, by seed and by class, are Spark's, which splits hot keys;
what is compared are the aligned tokens, never whole documents.

Tokens: runs of ASCII letters and digits and of non-ASCII characters, ASCII
letters lower-cased.  Items of 5 to 9 tokens are shorter than the masks and are
looked up as they are; shorter ones hold too little to tell and never match.

Edge cases: null or empty texts match nothing; null ids stay null; repeated rows
each give their own result; rows that repeat an id are told apart by their text;
very long texts are looked at whole; other columns are ignored by
:func:`overlaps` and kept by :func:`clean`; an empty benchmark or document table
gives an empty result, or all documents.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, mix, near, odd_multipliers, store, table, utf8

#: Positions that each mask looks at; fixed values of this operator.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 1, 3, 6, 7, 9), (0, 2, 3, 5, 8, 9), (0, 1, 2, 4, 5, 6))
SPAN = 10
SHORTEST = 5
MATCHES, SHARE = 13, 0.8  #: an overlap has so many matching tokens, or this share of a shorter item
SEED_BITS = 1 << 27  #: of the table that seeds are looked up in first

_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_MULTIPLIERS = odd_multipliers(SPAN, 91)


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _seeds(hashes: np.ndarray, positions: tuple[int, ...], salt: int) -> np.ndarray:
    n = len(hashes) - positions[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(salt))
    for m, at in zip(_MULTIPLIERS, positions, strict=False):
        total += hashes[at : at + n] * m
    return mix(total)


def _masks(short: list[int]) -> list[tuple[int, ...]]:
    """The masks, and a full one for each item length that is too short for them."""
    return [*MASKS, *(tuple(range(n)) for n in sorted(short))]


def best_runs(same: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matches, begin, end) of each comparison's run with the highest sum of 1 for a match and -2 for a substitution.

    same: comparisons of one token at least, one after another.
    """
    size = lengths + 1  # sums begin with one of no token
    first = np.append(0, np.cumsum(size)[:-1])
    whose = np.repeat(np.arange(len(lengths)), size)
    step = np.zeros(len(whose), np.int64)
    inner = np.ones(len(whose), bool)
    inner[first] = False
    step[inner] = np.where(same, 1, -2)
    total = np.cumsum(step)
    total -= total[first][whose]
    far = 3 * int(lengths.max(initial=0)) + 1  # puts each comparison below the ones before it
    low = np.minimum.accumulate(total - whose * far) + whose * far
    place = np.arange(len(whose))
    rise = total - low

    def earliest(hit: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(np.where(hit, place, len(place)), first)

    end = earliest(rise == np.maximum.reduceat(rise, first)[whose])
    begin = earliest(total == low[end][whose])
    matched = np.cumsum(step > 0)
    return matched[end] - matched[begin], begin - first, end - first


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """(item, class, n, hashes) of every item with enough tokens; equal tokens, equal class."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            own = [hashes.of(tokens(t)) for t in batch.column(1).to_pylist()]
            marks = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks), pa.array([len(h) for h in own], pa.int64()), pa.array([h.tobytes() for h in own], pa.binary())], ["item", "class", "n", "hashes"])

    rows = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null").select("item", utf8("text").alias("text"))
    return rows.mapInArrow(run, f"item {benchmark.schema[item_col].dataType.simpleString()}, class long, n long, hashes binary").where(F.col("n") >= SHORTEST)


def _class_seeds(classes: DataFrame, short: list[int]) -> DataFrame:
    """(seed, class, at, n) of every class and place."""
    masks = _masks(short)

    def run(batches):
        for batch in batches:
            for mark, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(data, np.uint64)
                for salt, mask in enumerate(masks):
                    if len(h) >= SPAN if salt < len(MASKS) else len(h) == len(mask):
                        found = _seeds(h, mask, salt)
                        n = len(found)
                        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(n, mark)), pa.array(np.arange(n)), pa.array(np.full(n, len(h)))], ["seed", "class", "at", "n"])

    return classes.select("class", "hashes").mapInArrow(run, "seed long, class long, at long, n long")


def _seed_bits(seeds: DataFrame, bits: int) -> np.ndarray:
    """Words of 64 bits, one set for each seed; the driver gets ``bits`` / 64 of them at most."""
    bit = F.pmod("seed", F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    words = seeds.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _leads(docs: DataFrame, id_col: str, text_col: str, short: list[int], bits: np.ndarray) -> DataFrame:
    """(lead, id, text_key, hashes, seeds, places) of the rows that hold a seed of the table; lead: a number of its own."""
    kind, masks = docs.schema[id_col].dataType.simpleString(), _masks(short)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        number, hashes, words = count(TaskContext.get().partitionId() << 32), WordHashes(), sent.value
        last = np.uint64(64 * len(words) - 1)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                row, out = [], ([], [], [])
                for r, data in enumerate(part.column(2).to_pylist()):
                    own = hashes.of(tokens(data))
                    seeds, places = [], []
                    for salt, mask in enumerate(masks):
                        here = _seeds(own, mask, salt)
                        bit = here & last
                        at = np.flatnonzero((words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                        if len(at):
                            seeds.append(here[at].view(np.int64))
                            places.append(at)
                    if seeds:
                        row.append(r)
                        for x, y in zip(out, (own.tobytes(), np.concatenate(seeds), np.concatenate(places)), strict=True):
                            x.append(y)
                if row:
                    rows = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([next(number) for _ in row], pa.int64()), part.column(0).take(rows), part.column(1).take(rows), pa.array(out[0], pa.binary()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.int64()))],
                        ["lead", "id", "text_key", "hashes", "seeds", "places"],
                    )

    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), utf8(text_col).alias("text"))
    return text.mapInArrow(run, f"lead long, id {kind}, text_key long, hashes binary, seeds array<long>, places array<long>")


def _compare(pairs: DataFrame) -> DataFrame:
    """(lead, class, n, begin, n_match, run_tokens, first_token) of pairs (lead, class, n, begin, low, a, b) of aligned tokens a and b."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64) for c in (5, 6))
            lengths = np.array([len(x) // 8 for x in batch.column(5).to_pylist()], np.int64)
            n, first, last = best_runs(a == b, lengths)
            at = batch.column(3).to_numpy() + batch.column(4).to_numpy() + first
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(n), pa.array(last - first), pa.array(at)], ["lead", "class", "n", "begin", "n_match", "run_tokens", "first_token"])

    return pairs.mapInArrow(run, "lead long, class long, n long, begin long, n_match long, run_tokens long, first_token long")


def _matches(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches of a lead and a class, the best run of each; leads; items)."""
    items, _ = store(_items(benchmark, item_col, item_text_col), "items")
    classes = items.groupBy("class").agg(F.any_value("n").alias("n"), F.any_value("hashes").alias("hashes"))
    short = [r["n"] for r in items.where(F.col("n") < SPAN).select("n").distinct().collect()]  # five lengths at most
    seeds, _ = store(_class_seeds(classes, short), "seeds")
    leads, _ = store(_leads(docs, id_col, text_col, short, _seed_bits(seeds, bits)), "leads")
    hits = leads.select("lead", F.octet_length("hashes").alias("size"), F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("lead", "size", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"))
    aligned = hits.join(seeds, "seed").select("lead", "class", "n", (F.col("place") - F.col("at")).alias("begin"), "size").distinct()
    low = F.greatest(F.lit(0), -F.col("begin"))
    high = F.least(F.col("n"), F.floor(F.col("size") / 8) - F.col("begin"))
    aligned = aligned.select("lead", "class", "n", "begin", low.cast("int").alias("low"), (high - low).cast("int").alias("wide"))
    of_doc = aligned.join(leads.select("lead", "hashes"), "lead").select("lead", "class", "n", "begin", "low", "wide", F.substring("hashes", ((F.col("begin") + F.col("low")) * 8 + 1).cast("int"), F.col("wide") * 8).alias("a"))
    both = of_doc.join(classes.select("class", "hashes"), "class").select("lead", "class", "n", "begin", F.col("low").cast("long").alias("low"), "a", F.substring("hashes", F.col("low") * 8 + 1, F.col("wide") * 8).alias("b"))
    pairs = both.select("lead", "class", "n", "begin", "low", "a", "b")
    enough = F.least(F.lit(MATCHES), F.greatest(F.lit(SHORTEST), F.ceil(F.col("n") * SHARE)))
    found = _compare(pairs).where(F.col("n_match") >= enough)
    run = F.struct("n", "n_match", "run_tokens", "first_token")
    return found.groupBy("lead", "class").agg(F.max_by(run, F.struct("n_match", -F.col("begin"))).alias("run")).select("lead", "class", "run.*"), leads, items


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", bits: int = SEED_BITS) -> DataFrame:
    """(id, item, n_match, run_tokens, item_tokens, first_token) of every document and item that overlap, the best run of each.

    bits: a power of two.
    """
    found, leads, items = _matches(docs, benchmark, id_col, text_col, item_col, item_text_col, bits)
    out = found.join(leads.select("lead", "id"), "lead").join(items.select("item", "class"), "class")
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_match", "run_tokens", F.col("n").alias("item_tokens"), "first_token")


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that overlap with no benchmark item; each row by its id and text."""
    found, leads, _ = _matches(docs, benchmark, id_col, text_col, item_col, item_text_col, SEED_BITS)
    gone, _ = store(leads.join(found.select("lead").distinct(), "lead", "left_semi").select(F.col("id").alias("its_id"), F.col("text_key").alias("its_key")).distinct(), "gone")
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"))
    marked = near(own, F.xxhash64("id", "text_key"), gone.select(F.xxhash64("its_id", "its_key").alias("key")))
    asked = marked.where("near").join(gone, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key")), "left_anti")
    return marked.where(~F.col("near")).select("row.*").unionByName(asked.select("row.*"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
