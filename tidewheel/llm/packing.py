"""Packing token sequences by shortest-pack-first over the length histogram.

Documents are tokenised and cut at the capacity; the lengths of the pieces form
a histogram of at most ``capacity`` bins, and only that goes to the driver.
Lengths are placed longest first, each into the shortest open packs (those with
most room) that it fits, as counts of packing patterns.  Every pattern then
takes a range of ranks of each of its lengths, and the pieces, ranked within
their length, are joined back by rank.

Ranks come from two levels, counts by (length, hash bucket) and a row number
within each, so a length that most pieces share is spread over many tasks.

Edge cases: a null or empty text is the end id alone; a null ``doc_id`` stays
null; repeated rows are packed each; other columns are ignored; an empty table
gives no pieces.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread, store, table, utf8

CAPACITY = 1024
END_ID = 0
CACHE = 400_000  #: chunks whose ids a worker remembers

#: White space as the vocabulary's own pattern takes it (Unicode White_Space), fixed values.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern that cuts texts before byte-pair merging, a fixed value of the vocabulary.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevelIds:
    """Token ids of whole texts by a byte-level vocabulary file, with chunks remembered.

    A cut between anything and a following white-space run never crosses a
    match of the vocabulary's pattern, so ids of the chunks are ids of the text.
    Texts that hold one of the file's added tokens go to the library as they are.
    """

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("a byte-level vocabulary without a normaliser is asked for")
        as_byte = _byte_of_character()
        ranks = {bytes(as_byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in {a["content"] for a in spec["added_tokens"]}}
        made = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"]["".join(m)] for m in made]
        if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
            raise ValueError("merges must make ids in order")
        self.encode = tiktoken.Encoding("from-file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_str(vocabulary)
        self.added = [a["content"] for a in spec["added_tokens"]]
        self.odd = re.compile(f"[{_SPACES}] ")
        self.chunks = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
        self.after_space: dict[str, bytes] = {}
        self.exact: dict[str, bytes] = {}

    def _bytes(self, chunk: str) -> bytes:
        return np.array(self.encode(chunk), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.odd.search(text):
            parts, seen, before = self.chunks.findall(text), self.exact, ""
            out = []
        else:
            parts, seen, before = text.split(" "), self.after_space, " "
            out = [self._bytes(parts[0])]
            del parts[0]
        if len(seen) > CACHE:
            seen.clear()
        for part in parts:
            if (ids := seen.get(part)) is None:
                ids = self._bytes(before + part)
                if len(part) <= 64:
                    seen[part] = ids
            out.append(ids)
        return b"".join(out)


def pieces_of(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens) of every piece, in a narrow pass."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        ids_of = ByteLevelIds(vocabulary.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                row, start, length, crc, total = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    data = ids_of(text.decode()) + end
                    n = len(data) // 4
                    for at in range(0, n, capacity):
                        piece = data[4 * at : 4 * (at + capacity)]
                        row.append(i)
                        start.append(at)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *longs], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how many packs follow each.

    Work and memory depend on the number of distinct patterns, not of pieces.
    """
    open_packs: dict[int, Counter] = {}  # room -> patterns with that room
    rooms: list[int] = []
    closed: Counter = Counter()

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if not room:
            closed[pattern] += n
            return
        if room not in open_packs:
            open_packs[room] = Counter()
            bisect.insort(rooms, room)
        open_packs[room][pattern] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                patterns = open_packs[room]
                pattern = next(iter(patterns))
                n = min(left, patterns[pattern])
                if n == patterns[pattern]:
                    del patterns[pattern]
                    if not patterns:
                        del open_packs[room]
                        rooms.pop()
                else:
                    patterns[pattern] -= n
                put((*pattern, length), n)
                left -= n
            else:  # new packs, each as full of this length as it goes
                each = capacity // length
                if left >= each:
                    put((length,) * each, left // each)
                    left %= each
                if left:
                    put((length,) * left, 1)
                    left = 0
    for patterns in open_packs.values():
        closed.update(patterns)
    return sorted(closed.items(), reverse=True)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks, by length: where each begins, its first sequence, its offset there."""
    rows, used, base = [], Counter(), 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    rows.sort()
    length, rank, sequence, offset = np.array(rows, np.int64).reshape(-1, 4).T
    return {"key": length << 44 | rank, "rank": rank, "sequence": sequence, "offset": offset}


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (id, start, length, ...) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    parts = spread(spark)
    # equal rows may take each other's places, as they hold the same; a column "deal" tells them apart for dealing out
    key = ["id", "start", "ids_crc32", *(["deal"] if "deal" in pieces.columns else [])]
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)))
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row for each length up to the capacity
    slots = spark.sparkContext.broadcast(_slots(pack_histogram(histogram, capacity)))
    row = F.row_number().over(Window.partitionBy("length", "part").orderBy(*key))
    ranked = dealt.withColumn("row", row).join(bases, ["length", "part"])
    columns = [c for c in pieces.columns if c != "deal"]
    ranked = ranked.select(*columns, (F.col("base") + F.col("row") - 1).cast("long").alias("rank"))

    def run(batches):
        s = slots.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(s["key"], length << 44 | rank, side="right") - 1
            out = batch.select(columns)
            yield out.append_column("sequence_id", pa.array(s["sequence"][at] + rank - s["rank"][at])).append_column("offset", pa.array(s["offset"][at]))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "deal")
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    pieces = pieces_of(docs, vocabulary_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id)
    pieces, _ = store(pieces.withColumn("deal", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, capacity=capacity).withColumnRenamed("id", id_col)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
