"""Substring dedup over sliding spans of sentences.

Every run of several consecutive sentences is hashed; all runs are joined
globally, and the sentences of every run but its first occurrence (the smallest
document id, then the earliest place) are removed.

First occurrences are minima, combined on the map side, so a passage that a
third of all documents share sends one row from each task; only runs that occur
again are joined back, where Spark splits frequent ones.

Sentences end at ``.``, ``!`` or ``?`` before white space, at the full-width marks of
East Asian scripts and at line ends; one of
more than ``PIECE`` words counts as several pieces of that length at most, cut after
words whose hashes are the smallest nearby, so that a passage is cut alike whatever
stands around it.  Words: runs of ASCII letters and digits and of non-ASCII
characters, ASCII letters lower-cased; a character of an East Asian script, which
writes no spaces, counts as a word besides.  Sentences without words belong to no run.
Runs of fewer than ``MIN_WORDS`` words say too little and are lengthened, in either
direction, until they hold as many.

Edge cases: null and empty texts have no runs; ids may be of any type that has an
order; a null one comes after all others and stays null; rows that repeat an id are
told apart by their text; equal rows, id and text, count as one occurrence and lose
the same sentences; very long texts are taken whole; other columns are kept by
:func:`remove_repeats` and ignored by the query; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, mix, near, odd_multipliers, store, table, utf8
from .decontamination import tokens

RUN = 3
PIECE = 16
MIN_WORDS = 10
NEAR = 3  #: a long sentence is cut after words with the smallest hash of this many on either side

_CUT = re.compile(rb"(?<=[.!?])[ \t\x0b\f\r]+|(?<=\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)[ \t\x0b\f\r]*|(?:[ \t\x0b\f\r]*\n)+[ \t\x0b\f\r]*")
_WORD = re.compile(rb"\S+")
_LOWER = bytes(range(256)).lower()
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_HASHES = WordHashes()
_EAST = bytes(range(0xE3, 0xEE))  #: first bytes of kana, East Asian ideographs and syllables in UTF-8


def pieces(part: bytes, piece: int = PIECE) -> list[int]:
    """Where the pieces of a sentence but the first begin."""
    found = [(m.start(), w) for m in _WORD.finditer(part) if (w := m.group().translate(_LOWER, _MARKS))]
    n = len(found)
    if n <= piece:
        return []
    near = min(NEAR, (piece - 1) // 2)
    h = _HASHES.of([w for _, w in found])
    inner = h[near : n - near]
    least = np.ones(len(inner), bool)
    for k in range(near):
        least &= (inner < h[k : k + len(inner)]) & (inner <= h[n - len(inner) - k : n - k])
    cuts, last = [], 0
    for cut in [*(np.flatnonzero(least) + near + 1).tolist(), n]:
        while cut - last > piece:  # the smallest hash so far, if none is the smallest nearby
            last += near + 1 + int(np.argmin(h[last + near : last + piece]))
            cuts.append(last)
        if cut < n:
            cuts.append(cut)
        last = cut
    return [found[k][0] for k in cuts]


def sentences(text: bytes, piece: int = PIECE) -> list[tuple[int, int]]:
    """(begin, end) of every sentence, or piece of a long one, that holds a word, in bytes."""
    out, at = [], 0
    for cut in [*_CUT.finditer(text), None]:
        end = cut.start() if cut else len(text)
        if end > at:
            part = text[at:end]
            if len(part.split()) <= piece:
                out.append((at, end))
            else:
                edges = [at, *(at + k for k in pieces(part, piece)), end]
                out += zip(edges, edges[1:], strict=False)
        at = cut.end() if cut else end
    return [(a, b) for a, b in out if tokens(text[a:b])]


def runs(text: bytes, length: int = RUN, piece: int = PIECE, min_words: int = MIN_WORDS, lengthen: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places, sizes, hashes, sentences) of the runs of a text; sizes in sentences."""
    parts = [text[a:b] for a, b in sentences(text, piece)]
    each = [tokens(x) for x in parts]
    n = len(each)
    words = np.cumsum([0, *(len(w) + len(x) - len(x.translate(None, _EAST)) for w, x in zip(each, parts, strict=True))])
    if n < length or words[-1] < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), n
    hashes = np.array([xxhash.xxh3_64_intdigest(b" ".join(w)) for w in each], np.uint64)
    # the shortest run from each sentence on and the shortest one up to each; mostly the same
    begin = np.arange(n - length + 1)
    end = np.maximum(begin + length, np.searchsorted(words, words[begin] + min_words))
    until = np.arange(length, n + 1)
    since = np.minimum(until - length, np.searchsorted(words, words[until] - min_words, "right") - 1)
    both = np.concatenate([(begin * (n + 1) + end)[end <= n], (since * (n + 1) + until)[since >= 0]])
    at, stop = np.divmod(np.unique(both), n + 1)
    if not lengthen:
        at, stop = at[stop - at == length], stop[stop - at == length]
    sizes = stop - at
    total = sizes.astype(np.uint64)
    for k, m in enumerate(odd_multipliers(int(sizes.max(initial=0)), 51)):
        inside = sizes > k
        total[inside] += hashes[at[inside] + k] * m
    return at, sizes, mix(total), n


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = utf8(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = RUN, piece: int = PIECE, min_words: int = MIN_WORDS, lengthen: bool = True) -> DataFrame:
    """(id, text_key, n_sentences, place, size, span) of every run of every document."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                places, lengths, found, whose, sizes = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    at, held, hashes, n = runs(text, length, piece, min_words, lengthen)
                    places.append(at)
                    lengths.append(held)
                    found.append(hashes)
                    whose.append(np.full(len(at), i))
                    sizes.append(np.full(len(at), n))
                row = pa.array(np.concatenate(whose) if whose else [], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), part.column(2).take(row), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(lengths), pa.int32()), pa.array(np.concatenate(found).view(np.int64))],
                    ["id", "text_key", "n_sentences", "place", "size", "span"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return _keyed(docs, id_col, text_col).mapInArrow(run, f"id {kind}, text_key long, n_sentences long, place int, size int, span long")


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = RUN, piece: int = PIECE, min_words: int = MIN_WORDS, lengthen: bool = False) -> DataFrame:
    """(id, text_key, n_sentences, removed, first_ids) of the documents that lose sentences.

    lengthen: short runs are lengthened, as :func:`remove_repeats` and the query do, instead of being left out.
    removed: the sentences' places; first_ids: documents that hold the first occurrences.
    """
    found, _ = store(spans(docs, id_col=id_col, text_col=text_col, length=length, piece=piece, min_words=min_words, lengthen=lengthen), "spans")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_key"), F.col("place"))
    first = found.groupBy("span").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("span", "first")
    later = found.join(first, "span").where(~order.eqNullSafe(F.col("first")))
    # a group has no more than two runs for each sentence of its document
    grouped = later.groupBy("id", "text_key").agg(F.max("n_sentences").alias("n_sentences"), F.collect_set(F.struct("place", "size")).alias("places"), F.collect_set("first.id").alias("first_ids"))
    covered = F.flatten(F.transform("places", lambda p: F.sequence(p["place"], p["place"] + p["size"] - 1)))
    return grouped.select("id", "text_key", "n_sentences", F.sort_array(F.array_distinct(covered)).alias("removed"), F.sort_array("first_ids").alias("first_ids"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = RUN, piece: int = PIECE, min_words: int = MIN_WORDS, lengthen: bool = True) -> DataFrame:
    """``docs``, all columns, with repeated sentences cut out of the texts."""
    gone = repeated(docs, id_col=id_col, text_col=text_col, length=length, piece=piece, min_words=min_words, lengthen=lengthen)
    gone, _ = store(gone.select(F.col("id").alias("its_id"), F.col("text_key").alias("its_key"), "removed"), "gone")
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(utf8(text_col)).alias("text_key"))
    marked = near(own, F.xxhash64("id", "text_key"), gone.select(F.xxhash64("its_id", "its_key").alias("key")))
    asked = marked.where("near").join(gone, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key")), "left")

    @F.pandas_udf("string")
    def cut(texts, removed):
        out = []
        for text, places in zip(texts, removed, strict=True):
            if places is not None and len(places):
                data, keep, at = text.encode(), [], 0
                where = sentences(data, piece)
                for p in places:
                    keep.append(data[at : where[p][0]])
                    at = where[p][1]
                text = b"".join([*keep, data[at:]]).decode()
            out.append(text)
        return texts.__class__(out)

    changed = F.when(F.col("removed").isNotNull(), cut(F.col("text"), F.col("removed"))).otherwise(F.col("text"))
    shortened = asked.select("row", changed.alias("text")).select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
    return marked.where(~F.col("near")).select("row.*").unionByName(shortened)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose sentences."""
    found = repeated(table(spark, sf_dir, "documents"), lengthen=True)
    return found.select(F.col("id").alias("doc_id"), "n_sentences", F.size("removed").cast("long").alias("n_removed"), "removed", "first_ids")
