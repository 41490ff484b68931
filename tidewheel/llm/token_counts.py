"""Token counts of whole texts under a byte-fallback piece vocabulary.

Rank-synchronous array merging: the distinct pre-tokens of a batch become one
ragged numpy array of symbols; in each round every sequence applies its
lowest-ranked adjacent pair, all sequences at once, until none has a pair left.
The surviving symbols are counted, those outside the vocabulary as their bytes.

No symbol can span two characters that stand side by side in no piece, so
sequences are cut there first.  A pair whose symbol makes a better pair is
followed up before later pairs nearby; pairs far from it don't wait, as what it
sets off reaches no further than the longest piece.

Edge cases: a null or empty text has 0 bytes and 0 tokens; a null ``doc_id``
stays null; repeated rows are counted each; very long texts and words without a
space are counted whole; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8

SPACE = "▁"
CACHE = 4_000_000  #: characters of the pre-tokens whose counts a worker remembers
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6  #: piece types of the model format


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = number()
        yield tag >> 3, data[at : at + size]
        at += size


def _run_costs(lengths: set[int]) -> np.ndarray | None:
    """Tokens that runs of 1 .. longest equal characters come to, joined from the left into pieces of these lengths.

    None unless a run that is longer by the longest piece comes to one token more.
    """
    longest = max(lengths)
    costs = []
    for n in range(1, 4 * longest + 1):
        run, at = [1] * n, 0
        while at < len(run) - 1:
            if run[at] + run[at + 1] in lengths:
                run[at : at + 2] = [run[at] + run[at + 1]]
                at = max(0, at - 1)
            else:
                at += 1
        costs.append(len(run))
    whole = all(costs[n + longest] == costs[n] + 1 for n in range(3 * longest))
    return np.array(costs[:longest], np.int64) if whole else None


class PieceMerger:
    """The pair table of a piece vocabulary, and the counting of pre-tokens with it."""

    def __init__(self, model: bytes):
        score, byte_pieces, trainer, normaliser = {}, 0, {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                kind = piece.get(3, NORMAL)
                byte_pieces += kind == BYTE
                if kind in (NORMAL, USER_DEFINED, UNUSED):
                    score[piece[1].decode()] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                if kind in (USER_DEFINED, UNUSED):
                    raise ValueError("user-defined and unused pieces are not supported")
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or byte_pieces != 256:
            raise ValueError("a pair-merging model with byte fallback is asked for")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1):
            raise ValueError("a model with the identity normaliser and a space put before texts is asked for")
        if any(SPACE in p.lstrip(SPACE) for p in score):
            raise ValueError("pieces may not hold a space after other characters")
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.ids = {p: i for i, p in enumerate(score)}
        keys, ranks, made = [], [], []
        for piece, s in score.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is None:  # a character outside the vocabulary still merges if the sum is a piece
                    left = self.ids.setdefault(piece[:cut], len(self.ids)) if cut == 1 else None
                if right is None:
                    right = self.ids.setdefault(piece[cut:], len(self.ids)) if cut == len(piece) - 1 else None
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(order[s])
                    made.append(self.ids[piece])
        by = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks, self.made = (np.array(x, np.int64)[by] for x in (keys, ranks, made))
        self.known = set(score)
        self.longest = max(map(len, score))
        ids_ = self.ids
        # characters side by side in a piece
        self.inside = np.unique(np.array([ids_[a] << 32 | ids_[b] for p in score for a, b in zip(p, p[1:], strict=False) if a in ids_ and b in ids_], np.int64))
        self.none = len(order)
        # pieces of spaces alone, all with the worst rank, join from the left once all else is done
        tied = [p for p, s in score.items() if order[s] == len(order) - 1]
        self.run_cost = _run_costs({len(p) for p in tied}) if set("".join(tied)) == {SPACE} and self.ids[SPACE] is not None else None
        self.cost = np.array([1 if p in self.known else len(p.encode()) for p in self.ids], np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], self.none), self.made[at]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each non-empty pre-token."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.ids
        flat = [ids.get(c, -1) for w in words for c in w]
        symbols = np.array(flat, np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        extra = np.zeros(len(words), np.int64)
        if (symbols < 0).any():  # characters outside the vocabulary take no part in merging
            strange = np.flatnonzero(symbols < 0)
            text = "".join(words)
            extra = np.bincount(word[strange], [len(text[i].encode()) for i in strange], len(words)).astype(np.int64)
        if not len(symbols):
            return extra
        key = symbols[:-1] << 32 | np.maximum(symbols[1:], 0)
        at = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
        apart = (self.inside[at] != key) | (symbols[:-1] < 0) | (symbols[1:] < 0) | (word[1:] != word[:-1])
        owner = np.cumsum(np.append(False, apart))
        word = word[np.flatnonzero(np.append(True, apart))]  # of each sequence
        size = np.ones(len(symbols), np.int64)
        total = np.zeros(len(word), np.int64)
        while len(symbols):
            same = np.append(owner[1:] == owner[:-1], False)
            rank, made = self._pairs(symbols, np.append(symbols[1:], -1))
            rank[~same] = self.none
            starts = np.flatnonzero(np.append(True, ~same[:-1]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            done = best == self.none
            if self.run_cost is not None:
                done |= best == self.none - 1
            if done.any():
                out = np.repeat(done, sizes)
                ended, whose = symbols[out], owner[out]
                cost = np.where(ended < 0, 0, self.cost[ended])
                if self.run_cost is not None:
                    space = ended == ids[SPACE]
                    first = space & ~np.append(False, space[:-1] & (whose[1:] == whose[:-1]))
                    at = np.flatnonzero(first)
                    if len(at):
                        run = np.add.reduceat(space.astype(np.int64), at)  # only the spaces between two starts, which are one run
                        cost[space] = 0
                        longest = len(self.run_cost)
                        cost[at] = self.run_cost[(run - 1) % longest] + (run - 1) // longest
                total += np.bincount(whose, cost, len(total)).astype(np.int64)
                keep = ~out
                symbols, owner, rank, made, size = symbols[keep], owner[keep], rank[keep], made[keep], size[keep]
                best, sizes = best[~done], sizes[~done]
                if not len(symbols):
                    break
                starts = np.append(0, np.cumsum(sizes)[:-1])
            wanted = np.repeat(best, sizes)
            hit = rank == wanted
            at = np.arange(len(hit))
            # overlapping occurrences: every second one from the left of each run
            fresh = hit & ~np.append(False, hit[:-1] & (owner[1:] == owner[:-1]))
            begin = np.maximum.accumulate(np.where(fresh, at, 0))
            hit &= (at - begin) % 2 == 0
            where = np.flatnonzero(hit)
            new = made[where]
            seq_of = owner[where]
            # all at once only if no pair that this creates would come before the rest of the round
            after = where + 2
            follows = np.where((after < len(symbols)) & (owner[np.minimum(after, len(owner) - 1)] == seq_of), symbols[np.minimum(after, len(symbols) - 1)], -1)
            before = where - 1
            previous = np.where((before >= 0) & (owner[before] == seq_of), symbols[before], -1)
            joined = np.append(False, where[1:] - 2 == where[:-1]) & np.append(False, seq_of[1:] == seq_of[:-1])
            previous = np.where(joined, np.append(-1, new[:-1]), previous)
            risky = np.minimum(self._pairs(new, follows)[0], self._pairs(previous, new)[0]) <= rank[where]
            if risky.any():
                place = (np.cumsum(size) - size)[where]
                last = np.append(-1, np.maximum.accumulate(np.where(risky, np.arange(len(where)), -1))[:-1])
                wait = (last >= 0) & (seq_of[last] == seq_of) & (place - place[last] <= 4 * self.longest)
                where, new = where[~wait], new[~wait]
            symbols[where] = new
            size[where] += size[where + 1]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, owner, size = symbols[keep], owner[keep], size[keep]
        return extra + np.bincount(word, total, len(words)).astype(np.int64)


class TextCounter:
    """Counts whole texts, remembering the pre-tokens seen."""

    RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def __init__(self, merger: PieceMerger):
        self.merger, self.seen, self.held = merger, {}, 0

    def __call__(self, texts: list[bytes]) -> list[int]:
        split = []
        for data in texts:
            text = SPACE + data.decode().replace(" ", SPACE)
            # every pre-token begins with a space, which its key leaves out
            split.append([] if text == SPACE else text[1:].split(SPACE) if SPACE * 2 not in text else [x[1:] for x in self.RUNS.findall(text)])
        words = set().union(*split) if split else set()
        if self.held > CACHE:
            self.seen, self.held = {}, 0
        if missing := [w for w in words if w not in self.seen]:
            self.held += sum(map(len, missing))
            for k in range(0, len(missing), 50_000):
                part = missing[k : k + 50_000]
                self.seen.update(zip(part, self.merger.count([SPACE + w for w in part]).tolist(), strict=True))
        get = self.seen.__getitem__
        return [sum(map(get, words)) for words in split]


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    A narrow pass without a shuffle.  The model file is read on the driver and
    its pair table (bounded by the vocabulary) is sent along.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        counter = TextCounter(PieceMerger(model.value))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):  # bounds what is split at once
                part = batch.slice(k, 500)
                n = pa.array(counter(part.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), n], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = text.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
