"""Language-model scoring: Katz backoff over words, three words deep.

Counts are discounted after Good and Turing, the mass so freed goes to backing
off, and backoff weights are normalised exactly over the vocabulary and one
class of unknown words.  Each token is evaluated recursively: by its gram of
``order`` words if training texts hold that, else by the backoff weight of the
words before it times its probability after one word less, down to its own.

The model is never in one place.  Documents form blocks of bounded size that
hold each distinct gram once.  For each length in turn, blocks ask a table
partitioned by context, which sums the counts of all blocks and answers each
block, aligned with what it asked; the block is written anew with the answers, and
asks for the next length without a shuffle of its own.  A frequent gram costs one
entry for each block, not one for each occurrence; the grams after a very frequent
context are dealt in shares, as many as its count asks for, and only that context's
sums are joined.  A block sends a partition one row at most, and never more rows
than it has distinct grams, which is what a join by gram would shuffle.

Tokens: ASCII letters lower-cased, words cut at ASCII white space, and one end
for each document; before the first token stands a start, which is never predicted.

Edge cases: a null or empty text is its end alone; a null ``doc_id`` is hashed as
an empty text and stays null; repeated rows count and are scored each; other
columns are ignored; without training documents all mass lies on the unknown
class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mix, odd_multipliers, spread, store, table, utf8, word_hash

ORDER = 3  #: words of the longest grams
BLOCK_TOKENS = 1_500_000  #: tokens that form a block
PARTITION_TOKENS = 4_000_000  #: a partition of the tables for so many tokens at least
HOT = 20_000  #: contexts with more than 1/HOT of all tokens are very frequent: fewer than HOT of each length
LARGEST = 5  #: counts up to this are discounted
END = word_hash(b"\n")  #: no word holds a line end


def packed(values: np.ndarray) -> bytes:
    """Compressed integers or doubles, bytes of equal weight together."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, where one of each stands, the number of each entry's value)."""
    order = np.argsort(key)
    ordered = key[order]
    edge = np.append(True, ordered[1:] != ordered[:-1]) if len(key) else np.zeros(0, bool)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(edge) - 1
    return ordered[edge], order[edge], number


def discounts(n: list[int], largest: int = LARGEST) -> np.ndarray:
    """The share that counts 0 .. largest keep, from n[r], how many distinct grams have count r.

    Good and Turing's estimate holds for the largest range of counts for which
    all shares lie between 0 and 1; without such a range, half a count is taken
    off each.
    """
    keep = np.ones(largest + 1)
    for top in range(largest, 1, -1):
        if min(n[1 : top + 2]) <= 0:
            continue
        common = (top + 1) * n[top + 1] / n[1]
        if common >= 1:
            continue
        share = [((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) for r in range(1, top + 1)]
        if all(0 < s < 1 for s in share):
            keep[1 : top + 1] = share
            return keep
    keep[1:] = [(r - 0.5) / r for r in range(1, largest + 1)]
    return keep


class Unigrams:
    """Probabilities of words by their counts, and of the unknown class."""

    def __init__(self, tokens: int, n: list[int]):
        self.tokens, self.keep = tokens, discounts(n)
        small = sum(r * n[r] for r in range(1, LARGEST + 1))
        mass = sum(self.keep[r] * r * n[r] for r in range(1, LARGEST + 1)) + tokens - small
        self.total = tokens
        self.unknown = 1 - mass / tokens if tokens else 1.0
        if self.unknown <= 1e-12:  # no count is small enough to give mass
            self.total, self.unknown = tokens + 1, 1 / (tokens + 1)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        kept = np.where(c <= LARGEST, self.keep[np.minimum(c, LARGEST)], 1.0) * c
        return np.where(c > 0, kept / max(self.total, 1), self.unknown)


def backoff(small: np.ndarray, big: np.ndarray, lower: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(divisor of discounted counts, backoff weight) of contexts.

    small[r-1]: how many words follow r times, big: the sum of larger counts,
    lower: the sum of the own probabilities of the words that follow.
    """
    r = np.arange(1, LARGEST + 1)
    whole = r @ small + big
    seen = (r * keep[1:]) @ small + big
    divisor = np.where(whole - seen > 1e-9 * np.maximum(whole, 1), whole, whole + 1).astype(float)
    left = 1 - seen / np.maximum(divisor, 1)
    return np.maximum(divisor, 1), np.where(whole > 0, left / np.maximum(1 - lower, 1e-300), 1.0)


# ---- blocks


_BLOCK = "block long, ids array<{id}>, lengths binary, held binary, words binary, tokens binary"


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_tokens: int) -> DataFrame:
    kind = docs.schema[id_col].dataType
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        number = count(TaskContext.get().partitionId() << 32)
        id_type = to_arrow_type(kind)
        fields = ["block", "ids", "lengths", "held", "words", "tokens"]

        def close(ids, lengths, held, local, tokens):
            words = np.fromiter((END if w is None else word_hash(w) for w in local), np.uint64, len(local))
            blobs = [np.array(lengths, np.uint32), np.array(held, np.uint8), words, np.concatenate(tokens)]
            return pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), pa.array([ids], pa.list_(id_type)), *(pa.array([packed(b)], pa.binary()) for b in blobs)], fields)

        def fresh():
            local = defaultdict(count().__next__)
            local[None]  # the end comes first
            return [], [], [], local, []

        block, size = fresh(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                for i, text, out in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = text.lower().split()
                    words.append(None)
                    ids, lengths, held_, local, tokens = block
                    ids.append(i)
                    lengths.append(len(words))
                    held_.append(out)
                    tokens.append(np.fromiter(map(local.__getitem__, words), np.uint32, len(words)))
                    size += len(words)
                    if size >= block_tokens:
                        yield close(*block)
                        block, size = fresh(), 0
        if size:
            yield close(*block)

    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"), held.alias("held")).mapInArrow(run, _BLOCK.format(id=kind.simpleString()))


class Block:
    """One block's arrays."""

    def __init__(self, row: dict):
        self.lengths = unpacked(row["lengths"], np.uint32).astype(np.int64)
        self.held = unpacked(row["held"], np.uint8).astype(bool)
        self.tokens = unpacked(row["tokens"], np.uint32).astype(np.int64)
        self.training = np.repeat(~self.held, self.lengths)
        self.begin = np.append(0, np.cumsum(self.lengths)[:-1])
        self.row = row


def _asked_words(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``words`` in the order of asking, where each partition begins)."""
    part = words % np.uint64(parts)
    order = np.argsort(words)
    order = order[np.argsort(part[order].astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")]
    return order, np.searchsorted(part[order], np.arange(parts + 1).astype(np.uint64))


class Grams:
    """The distinct grams of one length in a block, sorted by context and word, and what the tables say of them.

    key: what stands for a gram as the context of the next length; of_token: the
    gram that ends at each token; lower: the gram of one word less.
    """

    def __init__(self, of_token: np.ndarray, key: np.ndarray):
        self.of_token, self.key = of_token, key
        self.total = self.divisor = self.p = None


class Model:
    """What blocks and tables have to know of the model: a few numbers, and the sums of very frequent contexts."""

    def __init__(self, parts: int):
        self.parts = parts
        self.own, self.vocabulary, self.base = None, 0, 0
        self.keep, self.hot = {}, {}

    def placed(self, digits: int) -> bool:
        """Keys of so many words are numbers to the base ``base``; longer ones are hashed."""
        return self.base**digits < 1 << 62

    def longer(self, context: np.ndarray, word: np.ndarray, digits: int) -> np.ndarray:
        if self.placed(digits):
            return context * self.base + word + 1
        both = context.view(np.uint64) * _FOLD + word.astype(np.uint64)
        return (mix(both) >> np.uint64(1)).astype(np.int64) | 1

    def shorter(self, context: np.ndarray, k: int) -> np.ndarray:
        """The context of one word less of grams of length k; each entry by itself where keys are hashed."""
        return context % self.base ** (k - 2) if self.placed(k - 1) else np.arange(len(context))

    def kept(self, k: int, total: np.ndarray) -> np.ndarray:
        return np.where(total <= LARGEST, self.keep[k][np.minimum(total, LARGEST)], 1.0) * total

    def words(self, block: Block) -> Grams:
        number = np.cumsum(unpacked(block.row["number"], np.int64))
        found = Grams(block.tokens, number + 1)
        found.total, found.word = unpacked(block.row["seen"], np.int64), number
        found.p = self.own(found.total)
        return found

    def grams(self, block: Block, one: Grams, below: Grams, k: int) -> Grams:
        """The grams of length k, as they are asked for."""
        before = np.append(0, below.of_token[:-1] + 1)
        before[block.begin] = 0  # the start of a document
        size = len(one.key)
        pairs, some, at = distinct(before * size + one.of_token)
        context, word = pairs // size, one.word[pairs % size]
        h = np.append(0, below.key)[context]
        found = Grams(at, self.longer(h, word, k))
        found.h, found.w, found.lower = h, word, below.of_token[some]
        found.n = np.bincount(at[block.training], minlength=len(pairs))
        seen = np.append(0, below.total)[context]
        found.hot = (context == 0) | (seen * HOT > self.own.tokens)
        # a very frequent context has as many shares as it takes for each to be a small part of a partition
        shares = np.minimum(np.where(context == 0, self.parts, 1 + 4 * seen * self.parts // max(self.own.tokens, 1)), self.parts).astype(np.uint64)
        share = np.where(found.hot, 1 + mix(word.astype(np.uint64)) % shares, np.uint64(0))
        part = (mix(h.view(np.uint64) * _FOLD + share) % np.uint64(self.parts)).astype(np.uint16 if self.parts < 1 << 16 else np.uint32)
        found.order = np.argsort(part, kind="stable")
        found.begin = np.searchsorted(part[found.order], np.arange(self.parts + 1))
        return found

    def answered(self, found: Grams, answers: list[dict], k: int) -> None:
        """Fill in counts, divisors and backoff weights as the tables give them."""
        n = len(found.h)
        found.total, found.divisor, found.weight = np.zeros(n, np.int64), np.ones(n), np.ones(n)
        for a in answers:
            at = found.order[found.begin[a["part"]] : found.begin[a["part"] + 1]]
            found.total[at] = unpacked(a["a"], np.int64)
            at = at[~found.hot[at]]
            if len(at):
                whose, asking = _contexts(found.h[at], found.total[at])
                lower = np.zeros(whose[-1] + 1)
                lower[asking] = unpacked(a["c"], np.float64)
                sums = unpacked(a["b"], np.int64).reshape(-1, len(lower))
                d, b = backoff(sums[:LARGEST], sums[LARGEST], lower, self.keep[k])
                found.divisor[at], found.weight[at] = d[whose], b[whose]
        keys, its_divisor, its_weight = self.hot[k].value
        if len(keys):
            i = np.flatnonzero(found.hot)
            at = np.searchsorted(keys, found.h[i])
            found.divisor[i], found.weight[i] = its_divisor[at], its_weight[at]

    def evaluate(self, found: Grams, below: Grams, k: int) -> None:
        found.p = np.where(found.total > 0, self.kept(k, found.total) / found.divisor, found.weight * below.p[found.lower])

    def levels(self, block: Block, upto: int) -> list[Grams]:
        """The grams of each length up to ``upto``, with what the block was told of them."""
        out = [self.words(block)]
        for k in range(2, upto + 1):
            found, told = self.grams(block, out[0], out[-1], k), block.row["told"][k - 2]
            found.total, found.divisor = unpacked(told["total"], np.int64), unpacked(told["divisor"], np.int64).astype(float)
            found.weight = np.ones(len(found.total))
            found.weight[found.total == 0] = unpacked(told["weight"], np.float64)
            self.evaluate(found, out[-1], k)
            out.append(found)
        return out


_FOLD = odd_multipliers(1, 41)[0]


def _contexts(h: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each entry's context in a message, contexts that ask for their backing off: those of unseen grams)."""
    whose = np.cumsum(np.append(0, h[1:] != h[:-1]))
    return whose, np.unique(whose[total == 0])


# ---- words


def _ask_words(blocks: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                words = unpacked(row["words"], np.uint64)
                counts = np.bincount(block.tokens[block.training], minlength=len(words)).astype(np.uint32)
                order, begin = _asked_words(words, parts)
                rows = [(p, row["block"], packed(np.diff(words[at], prepend=np.uint64(0))), packed(counts[at])) for p in range(parts) if len(at := order[begin[p] : begin[p + 1]])]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "words", "counts"])

    return blocks.select("block", "lengths", "held", "words", "tokens").mapInArrow(run, "part int, block long, words binary, counts binary")


#: level 0: a partition's own sums; the others: the length of the grams answered
_ANSWER = "block long, part int, level int, a binary, b binary, c binary, n array<long>, hot array<struct<h: long, s: array<double>>>"
_ANSWER_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("level", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("n", pa.list_(pa.int64())), ("hot", pa.list_(pa.struct([("h", pa.int64()), ("s", pa.list_(pa.float64()))])))])


def _answers(rows: list[tuple]) -> pa.Table:
    names = _ANSWER_SCHEMA.names
    return pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], _ANSWER_SCHEMA)


def _count_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, LARGEST + 2), minlength=LARGEST + 3)[: LARGEST + 2].tolist()


def _sum_words(asked: DataFrame, parts: int) -> DataFrame:
    """Per block, numbers and counts of its words; per partition, its sums and how many words it holds."""

    def one(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        part = rows[0]["part"]
        each = [np.cumsum(unpacked(r["words"], np.uint64), dtype=np.uint64) for r in rows]
        words, _, at = distinct(np.concatenate(each))
        total = np.bincount(at, np.concatenate([unpacked(r["counts"], np.uint32) for r in rows]), len(words)).astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(words)) * parts + part  # frequent words get small numbers
        out, done = [], 0
        for r, own in zip(rows, each, strict=True):
            i = at[done : done + len(own)]
            done += len(own)
            out.append((r["block"], part, 1, packed(number[i]), packed(total[i]), None, None, None))
        out.append((None, part, 0, None, None, None, [len(words), int(total.sum()), int((total > 0).sum()), *_count_of_counts(total)], None))
        return _answers(out)

    return asked.groupBy("part").applyInArrow(one, _ANSWER)


_KNOWN = "block long, ids array<{id}>, lengths binary, held binary, tokens binary, number binary, seen binary, told array<struct<total: binary, divisor: binary, weight: binary>>"
_TOLD = pa.list_(pa.struct([("total", pa.binary()), ("divisor", pa.binary()), ("weight", pa.binary())]))


def _told_words(blocks: DataFrame, answers: DataFrame, model: Model, kind: str) -> DataFrame:
    """Blocks with the numbers and counts of their words, in the order of these numbers."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.drop_columns(["ids"]).to_pylist()[0]
        words, tokens = unpacked(row["words"], np.uint64), unpacked(row["tokens"], np.uint32)
        order, begin = _asked_words(words, model.parts)
        number, seen = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for a in right.to_pylist():
            at = order[begin[a["part"]] : begin[a["part"] + 1]]
            number[at], seen[at] = unpacked(a["a"], np.int64), unpacked(a["b"], np.int64)
        by = np.argsort(number)
        place = np.empty(len(by), np.uint32)
        place[by] = np.arange(len(by))
        told = [packed(x) for x in (place[tokens], np.diff(number[by], prepend=0), seen[by])]
        return pa.Table.from_arrays([*(left.column(c) for c in ("block", "ids", "lengths", "held")), *(pa.array([x], pa.binary()) for x in told), pa.array([[]], _TOLD)], ["block", "ids", "lengths", "held", "tokens", "number", "seen", "told"])

    known = answers.where("level > 0").select("block", "part", "a", "b")
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(one, _KNOWN.format(id=kind))


# ---- longer grams


def _ask(blocks: DataFrame, model: Model, k: int) -> DataFrame:
    fields = ("h", "w", "c", "d", "n", "hot")
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), *((f, pa.binary()) for f in fields)])

    def one(row: dict) -> pa.RecordBatch:
        block, rows = Block(row), []
        known = model.levels(block, k - 1)
        below = known[-1]
        found = model.grams(block, known[0], below, k)
        c = below.total[found.lower]
        d = None if below.divisor is None else below.divisor[found.lower].astype(np.int64)
        w = found.w.astype(np.uint32) if model.base < 1 << 32 else found.w
        for p in range(model.parts):
            at = found.order[found.begin[p] : found.begin[p + 1]]
            if len(at):
                h = found.h[at]
                its = {"h": np.diff(h, prepend=0), "w": w[at], "c": c[at], "n": found.n[at].astype(np.uint32), "hot": found.hot[at].astype(np.uint8)}
                if d is not None:  # one for each shorter context
                    its["d"] = d[at][distinct(model.shorter(h, k))[1]]
                rows.append({"part": p, "block": row["block"]} | {f: packed(x) for f, x in its.items()})
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield one(batch.slice(i, 1).to_pylist()[0])

    return blocks.drop("ids").mapInArrow(run, "part int, block long, " + ", ".join(f"{f} binary" for f in fields))


def _sum(asked: DataFrame, model: Model, k: int) -> DataFrame:
    """Per block, counts of its grams and sums of its contexts; per partition, its sums and those of very frequent contexts."""
    kind = np.uint32 if model.base < 1 << 32 else np.int64

    def one(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        part = rows[0]["part"]
        each = [np.cumsum(unpacked(r["h"], np.int64)) for r in rows]
        contexts, _, h_at = distinct(np.concatenate(each))
        word = np.concatenate([unpacked(r["w"], kind) for r in rows]).astype(np.int64)
        size = int(word.max(initial=0)) + 1
        hot_of = np.zeros(len(contexts), bool)
        hot_of[h_at] = np.concatenate([unpacked(r["hot"], np.uint8) for r in rows]).astype(bool)
        grams, some, at = distinct(h_at * size + word)
        total = np.bincount(at, np.concatenate([unpacked(r["n"], np.uint32) for r in rows]), len(grams)).astype(np.int64)
        c = np.concatenate([unpacked(r["c"], np.int64) for r in rows])[some]
        if k == 2:
            lower = model.own(c)
        else:
            d = np.concatenate([unpacked(r["d"], np.int64)[distinct(model.shorter(h, k))[2]] for r, h in zip(rows, each, strict=True)])[some]
            lower = model.kept(k - 1, c) / d
        context = grams // size
        sums = np.stack([*(np.bincount(context[total == r], minlength=len(contexts)) for r in range(1, LARGEST + 1)), np.bincount(context, np.where(total > LARGEST, total, 0), len(contexts)).astype(np.int64)])
        lower = np.bincount(context, np.where(total > 0, lower, 0.0), len(contexts))
        out, done = [], 0
        for r, its in zip(rows, each, strict=True):
            i = slice(done, done + len(its))
            done += len(its)
            counts, whose = total[at[i]], h_at[i]
            cold = ~hot_of[whose]
            asked_for, asking = whose[cold], None
            if len(asked_for):
                number, asking = _contexts(asked_for, counts[cold])
                asked_for = asked_for[np.append(True, number[1:] != number[:-1])]
            answer = (packed(sums[:, asked_for].ravel()), packed(lower[asked_for][asking])) if asking is not None else (None, None)
            out.append((r["block"], part, k, packed(counts), *answer, None, None))
        hot = [{"h": int(contexts[i]), "s": [*sums[:, i].tolist(), float(lower[i])]} for i in np.flatnonzero(hot_of).tolist()]
        out.append((None, part, 0, None, None, None, _count_of_counts(total), hot))
        return _answers(out)

    return asked.groupBy("part").applyInArrow(one, _ANSWER)


def _asked_and_told(left: pa.Table, right: pa.Table, model: Model, k: int) -> tuple[Block, list[Grams]]:
    block = Block(left.drop_columns(["ids"]).to_pylist()[0])
    known = model.levels(block, k - 1)
    found = model.grams(block, known[0], known[-1], k)
    model.answered(found, right.to_pylist(), k)
    return block, [*known, found]


def _told(blocks: DataFrame, answers: DataFrame, model: Model, k: int, kind: str) -> DataFrame:
    """Blocks with what the tables say of their grams of length k as well."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        block, known = _asked_and_told(left, right, model, k)
        found = known[-1]
        told = {"total": packed(found.total), "divisor": packed(found.divisor.astype(np.int64)), "weight": packed(found.weight[found.total == 0])}
        return left.drop_columns(["told"]).append_column("told", pa.array([[*block.row["told"], told]], _TOLD))

    known = answers.where("level > 0").select("block", "part", "a", "b", "c")
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(one, _KNOWN.format(id=kind))


# ---- scores


def _score(blocks: DataFrame, answers: DataFrame, model: Model, order: int, kind: str, token_scores: bool) -> DataFrame:
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", *(["token_scores"] if token_scores else [])]

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        block, known = _asked_and_told(left, right, model, order)
        words, longest, tokens = known[0], known[-1], model.own.tokens
        model.evaluate(longest, known[-2], order)
        base = np.log10((words.total + 0.1) / (tokens + 0.1 * (model.vocabulary + 1)))
        log_p = np.log10(longest.p)[longest.of_token]
        sums = [np.add.reduceat(x, block.begin) for x in ((words.total > 0).astype(np.int64)[words.of_token], base[words.of_token], log_p)]
        columns = [left.column("ids").combine_chunks().flatten(), pa.array(block.held), pa.array(block.lengths), pa.array(sums[0]), pa.array(np.full(len(block.begin), tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        if token_scores:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(block.begin, len(log_p)), pa.int32()), pa.array(log_p)))
        return pa.Table.from_arrays(columns, names)

    known = answers.where("level > 0").select("block", "part", "a", "b", "c")
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double" + (", token_scores array<double>" if token_scores else "")
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(one, schema)


def _sums(answers: DataFrame, n: int) -> list[int]:
    """Sums over all partitions of what each reports; the largest first number at the end."""
    row = answers.where("level = 0").agg(*(F.sum(F.get("n", F.lit(k))).alias(f"s{k}") for k in range(n)), F.max(F.get("n", F.lit(0))).alias("most")).first()
    return [int(x or 0) for x in row]


def _hot_contexts(answers: DataFrame, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, divisors, backoff weights) of very frequent contexts, fewer than HOT and the start, summed over all partitions."""
    x = answers.where("level = 0").select(F.explode("hot").alias("x")).select("x.h", "x.s")
    each = x.groupBy("h").agg(*(F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(LARGEST + 2)))
    rows = each.orderBy("h").collect()
    sums = np.array([list(r)[1:] for r in rows], float).reshape(-1, LARGEST + 2)
    divisor, weight = backoff(sums[:, :LARGEST].T, sums[:, LARGEST], sums[:, LARGEST + 1], keep)
    return np.array([r["h"] for r in rows], np.int64), divisor, weight


def score_documents(docs: DataFrame, *, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, token_scores: bool = False) -> DataFrame:
    """Score every row of ``docs`` with a model of the rows whose crc32 of the id is no multiple of 10.

    order: words of the longest grams, 2 at least.  token_scores: add the log10
    probability of each token.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    blocks, path = store(_blocks(docs, id_col, text_col, block_tokens), "blocks")
    size = blocks.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    model = Model(max(spread(spark), int(size) // 2 // PARTITION_TOKENS))  # a token takes about two bytes of a block
    answers, answers_path = store(_sum_words(_ask_words(blocks, model.parts), model.parts), "words")
    _, tokens, model.vocabulary, *n, most = _sums(answers, LARGEST + 5)
    model.own, model.base = Unigrams(tokens, n), most * model.parts + 2
    known, known_path = store(_told_words(blocks, answers, model, kind), "known")
    discard(spark, path, answers_path)
    for k in range(2, order + 1):
        answers, answers_path = store(_sum(_ask(known, model, k), model, k), "grams")
        model.keep[k] = discounts(_sums(answers, LARGEST + 2)[:-1])
        model.hot[k] = spark.sparkContext.broadcast(_hot_contexts(answers, model.keep[k]))
        if k < order:
            after, after_path = store(_told(known, answers, model, k, kind), "known")
            discard(spark, known_path, answers_path)
            known, known_path = after, after_path
    return _score(known, answers, model, order, kind, token_scores).withColumnRenamed("id", id_col)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
