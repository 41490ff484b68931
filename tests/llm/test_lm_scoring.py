"""Katz backoff against a plain version that shares nothing with the operator, and the sums of what Spark's tables say."""

import math
import zlib
from collections import Counter

import pytest

from tidewheel.llm import lm_scoring

END, BEFORE = object(), object()


def words_of(text):
    return [w for w in (text or "").encode().lower().split()] + [END]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def shares_kept(counts):
    """What counts 1 to 5 keep of themselves, by Good and Turing where their estimate makes sense."""
    how_many = Counter(counts)
    for top in (5, 4, 3, 2):
        if not all(how_many[r] for r in range(1, top + 2)):
            continue
        beyond = (top + 1) * how_many[top + 1] / how_many[1]
        if beyond >= 1:
            continue
        share = {r: ((r + 1) * how_many[r + 1] / (r * how_many[r]) - beyond) / (1 - beyond) for r in range(1, top + 1)}
        if all(0 < x < 1 for x in share.values()):
            return share
    return {r: (r - 0.5) / r for r in range(1, 6)}


class Katz:
    def __init__(self, texts, order=3):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]  # by length; a gram is a tuple
        for text in texts:
            words = [BEFORE] * (order - 1) + words_of(text)
            for t in range(order - 1, len(words)):
                for k in range(1, order + 1):
                    self.counts[k][tuple(words[t - k + 1 : t + 1])] += 1
        self.share = [None, *(shares_kept(c.values()) for c in self.counts[1:])]
        self.after = {}
        for k in range(2, order + 1):
            for gram in self.counts[k]:
                self.after.setdefault(gram[:-1], []).append(gram[-1])
        self.tokens = sum(self.counts[1].values())
        self.weights = {}
        self.own = {g[0]: self.discounted(g) for g in self.counts[1]}
        self.unknown = 1 - sum(self.own.values()) / self.tokens
        self.total = self.tokens
        if self.unknown <= 1e-12:
            self.total, self.unknown = self.tokens + 1, 1 / (self.tokens + 1)

    def discounted(self, gram):
        c = self.counts[len(gram)][gram]
        return c * self.share[len(gram)].get(c, 1.0)

    def context(self, h):
        """(divisor, backoff weight) of the words before."""
        if h not in self.weights:
            followers = self.after.get(h)
            if not followers:
                self.weights[h] = (1, 1.0)
            else:
                whole = sum(self.counts[len(h) + 1][(*h, w)] for w in followers)
                seen = sum(self.discounted((*h, w)) for w in followers)
                if whole - seen <= 1e-9 * whole:
                    whole += 1
                self.weights[h] = (whole, (1 - seen / whole) / (1 - sum(self.p(w, h[1:]) for w in followers)))
        return self.weights[h]

    def p(self, w, h):
        if not h:
            return self.own[w] / self.total if w in self.own else self.unknown
        divisor, weight = self.context(h)
        if (*h, w) in self.counts[len(h) + 1]:
            return self.discounted((*h, w)) / divisor
        return weight * self.p(w, h[1:])

    def scores(self, text):
        words = [BEFORE] * (self.order - 1) + words_of(text)
        return [math.log10(self.p(words[t], tuple(words[t - self.order + 1 : t]))) for t in range(self.order - 1, len(words))]


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.mark.parametrize(("order", "block", "partition", "hot"), [(3, 10**7, 10**7, 20_000), (3, 3000, 2000, 200), (2, 10**7, 10**7, 20_000), (4, 5000, 10**7, 300)])
def test_scores(documents, monkeypatch, order, block, partition, hot):
    monkeypatch.setattr(lm_scoring, "PARTITION_TOKENS", partition)
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    if order != 3:
        documents = documents.where("doc_id % 3 = 0")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    model = Katz([t for i, t in texts.items() if not held(i)], order)
    for r in lm_scoring.score_documents(documents, order=order, block_tokens=block, token_scores=True).collect():
        words = words_of(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(r["doc_id"]), len(words), model.tokens)
        assert r["n_known"] == sum(w in model.own for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((model.counts[1][w,] + 0.1) / (model.tokens + 0.1 * (len(model.own) + 1))) for w in words))
        if r["doc_id"] % 4 == 0 or r["held_out"]:
            want = model.scores(texts[r["doc_id"]])
            assert r["token_scores"] == pytest.approx(want) and r["score"] == pytest.approx(sum(want))


def test_hashed_contexts(documents, monkeypatch):
    """Keys that a number can't hold are hashed; nothing else changes."""
    def rows():
        return {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(documents.where("doc_id % 3 = 0")).collect()}

    want = rows()
    monkeypatch.setattr(lm_scoring.Model, "placed", lambda self, digits: digits < 2)
    assert rows() == pytest.approx(want)


def test_probabilities_sum_to_one(spark):
    """After any two words the probabilities of all words, of the end and of an unknown word come to 1."""
    training = ["a b c d a b", "b c a b d e", "a b c", "e e e e", "c d a b c a", "d"] * 2 + ["f a b", "g c d"]
    out_ids = iter(i for i in range(10**6) if held(i))
    rows = [(i, t) for i, t in zip((i for i in range(10**6) if not held(i)), training, strict=False)]
    vocabulary = [*"abcdefg", "neverseen"]
    asked = {}
    for h in ("a b", "e e", "b d", "g c", "neverseen a", "a neverseen", "f g", "d e"):
        for w in [*vocabulary, ""]:
            i = next(out_ids)
            asked[i] = (h, w)
            rows.append((i, f"{h} {w}"))
    for w in [*vocabulary, ""]:
        i = next(out_ids)
        asked[i] = ("", w)
        rows.append((i, w))
    total = Counter()
    for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), token_scores=True).collect():
        if r["doc_id"] in asked:
            h, _ = asked[r["doc_id"]]
            total[h] += 10 ** r["token_scores"][len(h.split())]
    assert len(total) == 9 and all(x == pytest.approx(1) for x in total.values())


def test_what_occurs_twice_is_told_apart(spark):
    import random

    rng = random.Random(3)

    def text():
        return " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(120))

    rows = [(i, text()) for i in range(300)]
    twice = [i for i, _ in rows[:20] if not held(i) and not held(1000 + i)]
    rows += [(1000 + i, rows[i][1]) for i in twice]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    once = sorted(s for i, s in got.items() if 20 <= i < 300 and not held(i))
    assert sum(got[i] > once[int(0.95 * len(once))] for i in twice) >= 0.9 * len(twice)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (None, "a text without an id, repeated"), (None, "a text without an id, repeated"), (6, "word " * 3000), (6, "word " * 3000), (7, "é梦 😀 <|endoftext|> <s> naïve space　wide")]
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, block long, id string, part long, level int").repartition(2)
    out = lm_scoring.score_documents(df).collect()
    assert len(out) == len(rows) and all(math.isfinite(r["score"]) for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm_scoring.score_documents(df.limit(0)).count() == 0
    alone = [i for i in range(60) if held(i)][:3]
    none = lm_scoring.score_documents(spark.createDataFrame([(i, "no training at all") for i in alone], "doc_id long, text string")).collect()
    assert len(none) == 3 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 for r in none)
