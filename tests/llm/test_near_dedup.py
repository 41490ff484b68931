"""Near-duplicates and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import components, near_dedup, quality_rules
from tidewheel.llm.decontamination import tokens


def shingle_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def groups(docs, threshold=85):
    """Smallest reachable id of every (id, text), by comparing all pairs."""
    sets = {i: shingle_sets(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= threshold * max(len(a), len(b)) and 100 * len(a & b) >= threshold * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}


def test_against_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found(docs) == groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def crowd(n, seed=1, words=60):
    """Many texts near one another, about as far apart as the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(0, 3)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize(("few", "chunk"), [(16, 1024), (2, 8)])
def test_crowds_lose_no_link(spark, monkeypatch, few, chunk):
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rows = crowd(120) + [(1000 + i, t) for i, t in crowd(40, seed=2)] + [(2000 + i, "a b c d e f g") for i in range(30)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == groups(rows)


def test_shared_counts():
    rng = np.random.default_rng(3)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(n)] for n in (7, 9))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert near_dedup._shared(left, right, step=16).tolist() == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Few words"), (5, "few\tWORDS"), (None, "few words"), (None, None), (6, "few words"), (6, "few words"), (7, "x " * 20_000), (8, "x " * 20_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "component": F.lit("c"), "bucket": F.lit(2)})
    out = [tuple(r) for r in near_dedup.near_duplicates(df).collect()]
    assert sorted(out, key=str) == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, None, True), (None, 0, None, True), (6, 1, 4, False), (6, 1, 4, False), (7, 1, 7, True), (8, 1, 7, False)], key=str)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(4000, 4100)] + [(7, 7)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {i: root(i) for a, b in edges for i in (a, b) if a != b}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_against_brute_force(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    bench = [tokens(r["text"].encode()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.op8(spark, small).collect()}
    kept = [(i, t) for i, t, _ in docs if verdict[i]]
    first = groups(kept, threshold=80)
    kept = [(i, t) for i, t in kept if first[i][1] == i]

    def leaks(text):
        words = b" " + b" ".join(tokens(text.encode())) + b" "
        return any(b" " + b" ".join(b) + b" " in words for b in bench)

    want = {i for i, t in kept if not leaks(t)}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in rows} == want
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "PII", "packing"]
