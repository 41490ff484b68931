"""Nulls, bounded blocks, user functions, handlers, balls, samplers and jobs."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewheel import jobs
from tidewheel.functions import vectors
from tidewheel.operators import factors, graph, keyed, learning, similarity, topics, trees, words
from tidewheel.sources import text


def vecs(n, width=5, seed=1):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, 1), 3) for _ in range(width)]) for i in range(n)]


def test_null_vectors_lose_no_others(spark):
    rows = vecs(40)
    whole = spark.createDataFrame(rows, "id long, features array<double>")
    holed = spark.createDataFrame([*rows, (100, None), (101, [1.0, None, 2.0, 3.0, 4.0])], "id long, features array<double>")
    want = sorted(map(tuple, similarity.similar(whole, whole, id_col="id", vec="features", least=0.0, chunk=7).collect()))
    assert want and sorted(map(tuple, similarity.similar(holed, holed, id_col="id", vec="features", least=0.0, chunk=7).collect())) == want
    nulls = spark.createDataFrame([*rows, (100, None)], "id long, features array<double>")
    a, b = learning.kmeans(whole, 3, 2), learning.kmeans(nulls, 3, 2)
    assert np.allclose(a[1], b[1]) and sorted(map(tuple, a[0].collect())) == sorted(map(tuple, b[0].collect()))
    assert np.allclose(learning.gram(whole)[0], learning.gram(nulls)[0]) and learning.gram(nulls)[2] == 40
    assert learning.gram(whole.limit(0))[2] == 0 and learning.kmeans(whole.limit(0), 3, 2)[0].count() == 0


def test_indexes_without_reused_exchanges(spark):
    df = spark.range(50_000).select((F.col("id") * 7919 % 100_003).alias("v"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = text.index_of(df, "v", parts=16).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    ordered = sorted(r["v"] for r in rows)
    assert [r["index"] for r in sorted(rows, key=lambda r: r["v"])] == list(range(len(ordered))) and len(set(ordered)) == 50_000


def test_nearest_breaks_ties_by_order():
    centres = np.array([[0.0, 0.0], [2.0, 0.0], [2.0, 0.0], [0.0, 1e-3]])
    x = np.array([[1.0, 0.0], [2.0, 0.0], [0.0, 0.0], [0.0, 1e-3], [1e6, 1.0]])
    want = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert learning._nearest(x, centres).tolist() == want.tolist()
    rng = np.random.default_rng(2)
    x, centres = rng.normal(size=(500, 7)), rng.normal(size=(40, 7))
    assert learning._nearest(x, centres).tolist() == ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()


def test_descent_in_bounded_blocks(spark):
    """Blocks of a shard are met one after another; a single shard's weights are handed on."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 1)], float(rng.random() < 0.5)) for i in range(60)]
    df = spark.createDataFrame([*rows, (100, None, 1.0), (101, [1.0, 2.0], None)], "id long, features array<double>, label double")
    theta = np.zeros(3)
    for b in range(3):
        for _, x, y in [r for r in rows if r[0] % 3 == b]:
            x = np.array([1.0, *x])
            theta = theta + 0.01 * (y - 1 / (1 + math.exp(-x @ theta))) * x - 2 * 0.01 * 0.1 * theta
    got = learning.parameter_mixing(df, 1, 0.01, 0.1, 1, logistic=True, shard_rows=20)
    assert got == pytest.approx(theta)


def test_clusters_and_radii(spark):
    rows = vecs(60, 3)
    df = spark.createDataFrame(rows, "id long, features array<double>")
    assigned, centres = learning.kmeans(df, 4, 2)
    of = {r["id"]: r["cluster"] for r in assigned.collect()}
    groups = Counter()
    for r in learning.members(assigned, parts=3).collect():
        assert r["ids"] == sorted(r["ids"]) and all(of[i] == r["cluster"] for i in r["ids"])
        groups[r["cluster"]] += len(r["ids"])
    assert groups == Counter(of.values())
    for r in learning.radii(df, assigned, centres).collect():
        away = [np.linalg.norm(np.array(v) - centres[r["cluster"]]) for i, v in rows if of[i] == r["cluster"]]
        assert r["n"] == len(away) and r["radius"] == pytest.approx(max(away))


def test_balls_find_what_a_scan_finds(spark):
    rows = vecs(300, 4, seed=5)
    rows += [(1000 + i, rows[i][1]) for i in range(20)]  # ties
    df = spark.createDataFrame(rows, "id long, features array<double>")
    index = similarity.BallIndex.build(df, 12)
    rng = random.Random(6)
    for k in (1, 7, 50, 400):
        q = [rng.gauss(0, 1) for _ in range(4)]
        want = [tuple(r) for r in similarity.inner_product_topk(df, q, k).collect()]
        assert [tuple(r) for r in index.search(q, k).collect()] == want
    black = df.where("id % 2 = 0").select("id")
    q = [0.3, -1.0, 0.5, 2.0]
    assert [tuple(r) for r in index.search(q, 9, black=black).collect()] == [tuple(r) for r in similarity.inner_product_topk(df, q, 9, black=black).collect()]


@pytest.mark.parametrize(("least", "piece"), [(1e-12, 256), (0.1, 3), (0.0, 4), (-1.0, 256)])
def test_sparse_cosine_in_pieces(spark, least, piece):
    rng = random.Random(7)
    cells = {(i, rng.choice([0, 0, 0, *range(1, 12)])): rng.choice([1.0, 2.0, -1.0, 3.0]) for i in range(30) for _ in range(3)}
    df = spark.createDataFrame([(i, j, w) for (i, j), w in cells.items()], "src long, dst long, w double")
    size = Counter()
    for (i, _), w in cells.items():
        size[i] += w * w
    rows = {}
    for (i, j), w in cells.items():
        rows.setdefault(i, {})[j] = w / math.sqrt(size[i])
    k, want = 4, []
    for i in rows:
        sims = [(round(sum(w * rows[j].get(c, 0.0) for c, w in rows[i].items()), 9), j, bool(set(rows[i]) & set(rows[j]))) for j in rows if j != i]
        sims = [(s, j) for s, j, met in sims if least <= s <= 1 and (met or least <= 0)]
        want += [(i, j, s) for s, j in sorted(sims, key=lambda x: (-x[0], x[1]))[:k]]
    got = [(r["i"], r["j"], round(r["sim"], 9)) for r in similarity.sparse_cosine_topk(df, k, least, piece=piece).collect()]
    assert sorted((i, j) for i, j, _ in got) == sorted((i, j) for i, j, _ in want)
    assert dict(((i, j), s) for i, j, s in got) == pytest.approx(dict(((i, j), s) for i, j, s in want))


def shuffled(spark, what="Records"):
    """Records, or bytes, of all shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(getattr(stages.apply(i), f"shuffleWrite{what}")() for i in range(stages.size()))


@pytest.mark.parametrize("size", [1 << 24, 1 << 18])
def test_cosine_without_shuffled_vectors(spark, monkeypatch, size):
    """Copies of vectors for each pair of chunks would be 9 MB here."""
    monkeypatch.setattr(similarity, "SLICE", size)
    x = np.random.default_rng(5).normal(size=(6000, 20))
    x[100:400] = x[100]
    x[17] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(8).cache()
    df.count()
    before = shuffled(spark, "Bytes")
    got = {(r["i"], r["rank"]): (r["j"], r["sim"]) for r in similarity.cosine_topk(df, df.where("id % 7 > 0"), 2, 0.1).collect()}
    assert shuffled(spark, "Bytes") - before < 4_000_000
    df.unpersist()
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x != 0)
    sims = unit @ unit.T
    sims[:, ::7] = -1
    np.fill_diagonal(sims, -1)
    sims = np.round(sims, 9)
    for i in range(6000):
        first = np.lexsort((np.arange(6000), -sims[i]))[:2]
        for rank, j in enumerate(first[sims[i, first] >= 0.1], 1):
            assert got.pop((i, rank)) == (j, pytest.approx(sims[i, j]))
    assert not got


@pytest.mark.parametrize(("entries", "at_once"), [(1 << 21, 1 << 24), (2000, 1500), (1, 800)])
def test_neighbours_without_shuffled_pairs(spark, monkeypatch, entries, at_once):
    """An item that everybody has makes 44,850 pairs of 300 users; blocks, and rounds of them, don't shuffle these."""
    monkeypatch.setattr(similarity, "ENTRIES", entries)
    monkeypatch.setattr(similarity, "ROUND", at_once)
    rng = random.Random(11)
    ratings = {u: {0: 1.0 + u % 5} | {rng.randrange(1, 60): float(rng.randrange(1, 6)) for _ in range(6)} for u in range(300)}
    df = spark.createDataFrame([(u, i, w) for u, own in ratings.items() for i, w in own.items()], "user long, item long, rating double")
    cells, before = df.count(), shuffled(spark)
    sims = similarity.sparse_cosine_topk(df.toDF("src", "dst", "w"), 6, 0.001)
    got = {(r["i"], r["rank"]): (r["j"], r["sim"]) for r in sims.collect()}
    assert shuffled(spark) - before < (8 if entries > 1 else 20) * cells  # a block for each row gets every column of its own
    size = {u: math.sqrt(sum(w * w for w in own.values())) for u, own in ratings.items()}
    for u, own in ratings.items():
        near = [(-round(sum(w / size[u] * (them[i] / size[v]) for i, w in own.items() if i in them), 9), v) for v, them in ratings.items() if v != u]
        for rank, (s, v) in enumerate(sorted(near)[:6], 1):
            assert got.pop((u, rank)) == (v, pytest.approx(-s))
    assert not got
    before = shuffled(spark)
    found = similarity.neighbourhood_sizes(df, sims, 2).collect()
    assert len(found) == 300 and shuffled(spark) - before < 12 * cells
    named = df.withColumn("item", F.concat(F.lit("item "), F.col("item")))
    assert sorted(similarity.neighbourhood_sizes(named, sims, 2).collect()) == sorted(found)


def test_trees_take_items_in_groups(spark, monkeypatch):
    users = spark.createDataFrame(vecs(80, 3, seed=8), "id long, v array<double>").withColumn("node", F.col("id") % 2 + 1)
    items = spark.createDataFrame([*vecs(25, 3, seed=9), (99, None)], "id long, v array<double>")
    whole = sorted((r["node"], r["item"], r["likes"], r["hates"], round(r["error"], 9)) for r in trees.split_errors(users, items).collect())
    monkeypatch.setattr(trees, "ITEMS", 6)
    monkeypatch.setattr(trees, "HELD", 50)
    assert sorted((r["node"], r["item"], r["likes"], r["hates"], round(r["error"], 9)) for r in trees.split_errors(users, items, block=4).collect()) == whole
    assert whole and trees.split_errors(users, items.limit(0)).count() == 0


def test_topics_against_a_plain_sampler(spark, monkeypatch):
    rng = random.Random(10)
    docs = [(d, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 5, 30])))) for d in range(25)]
    df = spark.createDataFrame([*docs, (99, None)], "doc_id long, text string")
    k, alpha, beta = 3, 0.1, 0.01
    state = {(r["doc"], r["pos"]): (r["word"], r["topic"]) for r in topics.first_topics(topics.corpus(df, "doc_id", "text"), k).collect()}
    vocabulary = len({w for w, _ in state.values()})
    for t in range(2):
        by_word, totals = {}, np.zeros(k)
        for w, z in state.values():
            by_word.setdefault(w, np.zeros(k))[z] += 1
            totals[z] += 1
        after = {}
        for d, _ in docs:
            own_tokens = sorted(p for e, p in state if e == d)
            if not own_tokens:
                continue
            draws = np.random.default_rng(xxhash.xxh3_64_intdigest(str(d), 1 + 1000 * (t + 1))).random(len(own_tokens))
            counts, total, own = {w: c.copy() for w, c in by_word.items()}, totals.copy(), np.zeros(k)
            for p in own_tokens:
                own[state[d, p][1]] += 1
            for p, u in zip(own_tokens, draws, strict=True):
                w, z = state[d, p]
                for c in (counts[w], total, own):
                    c[z] -= 1
                weight = [(own[x] + alpha) * (counts[w][x] + beta) / (total[x] + vocabulary * beta) for x in range(k)]
                z, left = 0, u * np.cumsum(weight)[-1]
                while z < k - 1 and np.cumsum(weight)[z] <= left:
                    z += 1
                for c in (counts[w], total, own):
                    c[z] += 1
                after[d, p] = (w, z)
        state = after
    for cells in (1 << 21, 10):
        monkeypatch.setattr(topics, "CELLS", cells)
        got = topics.gibbs(df, k, 2, alpha, beta).collect()
        assert {(r["doc"], r["pos"]): (r["word"], r["topic"]) for r in got} == state and len(got) == len(state)


def plain_factorisation(rows, users, items, n, staleness=0, shard=lambda u, i: u % 4, alpha=0.005, beta=0.01):
    mean = sum(r for *_, r in rows) / len(rows)
    states = [{**{("user", i): v for i, v in users.items()}, **{("item", i): v for i, v in items.items()}}]
    for t in range(n):
        old, moves = states[max(0, t - staleness)], {}
        for s in {shard(u, i) for u, i, _ in rows}:
            own = {k: (f.copy(), b) for k, (f, b) in old.items()}
            mine = sorted((u, i, r) for u, i, r in rows if shard(u, i) == s)
            for u, i, r in mine:
                (x, bx), (y, by) = own["user", u], own["item", i]
                e = r - min(5.0, max(1.0, mean + bx + by + x @ y))
                own["user", u] = (x + alpha * (2 * e * y - beta * x), bx + alpha * (2 * e - beta * bx))
                own["item", i] = (y + alpha * (2 * e * x - beta * y), by + alpha * (2 * e - beta * by))
            for key in {("user", u) for u, _, _ in mine} | {("item", i) for _, i, _ in mine}:
                moves.setdefault(key, []).append((own[key][0] - old[key][0], own[key][1] - old[key][1]))
        states.append({k: (f + np.mean([m for m, _ in moves[k]], axis=0), b + np.mean([m for _, m in moves[k]])) if k in moves else (f, b) for k, (f, b) in states[-1].items()})
    return states[-1]


@pytest.mark.parametrize(("n", "staleness"), [(1, 0), (3, 0), (3, 1)])
def test_factorisation_against_a_plain_one(spark, n, staleness):
    rng = random.Random(11)
    rows = sorted({(u, i): float(rng.randrange(1, 6)) for u in range(9) for i in rng.sample(range(20, 30), 4)}.items())
    rows = [(u, i, r) for (u, i), r in rows]
    users = {u: (np.array([u % 3 / 10, 0.1]), 0.0) for u in range(9)}
    items = {i: (np.array([0.2, i % 4 / 10]), 0.0) for i in {i for _, i, _ in rows}}
    frames = [spark.createDataFrame([(i, f.tolist(), b) for i, (f, b) in side.items()], "id long, factors array<double>, bias double") for side in (users, items)]
    ratings = spark.createDataFrame(rows, "user long, item long, rating double")
    want = plain_factorisation(rows, users, items, n, staleness)
    found = factors.train(ratings, 2, n, users=frames[0], items=frames[1], staleness=staleness)
    for side, table in zip(("user", "item"), found, strict=False):
        for r in table.collect():
            assert [*r["factors"], r["bias"]] == pytest.approx([*want[side, r["id"]][0], want[side, r["id"]][1]])


def test_heavy_users_are_split(spark):
    rows = [(1, i, 3.0) for i in range(200)] + [(2, i, 4.0) for i in range(5)] + [(None, 1, 1.0)]
    dealt = factors._dealt(spark.createDataFrame(rows, "user long, item long, rating double").where("user is not null"), 4, 20).collect()
    shards = {r["shard"] for r in dealt if r["user"] == 1}
    assert len(dealt) == 205 and len(shards) > 5 and len({r["shard"] for r in dealt if r["user"] == 2}) == 1


def test_generated_factors(spark):
    df = spark.createDataFrame([(1, [0.5, 2.0])], "id long, factors array<double>")
    assert factors.generated_factors(df).first()["factors"] == [1.0, 0.5, 2.0]


# ---- user functions and handlers


def test_folds_by_any_function(spark):
    rng = random.Random(12)
    rows = [(rng.choice("aaab"), rng.randrange(1, 100)) for _ in range(500)] + [("c", None), ("d", 4)]
    df = spark.createDataFrame(rows, "key string, value long").repartition(6)
    got = {r["key"]: r["value"] for r in keyed.fold_with(df, math.gcd).collect()}
    assert got == {k: math.gcd(*[v for x, v in rows if x == k]) for k in "abd"}
    state = spark.createDataFrame([("d", 6), ("e", 9)], "key string, value long")
    assert {r["key"]: r["value"] for r in keyed.fold_with(df, math.gcd, state=state).collect()} == got | {"d": 2, "e": 9}
    lists = spark.createDataFrame([("a", [2, 1]), ("a", [3]), ("b", [])], "key string, value array<int>")
    assert {r["key"]: r["value"] for r in keyed.concat_lists(lists).collect()} == {"a": [1, 2, 3], "b": []}


def test_shard_handlers(spark):
    df = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 7).alias("value")).repartition(5)

    def total(rows):
        n = s = 0
        for r in rows:
            n, s = n + 1, s + r["value"]
        yield {"n": n, "s": s}

    parts = keyed.handle_shards(df, total, "n long, s long").collect()
    assert sum(r["n"] for r in parts) == 1000 and sum(r["s"] for r in parts) == sum(i % 7 for i in range(1000))
    some = keyed.handle_shards(df, total, "n long, s long", F.col("value") == 3).collect()
    assert sum(r["n"] for r in some) == sum(i % 7 == 3 for i in range(1000))


def test_strict_reads(spark):
    state = spark.createDataFrame([("a", 1)], "key string, value long")
    assert keyed.get(state, "a", strict=True).first()["value"] == 1 and keyed.get(state, "b").count() == 0
    with pytest.raises(Exception, match="no such key"):
        keyed.get(state, "b", strict=True).collect()


def test_increments(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.5, 0.5]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [tuple(r["x"]) for r in df.select(vectors.increment(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [(True, [1.5, 2.5]), (False, [1.0]), (False, None)]
    both = df.limit(1).select(vectors.from_ml(vectors.as_ml(F.col("a"))).alias("x")).first()
    assert both["x"] == [1.0, 2.0]


def test_line_and_chunk_handlers(spark):
    df = spark.createDataFrame([("a b",), (None,), ("c",), ("",)], "value string")
    found = text.handle_lines(df, lambda line: ({"word": w, "n": len(w)} for w in line.split()), "word string, n int").collect()
    assert sorted(tuple(r) for r in found) == [("a", 1), ("b", 1), ("c", 1)]
    sizes = text.handle_chunks(df.repartition(1), lambda lines: [{"n": len(lines)}], "n int", chunk=2).collect()
    assert sorted(r["n"] for r in sizes) == [1, 2]


def test_clean_pairs(spark):
    df = spark.createDataFrame([(x,) for x in ("a,b", "a,b", "a", "a,b,c", "a,", "b,a", "")], "value string")
    assert sorted(r["value"] for r in text.clean_pairs(df).collect()) == ["a,b", "b,a"]


def test_vocabulary(spark):
    df = spark.createDataFrame([("b a b",)], "t string")
    assert {r["word"]: r["index"] for r in words.vocabulary(words.word_counts(df, "t")).collect()} == {"a": 0, "b": 1}


# ---- graphs


def test_graph_changes_and_walks(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 2.0), (5, 6, 1.0), (6, 5, 1.0)], "src long, dst long, w double")
    new = spark.createDataFrame([(1, 2, 9.0), (3, 1, 4.0)], "src long, dst long, w double")
    grown = graph.add_edges(e, new)
    assert {(r["src"], r["dst"]): r["w"] for r in grown.collect()} == {(1, 2): 9.0, (2, 3): 1.0, (4, 5): 2.0, (5, 6): 1.0, (6, 5): 1.0, (3, 1): 4.0}
    assert {r["id"] for r in graph.reachable(e, 1).collect()} == {1, 2, 3} and {r["id"] for r in graph.reachable(e, 77).collect()} == set()
    assert {r["id"]: r["position"] for r in graph.topological_order(e).collect()} == {1: 0, 4: 1, 2: 2, 3: 3}
    assert {r["id"]: r["number"] for r in graph.component_numbers(graph.connected_components(e)).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1}
    assert {r[0] for r in graph.traverse(e, F.col("dst"), vertex=5).collect()} == {6} and graph.traverse(e, F.col("w")).count() == 5
    assert {r["src"]: r["value"] for r in graph.traverse_by_vertex(e, F.sum("w")).collect()} == {1: 1.0, 2: 1.0, 4: 2.0, 5: 1.0, 6: 1.0}


# ---- jobs


def lines_of(path):
    return sorted(line for p in path.glob("part-*") for line in p.read_text().splitlines())


@pytest.fixture
def job(spark, tmp_path):
    def go(name, inputs, **options):
        for key, content in inputs.items():
            (tmp_path / key).write_text("\n".join(content) + "\n")
            options[key] = str(tmp_path / key)
        options["output"] = str(tmp_path / "out")
        (tmp_path / "options.json").write_text(json.dumps(options))
        said = jobs.run(spark, name, str(tmp_path / "options.json"))
        return said, {p.name: lines_of(p) for p in tmp_path.glob("out*")}

    return go


def test_word_and_graph_jobs(job):
    _, out = job("word_count", {"input": ["a b a", "b a"]}, topk=1)
    assert out == {"out": ["a\t3"]}
    _, out = job("pagerank", {"input": ["a,b", "a,b", "b,a", "odd", "a,c"]}, rounds=2, damping_factor=0.5)
    assert [x.split("\t")[0] for x in out["out"]] == ["a", "b"] or len(out["out"]) == 3
    _, out = job("max_vertex_value", {"input": ["3,1", "1,2"]})
    assert out["out"] == ["1\t3", "2\t3", "3\t3"]


def test_cluster_and_similarity_jobs(job):
    points = {"input": [f"{i}\t{i % 2 * 10},{i}" for i in range(6)]}
    said, out = job("kmeans", points, kclusters=2, rounds=3)
    assert len(out["out"]) == 6 and len(said["centres"]) == 2
    _, out = job("similarity_dense", {"input": ["1,1,0", "2,1,0.1", "3,0,1"]}, topk=1, simbar=0.1)
    assert out["out"][0].startswith("1\t2:0.99")
    _, out = job("similarity_sparse", {"input": ["1,a,1", "2,a,1", "2,b,1", "3,b,2"]}, topk=2)
    assert out["out"][0] == "1\t2:0.707107" and len(out["out"]) == 3
    _, out = job("similarity_dense", {"input_a": ["1,1,0"], "input_b": ["7,1,0"]})
    assert out["out"] == ["1\t7:1.000000"]


def test_regression_jobs(job):
    rng = random.Random(1)
    rows = [",".join(map(str, (x := rng.gauss(0, 1), rng.gauss(0, 1), float(x > 0)))) for _ in range(40)]
    for method in ("dgd", "ipm", "downpour", "agd"):
        said, out = job("logistic_regression", {"training_input": rows, "test_input": rows[:5], "predict_input": ["0.5,0.1", "-3,0"]}, method=method, rounds=3, alpha=0.1, beta=0.001)
        assert len(out["out"][0].split("|")) == 3 and said["loss"] < math.log(2) and "test_loss" in said
        high, low = sorted(float(x.split("\t")[1]) for x in out["out_predict"])[::-1]
        assert high > 0.5 > low
    said, out = job("ridge", {"training_input": rows, "predict_input": ["1,1"]}, rounds=2)
    assert len(out["out_predict"]) == 1 and said["loss"] > 0
    for name in ("lasso", "logistic_l1"):
        _, out = job(name, {"input": rows}, **{"lambda": 0.1, "rounds": 8})
        assert len(out["out"][0].split("|")) == 2


def test_recommendation_jobs(job):
    ratings = [f"{u} {i} {1 + (u * i) % 5}" for u in range(1, 6) for i in range(1, 5)]
    said, out = job("matrix_factorisation", {"input": ratings, "predict_input": ["1,2", "9,9"]}, k=2, rounds=2, ssp_switch=True, limit_s=1)
    assert len(out["out_user"]) == 5 and len(out["out_item"]) == 4 and len(out["out_predict"]) == 2 and 0 < said["rmse"] < 3
    held = [f"{i}\t{i / 10}|1.0" for i in range(1, 5)]
    said, out = job("als", {"rating_input": ratings, "factor_input": held}, **{"lambda": 0.1})
    assert len(out["out"]) == 5 and said["rmse"] > 0
    said, _ = job("als_validate", {"rating_input": ratings[:10], "validate_input": ratings[10:], "factor_input": held}, lambdas=[0.1, 1])
    assert set(said) == {0.1, 1.0}
    said, out = job("adaptive_k", {"rating_input": ratings, "sim_input": ["1\t2:0.9|3:0.5", "2\t1:0.9"]}, **{"lower bound": 1})
    assert len(out["out"]) == 2 and set(said) == {"adjusted", "base"}
    _, out = job("decision_tree", {"user_fac_input": [f"{i}\t{math.sin(i):.3f}|{math.cos(i):.3f}" for i in range(30)], "item_fac_input": ["1\t1|0", "2\t0|1", "3\t1|1"]}, level=2, tree_start_index=0, tree_end_index=1)
    assert len(out["out_0"]) == 3 and len(out["out_1"]) == 3


def test_other_jobs(job):
    _, out = job("lda", {"input": ["a b a c", "d e d", "a c"]}, k_topics=2, iters=2, top_words=3)
    assert len(out["out_documents"]) == 3 and 1 <= len(out["out_topics"]) <= 2
    said, out = job("svd", {"input": ["1,3,0", "2,0,4"]}, k=2)
    assert said["values"] == pytest.approx([4, 3]) and len(out["out_u"]) == 2
    _, out = job("steady_state", {"mass_input": ["A 0.5", "B 0.5"], "edge_input": ["A\tB,0.7|A,0.3", "B\tA,0.5|B,0.5"]})
    assert len(out["out"]) == 2 and len(out["out_transfers"]) == 2
    with pytest.raises(KeyError, match="k_topics"):
        job("lda", {"input": ["a"]})
    assert len(jobs.JOBS) == 18
