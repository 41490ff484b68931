"""Literal expectations and numpy results for the operators."""

import datetime
import json
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewheel.functions import strings, vectors
from tidewheel.operators import factors, graph, keyed, learning, similarity, steady, topics, trees
from tidewheel.plans import iterate
from tidewheel.sources import dumps, text

BIPARTITE = [("a", "A", 3.0), ("a", "B", 4.0), ("a", "D", 2.0), ("b", "C", 5.0), ("b", "D", 4.0), ("c", "D", 3.0), ("b", "E", 5.0), ("c", "E", 1.0), ("c", "F", 2.0), ("d", "C", 3.0), ("c", "G", 3.6)]
DIRECTED = [(0, 0, 3.0), (0, 2, 5.0), (1, 0, 4.0), (1, 1, 3.0), (1, 2, 1.0), (2, 0, 2.0), (2, 3, 1.0), (3, 1, 3.0), (3, 3, 1.0), (3, 4, 5.0)]
UNDIRECTED = [(0, 1), (0, 2), (0, 5), (0, 6), (3, 4), (3, 5), (4, 5), (4, 6), (9, 10), (9, 11), (9, 12), (11, 12)]


def edges(spark, rows, kind="long"):
    return spark.createDataFrame([(*r, 1.0)[:3] for r in rows], f"src {kind}, dst {kind}, w double")


def one(df):
    return df.first().asDict()


def as_dict(df):
    return {r[0]: r[1] if len(r) == 2 else tuple(r[1:]) for r in df.collect()}


# ---- graphs


def test_bipartite(spark):
    g = edges(spark, BIPARTITE, "string")
    assert one(graph.bipartite_stats(g)) == {"v": 4, "e": 11, "max_out": 4, "max_in": 3, "avg_out": 11 / 4}
    degree = as_dict(graph.degrees(g))
    assert degree["a"][0] == 3 and degree["E"][1] == 2 and degree["c"][0] == 4 and degree["D"][1] == 3


def test_directed(spark):
    g = edges(spark, DIRECTED)
    for e in (g, graph.reverse(g)):
        stats = one(graph.directed_stats(e))
        assert (stats["v"], stats["e"], stats["avg_degree"], stats["selfloops"]) == (5, 10, 2.0, 3)
    assert as_dict(graph.degrees(g))[0] == (2, 3)
    assert as_dict(graph.degrees(graph.reverse(g)))[0] == (3, 2)
    assert as_dict(graph.adjacency(g))[0] == {0: 3.0, 2: 5.0}
    assert {r["dst"] for r in graph.neighbours(g, 3).collect()} == {1, 3, 4}


def test_undirected(spark):
    g = edges(spark, UNDIRECTED)
    assert one(graph.undirected_stats(g)) == {"v": 11, "e": 12, "avg_degree": 24 / 11, "max_degree": 4, "selfloops": 0}
    assert as_dict(graph.connected_components(g)) == {i: 0 for i in range(7)} | {i: 9 for i in range(9, 13)}
    hops = as_dict(graph.bfs(graph.both_ways(g.select("src", "dst")), 0))
    assert {i: h[0] for i, h in hops.items()} == {0: 0, 1: 1, 2: 1, 5: 1, 6: 1, 3: 2, 4: 2, 9: None, 10: None, 11: None, 12: None}
    assert hops[3][1] == 5 and hops[4][1] == 5


def test_last_weight_wins(spark):
    df = spark.createDataFrame([(1, 2, 5.0, 1), (1, 2, 7.0, 2)], "src long, dst long, w double, n int")
    assert graph.last_weights(df, "n").first()["w"] == 7.0


def test_topological_levels(spark):
    g = edges(spark, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (3, 6)])
    assert as_dict(graph.topological_levels(g)) == {1: 0, 2: 1, 3: 2, 6: 3, 4: None, 5: None}


def test_pagerank_and_sinks(spark):
    g = graph.close_sinks(edges(spark, [(1, 2), (1, 2), (1, 3), (2, 3)]))
    assert {(r["src"], r["dst"]) for r in g.collect()} == {(1, 2), (1, 3), (2, 3), (3, graph.SINK)}
    rank = dict.fromkeys((1, 2, 3), 1 / 3)
    for _ in range(6):
        rank = {1: 0.15, 2: 0.15 + 0.85 * rank[1] / 2, 3: 0.15 + 0.85 * (rank[1] / 2 + rank[2])}
    assert as_dict(graph.pagerank(g, 6)) == pytest.approx(rank)


def test_max_vertex_value(spark):
    assert as_dict(graph.max_vertex_value(edges(spark, [(1, 2), (2, 3), (3, 1), (9, 3), (4, 9)]))) == {1: 9, 2: 9, 3: 9, 9: 9, 4: 4}


# ---- keyed state


def test_keyed_state(spark):
    state = spark.createDataFrame([("a", 2), ("b", 0), ("x", 100), ("y", 200)], "key string, value int")
    stale = spark.createDataFrame([("a", 20, 30)], "key string, value int, token long")
    assert as_dict(keyed.compare_and_set(state, stale))["a"] == 2
    seen = state.where("key = 'a'").select("key", F.lit(20).alias("value"), keyed.token(F.col("value")).alias("token"))
    state = keyed.compare_and_set(state, seen)
    assert as_dict(state)["a"] == 20
    state = keyed.fold(spark.createDataFrame([("a", 30)], "key string, value int"), F.sum, state=state)
    assert as_dict(state)["a"] == 50
    gone = spark.createDataFrame([("b",), ("c",)], "key string")
    assert set(as_dict(keyed.remove(state, gone))) == {"a", "x", "y"}
    assert {r["key"] for r in keyed.contains(gone, state).collect()} == {"b"}
    with pytest.raises(PySparkException):
        keyed.get_many(state, gone, strict=True).collect()
    assert [r["key"] for r in keyed.top(state, 2).collect()] == ["y", "x"]


def test_vector_fold(spark):
    df = spark.createDataFrame([("k", [1.0, 2.0, 3.0]), ("k", [3.0, 2.0, 1.0])], "key string, value array<double>")
    assert keyed.fold_vectors(df).first()["value"] == [4.0, 4.0, 4.0]


# ---- sources, formats, functions


def test_strings(spark):
    df = spark.createDataFrame([("hello|world||happy",)], "s string")
    words = ["hello", "world", "happy", "new", "year", "2015"]
    row = df.select(strings.split_any(F.col("s"), "|").alias("a"), strings.split_any(F.col("s"), "?|?").alias("b"), strings.join(F.array(*map(F.lit, words)), "orz").alias("j"), strings.split_regex(F.lit("aorzborzorzcorz"), "orz").alias("r")).first()
    assert row["a"] == row["b"] == ["hello", "world", "happy"]
    assert row["j"] == "helloorzworldorzhappyorzneworzyearorz2015" and row["r"] == ["a", "b", "", "c"]


@pytest.mark.parametrize(
    ("tokens", "mix", "want"),
    [
        (["a", "b"], True, [("a", "b", 1.0)]),
        (["a", "b:0.2"], False, [("a", "b", 0.2)]),
        (["a", "b", "0.5"], False, [("a", "b", 0.5)]),
        (["1", "2", "3"], True, [("1", "2", 1.0), ("1", "3", 1.0)]),
        (["a", "b:0.1", "c:0.2", "d:0.4"], True, [("a", "b", 0.1), ("a", "c", 0.2), ("a", "d", 0.4)]),
    ],
)
def test_line_shapes(spark, tokens, mix, want):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert [tuple(r) for r in text.edges(df, "t", mix=mix).collect()] == want


def test_line_shape_error(spark):
    with pytest.raises(PySparkException):
        text.edges(spark.createDataFrame([(["a", "b", "c", "d"],)], "t array<string>"), "t").collect()


def test_scan_is_independent_of_partitions(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"in/{k}").mkdir(parents=True)
        (tmp_path / f"in/{k}/part.txt").write_text("\n".join(f"1234567 {i % 10}" for i in range(k * 1000, k * 1000 + 1000)) + "\n\nlast\n")
    df = text.lines(spark, str(tmp_path / "in"))
    want = sorted(r["value"] for r in df.collect())
    assert len(want) == 3006
    for n in (1, 7, 33):
        assert sorted(r["value"] for r in df.repartition(n).collect()) == want


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([("id1\t1,2.5", "3,1,4.5", "7 8 d 4.0", "a\tx|y")], "v string, s string, r string, l string")
    assert tuple(text.dense_matrix(df.select("v"), "v", "\t", ",").first()) == ("id1", [1.0, 2.5])
    assert tuple(text.supervised(df, "s").first()) == ([3.0, 1.0], 4.5)
    assert tuple(text.ratings(df, "r", dated=True).first()) == (7, 8, 4.0)
    assert df.select(text.head_and_list(F.col("l"))).first()[0] == ["a", "x", "y"]
    head = spark.createDataFrame([(0, "5"), (1, "0,1,3"), (2, "0,2,4")], "n long, value string")
    n, e = text.edges_with_header(head, "n")
    assert n.first()[0] == 5 and e.count() == 2
    assert [r["n"] for r in text.tail(head, "n", 2).collect()] == [1, 2] and text.tail(head, "n", 9).count() == 3
    (tmp_path / "o.json").write_text(json.dumps({"hong": 7, "list": [1, 2]}))
    assert text.options(str(tmp_path / "o.json"), ["hong"])["hong"] == 7
    with pytest.raises(KeyError):
        text.options(str(tmp_path / "o.json"), ["nothing"])


def test_index_and_matrix(spark):
    cells = spark.createDataFrame([("r2", "c1", 1.0), ("r1", "c9", 2.0), ("r2", "c1", 3.0), ("r10", "c1", 5.0)], "src string, dst string, w double")
    m, rows, _ = text.sparse_matrix(cells)
    assert as_dict(rows) == {"r1": 0, "r10": 1, "r2": 2}
    assert {(r["i"], r["j"]): r["v"] for r in m.collect()} == {(2, 0): 4.0, (0, 1): 2.0, (1, 0): 5.0}


def test_generated(spark):
    for kind in ("classification", "regression", "vectors", "blobs", "documents"):
        assert text.generated(spark, kind, 20, 3).count() == 20


def test_dumps(spark, tmp_path):
    df = spark.createDataFrame([("k", 1.5, [1.0, 2.0], [(7, 0.25)])], "k string, x double, v array<double>, p array<struct<id:long,w:double>>")
    row = df.select(dumps.vector_line(F.col("v")), dumps.list_line(F.col("k"), F.col("v")), dumps.weighted_list_line(F.col("k"), F.col("p")), dumps.probability_line(F.col("k"), F.slice("v", 1, 0))).first()
    assert tuple(row) == ("1.000000,2.000000", "k\t1.000000|2.000000", "k\t7:0.250000", "k")
    dumps.write_lines(df, "k", str(tmp_path / "out"), merge=True)
    dumps.write_lines(df, "k", str(tmp_path / "out"), append=True)
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    dumps.write_table(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).first() == df.first()
    assert dumps.dated("out_", datetime.date(2015, 3, 7)) == "out_201537"
    assert dumps.fill_template("# no\nx=@x@", {"@x@": "1"}) == "x=1"


@pytest.mark.parametrize(("n", "turned", "want"), [(10, False, (2, 5)), (10, True, (5, 2)), (7, False, (7, 1)), (7, True, (7, 1)), (2, False, (2, 1)), (6, False, (2, 3)), (8, False, (2, 4))])
def test_grid(n, turned, want):
    assert iterate.grid(n, columns_first=turned) == want


def test_loops(spark):
    df = spark.createDataFrame([(1, 1.0)], "id long, x double")
    assert iterate.rounds(df, lambda s: s.withColumn("x", F.col("x") * 2), 9).first()["x"] == 512.0
    assert iterate.stale_rounds(1, lambda s: s, lambda now, read: now + read, 3, 0) == 8
    assert iterate.stale_rounds(1, lambda s: s, lambda now, read: now + read, 3, 1) == 5
    assert as_dict(iterate.all_sum_vectors(spark.createDataFrame([([1, 2, 3],), ([3, 2, 1],)], "v array<long>"), "v")) == {0: 4, 1: 4, 2: 4}
    for pattern in ("fmap", "smap", "fsmap", "fvec"):
        assert iterate.exchange(edges(spark, DIRECTED), 3, pattern).count() == 10


def test_fold_stream(spark, tmp_path):
    from tidewheel.streaming import folds

    spark.range(100).select((F.col("id") % 3).alias("key"), F.col("id").alias("value")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, value long").parquet(str(tmp_path / "in"))
    q = folds.start(folds.fold_stream(stream, F.sum), "folded", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert as_dict(spark.table("folded")) == {k: sum(range(k, 100, 3)) for k in range(3)}


# ---- similarity


POINTS = {k: v for k, v in enumerate([(i * 0.7 % 5, i * 1.3 % 7) for i in range(24)])}


def test_inner_product_topk(spark):
    df = spark.createDataFrame([(k, list(v)) for k, v in POINTS.items()], "id long, features array<double>")
    want = sorted(((round(v[0] + 2 * v[1], 9), -k) for k, v in POINTS.items()), reverse=True)[:7]
    assert [(r["score"], -r["id"]) for r in similarity.inner_product_topk(df, [1, 2], 7).collect()] == want
    black = spark.createDataFrame([(-want[0][1],)], "id long")
    assert similarity.inner_product_topk(df, [1, 2], 7, black=black, white=black.limit(0)).first()["id"] == -want[1][1]


@pytest.mark.parametrize("chunk", [1024, 16])
def test_similar(spark, chunk):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    sims = unit @ unit.T
    got = {(r["i"], r["j"]) for r in similarity.similar(df, df, id_col="id", vec="features", least=0.5, chunk=chunk).collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if i != j and sims[i, j] >= 0.5}
    top = similarity.cosine_topk(df, df, 3, 0.1)
    for i in (0, 31):
        want = sorted((-round(sims[i, j], 9), j) for j in range(60) if j != i and sims[i, j] >= 0.1)[:3]
        assert [r["j"] for r in top.where(F.col("i") == i).orderBy("rank").collect()] == [j for _, j in want]


def test_sparse_cosine(spark):
    rng = random.Random(2)
    rows = [(i, j, float(rng.randrange(1, 5))) for i in range(12) for j in range(9) if rng.random() < 0.4]
    m = np.zeros((12, 9))
    for i, j, w in rows:
        m[i, j] = w
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame(rows, "src long, dst long, w double")
    for least in (0.2, 0.0):
        got = {(r["i"], r["j"]): r["sim"] for r in similarity.sparse_cosine_topk(df, 100, least, 1.1).collect()}
        want = {(i, j): m[i] @ m[j] for i in range(12) for j in range(12) if i != j and m[i] @ m[j] >= least}
        assert got == pytest.approx(want, abs=1e-8)


def brute_sizes(ratings, sims, low):
    out = {}
    for u, near in sims.items():
        near = sorted(near, key=lambda x: (-x[1], x[0]))
        top, num, den, residuals = {}, {}, {}, []
        for rank in range(low, len(near) + 1):
            v, s = near[rank - 1]
            for i in ratings.get(u, {}):
                if i in ratings.get(v, {}):
                    num[i] = num.get(i, 0) + ratings[v][i] * s
                    den[i] = den.get(i, 0) + s
            residuals.append((rank, round(sum((a - num[i] / den[i]) ** 2 for i, a in ratings.get(u, {}).items() if den.get(i)), 9)))
        best = None
        for rank, r in residuals:
            if best is None and r == 0:
                continue
            if best is None or r < best[1]:
                best = (rank, r)
        out[u] = (best[0] if best else len(near), pytest.approx(best[1] if best else 0.0, abs=1e-8), pytest.approx(residuals[-1][1] if residuals else 0.0, abs=1e-8))
    return out


@pytest.mark.parametrize("low", [1, 2, 4])
def test_neighbourhood_sizes(spark, low):
    rng = random.Random(low)
    ratings = {u: {i: float(rng.randrange(1, 6)) for i in range(8) if rng.random() < 0.5} for u in range(10)}
    sims = {u: [(v, round(rng.random(), 3)) for v in rng.sample([x for x in range(10) if x != u], rng.randrange(1, 6))] for u in range(10)}
    r = spark.createDataFrame([(u, i, x) for u, own in ratings.items() for i, x in own.items()], "user long, item long, rating double")
    s = spark.createDataFrame([(u, v, x) for u, near in sims.items() for v, x in near], "i long, j long, sim double")
    assert as_dict(similarity.neighbourhood_sizes(r, s, low)) == brute_sizes(ratings, sims, low)


# ---- learners


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.3 > 0).astype(float)
    return x, y, spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, label double")


def squash(a):
    return 1 / (1 + np.exp(-a))


def test_gradient_descent(labelled):
    x, y, df = labelled
    b = np.column_stack([np.ones(len(x)), x])
    theta = np.zeros(4)
    for _ in range(3):
        theta = theta + 0.002 * b.T @ (y - squash(b @ theta)) - 2 * 0.002 * 0.1 * len(x) * theta
    assert learning.logistic_gradient_descent(df, 3) == pytest.approx(theta)


@pytest.mark.parametrize(("logistic", "batches", "mean", "shards"), [(True, 1, True, 4), (False, 1, True, 3), (True, 4, False, 2), (True, 1, True, 1)])
def test_mixing(labelled, logistic, batches, mean, shards):
    x, y, df = labelled
    b, theta = np.column_stack([np.ones(len(x)), x]), np.zeros(4)
    f = squash if logistic else (lambda a: a)
    for _ in range(2):
        for k in range(batches):
            moved = []
            for s in range(shards):
                t = theta.copy()
                for i in range(s, len(x), shards):
                    if (i // shards) % batches == k:
                        t = t + 0.01 * (y[i] - f(b[i] @ t)) * b[i] - 2 * 0.01 * 0.1 * t
                moved.append(t - theta)
            theta = theta + (np.mean(moved, axis=0) if mean else np.sum(moved, axis=0))
    got = learning.parameter_mixing(df.repartition(5), 2, 0.01, 0.1, shards, logistic=logistic, batches=batches, mean=mean)
    assert got == pytest.approx(theta)


def test_lasso_and_l1(labelled):
    x, y, df = labelled
    w, v = np.zeros(6), np.zeros(6)
    both, z = np.column_stack([x, -x]), np.where(y == 0, -1.0, 1.0)
    for t in range(60):
        j = t % 6
        w[j] += max(-w[j], -(0.5 + (both @ w - y) @ both[:, j]) / len(x))
    for t in range(12):
        j = t % 6
        v[j] += max(-v[j], -4 * (0.5 + (-z / (1 + np.exp(z * (both @ v)))) @ both[:, j]) / len(x))
    assert learning.lasso(df, 0.5, 60) == pytest.approx(w[:3] - w[3:])
    assert learning.logistic_l1(df, 0.5, 12) == pytest.approx(v[:3] - v[3:])


def test_losses(labelled):
    x, y, df = labelled
    theta = np.array([0.1, 0.2, -0.3, 0.4])
    h = squash(np.column_stack([np.ones(len(x)), x]) @ theta)
    assert learning.logistic_loss(df, theta).first()[0] == pytest.approx(float(-np.mean(y * np.log(h) + (1 - y) * np.log(1 - h))))
    assert [r["prediction"] for r in learning.logistic_predictions(df, theta).orderBy("id").collect()] == pytest.approx(h)


def test_kmeans(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 2)) + np.repeat([[0, 0], [9, 9], [0, 9]], 30, axis=0)
    x[1] = x[0]  # the second centre gets no row: ties go to the first
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(3)
    centres = x[:4].copy()
    for _ in range(3):
        at = np.argmin(((x[:, None] - centres[None]) ** 2).sum(axis=2), axis=1)
        centres = np.array([x[at == c].mean(axis=0) if (at == c).any() else centres[c] for c in range(4)])
    assigned, got = learning.kmeans(df, 4, 3)
    assert got == pytest.approx(centres)
    assert as_dict(assigned) == dict(enumerate(at.tolist()))


# ---- factors


def test_als(spark):
    rng = np.random.default_rng(9)
    h = {i: rng.normal(size=3) for i in range(6)}
    r = [(u, i, float(rng.normal())) for u in range(5) for i in range(6) if (u + i) % 3]
    ratings = spark.createDataFrame(r, "user long, item long, rating double")
    fac = spark.createDataFrame([(i, v.tolist()) for i, v in h.items()], "id long, factors array<double>")
    got = {(x["user"], x["lambda"]): x["factors"] for x in factors.als_half_step(ratings, fac, [0.1, 2.0], 3).collect()}
    for u in range(5):
        a, b = np.array([h[i] for v, i, _ in r if v == u]), np.array([x for v, _, x in r if v == u])
        for lam in (0.1, 2.0):
            assert got[u, lam] == pytest.approx(np.linalg.solve(a.T @ a + lam * np.eye(3), a.T @ b))
    with pytest.raises(PySparkException):
        factors.als_half_step(ratings, fac.where("id > 0"), [0.1], 3).collect()


def test_factorisation(spark):
    rng = random.Random(3)
    r = [(u, i, float(rng.randrange(1, 6))) for u in range(6) for i in range(5) if rng.random() < 0.7]
    ratings = spark.createDataFrame(r, "user long, item long, rating double")
    users, items, mean = factors.train(ratings, 2, 1, shards=2)
    start = {("user", x["id"]): x for x in factors.hashed_factors(ratings.select("user").distinct(), "user", 2).collect()} | {("item", x["id"]): x for x in factors.hashed_factors(ratings.select("item").distinct(), "item", 2, seed=2).collect()}
    changes = {}
    for s in range(2):
        state = {k: [np.array(x["factors"]), x["bias"]] for k, x in start.items()}
        held = set()
        for u, i, x in sorted(r):
            if u % 2 != s:
                continue
            a, b = state["user", u], state["item", i]
            held |= {("user", u), ("item", i)}
            e = x - min(5, max(1, mean + a[1] + b[1] + a[0] @ b[0]))
            old = a[0]
            a[0] = old + 0.005 * (2 * e * b[0] - 0.01 * old)
            b[0] = b[0] + 0.005 * (2 * e * old - 0.01 * b[0])
            a[1] += 0.005 * (2 * e - 0.01 * a[1])
            b[1] += 0.005 * (2 * e - 0.01 * b[1])
        for k in held:
            changes.setdefault(k, []).append(np.append(state[k][0] - start[k]["factors"], state[k][1] - start[k]["bias"]))
    for side, df in (("user", users), ("item", items)):
        for x in df.collect():
            want = np.append(start[side, x["id"]]["factors"], 0.0) + np.mean(changes[side, x["id"]], axis=0)
            assert [*x["factors"], x["bias"]] == pytest.approx(want)
    pairs = spark.createDataFrame([(0, 0), (99, 0)], "user long, item long")
    assert as_dict(factors.predict(pairs, users, items, mean).select("user", "prediction"))[99] == mean
    assert factors.rmse(ratings, users, items, mean).first()["n"] == len(r)


def test_singular_values(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    values, right = factors.singular_values(df, 4)
    assert values == pytest.approx(np.linalg.svd(x)[1][:4])
    u = np.array([r["u"] for r in factors.left_vectors(df, values, right).orderBy("id").collect()])
    assert u.T @ u == pytest.approx(np.eye(4), abs=1e-8)


def test_matrix_product(spark):
    a = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0)], "i long, j long, v double")
    b = spark.createDataFrame([(0, 0, 1.0), (1, 0, 4.0), (1, 1, 5.0)], "i long, j long, v double")
    assert {(r["i"], r["j"]): r["v"] for r in factors.multiply(a, b).collect()} == {(0, 0): 8.0, (0, 1): 10.0, (1, 0): 3.0}


# ---- trees, topics, steady state


def brute_splits(users, items):
    out = {}
    for i, v in items.items():
        like = {u for u, x in users.items() if np.dot(v, x) >= 0}
        hate = set(users) - like
        if not like or not hate or len(like) // len(hate) >= 3 or len(hate) // len(like) >= 3:
            continue
        out[i] = sum(((np.array([users[u] for u in s]) - np.mean([users[u] for u in s], axis=0)) ** 2).sum() for s in (like, hate))
    return out


def test_tree(spark):
    rng = np.random.default_rng(6)
    users, items = {i: rng.normal(size=3) for i in range(60)}, {i: rng.normal(size=3) for i in range(12)}
    table = lambda d: spark.createDataFrame([(i, v.tolist()) for i, v in d.items()], "id long, v array<double>")
    errors = {r["item"]: r["error"] for r in trees.split_errors(table(users).withColumn("node", F.lit(1)), table(items)).collect()}
    assert errors == pytest.approx(brute_splits(users, items))
    for tree in (0, 1):
        nodes = {1: set(users)}
        used, want = [], {}
        for node in range(1, 8):
            mine = {u: users[u] for u in nodes.get(node, ())}
            ranked = sorted((round(e, 9), i) for i, e in brute_splits(mine, items).items() if i not in used) if mine else []
            at = tree if node == 1 else 0
            want[node] = (ranked[at][1] if len(ranked) > at else None, len(mine))
            if want[node][0] is not None:
                used.append(want[node][0])
                like = {u for u, x in mine.items() if np.dot(items[want[node][0]], x) >= 0}
                nodes[2 * node], nodes[2 * node + 1] = like, set(mine) - like
        got = {r["node"]: (r["item"], r["n_users"]) for r in trees.build(table(users), table(items), 3, tree).collect()}
        assert got == want


def test_topics(spark):
    docs = spark.createDataFrame([(i, " ".join((["sun", "moon", "star"] if i % 2 else ["pig", "cow", "hen"])[j % 3] for j in range(30))) for i in range(20)], "doc_id long, text string")
    state = topics.gibbs(docs, 2, 15)
    assert state.count() == 600 and state.where("topic < 0 or topic > 1").count() == 0
    assert {r["topic"]: sorted(x["word"] for x in topics.topic_words(state, 0.01, 3).where(F.col("topic") == r["topic"]).collect()) for r in state.select("topic").distinct().collect()} in (
        {0: ["cow", "hen", "pig"], 1: ["moon", "star", "sun"]},
        {1: ["cow", "hen", "pig"], 0: ["moon", "star", "sun"]},
    )
    theta = topics.document_topics(state, 2, 0.1).groupBy("doc").agg(F.sum("theta").alias("s"), F.count("*").alias("n")).collect()
    assert all(0.9 < r["s"] <= 1.0000001 for r in theta)


def test_steady_state(spark):
    masses = spark.createDataFrame([("A", 0.3333), ("B", 0.25), ("C", 0.25), ("D", 0.16666)], "node string, p double")
    links = spark.createDataFrame([("A", "B", 0.7), ("A", "C", 0.6), ("B", "A", 0.5), ("B", "C", 0.4), ("C", "D", 0.4), ("D", "A", 0.9)], "src string, dst string, w double")
    half, across = steady.expand(masses, links)
    assert half.count() == 8 and across.count() == 10
    forward = across.where("src like '%L'").toDF("i", "j", "a")
    left, right = half.where("node like '%L'").toDF("i", "p"), half.where("node like '%R'").toDF("j", "p")
    p, aim = as_dict(left), as_dict(right)
    a = {(r["i"], r["j"]): r["a"] for r in forward.collect()}
    want = dict(aim)
    for _ in range(3):
        total = {i: sum(w * want[j] for (x, j), w in a.items() if x == i) for i in p}
        moved = {}
        for j in aim:
            mine = [(p[i], w, total[i] - w * want[j]) for (i, x), w in a.items() if x == j]
            q = sum(m * w * want[j] / (w * want[j] + rest) for m, w, rest in mine)
            if q and q < aim[j] * (1 - 1e-4):
                x = want[j]
                for _ in range(100):
                    f = sum(m * w * x / (w * x + rest) for m, w, rest in mine) - aim[j] * (1 - 5e-5)
                    slope = sum(m * w * rest / (w * x + rest) ** 2 for m, w, rest in mine)
                    if abs(f) <= 1e-10 or not slope:
                        break
                    x -= f / slope
                moved[j] = x
        if not moved:
            break
        want |= moved
    assert as_dict(steady.solve(left, right, forward, rounds=3)) == pytest.approx(want)
    probs = steady.transfers(left, steady.solve(left, right, forward, rounds=1), forward).groupBy("i").agg(F.sum("prob")).collect()
    assert all(r[1] == pytest.approx(1) for r in probs)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0], [1.0])], "a array<double>, b array<double>, c array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(vectors.dot(a, b), vectors.dot(a, F.col("c")), vectors.norm(a), vectors.distance(a, b), vectors.inner_product_bound(a, b, F.lit(2.0)), vectors.add(a, F.col("c")), vectors.unit(a)).first()
    assert tuple(row) == (11.0, None, 5.0, pytest.approx(8**0.5), 21.0, [4.0, 4.0], [0.6, 0.8])
