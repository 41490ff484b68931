"""Jobs: JSON options, a solver, and a dump of lines; ``python -m tidewheel.jobs NAME OPTIONS.json``."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import factors, graph, keyed, learning, similarity, steady, topics, trees, words
from .sources import dumps, text

JOBS = keyed.Registry()


def run(spark: SparkSession, name: str, path: str) -> dict:
    """Run a job with the options of a JSON file; what it says besides its dump."""
    return JOBS[name](spark, text.options(path, REQUIRED[name])) or {}


REQUIRED: dict[str, list[str]] = {}


def job(name: str, *required: str):
    def add(f):
        REQUIRED[name] = list(required)
        return JOBS.register(name)(f)

    return add


def _dump(df: DataFrame, line: Column, path: str) -> None:
    dumps.write_lines(df.select(line.alias("line")), "line", path)


def _edges(spark: SparkSession, path: str, separators: str = ", \t") -> DataFrame:
    """Edges of lines ``a,b`` or ``a,b,w``; other lines are an error."""
    return text.edges(text.lines(spark, path).select(text.tokens(F.col("value"), separators).alias("t")), "t")


def _vectors(spark: SparkSession, path: str, first: str = "\t", second: str = "|") -> DataFrame:
    v = text.dense_matrix(text.lines(spark, path).where("value <> ''"), first=first, second=second)
    return v.select(F.col("id").cast("long").alias("id"), "features")


def _ratings(spark: SparkSession, path: str) -> DataFrame:
    return text.ratings(text.lines(spark, path).where("value <> ''"))


def _supervised(spark: SparkSession, path: str) -> DataFrame:
    return text.supervised(text.lines(spark, path).where("value <> ''")).withColumn("id", F.monotonically_increasing_id())


def _weights_line(spark: SparkSession, theta, path: str) -> None:
    df = spark.createDataFrame([([float(x) for x in theta],)], "w array<double>")
    _dump(df, dumps.vector_line(F.col("w"), "|"), path)


@job("word_count", "input", "output")
def word_count(spark, o):
    found = words.word_count_topk(text.lines(spark, o["input"]), "value", o.get("topk", 10))
    _dump(found, dumps.pair_line(F.col("word"), F.col("n").cast("string")), o["output"])


@job("pagerank", "input", "output")
def pagerank(spark, o):
    e = text.edges(text.clean_pairs(text.lines(spark, o["input"])).select(text.tokens(F.col("value")).alias("t")), "t")
    ranks = graph.pagerank(graph.close_sinks(e, "sink"), o.get("rounds", 10), o.get("damping_factor", 0.85), "sink")
    _dump(ranks, dumps.pair_line(F.col("id"), dumps.fixed(F.col("rank"))), o["output"])


@job("max_vertex_value", "input", "output")
def max_vertex_value(spark, o):
    e = _edges(spark, o["input"]).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "w")
    _dump(graph.max_vertex_value(e), dumps.pair_line(F.col("id"), F.col("value").cast("string")), o["output"])


@job("kmeans", "input", "output", "kclusters")
def kmeans(spark, o):
    assigned, centres = learning.kmeans(_vectors(spark, o["input"], "\t", ","), o["kclusters"], o.get("rounds", 10))
    _dump(assigned, dumps.pair_line(F.col("id"), F.col("cluster").cast("string")), o["output"])
    return {"centres": centres.tolist()}


_METHODS = {"dgd": learning.logistic_gradient_descent, "ipm": learning.logistic_mixing, "downpour": learning.logistic_downpour, "agd": learning.logistic_sequential}


def _regression(spark, o, solve, loss, predict) -> dict:
    training = _supervised(spark, o["training_input"])
    theta = solve(training, o.get("rounds", 10), o.get("alpha", 0.002), o.get("beta", 0.1))
    _weights_line(spark, theta, o["output"])
    said = {"loss": loss(training, theta).first()[0]}
    if "test_input" in o:
        said["test_loss"] = loss(_supervised(spark, o["test_input"]), theta).first()[0]
    if "predict_input" in o:
        rows = text.lines(spark, o["predict_input"]).where("value <> ''").select(text.numbers(F.col("value")).alias("features"))
        found = rows.select("features", predict(F.col("features"), theta).alias("prediction"))
        _dump(found, F.concat_ws("\t", dumps.vector_line(F.col("features")), dumps.fixed(F.col("prediction"))), f"{o['output']}_predict")
    return said


@job("logistic_regression", "training_input", "output")
def logistic_regression(spark, o):
    return _regression(spark, o, _METHODS[o.get("method", "ipm")], learning.logistic_loss, lambda f, theta: learning.sigmoid(learning.linear(f, theta)))


@job("ridge", "training_input", "output")
def ridge(spark, o):
    return _regression(spark, o, learning.ridge_mixing, learning.squared_loss, learning.linear)


@job("matrix_factorisation", "input", "output", "k")
def matrix_factorisation(spark, o):
    ratings = _ratings(spark, o["input"])
    users, items, mean = factors.train(ratings, o["k"], o.get("rounds", 1), o.get("alpha", 0.005), o.get("beta", 0.01), staleness=o.get("limit_s", 0) if o.get("ssp_switch") else 0)
    for side, table in (("user", users), ("item", items)):
        _dump(table, dumps.list_line(F.col("id"), F.concat("factors", F.array("bias"))), f"{o['output']}_{side}")
    said = {"mean": mean, "rmse": factors.rmse(ratings, users, items, mean).first()["rmse"]}
    if "predict_input" in o:
        p = text.lines(spark, o["predict_input"]).where("value <> ''").select(text.tokens(F.col("value"), ", \t").alias("t"))
        pairs = p.select(F.col("t")[0].cast("long").alias("user"), F.col("t")[1].cast("long").alias("item"))
        _dump(factors.predict(pairs, users, items, mean), F.concat_ws(",", F.col("user").cast("string"), F.col("item").cast("string"), dumps.fixed(F.col("prediction"))), f"{o['output']}_predict")
    return said


def _factors(spark, path):
    return _vectors(spark, path).select("id", F.col("features").alias("factors"))


@job("als", "rating_input", "factor_input", "output", "lambda")
def als(spark, o):
    ratings, items = _ratings(spark, o["rating_input"]), _factors(spark, o["factor_input"])
    k = items.select(F.size("factors")).first()[0]
    solved = factors.als_half_step(ratings, items, [float(o["lambda"])], k)
    _dump(solved, dumps.list_line(F.col("user"), F.col("factors")), o["output"])
    return {"rmse": factors.als_errors(solved, ratings, items).first()["rmse"]}


@job("als_validate", "rating_input", "validate_input", "factor_input", "output", "lambdas")
def als_validate(spark, o):
    items = _factors(spark, o["factor_input"])
    k = items.select(F.size("factors")).first()[0]
    found = factors.als_validate(_ratings(spark, o["rating_input"]), _ratings(spark, o["validate_input"]), items, [float(x) for x in o["lambdas"]], k)
    _dump(found, dumps.list_line(F.col("lambda"), F.array("train_rmse", "validation_rmse")), o["output"])
    return {r["lambda"]: r["validation_rmse"] for r in found.collect()}


def _neighbours(found: DataFrame, path: str) -> None:
    listed = found.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("j").alias("id"), F.col("sim").alias("w")))).alias("n"))
    _dump(listed, dumps.weighted_list_line(F.col("i"), F.transform("n", lambda x: F.struct(x["id"].alias("id"), x["w"].alias("w")))), path)


@job("similarity_dense", "output")
def similarity_dense(spark, o):
    a, b = (_vectors(spark, o[k], ",", ",") for k in (("input", "input") if "input" in o else ("input_a", "input_b")))
    _neighbours(similarity.cosine_topk(a, b, o.get("topk", 20), o.get("simbar", 0.0)), o["output"])


@job("similarity_sparse", "input", "output")
def similarity_sparse(spark, o):
    e = _edges(spark, o["input"]).select(F.col("src").cast("long").alias("src"), "dst", "w")
    _neighbours(similarity.sparse_cosine_topk(e, o.get("topk", 20), o.get("sim_bar", 1e-12), o.get("sim_ubar", 1.0)), o["output"])


@job("adaptive_k", "rating_input", "sim_input", "output")
def adaptive_k(spark, o):
    sims = text.edges(text.lines(spark, o["sim_input"]).select(text.tokens(F.col("value"), "\t|").alias("t")), "t", mix=True)
    sims = sims.select(F.col("src").cast("long").alias("i"), F.col("dst").cast("long").alias("j"), F.col("w").alias("sim"))
    found = similarity.neighbourhood_sizes(_ratings(spark, o["rating_input"]), sims, o.get("lower bound", 1))
    _dump(found, dumps.pair_line(F.col("user"), F.col("size").cast("string")), o["output"])
    return found.agg(F.sum("residual").alias("adjusted"), F.sum("base_residual").alias("base")).first().asDict()


@job("decision_tree", "user_fac_input", "item_fac_input", "output", "level")
def decision_tree(spark, o):
    users, items = (_vectors(spark, o[k]).select("id", F.col("features").alias("v")) for k in ("user_fac_input", "item_fac_input"))
    for tree in range(o.get("tree_start_index", 0), o.get("tree_end_index", o.get("tree_start_index", 0)) + 1):
        built = trees.build(users, items, o["level"], tree)
        line = F.concat_ws("\t", F.col("node").cast("string"), F.coalesce(F.col("item").cast("string"), F.lit("-")), F.array_join(F.transform("mean", lambda x: dumps.fixed(x)), "|"))
        _dump(built, line, f"{o['output']}_{tree}")


@job("lda", "input", "output", "k_topics")
def lda(spark, o):
    k, alpha, beta = o["k_topics"], o.get("alpha", 0.1), o.get("beta", 0.01)
    docs = text.lines(spark, o["input"]).where("value <> ''").select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))
    state = topics.gibbs(docs, k, o.get("iters", 10), alpha, beta)
    found = topics.topic_words(state, beta, o.get("top_words", 20)).groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("word").alias("id"), F.col("phi").alias("w")))).alias("n"))
    _dump(found, dumps.weighted_list_line(F.col("topic"), F.transform("n", lambda x: F.struct(x["id"].alias("id"), x["w"].alias("w")))), f"{o['output']}_topics")
    theta = topics.document_topics(state, k, alpha).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(F.col("topic").alias("id"), F.col("theta").alias("w")))).alias("n"))
    _dump(theta, dumps.weighted_list_line(F.col("doc"), F.col("n")), f"{o['output']}_documents")


@job("svd", "input", "output", "k")
def svd(spark, o):
    rows = _vectors(spark, o["input"], ",", ",")
    values, right = factors.singular_values(rows, o["k"])
    _dump(factors.left_vectors(rows, values, right), dumps.list_line(F.col("id"), F.col("u")), f"{o['output']}_u")
    _weights_line(spark, values, f"{o['output']}_s")
    return {"values": values.tolist()}


@job("lasso", "input", "output", "lambda")
def lasso(spark, o):
    _weights_line(spark, learning.lasso(_supervised(spark, o["input"]), float(o["lambda"]), o.get("rounds", 100)), o["output"])


@job("logistic_l1", "input", "output", "lambda")
def logistic_l1(spark, o):
    _weights_line(spark, learning.logistic_l1(_supervised(spark, o["input"]), float(o["lambda"]), o.get("rounds", 100)), o["output"])


@job("steady_state", "mass_input", "edge_input", "output")
def steady_state(spark, o):
    p = text.lines(spark, o["mass_input"]).where("value <> ''").select(text.tokens(F.col("value"), ", \t").alias("t"))
    masses = p.select(F.col("t")[0].alias("node"), F.col("t")[1].cast("double").alias("p"))
    e = text.edges(text.lines(spark, o["edge_input"]).where("value <> ''").select(text.head_and_list(F.col("value")).alias("t")).select(F.transform("t", lambda x: F.replace(x, F.lit(","), F.lit(":"))).alias("t")), "t", mix=True)
    half, both = steady.expand(masses, e)
    left, right = (half.where(F.col("node").endswith(s)) for s in "LR")
    edges = both.where(F.col("dst").endswith("R")).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("a"))
    scores = steady.solve(left.withColumnRenamed("node", "i"), right.withColumnRenamed("node", "j"), edges)
    _dump(scores, dumps.pair_line(F.col("j"), dumps.fixed(F.col("score"))), o["output"])
    found = steady.transfers(left.withColumnRenamed("node", "i"), scores, edges, o.get("top", steady.TOP))
    _neighbours(found.withColumnRenamed("prob", "sim"), f"{o['output']}_transfers")


if __name__ == "__main__":
    session = SparkSession.builder.appName(sys.argv[1]).getOrCreate()
    print(run(session, sys.argv[1], sys.argv[2]))
    session.stop()
