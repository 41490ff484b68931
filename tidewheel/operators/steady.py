"""Scores under which a random walk's induced inflow meets a given steady state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import discard, store
from .similarity import top_per_key

EPSILON = 1e-4
ROUNDS, STEPS = 20, 100
TOGETHER = 6  #: steps that are planned together
TOP = 100


def expand(masses: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Masses (node, p) and edges (src, dst, w) with each node as a left and a right one: masses halved, right to left 1."""
    half = masses.select(F.explode(F.array(F.concat("node", F.lit("L")), F.concat("node", F.lit("R")))).alias("node"), (F.col("p") / 2).alias("p"))
    across = edges.select(F.concat("src", F.lit("L")).alias("src"), F.concat("dst", F.lit("R")).alias("dst"), "w")
    back = masses.select(F.concat("node", F.lit("R")).alias("src"), F.concat("node", F.lit("L")).alias("dst"), F.lit(1.0).alias("w"))
    return half, across.unionByName(back)


def _flows(edges: DataFrame, left: DataFrame, scores: DataFrame) -> DataFrame:
    """(i, j, p, a, flow, rest): p of i, weight, a times the score of j, and the other flows of i."""
    flow = edges.join(scores, "j").select("i", "j", "a", "x", (F.col("a") * F.col("x")).alias("flow"))
    total = flow.groupBy("i").agg(F.sum("flow").alias("total"))
    return flow.join(total, "i").join(left, "i").select("i", "j", "p", "a", "x", "flow", (F.col("total") - F.col("flow")).alias("rest"), "total")


def _newton(held: DataFrame, start: DataFrame, steps: int) -> tuple[DataFrame, str]:
    """(j, x) by Newton steps, and their table: each step is one aggregate over the edges of the nodes, TOGETHER of them between writes."""
    spark = held.sparkSession
    now, path = store(start.withColumn("done", F.lit(False)), "newton")
    at = F.col("a") * F.col("x") + F.col("rest")
    inflow = F.sum(F.try_divide(F.col("p") * F.col("a") * F.col("x"), at)) - F.max("aim")
    slope = F.sum(F.try_divide(F.col("p") * F.col("a") * F.col("rest"), at * at))
    for k in range(steps):
        both = held.join(now, "j").groupBy("j").agg(F.first("x").alias("x"), F.first("done").alias("done"), inflow.alias("f"), slope.alias("slope"))
        stop = F.col("done") | F.coalesce((F.abs("f") <= 1e-10) | (F.col("slope") == 0), F.lit(True))
        now = both.select("j", F.when(stop, F.col("x")).otherwise(F.col("x") - F.try_divide("f", "slope")).alias("x"), stop.alias("done"))
        if (k + 1) % TOGETHER == 0 or k + 1 == steps:
            now, after_path = store(now, "newton")
            discard(spark, path)
            path = after_path
            if now.where(~F.col("done")).isEmpty():
                break
    return now.select("j", "x"), path


def solve(left: DataFrame, right: DataFrame, edges: DataFrame, *, epsilon: float = EPSILON, rounds: int = ROUNDS, steps: int = STEPS) -> DataFrame:
    """(j, score) for masses (i, p) and (j, p) and edges (i, j, a).

    Scores begin at the masses.  Each round takes the nodes whose inflow is too
    small and moves each to the score that gives it enough, the others held, by
    Newton steps.
    """
    spark = edges.sparkSession
    edges, _ = store(edges, "edges")
    scores, path = store(right.select("j", F.col("p").alias("x")), "scores")
    for _ in range(rounds):
        flows, flows_path = store(_flows(edges, left, scores), "flows")
        inflow = flows.groupBy("j").agg(F.sum(F.try_divide(F.col("p") * F.col("flow"), F.col("total"))).alias("q"))
        short = inflow.join(right, "j").where((F.col("q") != 0) & (F.col("q") < F.col("p") * (1 - epsilon))).select("j", (F.col("p") * (1 - epsilon / 2)).alias("aim"))
        held, held_path = store(flows.join(short, "j").select("j", "p", "a", "rest", "aim"), "held")
        if held.isEmpty():
            discard(spark, flows_path, held_path)
            break
        now, now_path = _newton(held, scores.join(held.select("j"), "j", "left_semi"), steps)
        used = [held_path, now_path]
        after, after_path = store(scores.join(now.select("j", F.col("x").alias("new")), "j", "left").select("j", F.coalesce("new", "x").alias("x")), "scores")
        discard(spark, path, flows_path, *used)
        scores, path = after, after_path
    return scores.select("j", F.col("x").alias("score"))


def transfers(left: DataFrame, scores: DataFrame, edges: DataFrame, k: int = TOP) -> DataFrame:
    """(i, j, prob, rank): the k likeliest targets of each left node with mass."""
    flows = _flows(edges, left, scores.select("j", F.col("score").alias("x")))
    prob = flows.select("i", "j", F.try_divide("flow", "total").alias("prob")).where("prob > 0")
    return top_per_key(prob, "i", "prob", "j", k)
