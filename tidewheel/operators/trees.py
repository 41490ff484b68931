"""Decision trees over items that split users by the sign of their inner product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import store

ITEMS = 20_000  #: items that are sent to the tasks at once; more take several passes
HELD = 1 << 22  #: numbers that a task sums up before it sends them on
RATIO = 3


def _side_sums(users: DataFrame, rows: list, d: int, block: int) -> DataFrame:
    """(node, item, side, sums): count, squared length and sum of the users on each side of each item, in partial sums."""
    sent = users.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], float)))

    def run(batches):
        ids, m = sent.value
        total = {}

        def emptied():
            for (n, k, side), part in total.items():
                size = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, n)), pa.array(ids[k : k + size]), pa.array(np.full(size, side)), pa.array(part.tolist(), pa.list_(pa.float64()))], ["node", "item", "side", "sums"])
            total.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(node), -1)
            for n in np.unique(node):
                mine = x[node == n]
                square = (mine * mine).sum(axis=1)
                for k in range(0, len(ids), block):
                    like = (mine @ m[k : k + block].T >= 0).T.astype(float)
                    for side, mask in ((1, like), (0, 1 - like)):
                        part = np.column_stack([mask.sum(axis=1), mask @ square, mask @ mine])
                        key = (n, k, side)
                        total[key] = total[key] + part if key in total else part
                if len(total) * block * (d + 2) > HELD:
                    yield from emptied()
        yield from emptied()

    return users.select(F.col("node").cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, "node long, item long, side long, sums array<double>")


def split_errors(users: DataFrame, items: DataFrame, *, block: int = 256) -> DataFrame:
    """(node, item, likes, hates, error) of every admissible split.

    users (id, node, v), items (id, v).  error: the squared distances of both sides'
    users to their sides' means.  A split is admissible if neither side is empty and
    neither is three times the other, in whole numbers.
    Tasks send sums of sides, not users; items go to them in groups of bounded size.
    Rows without a vector say nothing.
    """
    users, items = users.where("v is not null"), items.where("v is not null")
    d, count = items.agg(F.max(F.size("v")), F.count("*")).first()
    if not count:
        return users.sparkSession.createDataFrame([], "node long, item long, likes long, hates long, error double")
    groups, parts = -(-count // ITEMS), None
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).select("id", "v").orderBy("id").collect()
        if rows:
            sums = _side_sums(users, rows, d, block)
            parts = sums if parts is None else parts.unionByName(sums)
    sides = parts.groupBy("node", "item", "side").agg(*(F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(d + 2)))
    spread = F.col("s1") - sum((F.col(f"s{j}") * F.col(f"s{j}") for j in range(2, d + 2)), F.lit(0.0)) / F.col("s0")
    by = sides.where("s0 > 0").withColumn("e", spread)
    pairs = by.groupBy("node", "item").agg(
        F.sum(F.when(F.col("side") == 1, F.col("s0")).otherwise(0.0)).cast("long").alias("likes"),
        F.sum(F.when(F.col("side") == 0, F.col("s0")).otherwise(0.0)).cast("long").alias("hates"),
        F.sum("e").alias("error"),
    )
    few = F.least("likes", "hates")
    return pairs.where((few > 0) & (F.floor(F.try_divide(F.greatest("likes", "hates"), few)) < RATIO))


def build(users: DataFrame, items: DataFrame, levels: int, tree: int = 0) -> DataFrame:
    """(node, item, n_users, mean) in heap order from node 1.

    users, items: (id, v).  The root's item is the (tree+1)-th best, every other
    node's the best one not used before it; a node that can't be split has a null
    item, and one without users a mean of zeros.
    """
    spark = users.sparkSession
    d = users.select(F.size("v")).first()[0]
    state, _ = store(users.select("id", F.lit(1).cast("long").alias("node"), F.col("v").cast("array<double>").alias("v")), "nodes")
    used, out = [], []
    for level in range(levels):
        first, last = 1 << level, 2 << level
        live = state.where(F.col("node").between(first, last - 1))
        means = {r["node"]: (r["n"], [r[f"m{j}"] for j in range(d)]) for r in live.groupBy("node").agg(F.count("*").alias("n"), *(F.avg(F.get("v", F.lit(j))).alias(f"m{j}") for j in range(d))).collect()}
        # of each node as many candidates as the nodes before it may take
        need = len(used) + (last - first) + tree + 1
        best = {}
        from .similarity import top_per_key

        candidates = split_errors(live, items).withColumn("gain", -F.round("error", 9))
        for r in top_per_key(candidates, "node", "gain", "item", need).orderBy("node", "rank").collect():
            best.setdefault(r["node"], []).append(r["item"])
        chosen = {}
        for node in range(first, last):
            free = [i for i in best.get(node, []) if i not in used]
            at = tree if node == 1 else 0
            item = free[at] if len(free) > at else None
            if item is not None:
                used.append(item)
                chosen[node] = item
            n, mean = means.get(node, (0, [0.0] * d))
            out.append((node, item, n, mean))
        if level == levels - 1 or not chosen:
            continue
        picks = spark.createDataFrame(list(chosen.items()), "node long, item long").join(items.select(F.col("id").alias("item"), F.col("v").alias("iv")), "item")
        like = F.aggregate(F.zip_with("v", F.col("iv").cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x) >= 0
        moved = live.join(F.broadcast(picks), "node").select("id", (F.col("node") * 2 + F.when(like, 0).otherwise(1)).alias("node"), "v")
        state, _ = store(moved, "nodes")
    have = {r[0] for r in out}
    out += [(node, None, 0, [0.0] * d) for node in range(1, 1 << levels) if node not in have]
    return spark.createDataFrame(sorted(out), "node long, item long, n_users long, mean array<double>")
