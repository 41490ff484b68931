"""Iterative learners: k-means, logistic and ridge regression, lasso, and L1 logistic regression."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, log_loss, sigmoid


SHARD_ROWS = 50_000  #: rows that one task descends over at most


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of arrays that are not null; unequal widths are an error."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


# ---- k-means


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of equals.

    Products give the distances but for rounding; where two centres are within it,
    differences decide.
    """
    about = (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    best = about.min(axis=1)
    slack = 1e-9 * (1 + np.abs(best) + (x * x).sum(axis=1) + (centres * centres).sum(axis=1).max())
    close = about <= (best + slack)[:, None]
    out = close.argmax(axis=1)
    for r in np.flatnonzero(close.sum(axis=1) > 1).tolist():
        which = np.flatnonzero(close[r])
        out[r] = which[np.argmin(((x[r] - centres[which]) ** 2).sum(axis=1))]
    return out


def _assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    sent = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_nearest(_matrix(part.column(1)), sent.value), pa.int64())], ["id", "cluster"])

    return points.mapInArrow(run, f"id {points.schema[0].dataType.simpleString()}, cluster long")


def _centre_sums(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cluster, pos, total, n): one row for each task, centre and dimension before the shuffle."""
    sent = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        c = sent.value
        total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(1).slice(k, 4096))
                if len(x):
                    at = _nearest(x, c)
                    np.add.at(total, at, x)
                    n += np.bincount(at, minlength=len(c))
        k, d = c.shape
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), d)), pa.array(np.tile(np.arange(d), k)), pa.array(total.ravel()), pa.array(np.repeat(n, d))], ["cluster", "pos", "total", "n"])

    return points.mapInArrow(run, "cluster long, pos long, total double, n long").groupBy("cluster", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def kmeans(points: DataFrame, k: int, n: int = 1, *, id_col: str = "id", vec: str = "features") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster) of the last round, before its centres moved; the final centres).

    Lloyd's rounds from the k rows with the smallest ids; a centre without rows
    stays where it is; a row without a vector has no cluster.  Centres, k vectors,
    are all that the driver holds.
    """
    rows = points.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    centres = np.array([r["v"] for r in rows.orderBy("id").limit(k).collect()])
    if not len(centres):
        return rows.select("id", F.lit(0).cast("long").alias("cluster")), centres
    assigned = None
    for _ in range(n):
        assigned, new = _assigned(rows, centres), centres.copy()
        for r in _centre_sums(rows, centres).collect():
            if r["n"]:
                new[r["cluster"], r["pos"]] = r["total"] / r["n"]
        centres = new
    return assigned, centres


def members(assigned: DataFrame, parts: int = 64) -> DataFrame:
    """(cluster, part, ids): the rows of each cluster, a large one in several parts dealt by hash; ids in order."""
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    return assigned.groupBy("cluster", part.alias("part")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def radii(points: DataFrame, assigned: DataFrame, centres: np.ndarray, *, id_col: str = "id", vec: str = "features") -> DataFrame:
    """(cluster, n, radius): the largest distance of a row from its centre."""
    own = points.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).where("v is not null").join(assigned, "id")
    sent = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                away = np.sqrt(((_matrix(part.column(1)) - sent.value[part.column(0).to_numpy()]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(away)], ["cluster", "away"])

    return own.select("cluster", "v").mapInArrow(run, "cluster long, away double").groupBy("cluster").agg(F.count("*").alias("n"), F.max("away").alias("radius"))


# ---- regressions; weights begin with the intercept


def with_bias(features: Column) -> Column:
    return F.concat(F.array(F.lit(1.0)), features.cast("array<double>"))


def linear(features: Column, weights) -> Column:
    """Intercept and weights applied to the first features."""
    w = F.array(*(F.lit(float(x)) for x in weights[1:]))
    return F.lit(float(weights[0])) + dot(F.slice(features, 1, len(weights) - 1).cast("array<double>"), w)


def _whole(data: DataFrame, vec: str, label: str) -> DataFrame:
    """(x, y) of the rows that have both."""
    return data.select(F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")).where("x is not null and y is not null")


def _sums(rows: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, int]:
    """(sum over all rows (x, y) of what ``f`` makes of a batch of them, rows): one vector from each task."""

    def run(batches):
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                part = f(_matrix(batch.column(0)), batch.column(1).to_numpy())
                total, n = part if total is None else total + part, n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], ["pos", "v", "n"])

    parts = rows.mapInArrow(run, "pos long, v double, n long").groupBy("pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    out = np.zeros(len(parts))
    for r in parts:
        out[r["pos"]] = r["v"]
    return out, int(parts[0]["n"]) if parts else 0


def logistic_gradient_descent(data: DataFrame, n: int = 1, alpha: float = 0.002, beta: float = 0.1, start=None, *, vec: str = "features", label: str = "label") -> np.ndarray:
    """Full-batch rounds: weights += sum over rows of alpha (y - h) x - 2 alpha beta weights.

    A task sends one vector for each round; rows without features or label say nothing.
    """
    rows = _whole(data, vec, label)
    d = len(start) - 1 if start is not None else rows.agg(F.max(F.size("x"))).first()[0] or 0
    theta = np.zeros(d + 1) if start is None else np.array(start, float)
    for _ in range(n):

        def gradient(x: np.ndarray, y: np.ndarray, theta: np.ndarray = theta) -> np.ndarray:
            error = y - 1 / (1 + np.exp(-(theta[0] + x @ theta[1:])))
            return np.append(error.sum(), error @ x)

        total, count = _sums(rows, gradient)
        theta = theta + alpha * (total if count else 0) - 2 * alpha * beta * count * theta
    return theta


def _sequential(x: np.ndarray, y: np.ndarray, theta: np.ndarray, alpha: float, beta: float, logistic: bool) -> np.ndarray:
    for row, target in zip(x, y, strict=True):
        a = row @ theta
        theta = theta + alpha * (target - (1 / (1 + math.exp(-a)) if logistic else a)) * row - 2 * alpha * beta * theta
    return theta


def _shard(start: np.ndarray, alpha: float, beta: float, logistic: bool) -> Callable:
    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id").combine_chunks()
        moved = _sequential(_matrix(rows.column("x").combine_chunks()), rows.column("y").to_numpy(), start, alpha, beta, logistic) - start
        return pa.table({"pos": pa.array(np.arange(len(moved)), pa.int64()), "moved": pa.array(moved)})

    return one


def parameter_mixing(data: DataFrame, n: int, alpha: float, beta: float, shards: int, *, logistic: bool, start=None, batches: int = 1, mean: bool = True, id_col: str = "id", vec: str = "features", label: str = "label", shard_rows: int = SHARD_ROWS) -> np.ndarray:
    """Rounds of sequential descent on each shard, in the order of ids, whose changes are put together.

    ``mean``: the weights move by the mean of the shards' changes, else by their
    sum.  ``batches``: how often in a round the shards meet.  With one shard and
    batch this is plain stochastic descent.  Rows are dealt by id modulo ``shards``,
    then batches.  There are more batches than asked for where a shard would hold
    more than ``shard_rows`` rows of one: each takes its rows in bounded blocks and
    meets the others in between.
    """
    data = data.where(F.col(vec).isNotNull() & F.col(label).isNotNull())
    d, count = data.agg(F.max(F.size(vec)), F.count("*")).first()
    theta = np.zeros((d or 0) + 1) if start is None else np.array(start, float)
    batches = max(batches, math.ceil(count / (shards * shard_rows)))
    rows = data.select(F.pmod(F.col(id_col), F.lit(shards)).alias("shard"), F.pmod(F.floor(F.col(id_col) / shards), F.lit(batches)).alias("batch"), F.col(id_col).alias("id"), with_bias(F.col(vec)).alias("x"), F.col(label).cast("double").alias("y"))
    for _ in range(n):
        for b in range(batches):
            part = rows.where(F.col("batch") == b) if batches > 1 else rows
            changes = part.select("shard", "id", "x", "y").groupBy("shard").applyInArrow(_shard(theta, alpha, beta, logistic), "pos long, moved double").groupBy("pos").agg(F.sum("moved").alias("moved"), F.count("*").alias("n")).collect()
            theta = theta.copy()
            for r in changes:
                theta[r["pos"]] += r["moved"] / r["n"] if mean else r["moved"]
    return theta


def logistic_mixing(data: DataFrame, n: int = 1, alpha: float = 0.002, beta: float = 0.1, shards: int = 4, **more) -> np.ndarray:
    return parameter_mixing(data, n, alpha, beta, shards, logistic=True, **more)


def ridge_mixing(data: DataFrame, n: int = 1, alpha: float = 0.002, beta: float = 0.1, shards: int = 4, **more) -> np.ndarray:
    return parameter_mixing(data, n, alpha, beta, shards, logistic=False, **more)


def logistic_downpour(data: DataFrame, n: int = 1, alpha: float = 0.002, beta: float = 0.1, shards: int = 4, batches: int = 8, **more) -> np.ndarray:
    """Shards that push their changes often: several meetings in a round, changes summed; made deterministic."""
    return parameter_mixing(data, n, alpha, beta, shards, logistic=True, batches=batches, mean=False, **more)


def logistic_sequential(data: DataFrame, n: int = 1, alpha: float = 0.002, beta: float = 0.1, **more) -> np.ndarray:
    """Descent that pulls and pushes at every row, as one worker does it; block after block where there are many rows."""
    return parameter_mixing(data, n, alpha, beta, 1, logistic=True, **more)


def logistic_predictions(data: DataFrame, theta, *, vec: str = "features") -> DataFrame:
    return data.withColumn("prediction", sigmoid(linear(F.col(vec), theta)))


def logistic_loss(data: DataFrame, theta, *, vec: str = "features", label: str = "label") -> DataFrame:
    """One row: the mean log-loss."""
    return data.agg(F.avg(log_loss(F.col(label), sigmoid(linear(F.col(vec), theta)))).alias("loss"))


def squared_loss(data: DataFrame, theta, *, vec: str = "features", label: str = "label") -> DataFrame:
    """One row: the mean squared error."""
    return data.agg(F.avg(F.pow(linear(F.col(vec), theta) - F.col(label), 2)).alias("loss"))


def gram(data: DataFrame, *, vec: str = "features", label: str | None = None) -> tuple[np.ndarray, np.ndarray | None, int]:
    """(X'X, X'y, rows): one matrix of the width's square from each task; rows without a vector say nothing."""
    data = data.where(F.col(vec).isNotNull())
    d = data.agg(F.max(F.size(vec))).first()[0] or 0
    y = F.col(label).cast("double") if label else F.lit(0.0)

    def run(batches):
        total, n = np.zeros((d + 1, d + 1)), 0
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                both = np.column_stack([x, batch.column(1).to_numpy()])
                total += both.T @ both
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel()), pa.array(np.full(total.size, n))], ["pos", "v", "n"])

    parts = data.select(F.col(vec).cast("array<double>").alias("x"), y.alias("y")).mapInArrow(run, "pos long, v double, n long")
    rows = parts.groupBy("pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    total = np.zeros((d + 1) ** 2)
    for r in rows:
        total[r["pos"]] = r["v"]
    total = total.reshape(d + 1, d + 1)
    return total[:d, :d], total[:d, d] if label else None, int(rows[0]["n"] or 0) if rows else 0


def lasso(data: DataFrame, lam: float, n: int, *, vec: str = "features", label: str = "label") -> np.ndarray:
    """Coordinate descent over doubled, non-negative weights, coordinates in turn; w = w+ - w-.

    The data are read once, for their products; every step is then exact on the driver.
    """
    xx, xy, rows = gram(data, vec=vec, label=label)
    d = len(xy)
    w = np.zeros(2 * d)
    for t in range(n):
        j = t % (2 * d)
        sign, at = (1, j) if j < d else (-1, j - d)
        slope = sign * (xx[at] @ (w[:d] - w[d:]) - xy[at])
        w[j] += max(-w[j], -(lam + slope) / rows)
    return w[:d] - w[d:]


def logistic_l1(data: DataFrame, lam: float, n: int, *, vec: str = "features", label: str = "label") -> np.ndarray:
    """As :func:`lasso` for logistic loss with labels 0 and 1; a pass over the data for each step."""
    rows = _whole(data, vec, label)
    d, count = rows.agg(F.max(F.size("x")), F.count("*")).first()
    w = np.zeros(2 * (d or 0))
    for t in range(n if count else 0):
        j = t % (2 * d)
        sign, at = (1, j) if j < d else (-1, j - d)

        def slope(x: np.ndarray, y: np.ndarray, v: np.ndarray = w[:d] - w[d:], at: int = at) -> np.ndarray:
            y = np.where(y == 0, -1.0, 1.0)
            return np.array([(-y / (1 + np.exp(y * (x @ v))) * x[:, at]).sum()])

        w[j] += max(-w[j], -4 * (lam + sign * _sums(rows, slope)[0][0]) / count)
    return w[: len(w) // 2] - w[len(w) // 2 :]
