"""Factor models: biased matrix factorisation, half-steps of alternating least squares, singular values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clip, dot
from ..plans.iterate import stale_rounds
from ..plans.tables import store
from .learning import gram

# ---- biased factorisation: users and items (id, factors, bias), ratings (user, item, rating)


def hashed_factors(ids: DataFrame, id_col: str, k: int, scale: float = 0.1, seed: int = 1) -> DataFrame:
    """(id, factors, bias): reproducible numbers below ``scale`` from hashes of the ids, bias 0."""
    unit = [F.pmod(F.xxhash64(id_col, F.lit(seed), F.lit(j)), F.lit(1_000_003)) / F.lit(1_000_003.0) * scale for j in range(k)]
    return ids.select(F.col(id_col).alias("id"), F.array(*unit).alias("factors"), F.lit(0.0).alias("bias"))


def _predicted(mean: float) -> Column:
    return clip(F.lit(mean) + F.col("user_bias") + F.col("item_bias") + dot(F.col("user_factors"), F.col("item_factors")), 1, 5)


def _with_factors(pairs: DataFrame, users: DataFrame, items: DataFrame, how: str) -> DataFrame:
    u = users.select(F.col("id").alias("user"), F.col("factors").alias("user_factors"), F.col("bias").alias("user_bias"))
    i = items.select(F.col("id").alias("item"), F.col("factors").alias("item_factors"), F.col("bias").alias("item_bias"))
    return pairs.join(u, "user", how).join(i, "item", how)


def predict(pairs: DataFrame, users: DataFrame, items: DataFrame, mean: float) -> DataFrame:
    """``pairs`` with a prediction between 1 and 5; the mean where user or item is unknown."""
    both = _with_factors(pairs, users, items, "left")
    known = F.col("user_factors").isNotNull() & F.col("item_factors").isNotNull()
    return both.select(*pairs.columns, F.when(known, _predicted(mean)).otherwise(F.lit(mean)).alias("prediction"))


def rmse(ratings: DataFrame, users: DataFrame, items: DataFrame, mean: float) -> DataFrame:
    """One row: n and the root mean square error."""
    e = F.col("rating") - F.col("prediction")
    return predict(ratings, users, items, mean).agg(F.count("*").alias("n"), F.sqrt(F.sum(e * e) / F.count("*")).alias("rmse"))


RATINGS = 200_000  #: ratings that one task descends over, about


def _dealt(ratings: DataFrame, shards: int, most: int) -> DataFrame:
    """``ratings`` with a shard: by user, in more shards where one would hold more than ``most``; such a user's by item as well."""
    shards = max(shards, math.ceil(ratings.count() / most))
    heavy, _ = store(ratings.groupBy("user").agg(F.count("*").alias("n")).where(F.col("n") > most).select("user", F.lit(True).alias("heavy")), "heavy")
    by_user, by_both = F.pmod("user", F.lit(shards)), F.pmod(F.xxhash64("user", "item"), F.lit(shards))
    marked = ratings.join(heavy, "user", "left")
    return store(marked.select("user", "item", "rating", F.when(F.col("heavy").isNull(), by_user).otherwise(by_both).alias("shard")), "dealt")[0]


def train(ratings: DataFrame, k: int, n: int = 1, alpha: float = 0.005, beta: float = 0.01, shards: int = 4, users: DataFrame | None = None, items: DataFrame | None = None, *, staleness: int = 0, shard_ratings: int = RATINGS) -> tuple[DataFrame, DataFrame, float]:
    """(users, items, mean) after n rounds.

    Each round every shard (user modulo ``shards``) descends over its ratings by
    user and item; a user's or item's change is the mean of the changes of the
    shards that hold it.  Factors are joined on, never sent whole to a task.
    ``staleness``: a round's changes come from the factors so many rounds before.
    """
    mean = ratings.agg(F.avg("rating")).first()[0] or 0.0
    ratings = _dealt(ratings.select("user", "item", "rating").where("user is not null and item is not null and rating is not null"), shards, shard_ratings)
    users = hashed_factors(ratings.select("user").distinct(), "user", k) if users is None else users
    items = hashed_factors(ratings.select("item").distinct(), "item", k, seed=2) if items is None else items

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["user", "item"])
        state = {}
        for side in ("user", "item"):
            for i, f, b in zip(pdf[side], pdf[f"{side}_factors"], pdf[f"{side}_bias"], strict=True):
                state.setdefault((side, i), [np.array(f, float), float(b)])
        begin = {key: (f.copy(), b) for key, (f, b) in state.items()}
        for u, i, r in zip(pdf["user"], pdf["item"], pdf["rating"], strict=True):
            x, y = state["user", u], state["item", i]
            e = r - min(5.0, max(1.0, mean + x[1] + y[1] + x[0] @ y[0]))
            w = x[0]
            x[0] = w + alpha * (2 * e * y[0] - beta * w)
            y[0] = y[0] + alpha * (2 * e * w - beta * y[0])
            x[1] += alpha * (2 * e - beta * x[1])
            y[1] += alpha * (2 * e - beta * y[1])
        out = [(side, i, list(f - begin[side, i][0]) + [b - begin[side, i][1]]) for (side, i), (f, b) in state.items()]
        return pd.DataFrame(out, columns=["side", "id", "moved"])

    def moved(old: DataFrame, changes: DataFrame, side: str) -> DataFrame:
        mean_change = changes.where(F.col("side") == side).select("id", F.posexplode("moved")).groupBy("id", "pos").agg(F.avg("col").alias("x"))
        change = mean_change.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("x"))
        new = F.zip_with("factors", F.slice("x", 1, k), lambda a, b: a + b)
        return old.join(change, "id", "left").select("id", F.when(F.col("x").isNull(), F.col("factors")).otherwise(new).alias("factors"), (F.col("bias") + F.coalesce(F.element_at("x", k + 1), F.lit(0.0))).alias("bias"))

    def pull(old: tuple[DataFrame, DataFrame]) -> DataFrame:
        joined = _with_factors(ratings, *old, "inner")
        return store(joined.groupBy("shard").applyInPandas(shard, "side string, id long, moved array<double>"), "changes")[0]

    def push(now: tuple[DataFrame, DataFrame], changes: DataFrame) -> tuple[DataFrame, DataFrame]:
        return store(moved(now[0], changes, "user"), "users")[0], store(moved(now[1], changes, "item"), "items")[0]

    return *stale_rounds((users, items), pull, push, n, staleness), mean


def generated_factors(rows: DataFrame) -> DataFrame:
    """(id, factors) with a constant factor of 1 put first, for models with a bias among the factors."""
    return rows.select("id", F.concat(F.array(F.lit(1.0)), F.col("factors").cast("array<double>")).alias("factors"))


def debias(ratings: DataFrame, item_bias: DataFrame, mean: float) -> DataFrame:
    """Ratings less mean and item bias; items without a bias, or with none but 0, go."""
    return ratings.join(item_bias.where("bias <> 0"), "item").select("user", "item", (F.col("rating") - mean - F.col("bias")).alias("rating"))


def split_by_last_digit(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training, validation): items whose id ends in 0, 1 or 2 are for validation."""
    held = F.substring(F.col("item").cast("string"), -1, 1).isin("0", "1", "2")
    return ratings.where(~held), ratings.where(held)


# ---- alternating least squares, one half


def als_half_step(ratings: DataFrame, factors: DataFrame, lambdas: list[float], k: int) -> DataFrame:
    """(user, lambda, factors): each user's least squares against fixed item factors (id, factors).

    The normal equations are sums, combined in the tasks, so a user with very many
    ratings costs no more than another; a rated item without factors is an error.
    """
    items = factors.select(F.col("id").alias("item"), F.col("factors").alias("h"))
    wrong = F.raise_error(F.concat(F.lit("no factors for item "), F.col("item").cast("string"))).cast("array<double>")
    both = ratings.join(items, "item", "left").select("user", "rating", F.coalesce("h", wrong).alias("h"))
    h = [F.get("h", F.lit(a)) for a in range(k)]
    cells = [F.sum(h[a] * h[b]) for a in range(k) for b in range(a, k)]
    sums = both.groupBy("user").agg(F.array(*cells).alias("hh"), F.array(*(F.sum(x * F.col("rating")) for x in h)).alias("hr"))
    upper = np.triu_indices(k)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            hh, hr = (batch.column(c).flatten().to_numpy().reshape(n, -1) for c in (1, 2))
            m = np.zeros((n, k, k))
            m[:, upper[0], upper[1]] = hh
            m[:, upper[1], upper[0]] = hh
            for lam in lambdas:
                w = np.linalg.solve(m + lam * np.eye(k), hr[:, :, None])[:, :, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, lam)), pa.array(w.tolist(), pa.list_(pa.float64()))], ["user", "lambda", "factors"])

    return sums.mapInArrow(run, "user long, lambda double, factors array<double>")


def als_errors(solved: DataFrame, ratings: DataFrame, factors: DataFrame) -> DataFrame:
    """(lambda, n, rmse) over the ratings of users and items that both have factors."""
    items = factors.select(F.col("id").alias("item"), F.col("factors").alias("h"))
    e = F.col("rating") - dot(F.col("factors"), F.col("h"))
    return ratings.join(items, "item").join(solved, "user").groupBy("lambda").agg(F.count("*").alias("n"), F.sqrt(F.sum(e * e) / F.count("*")).alias("rmse"))


def als_validate(ratings: DataFrame, validation: DataFrame, factors: DataFrame, lambdas: list[float], k: int) -> DataFrame:
    """(lambda, train_n, train_rmse, validation_n, validation_rmse) of every lambda in one pass."""
    solved, _ = store(als_half_step(ratings, factors, lambdas, k), "solved")
    parts = [als_errors(solved, r, factors).select("lambda", F.col("n").alias(f"{name}_n"), F.col("rmse").alias(f"{name}_rmse")) for name, r in (("train", ratings), ("validation", validation))]
    return parts[0].join(parts[1], "lambda", "left")


# ---- singular values


def singular_values(rows: DataFrame, k: int, *, vec: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """(values, right vectors as columns), the largest first, from the products of the columns."""
    xx, _, _ = gram(rows, vec=vec)
    values, vectors = np.linalg.eigh(xx)
    order = np.argsort(-values)[:k]
    return np.sqrt(np.maximum(values[order], 0)), vectors[:, order]


def left_vectors(rows: DataFrame, values: np.ndarray, right: np.ndarray, *, id_col: str = "id", vec: str = "features") -> DataFrame:
    """(id, u): rows times the right vectors, divided by the values; 0 where a value is."""
    scale = np.divide(right, values, out=np.zeros_like(right), where=values > 0)
    return project(rows, scale, id_col=id_col, vec=vec).withColumnRenamed("projected", "u")


def project(rows: DataFrame, matrix: np.ndarray, *, id_col: str = "id", vec: str = "features") -> DataFrame:
    """(id, projected): each row times a matrix that the driver holds."""
    sent = rows.sparkSession.sparkContext.broadcast(np.asarray(matrix, float))

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(sent.value)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((x @ sent.value).tolist(), pa.list_(pa.float64()))], ["id", "projected"])

    return rows.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("x")).mapInArrow(run, f"id {rows.schema[id_col].dataType.simpleString()}, projected array<double>")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of the product of two matrices given by their cells (i, j, v)."""
    right = b.select(F.col("i").alias("m"), F.col("j").alias("c"), F.col("v").alias("y"))
    return a.select("i", F.col("j").alias("m"), F.col("v").alias("x")).join(right, "m").groupBy("i", F.col("c").alias("j")).agg(F.sum(F.col("x") * F.col("y")).alias("v"))
