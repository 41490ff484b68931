"""Vector and scalar mathematics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda t, x: t + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x))


def distance(a: Column, b: Column) -> Column:
    """Euclidean."""
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def unit(a: Column) -> Column:
    """``a`` at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))


def inner_product_bound(query: Column, centre: Column, radius: Column) -> Column:
    """No vector within ``radius`` of ``centre`` has a larger inner product with ``query``."""
    return dot(query, centre) + norm(query) * radius


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic_slope(y: Column, a: Column) -> Column:
    """Derivative of log(1 + exp(-y a)) by a."""
    return -y / (1 + F.exp(y * a))


def log_loss(y: Column, h: Column) -> Column:
    """One example's loss; anything but exactly 1 is the other class."""
    return F.when(y == 1, -F.log(h)).otherwise(-F.log(1 - h))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def rmse(error: Column) -> Column:
    """An aggregate: the root of the mean square."""
    return F.sqrt(F.sum(error * error) / F.count(error))


def add(a: Column, b: Column) -> Column:
    """Element by element, over the length of ``a``."""
    return F.transform(a, lambda x, i: x + F.coalesce(F.get(b, i), F.lit(0.0)))


def increment(old: Column, delta: Column) -> Column:
    """(ok, value): the element-wise sum; not ok, and ``old`` as it is, where it is absent or of another size."""
    ok = F.coalesce(F.size(old) == F.size(delta), F.lit(False)) & old.isNotNull() & delta.isNotNull()
    return F.struct(ok.alias("ok"), F.when(ok, F.zip_with(old, delta, lambda x, y: x + y)).otherwise(old).alias("value"))


def as_ml(v: Column) -> Column:
    """An array as a dense vector of Spark's learning library."""
    from pyspark.ml.functions import array_to_vector

    doubles = v.cast("array<double>")
    return F.when(v.isNotNull(), array_to_vector(F.coalesce(doubles, F.array().cast("array<double>"))))


def from_ml(v: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return F.when(v.isNotNull(), vector_to_array(v))
