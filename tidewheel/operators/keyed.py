"""Typed keyed state as DataFrames (key, value): reads, writes, conditional updates, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def put(state: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """``new`` rows take the place of old ones with their key."""
    return state.join(new, key, "left_anti").unionByName(new)


def get(state: DataFrame, value_of: object, key: str = "key", *, strict: bool = False) -> DataFrame:
    """The row of one key; ``strict``: a missing key is an error when the row is read."""
    found = state.where(F.col(key) == F.lit(value_of))
    if not strict:
        return found
    wanted = state.sparkSession.range(1).select(F.lit(value_of).cast(state.schema[key].dataType).alias(key))
    return get_many(state, wanted, key, strict=True)


def get_many(state: DataFrame, wanted: DataFrame, key: str = "key", *, strict: bool = False, order: str | None = None) -> DataFrame:
    """Rows of the ``wanted`` keys, in their order if ``order`` names it; ``strict``: a missing key is an error."""
    columns = [c for c in state.columns if c != key]
    marked = state.withColumn("__there", F.lit(True))
    found = wanted.join(marked, key, "left" if strict else "inner")
    if strict:
        wrong = F.raise_error(F.concat(F.lit("no such key: "), F.col(key).cast("string")))
        found = found.withColumn(key, F.when(F.col("__there").isNull(), wrong.cast(state.schema[key].dataType)).otherwise(F.col(key)))
    out = found.select(*wanted.columns, *columns)
    return out.orderBy(order) if order else out


def contains(state: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    return wanted.join(state, key, "left_semi")


def select_where(state: DataFrame, predicate: Column) -> DataFrame:
    """A filtered scan; Spark pushes the predicate into the reader."""
    return state.where(predicate)


def remove(state: DataFrame, gone: DataFrame, key: str = "key") -> DataFrame:
    return state.join(gone, key, "left_anti")


def remove_where(state: DataFrame, predicate: Column) -> DataFrame:
    """Without the rows that meet the predicate; rows for which it is null stay."""
    return state.where(~F.coalesce(predicate, F.lit(False)))


def token(value: Column) -> Column:
    """What a reader gets to prove that it has seen a value."""
    return F.xxhash64(value)


def compare_and_set(state: DataFrame, changes: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Apply ``changes`` (key, new value, token) where the token is that of the value now, or the key is new."""
    old = state.select(F.col(key), F.col(value).alias("old"), F.lit(True).alias("there"))
    new = changes.select(F.col(key), F.col(value).alias("new"), F.col("token").alias("seen"))
    both = old.join(new, key, "full")
    wins = F.col("there").isNull() | F.coalesce(token(F.col("old")) == F.col("seen"), F.lit(False))
    return both.select(key, F.when(wins, F.col("new")).otherwise(F.col("old")).alias(value))


def fold(deltas: DataFrame, how: Callable[[Column], Column], key: str = "key", value: str = "value", state: DataFrame | None = None) -> DataFrame:
    """Fold deltas, and the values there already, by key.

    ``how`` is an aggregate that may be applied to its own results; a key without
    a value takes what its deltas come to.
    """
    rows = deltas.select(key, value)
    if state is not None:
        rows = rows.unionByName(state.select(key, value))
    return rows.groupBy(key).agg(how(F.col(value)).alias(value))


def fold_with(deltas: DataFrame, f: Callable[[object, object], object], key: str = "key", value: str = "value", state: DataFrame | None = None) -> DataFrame:
    """Fold values by key with any binary Python function, which has to be associative and commutative.

    Tasks fold what they hold before the shuffle, batch by batch, so that a frequent
    key sends one value for each batch; the partial values of a key are then folded
    in one group.  Null values say nothing; a key with one value takes it as it is.
    """
    rows = deltas.select(key, value)
    if state is not None:
        rows = rows.unionByName(state.select(key, value))
    rows = rows.where(F.col(value).isNotNull())
    schema = rows.schema

    def folded(keys: list, values: list) -> dict:
        out = {}
        for k, v in zip(keys, values, strict=True):
            out[k] = f(out[k], v) if k in out else v
        return out

    def partial(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            out = folded(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(out), batch.schema.field(0).type), pa.array(list(out.values()), batch.schema.field(1).type)], schema.names)

    def whole(group: pa.Table) -> pa.Table:
        out = folded(group.column(0).to_pylist(), group.column(1).to_pylist())
        return pa.table([pa.array(list(out), group.schema.field(0).type), pa.array(list(out.values()), group.schema.field(1).type)], names=schema.names)

    return rows.mapInArrow(partial, schema).groupBy(key).applyInArrow(whole, schema)


def concat_lists(deltas: DataFrame, key: str = "key", value: str = "value", state: DataFrame | None = None) -> DataFrame:
    """Lists of a key put together, sorted, as their order of arrival is no fixed one."""
    rows = deltas.select(key, value)
    if state is not None:
        rows = rows.unionByName(state.select(key, value))
    return rows.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list(value))).alias(value))


def handle_shards(state: DataFrame, f: Callable[[Iterable[dict]], Iterable[dict]], schema: str, predicate: Column | None = None) -> DataFrame:
    """What ``f`` yields from the rows of each task, or those that meet a predicate; rows come one after another and are never held whole."""
    rows = state if predicate is None else state.where(predicate)
    kept = _arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]):
        def each():
            for batch in batches:
                yield from batch.to_pylist()

        held = []
        for out in f(each()):
            held.append(out)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist(held, kept)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kept)

    return rows.mapInArrow(run, schema)


def _arrow_schema(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def fold_vectors(deltas: DataFrame, key: str = "key", value: str = "value", state: DataFrame | None = None) -> DataFrame:
    """Element-wise sums of arrays by key."""
    rows = deltas.select(key, value)
    if state is not None:
        rows = rows.unionByName(state.select(key, value))
    sums = rows.select(key, F.posexplode(value)).groupBy(key, "pos").agg(F.sum("col").alias("x"))
    return sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(value))


def smallest_error(rows: DataFrame, key: str, id_col: str, error: str) -> DataFrame:
    """The id with the smallest error for each key, equal errors by id."""
    return rows.groupBy(key).agg(F.min(F.struct(error, id_col)).alias("m")).select(key, F.col(f"m.{id_col}").alias(id_col), F.col(f"m.{error}").alias(error))


def top(state: DataFrame, k: int, key: str = "key", value: str = "value", predicate: Column | None = None) -> DataFrame:
    """The k largest values, equal ones by key."""
    rows = state if predicate is None else state.where(predicate)
    return rows.orderBy(F.desc(value), key).limit(k)


class Registry(dict):
    """Named functions: the folds, predicates and parsers that job options name, and the jobs themselves."""

    def register(self, name: str) -> Callable:
        def add(f: Callable) -> Callable:
            self[name] = f
            return f

        return add
