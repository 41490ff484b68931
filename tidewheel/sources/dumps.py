"""Writing results as lines of text, as tables, and helpers for their places."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(x: Column, places: int = 6) -> Column:
    """A number with so many decimals."""
    return F.format_string(f"%.{places}f", x.cast("double"))


def vector_line(v: Column, separator: str = ",") -> Column:
    return F.array_join(F.transform(v, lambda x: fixed(x)), separator)


def pair_line(key: Column, value: Column) -> Column:
    """``key<TAB>value``; doubles with six decimals."""
    return F.concat_ws("\t", key.cast("string"), value)


def list_line(key: Column, values: Column) -> Column:
    """``key<TAB>v|v|v``."""
    return F.concat_ws("\t", key.cast("string"), F.array_join(F.transform(values, lambda x: fixed(x)), "|"))


def weighted_list_line(key: Column, pairs: Column) -> Column:
    """``key<TAB>id:w|id:w`` from an array of (id, w)."""
    return F.concat_ws("\t", key.cast("string"), F.array_join(F.transform(pairs, lambda p: F.concat(p["id"].cast("string"), F.lit(":"), fixed(p["w"]))), "|"))


def probability_line(row: Column, values: Column) -> Column:
    """As :func:`list_line`; an empty row is its key alone."""
    return F.when(F.size(values) > 0, list_line(row, values)).otherwise(row.cast("string"))


def write_lines(df: DataFrame, column: str, path: str, *, append: bool = False, merge: bool = False) -> None:
    """One text file for each task, or a single one."""
    out = df.select(F.col(column).cast("string").alias("value"))
    (out.coalesce(1) if merge else out).write.mode("append" if append else "overwrite").text(path)


def write_table(df: DataFrame, path: str, *, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def dated(folder: str, day: datetime.date | None = None) -> str:
    """``folder`` with year, month and day behind it, not padded."""
    day = day or datetime.date.today()
    return f"{folder}{day.year}{day.month}{day.day}"


def fill_template(text: str, values: dict[str, str]) -> str:
    """``text`` without its lines that begin with ``#``, and with every key replaced by its value."""
    kept = [line for line in text.splitlines() if not line.startswith("#")]
    out = "\n".join(kept)
    for key, value in values.items():
        out = out.replace(key, value)
    return out
