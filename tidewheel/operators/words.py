"""Word counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import identifier_words
from ..sources.text import index_of


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts; counted before and after the shuffle."""
    return df.select(F.explode(identifier_words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def word_count_topk(df: DataFrame, text_col: str, k: int) -> DataFrame:
    """The k most frequent words, equal counts by word."""
    return word_counts(df, text_col).orderBy(F.desc("n"), "word").limit(k)


def vocabulary(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, index): distinct words numbered from 0 in their order."""
    return index_of(words, column)
