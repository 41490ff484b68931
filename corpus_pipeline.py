"""From raw documents to packed training sequences, stage by stage.

Each stage gets what its predecessor kept, written as Parquet and reread.

What every stage does with odd rows: null and empty texts are empty texts (the
first stage rejects them; the later ones, run by themselves, keep them); very long
texts are handled whole; ids may be null or repeated, as rows are known by id and
text; equal rows share a fate, but for the second stage, which keeps one of them;
columns beyond those of ``documents`` come along whatever their names, except in
the last stage, which returns pieces; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import decontamination, near_dedup, packing, pii, quality_rules
from tidewheel.llm.common import discard, store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules don't reject, without frequent lines; ``n_chars`` follows.

    Null, empty and white-space texts are rejected; a null source is a host of its own.
    """
    return quality_rules.clean(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similar by 0.8 or more): the first by id, null ids last, then by text.

    Documents without words are linked with nothing and stay.
    """
    return near_dedup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those without words stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; ``n_chars`` follows where a text changes; a null text stays null."""
    return pii.replace_entities(docs, count_col=None, chars_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences; a null or empty text is its end alone."""
    return packing.pack_documents(docs, packing.vocabulary_path())


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate),
    ("PII", personal_data),
    ("packing", pack),
]

#: Shingle sets, seeds, permutations and tokens are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's table goes once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = store(docs, "stage")
            if last:
                discard(spark, last)
            last = path
    return docs
