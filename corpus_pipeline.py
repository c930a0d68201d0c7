"""From raw documents to mixed, tokenized training text, in five stages.

Each stage works on all rows that the one before kept; its result is written as Parquet and
read again.  Stages of the middle return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.llm.decontaminate import decontaminate
from marquee.llm.jaccard import keep_one
from marquee.llm.mixing import mixed_documents
from marquee.llm.quality import keep_good
from marquee.llm.queries import tokenizer_path
from marquee.llm.shared import read
from marquee.llm.tokens import read_tokens, write_tokens
from marquee.session import durable


def quality(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, read(spark, directory, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of 5-word shingles."""
    return keep_one(docs, width=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontaminate(docs, read(spark, directory, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents as the mix of sources takes them, repeated or cut where it says so."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Token ids of the mix, written as compressed files and read back: one row per document."""
    return read_tokens(write_tokens(docs, tokenizer_path()), with_ids=False)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: No SQL: shingle components, a fitted classifier and token files have none.
ORACLE_SQL = None


def run(spark: SparkSession, directory: str) -> DataFrame:
    """All stages, from ``documents`` on; each result is written and read by the next."""
    docs = read(spark, directory, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, directory))
    return STAGES[-1][1](spark, docs, directory)
