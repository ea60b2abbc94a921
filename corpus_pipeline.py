"""The corpus pipeline: language identification, exact and near duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a DataFrame; all
but the last return the columns of ``documents``. Results are lazy; tables that a stage leaves in the shared
folder are deleted when the next stage starts, whose input has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partonframe.llm.bpe import encode, read_tokenizer
from partonframe.llm.exact_dedup import drop_exact_duplicates
from partonframe.llm.language_id import keep_identified
from partonframe.llm.mixing import mix, mixed_documents
from partonframe.llm.queries import tokenizer_path
from partonframe.llm.scratch import Scratch
from partonframe.llm.simhash import drop_near_duplicates

_open: list[Scratch] = []


def _scratch(spark: SparkSession) -> Scratch:
    while _open:
        _open.pop().close()
    _open.append(Scratch(spark))
    return _open[-1]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    _scratch(spark)
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return drop_exact_duplicates(docs, scratch=_scratch(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return drop_near_duplicates(docs, scratch=_scratch(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them."""
    scratch = _scratch(spark)
    return mixed_documents(docs, mix(docs, scratch=scratch))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of the mix."""
    return encode(docs, read_tokenizer(tokenizer_path()), digests=True, scratch=_scratch(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes from one to the next is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    between = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = between.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language identification, SimHash's XXH64 and the tokenizer have no DuckDB SQL; tests hold the stages against brute force.
ORACLE_SQL = None
