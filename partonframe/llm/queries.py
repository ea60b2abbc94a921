"""Queries over the operators of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_folder
from .bpe import encode, read_tokenizer
from .chat_fixture import ORACLE as CALLS_ORACLE
from .chat_fixture import SCHEMAS, tool_turns
from .chat_format import ORACLE as CHAT_ORACLE
from .chat_format import format_chats
from .exact_dedup import exact_duplicates
from .filter_audit import ORACLE as AUDIT_ORACLE
from .filter_audit import audit_filters
from .language_id import identify, learn
from .line_dedup import ORACLE as LINE_ORACLE
from .line_dedup import drop_boilerplate
from .mixing import ORACLE as MIX_ORACLE
from .mixing import mix, taken
from .pii import BASE_ORACLE, base_spans, find
from .quality import oracle_sql as quality_sql
from .quality import score
from .simhash import near_duplicates
from .spelling import spelling_variants
from .substring_dedup import repeated_passages
from .token_files import read_token_files, write_token_files


def tokenizer_path() -> str:
    """Where the tokenizer of op10 lies; a parameter of the query, not a part of the repository."""
    import public_tokenizers

    return os.environ.get("PARTONFRAME_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


def word_tokenizer_path() -> str:
    """The same of op13."""
    import public_tokenizers

    return os.environ.get("PARTONFRAME_WORD_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents")).drop("mark")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_boilerplate(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents")).drop("good_probability")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls, results and awkward items in every conversation of the table, since its own have messages only."""
    return format_chats(tool_turns(read(spark, sf_dir, "conversations")), SCHEMAS)


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can express."""
    return base_spans(read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), read_tokenizer(tokenizer_path()), digests=True)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark, 'tokens')}/files"
    write_token_files(read(spark, sf_dir, "documents"), read_tokenizer(word_tokenizer_path()), path)
    return read_token_files(spark, path, digests=True)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_chat_format": op7_chat_format,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_bpe": op10_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_files": op13_token_files,
    "chat_tool_calls": chat_tool_calls,
    "pii_base_spans": pii_base_spans,
}

ORACLES = {
    "op2_exact_dedup": """
        with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
             g as (select t, max(doc_id) keep_id, count(*) group_size from n group by t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n.t) as text_sha256
        from n join g on n.t = g.t""",
    "op4_line_dedup": LINE_ORACLE,
    "op5_quality_rules": quality_sql(),
    "op7_chat_format": CHAT_ORACLE,
    "op9_mixing": MIX_ORACLE,
    "op12_filter_audit": AUDIT_ORACLE,
    "chat_tool_calls": CALLS_ORACLE,
    "pii_base_spans": BASE_ORACLE,
}
