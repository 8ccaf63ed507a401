"""The ten training-data operators as registered queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import chat_format, mixing
from fathom.llm.common import table
from fathom.llm.embedding_dedup import near_duplicates
from fathom.llm.jaccard_join import jaccard_groups
from fathom.llm.packing import pack_documents
from fathom.llm.secret_scan import find_secrets
from fathom.llm.token_files import read_token_files, write_token_files
from fathom.llm.toxicity import score_documents
from fathom.llm.url_filter import judge_urls
from fathom.llm.vector_search import nearest_neighbours


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_documents(table(spark, sf_dir, "documents"))
    places = (F.round(F.element_at("positions", k), 9) for k in (1, 2))
    return mix.select("doc_id", "size", "source_size", "target", "taken", *(p.alias(n) for p, n in zip(places, ("position", "next_position"), strict=True)))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted_digests(chat_format.with_hostile(table(spark, sf_dir, "conversations")))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


#: The rules of the query's contract, word for word; two of them say the opposite of the operator's defaults.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_dedup,
        op2_packing,
        op3_mixing,
        op4_ngram_jaccard,
        op5_token_files,
        op6_toxicity,
        op7_secret_scan,
        op8_chat_format,
        op9_vector_search,
        op10_url_filter,
    )
}

#: DuckDB equivalents, for the operators that SQL can express over whole tables.
SQL: dict[str, str] = {"op3_mixing": mixing.SQL, "op8_chat_format": chat_format.SQL}
