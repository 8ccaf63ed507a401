"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which :func:`run` writes as Parquet
and reads again for the next one.  All but the last return the columns of ``documents``; columns besides
``doc_id``, ``text``, ``source`` and ``n_chars`` travel along, whatever their names and types.

Defined results, stage by stage: null and empty texts are not toxic, nobody's copies and without secrets; the
mix leaves them out, as it takes no word of them.  A row without an id lends no label, is a copy like any other
and is mixed and packed.  Rows that repeat an id are documents of their own; rows alike in id and text are one
from the second stage on.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import mixing, packing, secret_scan, toxicity
from fathom.llm.common import materialize, table
from fathom.llm.jaccard_join import one_of_each_group

#: Distinct chunks and pieces that an encoder keeps in the packing stage.
REMEMBERED = 60_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each n-gram Jaccard group stays; rows without words stay all."""
    return one_of_each_group(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind; ``n_chars`` follows."""
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as, and as far as, the mix takes them."""
    return mixing.mixed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; small caches, as earlier stages have used the executors' memory before."""
    return packing.pack_documents(docs, remembered=REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Tokenizers and trained models are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None
