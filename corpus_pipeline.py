"""A corpus through five stages: quality rules, exact dedup, near dedup, substring
dedup, packing.

``STAGES`` lists (name, function).  A function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which ``run`` writes as Parquet to the shared folder and
reads again as the next stage's documents.  Each stage judges all that its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast.llm import exact_dedup, hyperminhash, phrase_automata, quality_rules, two_fit_packing
from revcast.llm.common import written


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the forest fitted on the labelled ones among them.

    Null and empty texts fail the base rules; equal texts share a verdict; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the one with the largest id.

    A null text is an empty one, a null id the smallest; of rows equal in both one stays; an empty table stays empty.
    """
    index = exact_dedup.new_index(spark)
    kept = exact_dedup.keep_unique(docs, index)
    index.drop()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, the smallest id.

    Texts without words and rows without id are linked with nothing and stay; rows that share an id
    stay or go together; an empty table stays empty.
    """
    return hyperminhash.keep_one(docs, width=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 20-word windows that also start earlier; ``n_chars`` follows the text.

    Null and empty texts, and those under 20 words, stay as they are; an empty table stays empty.
    """
    kept = phrase_automata.remove_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences.

    A null text is an empty one and costs its closing token; repeated rows are packed each; an empty table gives no pieces.
    """
    return two_fit_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", drop_low_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack),
]

#: Forests, similarity components and tokenizers are beyond SQL; tests/llm checks ``run`` by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
