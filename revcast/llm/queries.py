"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast.llm import (
    block_whitening,
    host_suffix,
    hyperminhash,
    license_scan,
    multi_index,
    pair_tiles,
    phrase_automata,
    piece_codec,
    quality_rules,
    separator_scan,
    two_fit_packing,
    zstd_language,
)
from revcast.llm.common import fresh_path
from revcast.llm.exact_dedup import new_index

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_host_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return host_suffix.extract(table(spark, sf_dir, "pages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return piece_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on two-word shingles."""
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in a sequence."""
    return two_fit_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict per document; the forest is fitted on labelled rows."""
    docs = table(spark, sf_dir, "documents")
    forest = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.verdicts(docs, forest)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by dictionaries learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    dictionaries = zstd_language.train(docs.filter(~zstd_language.held_out()))
    held = docs.withColumn("held_out", zstd_language.held_out()).select("doc_id", "text", "held_out")
    return zstd_language.predict(held, dictionaries, keep=["held_out"])


def op7_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeated 20-word windows take from every document."""
    return phrase_automata.digests(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict per document of a load into a new digest index."""
    index = new_index(spark)
    verdicts = index.load(table(spark, sf_dir, "documents"))
    index.drop()
    return verdicts.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as flat token files, then the documents found in these.

    Flat files carry no ids: a document is known by its file's number and its
    place in the file.
    """
    path = fresh_path(spark, "flat-tokens")
    separator_scan.write_flat(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    return separator_scan.count_tokens(spark, path).withColumn("file", number)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices found in all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op12_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector."""
    return block_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_pair_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest collocations of each language."""
    return pair_tiles.collocations(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

QUERIES: dict[str, Query] = {
    "op1_host_suffix": op1_host_suffix,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_hyperminhash": op3_hyperminhash,
    "op4_best_two_fit": op4_best_two_fit,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_phrase_automata": op7_phrase_automata,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_license_scan": op10_license_scan,
    "op11_multi_index": op11_multi_index,
    "op12_block_whitening": op12_block_whitening,
    "op13_pair_tiles": op13_pair_tiles,
}

ORACLE: dict[str, str] = {
    "op8_exact_dedup": OP8_SQL,
}
