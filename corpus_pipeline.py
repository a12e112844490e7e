"""Documents to training text: quality, near-copies, repeats, mixing, encoding. A part of quern.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import byte_bpe, minhash, quality, source_mix, suffix_dedup
from quern.llm.common import Stored, table



def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, learnt from all labels, predict label 1 for; a null id or text is judged like others.

    Labels teach the rules only; a document's own label doesn't decide about it. Repeated rows are judged each.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five-word shingles, similarity of 0.8 or more): the one of smallest id. Texts that repeat an id but aren't linked stay."""
    return minhash.keep_texts(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that a document of smaller id has; texts left without a word go."""
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies of it."""
    return source_mix.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids array<int>, decoded_sha256: texts as byte-level BPE ids, checked by decoding."""
    return byte_bpe.encoded_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("mix", mix_sources), ("encode", encode)]

#: The first stage is a fitted model, which SQL can't express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    store = Stored(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.keep(docs, name)
    return docs
