"""The corpus pipeline: language ID, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again for the next one.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sceneline.llm import bpe, jaccard, langid, mixing, pii
from sceneline.llm.common import materialize, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the language found; documents too far from all languages go.

    So do null texts and those without a letter.  Of equal cosines the language first by code point
    wins; repeated rows have repeated results; null ids and other columns stay as they are; an empty
    table, or one without languages to learn from, gives no rows.
    """
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word shingles with a Jaccard similarity of 0.8 or more, the first stays.

    The first is the one with the smallest doc_id; repeated rows of that id all stay, as do rows with
    a null id and null or empty texts.  Columns keep their values; an empty table gives no rows.
    """
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data and secrets become their kind in brackets.

    Overlapping spans become one, by the kind of the first.  Null and empty texts stay, repeated rows
    stay repeated, ``n_chars`` follows the text, other columns keep their values; an empty table
    gives no rows.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is drawn; words of the sources come near their targets.

    Null and empty texts have no words and are never drawn; a null source is one of its own; rows
    with equal ids share what is left of a quota by their size; of a part, the text is its first
    words.  Rows come in the order of shard and place; an empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids (little-endian 32-bit) and what they decode to, for each row.

    A null or empty text has no ids; repeated rows have repeated results, null ids stay null; an
    empty table gives no rows.
    """
    return bpe.encode(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

#: Stages learn models and draw by hashes: not for SQL.  tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
