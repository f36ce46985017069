"""From raw documents to training tokens: five stages over whole tables.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents that go on, the last one the encoded documents.
:func:`run` writes each stage's result as Parquet into the shared folder and
reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlens.llm import mixing
from tierlens.llm.exact_dedup import exact_dedup
from tierlens.llm.near_dedup import near_dedup
from tierlens.llm.sentencepiece_bpe import encode_documents
from tierlens.llm.tables import read, rows_with, save, shown
from tierlens.llm.toxicity import fit, without_toxic

#: Share of the tokens that reach the mixture and that it may take, each document at most once.
MIX_SHARE, MIX_SEED = 0.95, 29
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier accepts.

    A null or empty text has the score of an empty one; rows are judged one by
    one, so repeated rows and null ids share their text's verdict. Other columns
    are left behind; an empty table gives an empty result."""
    return without_toxic(docs, fit(docs, read(spark, sf_dir, "labels"))).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space: most code
    points, then smallest id.

    Null and empty texts are one group; a null id orders last. Rows are kept by
    id: rows that share the id of one that stays go on with it. An empty table
    gives an empty result."""
    return rows_with(docs, exact_dedup(docs).filter("kept")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle similarity of 0.8 or more,
    the smallest id.

    Null and empty texts link with nothing and stay. Rows are kept by id, as in
    :func:`drop_copies`. An empty table gives an empty result."""
    return rows_with(docs, near_dedup(docs, shingle=5, percent=80).filter("kept")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture with the target weights of domains, languages and sources.

    A null language or source is a leaf of its own; texts without words fit any
    budget; a null id has its own place in the order; rows that share an id go on
    together. An empty table gives an empty result."""
    chosen = mixing.mix_sources(mixing.with_domain(docs), mixing.table_weights(), MIX_SHARE, 1, MIX_SEED)
    return rows_with(docs, chosen).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document and the digest of their text: ``doc_id,
    n_tokens, ids, decoded_sha256``, one row per row.

    A null text is encoded as an empty one: begin and end ids alone. Null ids stay
    null; an empty table gives an empty result."""
    d = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return d.select(shown(), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("mixing", mix), ("sentencepiece", encode)]

#: Compression lengths, signatures and merge ranks have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
