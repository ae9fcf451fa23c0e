"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes all rows that the one before it kept, and its decisions take effect. Between stages
rows are written as Parquet and read again. All stages but the last return the columns of documents,
whatever further columns there are and however they are named. Null and empty texts, null and
repeated doc_ids, repeated rows and empty tables are rows, or tables, like others; what each stage
makes of them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandweave.llm import jaccard, mixing, packing, pii, quality
from brandweave.llm.common import Scratch, stored, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that importance resampling towards labelled good text rejects.

    A null or empty text has log weight 0, as one of which nothing tells; repeated rows share their
    fate. Without labelled good documents all stay.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest doc_id.

    Documents without words all stay. Of repeated rows of the chosen document one stays; a null doc_id
    is chosen only where a group has no other.
    """
    return jaccard.one_of_each(docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives personal values pseudonyms; ``n_chars``, where there is one, follows the new text.

    A null text stays null, and its ``n_chars`` is null; no row is dropped.
    """
    rows = pii.pseudonymise(docs).select("row.*")
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the mix does, in the order of their training positions.

    A null source is a source. Documents without words are in the mix only where whole epochs of their
    source are taken; each of several equal rows is taken equally often.
    """
    return mixing.mix(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences, which follow the order of the stored mix.

    A null or empty text is its end token. ``docs`` must have been read from files.
    """
    return packing.pack_documents(docs, ordered=True)


STAGES = [
    ("quality", select_quality),
    ("near_copies", drop_near_copies),
    ("pii", replace_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the hashed models, the pseudonyms or the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows between stages go when the sequences are written."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name, f"{scratch.folder}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
