"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.llm import langid, line_dedup, near_dedup, packing, quality
from lithic.llm.shared import join_ids, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or far from every language go.

    Null, empty and blank texts have no letters and go.  Rows are judged one by
    one, by their whole texts: rows with null or repeated ids like any other.
    Without rows to learn from every document goes; an empty table stays empty.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    return langid.identify(docs.select(*COLUMNS), model).where(~F.col("__rejected")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    A null text scores like an empty one; rows are scored one by one, by their
    whole texts, whatever their ids.  Without trusted rows every document
    scores 0.5 and stays; an empty table stays empty.
    """
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where(F.col("__score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate on their host; n_chars follows the text.

    A null text stays null, with the n_chars it had; a text of such lines only
    becomes empty.  A null host is a host of its own; repeated rows count as
    pages of their own; an empty table stays empty.
    """
    clean = line_dedup.dedup_lines(docs.select(*COLUMNS), pooled=True)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Texts without words are copies of nothing and stay, and so do rows with a
    null id.  Of rows equal in id and text one stays; rows that repeat an id
    with another text stay or go each by its own text.  An empty table stays
    empty.
    """
    texts = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = materialize(near_dedup.near_duplicates(docs.select("doc_id", "text")), "near")
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    if not twice:
        return join_ids(texts, found.where(~F.col("kept")).select("doc_id"), "left_anti").select(*COLUMNS)
    # With repeated ids the first row of each id and text is the document, under a number of its own.
    first = texts.where("doc_id is not null").dropDuplicates(["doc_id", "text_hash"])
    named = materialize(first.withColumn("own", F.xxhash64("doc_id", "text_hash")), "named")
    least = near_dedup.near_duplicates(named.select(F.col("own").alias("doc_id"), "text")).select(F.col("doc_id").alias("own"), "component_id")
    rank = Window.partitionBy("component_id").orderBy("doc_id", "own")
    gone = named.select("own", "doc_id").join(least, "own").withColumn("nth", F.row_number().over(rank)).where("nth > 1").select("own")
    return join_ids(named, gone, "left_anti").select(*COLUMNS).unionByName(texts.where("doc_id is null").select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences.

    A null text counts as empty: one piece, the end id.  Every row is packed,
    with null and repeated ids too, however long; an empty table gives no piece.
    """
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("lines", drop_boilerplate),
    ("near_copies", drop_near_copies),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
