"""Corpus preparation: language ID, line dedup, near-duplicate removal,
mixing to target weights, BPE encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. The first four return the columns of ``documents``; the last returns the
encodings. Null and empty texts: language ID rejects them (no letter), so the
later stages only see them if they are run on their own, each as its operator
defines. Ties: of near duplicates with the same smallest id the text with the
smallest hash stays. Rows that repeat an id with another text are documents of
their own in every stage; equal rows are one document from near-duplicate removal
on. Empty tables pass all stages; columns beyond those of ``documents``, whatever
their names, go with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm.bpe import default_path, encode
from tickwise.llm.common import read, ship, written
from tickwise.llm.language import learn, lowest_score, predict
from tickwise.llm.linededup import dedup_lines
from tickwise.llm.mixing import mix
from tickwise.llm.parityjoin import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MAX_EPOCHS = 1  # each document is taken once at most


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognised language: no letter, or fewer
    n-grams of the best language than half of what nearly all labelled
    documents have of theirs (``language.lowest_score``)."""
    ship(spark)
    filters = learn(docs)
    found = predict(docs, filters, keep=COLUMNS)
    least = lowest_score(docs, filters)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") > 0) & (F.col("score") >= least)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all but the first document; a document that has
    no other line is dropped, as nothing of it is left."""
    kept = dedup_lines(docs)
    left = kept.where((F.col("n_dropped") == 0) | (F.trim(F.col("kept"), F.lit(" \t\n\x0b\x0c\r")) != ""))
    return left.select("doc_id", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept")).alias("text"), "lang", "source",
                       F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("kept").cast("long")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id
    stays; documents without an id stay. A document is an id with a text, so
    rows that share an id but not a text are judged apart, and equal rows are
    one document."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    keyed = docs.where(F.col("doc_id").isNotNull()).withColumn("__key", F.xxhash64("doc_id", "text"))
    groups = near_duplicates(keyed.select("__key", "text"), id_column="__key").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    ids = keyed.select("__key", "doc_id").distinct()
    first = groups.join(ids, "__key").groupBy("component_id").agg(F.min(F.struct("doc_id", "__key")).alias("first")).select("first.*").distinct()
    stays = keyed.join(first, ["doc_id", "__key"], "left_semi")
    one = stays.groupBy("doc_id", "__key").agg(F.min("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return one.select("doc_id", "text", "rest.*").unionByName(docs.where(F.col("doc_id").isNull()))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the token budgets of the source tree take."""
    return mix(docs, max_epochs=MAX_EPOCHS).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return encode(docs, default_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: BPE and language ID are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
