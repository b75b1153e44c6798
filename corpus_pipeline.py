"""The corpus pipeline: toxicity, language identification, near duplicates, mixing, tokens.

Each stage takes and returns the columns of documents, the last returns one row of token digests a document.  Every
stage works on all rows that its predecessor kept and treats nulls, empty and long texts, repeated rows and empty
tables as its operator does; columns that it does not know pass through, whatever their names.  Rows with a null id pass
the first two stages like others and are never removed as duplicates.  Rows that repeat an id count as one document from
the third stage on: the one whose text sorts first.  The mix takes whole documents, so a source may miss its target by
half a document for each group of a source that is mixed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import bpe, jaccard, langid, mixing, toxicity
from blockloom.llm.cluster import checked_broadcast, cut, fresh

#: A text nearer than this to no learnt language goes; clean text scores 0.4 and more.
LEAST_SCORE = 0.25
#: Near duplicates share four fifths of their runs of five words.
SHINGLE, PERCENT = 5, 80
WEIGHTS, MOST = (1.0, 2.0, 3.0), 3.0
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, calls toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or like no language that was learnt, go."""
    profiles = langid.learn(docs, ~langid.held_out("doc_id"))
    return langid.accepted(docs, profiles, LEAST_SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays."""
    found = cut(jaccard.similar_sets(docs, k=SHINGLE, percent=PERCENT).select("doc_id", "component_id"))
    name, text = fresh(docs, "gone"), fresh(docs, "first")
    gone = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    kept = docs.join(checked_broadcast(gone), F.col("doc_id") == F.col(name), "left_anti")
    again = cut(found.where("doc_id is not null").groupBy(F.col("doc_id").alias(name)).count().where("count > 1").select(name))
    if again.isEmpty():
        return kept
    again = checked_broadcast(again)
    # One row of an id: the smallest by text (null last), then by the other columns.
    others = F.struct(F.col("text").isNull().alias("n"), F.col("text").alias("t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    repeats = kept.join(again, F.col("doc_id") == F.col(name), "left_semi").groupBy("doc_id").agg(F.min(others).alias(text)).select(f"{text}.row.*")
    return kept.join(again, F.col("doc_id") == F.col(name), "left_anti").unionByName(repeats)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole documents; what it does not take goes."""
    return mixing.repeated(docs, WEIGHTS, MOST)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return bpe.encode_digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("jaccard_join", one_of_each_group),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL can express the classifiers and the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage keeps is written to the shared checkpoint folder, for the next one reads it
    several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
