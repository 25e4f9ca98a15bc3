"""The training-text pipeline: five stages over the documents table.

    toxicity            documents scored toxic go
    near_duplicates     one document of each connected group of near duplicates stays
    decontamination     passages of the benchmark are cut out of the texts
    personal_data       personal data is replaced by surrogates
    encoding            texts become ids of pieces

Each stage is a function ``(spark, docs, sf_dir)``. ``run`` writes every stage's rows
as Parquet to the shared folder and reads them again as the next one's documents.
All stages but the last return the columns of ``documents``. Models and benchmark
come from the tables of ``sf_dir``. Documents whose whole text was a benchmark passage
stay, with an empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingml.llm import fm_decontam, minhash_forest, pii_surrogates, toxicity_fm, unigram_pieces
from ratingml.llm.common import fresh_path, table
from ratingml.llm.registry import query

#: A fixed key keeps the registered query repeatable; a user passes a secret of their own.
PII_KEY = "surrogate-key-of-the-registered-pipeline"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents of the tables, score all of ``docs``, keep what is below the threshold."""
    model = toxicity_fm.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity_fm.scored(docs, model, score_col="__score")
    return scored.filter(toxicity_fm.predicted(F.col("__score")) == 0).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_forest.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fm_decontam.without_passages(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_surrogates.replaced(docs, PII_KEY)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_chars, n_tokens, ids, round_trip`` of every document that is left."""
    vocab = unigram_pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    rows = unigram_pieces.encoded(docs, vocab, keep=["doc_id", "lang", "source", "n_chars"])
    count = F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens")
    return rows.select("doc_id", "lang", "source", "n_chars", count, "ids", "round_trip")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: SQL can express neither the learned scores nor the signatures; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


query("pipeline", ORACLE_SQL)(run)
