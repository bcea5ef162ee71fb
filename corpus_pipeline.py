"""A training-corpus pipeline in stages, each one operator of sievelight.llm applied to what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.decontam import benchmark_hits, contaminated
from sievelight.llm.jaccard import jaccard_components
from sievelight.llm.pieces import build_dictionary, document_digests, encoded_segments, load_model
from sievelight.llm.queries import PIECE_MODEL, held_out
from sievelight.llm.suffixes import suffix_dedup
from sievelight.llm.toxicity import fit_toxicity, toxicity_scores
from sievelight.plans.session import stored
from sievelight.plans.sizing import broadcast_if_small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels, held-out ones excepted, scores below 0.3. Null and empty texts score 0 and stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.filter(~held_out()))
    return toxicity_scores(docs, model, keep=COLUMNS).filter("score < 0.3").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the five-word Jaccard join at 0.8, the document with the smallest id. Empty texts are no copies."""
    dropped = jaccard_components(docs).filter("component_id != doc_id").select("doc_id")
    return docs.join(broadcast_if_small(stored(dropped)), "doc_id", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier, n_chars counted anew; a document that loses all its text goes."""
    cut = suffix_dedup(docs.select("doc_id", "text", "lang", "source"), with_text=True, keep=("lang", "source"))
    cut = cut.filter("n_removed = 0 OR kept != ''")
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that holds question and answer of a benchmark item."""
    hits = contaminated(benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).select("doc_id").distinct()
    return docs.join(broadcast_if_small(stored(hits)), "doc_id", "left_anti").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, with its number of pieces, a digest of their ids, and whether the text that they decode to is the document's."""
    model = load_model(PIECE_MODEL)
    encoded = document_digests(docs, encoded_segments(docs, build_dictionary(docs, model), model), model)
    return encoded.select("doc_id", "n_tokens", "n_decoded", "ids_digest", "whole")


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", pieces),
]

#: Trained and iterative stages have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between stages the rows are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
