"""A corpus from raw documents: toxic ones go, one of each near-duplicate group stays, repeated passages go,
personal data is masked, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined cases, in every stage: a null text counts as empty and stays null where nothing is done to it; an empty table gives
an empty one; extra columns stay, whatever their names.  Rows that repeat an id: toxicity judges each by its text;
ngram_jaccard_join keeps one of them; the later stages would treat them as rows of their own.  Rows without an id:
never learnt from, no one's copy, nothing repeated, and packed like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.llm import jaccard_join, packing, pii, substring_dedup, toxicity as toxic
from gaugeline.llm.common import crc_mod, materialise, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; labels of one row in five are never learnt from."""
    model = toxic.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return toxic.reject(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.75 or more connect, the document with the least id stays."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that occurred earlier go."""
    return _measured(substring_dedup.dedup_texts(docs), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in brackets."""
    model = pii.fit(materialise(docs.select(pii.candidates(F.col("text")).alias("cands")), "pii"))
    return _measured(docs.withColumn("text", pii.masked(F.col("text"), model)), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences."""
    return packing.pack_documents(docs)


def _measured(changed: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

#: Learnt scores and token ids are not expressible in SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
