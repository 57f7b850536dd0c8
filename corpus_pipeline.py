"""The training-data pipeline: raw documents in, token ids out.

Each stage takes what its predecessor kept and returns documents again; the last returns tokens. Stages are written to the
shared folder and read again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from boutline.llm import byte_pairs, toxic_passages
from boutline.llm.alike_texts import one_of_alike
from boutline.llm.leaked_questions import without_leaks
from boutline.llm.repeated_lines import drop_repeated_lines
from boutline.llm.stored import held_out, stored, table
from boutline.session import ship

#: The vocabulary file's name; its place is asked of the installed package.
VOCABULARY = "byte_bpe_50k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the model learns from the labelled documents among them."""
    model = toxic_passages.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))
    return toxic_passages.without_toxic(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; ``n_chars`` follows the text."""
    done = drop_repeated_lines(docs).drop("n_lines", "n_dropped")
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): that with the smallest id."""
    return one_of_alike(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark question."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    return byte_pairs.digests(docs, byte_pairs.Vocabulary(public_tokenizers.path(VOCABULARY)))


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("near duplicates", near_duplicates),
          ("decontamination", decontamination), ("byte pairs", tokens)]

#: Fitted scores and byte pairs have no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
