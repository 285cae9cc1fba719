"""A training corpus from the documents table: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm import chain, minhash, packing, radix, wu_manber
from lociq.llm.queries import CATEGORIES, TOKEN_LIMIT, TOXIC, WORD_BPE
from lociq.session import use_checkpoint_folder

#: Near-duplicates: words of a shingle and per cent of shingles in common.
SHINGLE, SIMILAR = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't find toxic. Null ids, null and empty texts and repeated rows are judged like others; without labels, and from an empty table, nothing goes."""
    prefix = "p_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    judged = chain.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), CATEGORIES, prefix=prefix)
    return judged.where(F.col(f"{prefix}toxic") < TOXIC).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest id. Null and repeated ids are rows like others."""
    return minhash.deduplicated(docs, size=SHINGLE, percent=SIMILAR)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that an earlier document has; documents of which nothing is left go.

    Rows with a null id are compared with nothing, rows with one id don't repeat each other, null texts stay null; an empty table stays empty.
    """
    left = radix.without_repeats(docs)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than 5 % is in a window of a benchmark item, each judged by its own text whatever its id."""
    rows, number = minhash.numbered(docs)
    found = wu_manber.occurrences(rows.select("doc_id", "text", F.col(number).alias("row_number")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("row_number",))
    gone = wu_manber.contamination(found, carry=("row_number",)).where("contaminated").select(F.col("row_number").alias(number))
    return rows.join(gone, number, "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``TOKEN_LIMIT`` tokens. Null and empty texts are a closing token; repeated rows and null ids are packed like others; an empty table gives none."""
    return packing.pack(packing.pieces(docs, WORD_BPE, TOKEN_LIMIT, with_ids=False).drop("ids"), TOKEN_LIMIT)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("decontamination", decontamination), ("packing", packing_stage)]

#: Learned classifiers and token ids are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each keeps is in a new folder of the shared checkpoint folder."""
    folder = f"{use_checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
