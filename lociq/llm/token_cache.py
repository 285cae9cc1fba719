"""Token counts with a digest cache: only texts whose digest has no stored count are encoded.

The cache is a Parquet folder (content_digest, tokenizer_digest, n_tokens) in a
shared store, appended to by Spark's own writer, so a lost executor leaves no half of
a part. Content is normalised before the digest in a way that keeps the count: runs
of ASCII white space become one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import SLICE, slices
from lociq.llm.tokens import digest_of, encoder
from lociq.session import cut_lineage

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"


def content_digest(text: str, words: bool) -> Column:
    """SHA-256 of the normalised text; null is taken as empty. Texts are kept as they are for tokenizers that see white space."""
    value = F.coalesce(F.col(text), F.lit(""))
    return F.unhex(F.sha2(F.regexp_replace(value, "[ \\t-\\r]+", " ") if words else value, 256))


def counted(texts: DataFrame, tokenizer: str, words: bool) -> DataFrame:
    """(content_digest, n_tokens) of each row (content_digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = encoder(tokenizer, words).column
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                n = np.diff(column(part.column("text"))[1])
                yield pa.RecordBatch.from_arrays([part.column("content_digest"), pa.array(n)], names=["content_digest", "n_tokens"])

    return texts.mapInArrow(run, "content_digest binary, n_tokens long")


def stored(spark, cache: str) -> DataFrame:
    """All stored counts; a folder without any gives an empty table."""
    spark.createDataFrame([], CACHE).coalesce(1).write.mode("append").parquet(cache)
    return spark.read.schema(CACHE).parquet(cache)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, id_column: str = "doc_id", text_column: str = "text", words: bool = True) -> DataFrame:
    """(id, n_bytes, n_tokens) per row, by a tokenizer file and a cache folder.

    A null text is empty and has no tokens. Repeated rows and texts that are equal
    but for white space are encoded once; an id may be null or occur on several
    rows. Texts move only to pick one row of each missing digest; the choice is made on digests
    and ids alone.
    """
    spark, version = docs.sparkSession, digest_of(tokenizer)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("content_digest", content_digest("text", words))
    known = stored(spark, cache).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
    # Of each digest one id, and whether several rows have both: only where there are such, texts move once more to pick one.
    pairs = rows.groupBy("content_digest", "id").agg(F.count("*").alias("n"))
    first = pairs.groupBy("content_digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("m"))
    missing = cut_lineage(first.join(known, "content_digest", "left_anti").select(F.col("content_digest").alias("digest"), F.col("m")["id"].alias("wanted"), (F.col("m")["n"] > 1).alias("several")))
    pick = lambda some: rows.join(missing.where(some), F.expr("content_digest = digest AND id <=> wanted"), "left_semi").select("content_digest", "text")
    chosen = pick("NOT several")
    if not missing.where("several").isEmpty():
        chosen = chosen.unionByName(pick("several").groupBy("content_digest").agg(F.first("text").alias("text")))
    counted(chosen, tokenizer, words).dropDuplicates(["content_digest"]).withColumn("tokenizer_digest", F.lit(version)).select("content_digest", "tokenizer_digest", "n_tokens").write.mode("append").parquet(cache)
    # Runs that raced may have stored a digest twice, with one count.
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.first("n_tokens").alias("n_tokens"))
    told = rows.select("id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "content_digest").join(counts, "content_digest", "left")
    return told.select(F.col("id").alias(id_column), "n_bytes", "n_tokens")
