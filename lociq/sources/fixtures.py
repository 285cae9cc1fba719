"""The library's inputs derived from the given star-schema tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions.draws import uniform

# Fixed value: gap in seconds that separates loci of the events table.
EVENT_CUTOFF = 21_600


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a time without zone, whatever the session's zone."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Events as cases: users are chromosomes, seconds are coordinates, purchases are positive."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("case_id"),
        F.col("user_id").cast("string").alias("chrom"),
        whole_seconds(F.col("ts")).alias("coord"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        F.col("value").alias("score"),
    )


def given_scores(cases: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Three given scores per case: the value, its negative, and a hash: (case_id, ``also``, config_id, set_name, score)."""
    scores = F.array(
        F.struct(F.lit(1).alias("config_id"), F.lit("value").alias("set_name"), F.col("score").alias("score")),
        F.struct(F.lit(2).alias("config_id"), F.lit("negated").alias("set_name"), (-F.col("score")).alias("score")),
        F.struct(F.lit(3).alias("config_id"), F.lit("hashed").alias("set_name"), uniform("case_id").alias("score")),
    )
    return cases.select("case_id", *also, F.explode(scores).alias("_s")).select("case_id", *also, "_s.*")


def embedding_features(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as a feature table: case_id, label, features ARRAY<DOUBLE>."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("case_id"),
        (F.col("label") >= 5).cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def role_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as multi-valued categories: distinct sorted roles, comma-joined."""
    roles = F.array_join(F.array_sort(F.collect_set("role")), ",")
    return table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(roles.alias("roles"))


def price_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as scored cases: returned items are positive, the price is the score, the line number the task."""
    return table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("task_id"),
        F.col("l_orderkey").alias("locus_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_extendedprice").alias("score"),
    )
