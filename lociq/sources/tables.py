"""Reading and writing of feature, coordinate, score, stage and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lociq.operators.quality import union_coordinates


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, sep: str = "\t", keep_na: bool = False) -> DataFrame:
    """Delimited text with a header and a declared schema.

    The text ``NA`` means missing, unless ``keep_na`` keeps it as a category;
    then empty text stays empty text as well. Fields that do not fit the schema
    are an error.
    """
    reader = spark.read.option("sep", sep).option("header", True).option("mode", "FAILFAST").schema(schema)
    paths = path if isinstance(path, str) else list(path)
    if keep_na:
        return reader.csv(paths).na.fill("")
    return reader.option("nullValue", "NA").csv(paths)


def first_column_as_key(df: DataFrame, key: str = "case_id") -> DataFrame:
    return df.withColumnRenamed(df.columns[0], key)


def restrict_to(df: DataFrame, keys_of: DataFrame, key: str = "case_id") -> DataFrame:
    """The rows of ``keys_of``'s keys; a key without a row gives NULLs."""
    return df.join(keys_of.select(key), key, "right")


def read_coordinates(spark: SparkSession, paths: Sequence[str], schema: StructType | str, columns: Sequence[str], renames: Mapping[str, str] | None = None, sep: str = "\t") -> DataFrame:
    """Coordinate files of the classes of cases, stacked."""
    return union_coordinates([read_delimited(spark, p, schema, sep) for p in paths], columns, renames)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A feature, coordinate or score table in Parquet."""
    return spark.read.parquet(path)


def stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write an intermediate table and go on from what was written."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_results(spark: SparkSession, base: str) -> DataFrame:
    """All results under ``base``, with label, seed and set type from their paths."""
    return spark.read.option("basePath", base).parquet(base)


def result_path(base: str, label: str, seed: int) -> str:
    return f"{base}/label={label}/seed={seed}"


def write_results(df: DataFrame, base: str, label: str, seed: int, by: Sequence[str] = ("set_type",)) -> str:
    """Results under a path that names analysis and seed, one folder per set type."""
    path = result_path(base, label, seed)
    df.write.mode("overwrite").partitionBy(*[c for c in by if c in df.columns]).parquet(path)
    return path


# Bare text: nothing quoted or trimmed, empty text stays empty, missing values are NA.
_BARE = {"sep": "\t", "header": True, "quote": "", "emptyValue": "", "nullValue": "NA", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _bare(df: DataFrame) -> DataFrame:
    """The table, or an error at the first text that a bare field cannot hold."""
    refused = lambda c: F.raise_error(F.concat(F.lit(f"a tab or line break in column {c}: "), F.col(c))).cast("string")
    return df.withColumns({c: F.when(F.col(c).rlike("[\\t\\r\\n]"), refused(c)).otherwise(F.col(c)) for c, t in df.dtypes if t == "string"})


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header, nothing quoted, missing values as NA; a text with a tab or line break is an error."""
    _bare(df).write.mode("overwrite").options(**_BARE).csv(path)


def write_importance(df: DataFrame, path: str, by: Sequence[str] = ("set_type", "config_name")) -> None:
    """Feature importance as tab-separated text, one folder per set type and configuration."""
    _bare(df).write.mode("overwrite").partitionBy(*by).options(**_BARE).csv(path)
