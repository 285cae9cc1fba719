"""Checks on feature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: more levels than this make a category column unfit for the forest.
MAX_LEVELS = 64


def feature_quality(df: DataFrame, cols: Sequence[str] | None = None, max_levels: int = MAX_LEVELS, matrix: bool = False) -> DataFrame:
    """Per feature: NaN count, NULL count, levels of a category column, and the verdict.

    All columns are measured in one aggregate. Category columns are the text ones and, in a
    ``matrix``, those of whole numbers.
    """
    types = dict(df.dtypes)
    cols = list(cols or df.columns)
    measured = []
    for c in cols:
        text = types[c] == "string" or (matrix and types[c] in ("tinyint", "smallint", "int", "bigint"))
        real = types[c] in ("double", "float")
        measured += [
            (F.count(F.when(F.isnan(c), 1)) if real else F.lit(0).cast("bigint")).alias(f"nan_{c}"),
            F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}"),
            # Collapsed to levels before the shuffle by partial aggregation.
            (F.count_distinct(c) if text else F.lit(0).cast("bigint")).alias(f"lev_{c}"),
        ]
    packs = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"nan_{c}").alias("nan_count"),
            F.col(f"null_{c}").alias("null_count"),
            F.col(f"lev_{c}").alias("levels"),
            ((F.col(f"nan_{c}") == 0) & (F.col(f"lev_{c}") <= max_levels)).alias("ok"),
        )
        for c in cols
    ]
    return df.agg(*measured).select(F.explode(F.array(*packs)).alias("_p")).select("_p.*")


def missing_values(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: number of NULL or NaN values in all columns, and whether the forest may use the table."""
    types = dict(df.dtypes)
    cols = list(cols or df.columns)
    missing = [F.when(F.col(c).isNull() | (F.isnan(c) if types[c] in ("double", "float") else F.lit(False)), 1).otherwise(0) for c in cols]
    total = F.sum(sum(missing, F.lit(0)).cast("bigint"))
    return df.agg(total.alias("missing"), (total == 0).alias("ok"))


def require_complete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The table itself, or an error when a value is missing."""
    found = missing_values(df, cols).first()["missing"]
    if found:
        raise ValueError(f"{found} missing values; the forest needs a complete table")
    return df


def table_alignment(left: DataFrame, right: DataFrame, key: str = "case_id", label: str = "label") -> DataFrame:
    """One row: keys only left, only right, shared keys with different labels, and the verdict."""
    joined = left.select(key, F.col(label).alias("_l"), F.lit(1).alias("_in_l")).join(
        right.select(key, F.col(label).alias("_r"), F.lit(1).alias("_in_r")), key, "full_outer"
    )
    only_left = F.count(F.when(F.col("_in_r").isNull(), 1))
    only_right = F.count(F.when(F.col("_in_l").isNull(), 1))
    differ = F.count(F.when(F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull() & ~F.col("_l").eqNullSafe(F.col("_r")), 1))
    return joined.agg(
        only_left.alias("only_left"),
        only_right.alias("only_right"),
        differ.alias("label_differs"),
        ((only_left == 0) & (only_right == 0) & (differ == 0)).alias("ok"),
    )


def require_rows(cases: DataFrame, tables: Mapping[str, DataFrame], key: str = "case_id") -> None:
    """An error when a case has no row, or several, in one of the tables: an inner join would lose or repeat it.

    All tables are counted by key in one pass; rows of other keys are allowed.
    """
    stacked = cases.select(key).distinct().withColumn("_t", F.lit(-1))
    for k, table in enumerate(tables.values()):
        stacked = stacked.unionByName(table.select(key).withColumn("_t", F.lit(k)))
    counts = [F.count_if(F.col("_t") == k).alias(f"n{k}") for k in range(len(tables))]
    per_key = stacked.groupBy(key).agg(F.count_if(F.col("_t") == -1).alias("asked"), *counts).where("asked = 1")
    worst = per_key.agg(*[F.count_if(F.col(f"n{k}") != 1).alias(f"n{k}") for k in range(len(tables))]).first()
    wrong = [f"{name} for {worst[k]} cases" for k, name in enumerate(tables) if worst[k]]
    if wrong:
        raise ValueError(f"not one row of {', '.join(wrong)}")


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table and whether all tables have the same number."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("cases")).select(F.lit(name).alias("name"), "cases")
        counts = one if counts is None else counts.unionByName(one)
    packed = counts.agg(F.collect_list(F.struct("name", "cases")).alias("_t"), (F.count_distinct("cases") == 1).alias("equal"))
    return packed.select(F.explode("_t").alias("_r"), "equal").select("_r.name", "_r.cases", "equal")


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: positives, negatives, negative per positive, and fraction positive."""
    positives = F.sum(F.col(label).cast("bigint"))
    total = F.count(F.lit(1))
    return df.agg(
        positives.alias("positives"),
        (total - positives).alias("negatives"),
        F.try_divide(total - positives, positives).alias("negative_per_positive"),
        F.try_divide(positives, total).alias("fraction_positive"),
    )


def label_as_int(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn(label, F.col(label).cast("string").cast("int"))


def union_coordinates(parts: Sequence[DataFrame], columns: Sequence[str], renames: Mapping[str, str] | None = None) -> DataFrame:
    """Coordinate tables of the classes stacked, reduced to ``columns`` and renamed."""
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out.withColumnsRenamed(dict(renames or {}))
