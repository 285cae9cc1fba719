"""Categories to 0/1 columns, imputation and model matrices.

The set of output columns depends on the data, so encoding takes two passes:
the distinct values of all category columns are gathered first (one aggregate for all), then every row is
projected without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dictionary(df: DataFrame, cols: Mapping[str, str | None]) -> DataFrame:
    """(column, value): distinct values of several columns in one pass; a separator beside the name makes it a list of tokens.

    Values collapse before the shuffle. NULL is no value, and empty text is no token.
    """

    def values(col: str, sep: str | None) -> Column:
        tokens = F.array(F.col(col).cast("string")) if sep is None else F.filter(F.split(col, _literal(sep)), lambda t: t != "")
        return F.transform(F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.isNotNull()), lambda t: F.struct(F.lit(col).alias("column"), t.alias("value")))

    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string")
    return df.select(F.explode(F.concat(*[values(c, sep) for c, sep in cols.items()])).alias("_v")).select("_v.*").distinct()


def categories(df: DataFrame, cols: Mapping[str, str | None]) -> dict[str, list[str]]:
    """Sorted distinct values of each column: as many as there will be output columns, as their names are needed here."""
    found: dict[str, list[str]] = {c: [] for c in cols}
    for row in dictionary(df, cols).collect():
        found[row["column"]].append(row["value"])
    return {c: sorted(v) for c, v in found.items()}


def _literal(sep: str) -> str:
    """A separator as a regular expression that matches it literally."""
    return "".join(f"[{c}]" if c not in "^\\[]" else f"\\{c}" for c in sep)


def binary_encode(df: DataFrame, col: str, sep: str = ",", prefix: str | None = None, integrate: bool = False, tokens: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One 0/1 column per token of a multi-valued text column.

    ``integrate`` replaces the source column by the new ones; otherwise only
    ``keys`` and the new columns are returned.
    """
    tokens = list(tokens) if tokens is not None else categories(df, {col: sep})[col]
    parts = F.split(col, _literal(sep))
    made = [F.coalesce(F.array_contains(parts, t), F.lit(False)).cast("int").alias(f"{prefix or ''}{t}") for t in tokens]
    return _with_columns(df, col, made, integrate, keys)


def one_hot_encode(df: DataFrame, col: str, prefix: str | None = None, integrate: bool = False, values: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One 0/1 column per value of a category, in sorted order."""
    values = list(values) if values is not None else categories(df, {col: None})[col]
    made = [F.coalesce(F.col(col).cast("string") == v, F.lit(False)).cast("int").alias(f"{prefix or ''}{v}") for v in values]
    return _with_columns(df, col, made, integrate, keys)


def _with_columns(df: DataFrame, col: str, made: list, integrate: bool, keys: Sequence[str]) -> DataFrame:
    if integrate:
        return df.select(*[c for c in df.columns if c != col], *made)
    return df.select(*keys, *made)


def encode_long(df: DataFrame, key: str, col: str, sep: str | None = None, prefix: str = "") -> DataFrame:
    """Sparse form of the same encoding, for any number of values: (key, feature) rows that are 1."""
    tokens = F.array(F.col(col).cast("string")) if sep is None else F.array_distinct(F.split(col, _literal(sep)))
    return (
        df.select(key, F.explode(tokens).alias("_t"))
        .where(F.col("_t").isNotNull() & (F.col("_t") != ""))
        .select(key, F.concat(F.lit(prefix), "_t").alias("feature"), F.lit(1).alias("value"))
    )


def chrom_flags(df: DataFrame, col: str = "chrom", prefix: str = "chrom", integrate: bool = True, values: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Chromosome as one-hot columns named prefix + value (``chrom`` + ``chr1``)."""
    return one_hot_encode(df, col, prefix, integrate, values, keys)


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each missing value (NULL or NaN) becomes the mean of the present ones.

    One aggregate gives all means; they enter the projection as a scalar
    subquery, so the table itself is not shuffled. A column without any value
    stays NULL.
    """
    present = {c: F.when(~F.isnan(c), F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c).cast("double") for c in cols}
    means = df.agg(F.struct(*[F.avg(x).alias(c) for c, x in present.items()]).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(x, means[c]) for c, x in present.items()})


def numeric_vector(df: DataFrame, label: str = "label", keys: Sequence[str] = ("case_id",), out: str = "features") -> DataFrame:
    """All columns but keys and label as one vector; missing values become NaN."""
    inputs = [c for c in df.columns if c != label and c not in keys]
    return VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep").transform(df).select(*keys, label, out)


def model_matrix(df: DataFrame, label: str = "label", keys: Sequence[str] = ("case_id",), out: str = "features") -> tuple[DataFrame, list[str]]:
    """Model matrix without intercept, as a vector, with its column names. One aggregate finds the values of all category columns.

    Numbers are kept. Without an intercept the first category column keeps an
    indicator for every value and the later ones drop their first value.
    """
    fields = [f for f in df.schema.fields if f.name != label and f.name not in keys]
    found = categories(df, {f.name: None for f in fields if f.dataType.simpleString() == "string"})
    parts, names, first = [], [], True
    for field in fields:
        if field.name not in found:
            names.append(field.name)
            parts.append(F.array(F.coalesce(F.col(field.name).cast("double"), F.lit(float("nan")))))
            continue
        values, first = (found[field.name] if first else found[field.name][1:]), False
        names.extend(f"{field.name}{v}" for v in values)
        parts.append(_indicators(field.name, values))
    return df.select(*keys, label, array_to_vector(F.concat(*parts)).alias(out)), names


def _indicators(col: str, values: Sequence[str]) -> Column:
    """One array for all values; a row without the category has no indicator at all, as a missing number has no value."""
    return F.transform(F.array(*[F.lit(v) for v in values]).cast("array<string>"), lambda v: F.coalesce((F.col(col) == v).cast("double"), F.lit(float("nan"))))


def combine_matrices(base: DataFrame, reduced: DataFrame, key: str = "case_id", base_col: str = "features", reduced_col: str = "reduced", out: str = "features") -> DataFrame:
    """Columns of two feature tables side by side, by key; array columns become one vector."""
    joined = base.withColumnRenamed(base_col, "_base").join(reduced.select(key, F.col(reduced_col).alias("_red")), key)
    for c in ("_base", "_red"):
        if joined.schema[c].dataType.typeName() == "array":
            joined = joined.withColumn(c, array_to_vector(c))
    made = VectorAssembler(inputCols=["_base", "_red"], outputCol="_all").transform(joined)
    return made.drop("_base", "_red").withColumnRenamed("_all", out)


def combined_name(base: str, reduced: str) -> str:
    return f"{base}_{reduced}"
