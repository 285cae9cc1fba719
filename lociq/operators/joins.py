"""Joins of many rows with a small keyed table, without sending a hot key to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.session import cut_lineage

# Up to this many values (rows x columns, array items counted) a table is broadcast.
BROADCAST_VALUES = 4_000_000
SALTS = 64
# Rows of a key beyond which it is salted.
HEAVY_ROWS = 1_000_000
# Bits a set key gets in the marks that are broadcast, and bits in all: 16 MB at most, however many keys there are.
MARKS_PER_KEY, MOST_MARKS = 16, 2**27


def join_small(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", values_per_row: int = 0, written: bool = False, size: str | None = None) -> DataFrame:
    """Join ``rows`` with a table that has one row per key and is expected to be small.

    The table is written once (unless it already was) and counted. Within the bound it is broadcast,
    so ``rows`` is not shuffled. Beyond it, every row of the table is repeated
    per salt and rows are spread over the salts, so even a key with a third of
    all rows is shared by many tasks. A table that says in ``size`` how many rows
    a key has is repeated for heavy keys only. ``values_per_row`` counts array items.
    """
    keys = list(keys)
    small = small if written else cut_lineage(small)
    if small.count() * max(len(small.columns), values_per_row) <= BROADCAST_VALUES:
        return rows.join(F.broadcast(small if size is None else small.drop(size)), keys, how)
    if size is None:
        return salted_join(rows, small.hint("merge"), keys, how)
    return join_sized(rows, small, keys, size, how, most=small.agg(F.max(size)).first()[0], large=True)


def join_large(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equal to ``rows.join(other, keys, how)`` for tables that both grow with the cases: neither is broadcast.

    The size Spark estimates for a compressed file or for what ``explode`` makes can be far below the real one.
    """
    return rows.join(other.hint("merge"), list(keys), how)


def salted_join(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equal to ``rows.join(small, keys, how)`` for inner and left joins, with hot keys split."""
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in _plain(rows)]), F.lit(SALTS)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")


def join_sized(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], size: str, how: str = "inner", most: int | None = None, large: bool = False) -> DataFrame:
    """Join ``rows`` with a table that has one row per key and says in ``size`` how many rows the key has.

    No key is heavy where ``most``, the rows of a key at most (all rows if it is not given), is within ``HEAVY_ROWS``. Otherwise
    keys with more rows than that, which are fewer than all rows / ``HEAVY_ROWS`` and so are broadcast, are
    salted: their rows go to ``SALTS`` places, where their row of ``per_key`` is repeated. For inner and left joins.
    With ``large`` the table grows with the rows and is never broadcast, whatever size Spark estimates.
    """
    keys = list(keys)
    join = join_large if large else DataFrame.join
    if (rows.count() if most is None else most) <= HEAVY_ROWS:
        return join(rows, per_key.drop(size), keys, how)
    heavy = per_key.where(F.col(size) > HEAVY_ROWS).select(*keys, F.lit(True).alias("_heavy"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in _plain(rows)]), F.lit(SALTS)).cast("int")
    spread = rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.when(F.col("_heavy"), salt).otherwise(0)).drop("_heavy")
    salts = F.when(F.col(size) > HEAVY_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = per_key.withColumn("_salt", F.explode(salts)).drop(size)
    return join(spread, repeated, [*keys, "_salt"], how).drop("_salt")


def _marked(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, str]:
    """``rows`` with a column, which is named beside: false where the key is null or certainly not in ``ids``, a table that was written and is counted here."""
    name = "_marks"
    while any(c.lower().startswith(name) for c in rows.columns):
        name += "_"
    part, at = f"{name}part", f"{name}at"
    bits = min(MOST_MARKS, MARKS_PER_KEY * max(ids.count(), 2048))
    place = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    marks = ids.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(place).alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(name))
    found = rows.withColumns({part: F.bitmap_bucket_number(place), at: F.bitmap_bit_position(place)}).join(F.broadcast(marks), part, "left")
    byte = f"CAST(conv(hex(substring({name}, CAST({at} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    hit = F.expr(f"coalesce({byte} & shiftleft(1, CAST({at} % 8 AS INT)) <> 0, false)") & F.col(column).isNotNull()
    return found.select(*rows.columns, hit.alias(name)), name


def with_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Equal to ``rows.join(ids, column, "left_semi")`` for wide rows of which few are wanted: most others go before the shuffle."""
    marked, name = _marked(rows, ids, column)
    return join_large(marked.where(name).drop(name), ids.select(column), [column], "left_semi").select(*rows.columns)


def without_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Equal to ``rows.join(ids, column, "left_anti")`` for wide rows of which few go: most others stay without a shuffle."""
    marked, name = _marked(rows, ids, column)
    doubtful = join_large(marked.where(name).drop(name), ids.select(column), [column], "left_anti")
    return marked.where(f"NOT {name}").drop(name).unionByName(doubtful.select(*rows.columns))


def _plain(df: DataFrame) -> list[str]:
    """Columns that can be hashed cheaply: no arrays, maps or vectors."""
    return [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "vector"))]
