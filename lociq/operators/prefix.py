"""Running totals and row numbers that never put one whole group in one task.

A plain window sorts a whole group in one task. Here a group is cut into
ordered cells: totals per cell are small, their running sum gives every cell
its offset, and only the inside of a cell is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions.scalars import order_code
from lociq.operators.joins import join_large
from lociq.session import cut_lineage

CELL = "_cell"
#: Rows a score cell may hold before it is cut into narrower ones, and the low bits of the code that cells of each width ignore.
HEAVY_CELL = 1_000_000
WIDTHS = (31, 17, 3)


def no_null(keys: Sequence[str]) -> Column:
    """All keys are set.

    Stated before the two branches of a cell join part, so that both read the
    same exchange instead of filtering, and therefore computing, it twice.
    """
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))


def _cell(bits: int) -> Column:
    return F.shiftleft(F.shiftright("_code", bits), bits)


def heavy_cells(df: DataFrame, keys: Sequence[str], score: str = "score") -> list[DataFrame]:
    """Cells (keys, cell) with more than ``HEAVY_CELL`` rows, a table for each width but the last, as far as there are any.

    A table with so few rows has none. Otherwise they are counted, and are fewer than rows / ``HEAVY_CELL``.
    """
    if df.count() <= HEAVY_CELL:
        return []
    rows, found = df.where(no_null(keys)).select(*keys, order_code(score).alias("_code")), []
    for width in WIDTHS[:-1]:
        for wide, heavy in zip(WIDTHS, found, strict=False):
            rows = rows.withColumn(CELL, _cell(wide)).join(F.broadcast(heavy), [*keys, CELL], "left_semi").drop(CELL)
        heavy = cut_lineage(rows.groupBy(*keys, _cell(width).alias(CELL)).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > HEAVY_CELL).drop("_rows"))
        if heavy.isEmpty():
            break
        found.append(heavy)
    return found


def score_cells(counts: DataFrame, keys: Sequence[str], heavy: Sequence[DataFrame], score: str = "score") -> DataFrame:
    """Add the cell of each score within its group, by radix refinement: what data make heavy is cut.

    Cells are the leading bits of an order-preserving code. Cells that ``heavy_cells`` found are cut
    by 14 bits more, and again, so a million and tiny differences spread over as many
    cells as scores around zero.
    """
    out = counts.withColumn("_code", order_code(score)).withColumn(CELL, _cell(WIDTHS[0]))
    for narrow, cells in zip(WIDTHS[1:], heavy, strict=False):
        out = out.join(F.broadcast(cells.withColumn("_heavy", F.lit(True))), [*keys, CELL], "left").withColumn(CELL, F.when(F.col("_heavy"), _cell(narrow)).otherwise(F.col(CELL))).drop("_heavy")
    return out.drop("_code")


def before_cell(cells: DataFrame, keys: Sequence[str], sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Per cell: totals of the cells before it (``<c>_before``) and of the group (``<c>_total``)."""
    group = "PARTITION BY " + ", ".join(f"`{k}`" for k in keys)
    order = f"ORDER BY {CELL} {'DESC' if descending else 'ASC'} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return cells.selectExpr(
        *[f"`{k}`" for k in keys],
        CELL,
        *[f"coalesce(sum({c}) OVER ({group} {order}), 0) AS {c}_before" for c in sums],
        *[f"sum({c}) OVER ({group}) AS {c}_total" for c in sums],
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    draw: Column,
    tie: str,
    position: str = "position",
    size: str = "group_size",
    cells: int = 4096,
) -> DataFrame:
    """Number the rows of every group 1..n in the order of ``draw`` (uniform in [0,1)), then ``tie``.

    Sorting happens per (group, draw cell), so a group that holds a third of
    all rows still spreads over ``cells`` tasks.
    """
    tagged = df.where(no_null(keys)).withColumn("_draw", draw).withColumn(CELL, F.floor(F.col("_draw") * cells).cast("int"))
    totals = tagged.groupBy(*keys, CELL).agg(F.count(F.lit(1)).alias("_n"))
    offsets = before_cell(totals, keys, ["_n"])
    inside = Window.partitionBy(*keys, CELL).orderBy("_draw", tie)
    return (
        join_large(tagged.withColumn("_row", F.row_number().over(inside)), offsets, [*keys, CELL])
        .withColumn(position, F.col("_n_before") + F.col("_row"))
        .withColumnRenamed("_n_total", size)
        .drop("_draw", CELL, "_row", "_n_before")
    )
