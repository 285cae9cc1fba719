"""Clustering of cases along a coordinate, and checks on the clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.operators import joins
from lociq.operators.joins import join_sized, join_small
from lociq.session import cut_lineage

# The default gap in base pairs and the chromosomes clustered by default in the one-hot form.
DEFAULT_CUTOFF = 50_000
CHROMOSOMES = [str(i) for i in range(1, 23)] + ["X"]


def locus_blocks(
    df: DataFrame,
    chrom: str = "chrom",
    coord: str = "coord",
    cutoff: int = DEFAULT_CUTOFF,
    gaps_per_block: int = 64,
) -> DataFrame:
    """Where loci begin, per block of the coordinate line.

    One row per (chrom, block): ``_base`` is the number of the locus that holds
    the block's first case, ``_breaks`` the coordinates inside the block where
    a new locus begins. Starts lie more than ``cutoff`` apart, so ``_breaks``
    has at most ``gaps_per_block`` + 1 entries however many cases there are.
    ``_size`` is the number of the block's cases.
    """
    width = gaps_per_block * max(int(cutoff), 1)
    spots = df.select(F.col(chrom).alias("_chrom"), F.col(coord).cast("bigint").alias("_coord")).where(
        F.col("_chrom").isNotNull() & F.col("_coord").isNotNull()
    )
    spots = spots.groupBy("_chrom", "_coord").agg(F.count(F.lit(1)).alias("_size"))
    spots = spots.withColumn("_block", F.col("_coord") - F.pmod(F.col("_coord"), F.lit(width)))
    inside = Window.partitionBy("_chrom", "_block").orderBy("_coord")
    gap = F.col("_coord") - F.lag("_coord").over(inside)
    blocks = (
        spots.withColumn("_start", F.when(gap > cutoff, F.col("_coord")))
        .groupBy("_chrom", "_block")
        .agg(
            F.min("_coord").alias("_first"),
            F.max("_coord").alias("_last"),
            F.sort_array(F.collect_list("_start")).alias("_breaks"),
            F.sum("_size").alias("_size"),
        )
    )
    along = Window.partitionBy("_chrom").orderBy("_block")
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(along) > cutoff, F.lit(True)).cast("bigint")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocks.withColumn("_new", opens + F.size("_breaks"))
        .withColumn("_base", F.sum("_new").over(upto) - F.size("_breaks"))
        .select("_chrom", "_block", "_base", "_breaks", "_size")
    )


def assign_loci(
    df: DataFrame,
    chrom: str = "chrom",
    coord: str = "coord",
    cutoff: int = DEFAULT_CUTOFF,
    sep: str = "_",
    chroms: Sequence[str] | None = None,
    out: str = "locus_id",
    gaps_per_block: int = 64,
) -> DataFrame:
    """Add the locus id: chromosome, separator, running number from 1.

    A new locus begins where the gap to the previous case of the chromosome is
    strictly larger than ``cutoff``. With ``chroms``, cases elsewhere get an
    empty id. A null chromosome or coordinate is an error. Cases are not sorted or shuffled by chromosome: distinct
    coordinates shrink to a table of blocks (written once, as in a fit), and
    the cases look up their block in it.
    """
    width = gaps_per_block * max(int(cutoff), 1)
    inside = df if chroms is None else df.where(F.col(chrom).isin(list(chroms)))
    blocks = locus_blocks(inside, chrom, coord, cutoff, gaps_per_block)
    place = F.col(coord).cast("bigint")
    keyed = df.withColumn("_chrom", F.col(chrom)).withColumn("_block", place - F.pmod(place, F.lit(width)))
    number = F.col("_base") + F.size(F.filter("_breaks", lambda b: b <= place))
    unplaced = F.raise_error(F.lit("a case without chromosome or coordinate has no locus")).cast("string")
    locus = F.concat_ws(sep, F.col(chrom).cast("string"), number.cast("string"))
    missing = F.col(chrom).isNull() | place.isNull()
    return (
        join_small(keyed, blocks, ["_chrom", "_block"], "left", values_per_row=4 + gaps_per_block, size="_size")
        .withColumn(out, F.when(missing, unplaced).when(F.col("_base").isNotNull(), locus).otherwise(F.lit("")))
        .drop("_chrom", "_block", "_base", "_breaks")
    )


def chrom_from_flags(df: DataFrame, prefix: str = "chromchr", chroms: Sequence[str] = CHROMOSOMES, out: str = "chrom") -> DataFrame:
    """Decode one-hot chromosome columns to one text column."""
    present = [c for c in chroms if f"{prefix}{c}" in df.columns]
    return df.withColumn(out, F.coalesce(*[F.when(F.col(f"{prefix}{c}") == 1, F.lit(c)) for c in present]))


def locus_summary(df: DataFrame, locus: str = "locus_id", label: str = "label") -> DataFrame:
    """Cases and positives per locus."""
    return df.groupBy(locus).agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum(F.col(label).cast("bigint")).alias("positives"),
    )


def locus_members(df: DataFrame, locus: str = "locus_id", case: str = "case_id", label: str = "label") -> DataFrame:
    """Membership as a relation: one row per (locus, case) with the locus counts.

    There is no list per locus, so a locus of any size stays spread out.
    """
    counts = locus_summary(df, locus, label).withColumn("_size", F.col("cases"))
    return join_sized(df.select(locus, case), counts, [locus], "_size", large=True)


def loci_without_positive(df: DataFrame, locus: str = "locus_id", label: str = "label") -> DataFrame:
    """Loci that hold no positive case; empty when the table is fit for grouped folds."""
    return locus_summary(df, locus, label).where(F.col("positives") == 0)


def keep_positive_loci(df: DataFrame, locus: str = "locus_id", label: str = "label", on_missing: str = "drop") -> DataFrame:
    """Deal with loci lacking a positive: ``drop`` them, raise an ``error``, or ``ignore``."""
    if on_missing == "ignore":
        return df
    if on_missing == "error":
        first = loci_without_positive(df, locus, label).take(1)
        if first:
            raise ValueError(f"no positive case in locus {first[0][locus]}")
        return df
    if on_missing != "drop":
        raise ValueError(f"on_missing must be drop, error or ignore, not {on_missing}")
    # The cases are gone through twice, for their loci and for the join, and not to count them.
    held = df.groupBy(locus).agg(F.count(F.lit(1)).alias("_size"), F.max(F.col(label) == 1).alias("_positive"))
    good = cut_lineage(held.where("_positive").drop("_positive"))
    most = good.agg(F.max("_size")).first()[0] or 0
    if most <= joins.HEAVY_ROWS:
        return df.join(good.select(locus).hint("merge"), locus, "left_semi")
    return join_sized(df, good, [locus], "_size", most=most, large=True).select(*df.columns)


def singleton_check(df: DataFrame, locus: str = "locus_id", label: str = "label") -> DataFrame:
    """One row: one-case loci, how many of them are negative, and the verdict."""
    single = locus_summary(df, locus, label).where(F.col("cases") == 1)
    negative = F.coalesce(F.sum(F.when(F.col("positives") == 0, 1).otherwise(0)), F.lit(0))
    return single.agg(
        F.count(F.lit(1)).alias("singletons"),
        negative.cast("bigint").alias("negative_singletons"),
        (negative == 0).alias("ok"),
    )


def mean_locus_size(df: DataFrame, locus: str = "locus_id", label: str = "label") -> DataFrame:
    return locus_summary(df, locus, label).agg(
        F.count(F.lit(1)).alias("loci"), F.avg("cases").alias("mean_cases"), F.max("cases").alias("largest")
    )


def attach_loci(features: DataFrame, loci: DataFrame, case: str = "case_id", locus: str = "locus_id") -> DataFrame:
    """Give a feature table its locus ids by key."""
    return features.join(loci.select(case, locus), case)
