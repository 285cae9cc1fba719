import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociq.operators import folds as FO
from lociq.operators import joins as J
from lociq.operators import loci as L


def located(spark, rows, **options):
    df = spark.createDataFrame(rows, "case_id int, chrom string, coord bigint")
    return {r["case_id"]: r["locus_id"] for r in L.assign_loci(df, **options).collect()}


def plain_loci(rows, cutoff):
    out, last, number = {}, {}, {}
    for case, chrom, coord in sorted(rows, key=lambda r: (r[1], r[2])):
        if chrom not in last or coord - last[chrom] > cutoff:
            number[chrom] = number.get(chrom, 0) + 1
        last[chrom] = coord
        out[case] = f"{chrom}_{number[chrom]}"
    return out


def test_gap_equal_to_the_cutoff_stays_together(spark):
    rows = [(1, "1", 100), (2, "1", 50_100), (3, "1", 100_101), (4, "1", 100_102), (5, "X", 7)]
    assert located(spark, rows) == {1: "1_1", 2: "1_1", 3: "1_2", 4: "1_2", 5: "X_1"}


def test_unlisted_chromosomes_get_an_empty_id(spark):
    assert located(spark, [(1, "1", 5), (2, "Y", 5)], chroms=L.CHROMOSOMES, sep="-") == {1: "1-1", 2: ""}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(coords=st.lists(st.tuples(st.sampled_from("ab"), st.integers(-300, 300)), min_size=1, max_size=60), cutoff=st.sampled_from([0, 1, 5]))
def test_blocks_agree_with_a_plain_walk(spark, coords, cutoff):
    rows = [(i, c, x) for i, (c, x) in enumerate(coords)]
    assert located(spark, rows, cutoff=cutoff, gaps_per_block=4) == plain_loci(rows, cutoff)


def table(spark, n=600, hot=200):
    """One locus holds a third of all cases; every locus has a positive."""
    df = spark.range(n).select(
        F.col("id").alias("case_id"),
        F.when(F.col("id") < hot, "hot").otherwise(F.concat(F.lit("l"), F.floor(F.col("id") / 3))).alias("locus_id"),
        ((F.col("id") % 3) == 0).cast("int").alias("label"),
    )
    return df


def test_fold_caps_by_hand(spark):
    df = spark.range(100).select((F.col("id") < 20).cast("int").alias("label"))
    assert tuple(FO.fold_caps(df, 5).first()) == (100, 20, 30, 9)


@pytest.mark.parametrize("at_once", [1, 3, 1000])
@pytest.mark.parametrize("seed", [1337, 5])
def test_grouped_folds_keep_loci_and_caps(spark, at_once, seed):
    df = table(spark)
    folds = FO.grouped_folds(df, 2, 2, seed=seed, loci_per_draw=at_once).cache()
    for row in FO.fold_checks(df, folds, 2).collect():
        assert (row["cases"], row["unassigned"], row["min_fold"], row["max_fold"], row["split_loci"]) == (600, 0, 1, 2, 0)
    caps = FO.fold_caps(df, 2).first()
    for row in FO.fold_profile(df, folds).collect():
        assert row["cases"] <= caps["max_cases"] and row["positives"] <= caps["max_positives"]
    again = FO.grouped_folds(df, 2, 2, seed=seed, loci_per_draw=at_once)
    assert folds.exceptAll(again).count() == 0
    folds.unpersist()


def test_no_room_is_an_error(spark):
    df = spark.range(10).select(F.col("id").alias("case_id"), F.lit("one").alias("locus_id"), F.lit(1).alias("label"))
    with pytest.raises(Exception, match="no fold has room"):
        FO.grouped_folds(df, 1, 5).collect()


def test_plain_folds_are_even_and_stratified_folds_even_per_label(spark):
    df = table(spark, 101)
    sizes = [r["count"] for r in FO.shuffled_folds(df, 2, 4, cells=3).groupBy("rep", "fold").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    per = FO.stratified_folds(df, 1, 4).join(df, "case_id").groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in per if r["label"] == label]
        assert max(counts) - min(counts) <= 1


def test_unknown_method_is_refused(spark):
    with pytest.raises(ValueError, match="LOCUS"):
        FO.assign_folds(table(spark), "OTHER", 1, 2)


def test_loci_without_positive(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 0)], "case_id int, locus_id string, label int")
    assert [r["locus_id"] for r in L.loci_without_positive(df).collect()] == ["b"]
    assert L.keep_positive_loci(df).count() == 2
    with pytest.raises(ValueError, match="locus b"):
        L.keep_positive_loci(df, on_missing="error")
    assert L.singleton_check(df).first()["ok"] is False


def test_a_case_without_coordinate_is_an_error(spark):
    df = spark.createDataFrame([(1, "1", 5), (2, "1", None), (3, None, 7)], "case_id int, chrom string, coord long")
    for case in (2, 3):
        with pytest.raises(Exception, match="without chromosome or coordinate"):
            L.assign_loci(df.where(f"case_id IN (1, {case})")).collect()
    assert [r["locus_id"] for r in L.assign_loci(df.where("case_id = 1")).collect()] == ["1_1"]


def largest_share(df):
    """The greatest share of rows in one partition."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


@pytest.mark.parametrize("heavy, most", [(1_000_000, 1.0), (100, 0.2)])
def test_heavy_keys_are_spread(spark, monkeypatch, heavy, most):
    monkeypatch.setattr(J, "HEAVY_ROWS", heavy)
    keep = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        df = table(spark, 6_000, 2_000)
        kept = L.keep_positive_loci(df)
        members = L.locus_members(df)
        folds = FO.grouped_folds(df, 1, 2)
        for got in (kept, members, folds):
            assert got.count() == df.join(df.where("label = 1").select("locus_id").distinct(), "locus_id", "left_semi").count() if got is kept else 6_000
            share = largest_share(got)
            assert share < most and (heavy == 100 or share > 0.3)
        assert FO.fold_checks(df, folds, 1).first()["split_loci"] == 0
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
