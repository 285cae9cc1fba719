"""Coordinate clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociq.operators import loci as L
from lociq.operators.quality import union_coordinates
from lociq.plans.validation import clustered_cases
from lociq.queries import query, rounded
from lociq.queries.sql import CASES, KEPT, LOCATED, r6
from lociq.sources.fixtures import EVENT_CUTOFF, cases


def located(spark, folder):
    return L.assign_loci(cases(spark, folder), cutoff=EVENT_CUTOFF)


def kept(spark, folder):
    return clustered_cases(cases(spark, folder), EVENT_CUTOFF)


@query("coordinates", f"WITH {CASES} SELECT case_id, chrom, coord FROM cases")
def _(spark, folder):
    return cases(spark, folder).select("case_id", "chrom", "coord")


@query("assign_loci", f"WITH {LOCATED} SELECT case_id, chrom, coord, locus_id FROM located")
def _(spark, folder):
    return located(spark, folder).select("case_id", "chrom", "coord", "locus_id")


@query(
    "assign_loci_listed",
    f"""WITH {LOCATED} SELECT case_id,
    CASE WHEN length(chrom) = 2 AND chrom < '55' THEN replace(locus_id, '_', '-') ELSE '' END AS locus_id FROM located""",
)
def _(spark, folder):
    listed = [str(i) for i in range(10, 55)]
    return L.assign_loci(cases(spark, folder), cutoff=EVENT_CUTOFF, sep="-", chroms=listed).select("case_id", "locus_id")


@query(
    "chrom_from_flags",
    """SELECT doc_id AS case_id, CASE WHEN lang IN ('de', 'en', 'fr') THEN lang END AS chrom FROM documents""",
)
def _(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("case_id"), "lang")
    flags = docs.select("case_id", *[(F.col("lang") == v).cast("int").alias(f"chromchr{v}") for v in ("de", "en", "fr")])
    return L.chrom_from_flags(flags, chroms=["de", "en", "fr"]).select("case_id", "chrom")


@query("locus_summary", f"WITH {LOCATED} SELECT locus_id, count(*) AS cases, CAST(sum(label) AS BIGINT) AS positives FROM located GROUP BY locus_id")
def _(spark, folder):
    return L.locus_summary(located(spark, folder))


@query(
    "locus_members",
    f"""WITH {LOCATED} SELECT locus_id, case_id, count(*) OVER (PARTITION BY locus_id) AS cases,
    CAST(sum(label) OVER (PARTITION BY locus_id) AS BIGINT) AS positives FROM located""",
)
def _(spark, folder):
    return L.locus_members(located(spark, folder))


@query("positive_loci", f"WITH {KEPT} SELECT case_id, locus_id, label FROM kept")
def _(spark, folder):
    return kept(spark, folder).select("case_id", "locus_id", "label")


@query(
    "loci_without_positive",
    f"""WITH {LOCATED} SELECT locus_id, count(*) AS cases, CAST(sum(label) AS BIGINT) AS positives
    FROM located GROUP BY locus_id HAVING sum(label) = 0""",
)
def _(spark, folder):
    return L.loci_without_positive(located(spark, folder))


@query(
    "singletons",
    f"""WITH {LOCATED}, s AS (SELECT sum(label) AS p FROM located GROUP BY locus_id HAVING count(*) = 1)
    SELECT count(*) AS singletons, count(*) FILTER (p = 0) AS negative_singletons, count(*) FILTER (p = 0) = 0 AS ok FROM s""",
)
def _(spark, folder):
    return L.singleton_check(located(spark, folder))


@query(
    "mean_locus_size",
    f"""WITH {KEPT}, s AS (SELECT count(*) AS n FROM kept GROUP BY locus_id)
    SELECT count(*) AS loci, {r6("avg(n)", "mean_cases")}, max(n) AS largest FROM s""",
)
def _(spark, folder):
    return rounded(L.mean_locus_size(kept(spark, folder)))


@query("attach_loci", f"WITH {LOCATED} SELECT event_id AS case_id, props, locus_id FROM events JOIN located ON case_id = event_id")
def _(spark, folder):
    features = spark.read.parquet(f"{folder}/events.parquet").select(F.col("event_id").alias("case_id"), "props")
    return L.attach_loci(features, located(spark, folder))


@query("coords_union", f"WITH {CASES} SELECT case_id, coord FROM cases")
def _(spark, folder):
    whole = cases(spark, folder).withColumnRenamed("coord", "chromStart")
    parts = [whole.where(F.col("label") == y) for y in (0, 1)]
    return union_coordinates(parts, ["case_id", "chromStart"], {"chromStart": "coord"})
