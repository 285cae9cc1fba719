"""Small column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(column(x), F.lit(high)), F.lit(low))


def logit(x: Column | str, eps: float | None = None) -> Column:
    """log(x / (1 - x)); 0 and 1 give -inf and +inf unless ``eps`` pulls them inside.

    A value outside [0, 1] is an error.
    """
    x = column(x)
    checked = F.when(
        (x < 0.0) | (x > 1.0), F.raise_error(F.concat(F.lit("logit of "), x.cast("string"))).cast("double")
    ).otherwise(x)
    if eps is not None:
        return F.log(clip(checked, eps, 1.0 - eps) / (1.0 - clip(checked, eps, 1.0 - eps)))
    return (
        F.when(checked == 0.0, F.lit(float("-inf")))
        .when(checked == 1.0, F.lit(float("inf")))
        .otherwise(F.log(checked / (1.0 - checked)))
    )


def inv_logit(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-column(x)))


def logit_mean(x: Column | str, eps: float | None = None) -> Column:
    """Aggregate: back-transformed mean on the logit scale."""
    return inv_logit(F.avg(logit(x, eps)))


def order_code(x: Column | str, per_e: int = 1 << 42) -> Column:
    """Order-preserving whole number of a double, of 54 bits and a sign.

    ``x <= y`` implies ``order_code(x) <= order_code(y)``. Codes are ``1/per_e``
    apart on the log scale, so at most some thousand neighbouring doubles share one. NULL comes first and
    NaN last, like in Spark's own ordering; the code itself is never NULL.
    """
    x = column(x).cast("double")
    # ln of a double lies within (-745, 710), so the shift keeps the sign apart.
    size = F.floor(F.least(F.log(F.abs(x)), F.lit(710.0)) * F.lit(float(per_e))) + F.lit(800 * per_e).cast("bigint")
    bucket = F.when(F.isnan(x), F.lit(2**62)).when(x == 0.0, F.lit(0).cast("bigint")).when(x > 0.0, size).otherwise(-size)
    return F.coalesce(F.when(x.isNotNull(), bucket), F.lit(-(2**62)))


def reciprocal_span(z: str, p: str) -> str:
    """SQL text for the sum of 1/(z+x) over x = 1..p, with z >= 0 and integer p, without a loop over p.

    Up to 32 terms are added one by one; beyond that the difference of two
    digamma values is taken in a form free of cancellation.
    """
    direct = f"aggregate(sequence(1L, least(greatest(CAST({p} AS BIGINT), 1L), 32L)), 0D, (acc, x) -> acc + 1D / ({z} + x))"
    # The first eight terms move the lower end to where the asymptotic series holds.
    head = " + ".join(f"1D / ({z} + {i}D)" for i in range(1, 9))
    low, high = f"({z} + 9D)", f"({z} + {p} + 1D)"
    tail = f"log1p(({p} - 8D) / {low}) + {_digamma_rest(high)} - {_digamma_rest(low)}"
    return f"(CASE WHEN {p} <= 0 THEN 0D WHEN {p} <= 32 THEN {direct} ELSE {head} + {tail} END)"


def _digamma_rest(x: str) -> str:
    """digamma(x) - ln(x) for x >= 9, asymptotic series."""
    r = f"(1D / ({x} * {x}))"
    series = f"(1D/12 - {r} * (1D/120 - {r} * (1D/252 - {r} * (1D/240 - {r} * (1D/132 - {r} * (691D/32760))))))"
    return f"(-0.5D / {x} - {r} * {series})"


def hp_text(hp: Column | str) -> Column:
    """Parameter map as one display string ``k=v, k=v`` with sorted keys."""
    pairs = F.array_sort(
        F.transform(F.map_entries(column(hp)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    )
    return F.array_join(pairs, ", ")
