"""Numeric helpers: zero-safe ratios, rounding for oracle comparison, vector similarity.

ANSI mode is on in Spark 4, so ``x / 0`` raises; every ratio goes through ``safe_div``.
Vectors are ``ARRAY<FLOAT|DOUBLE>`` columns; all arithmetic is done in double with
higher-order functions, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMALS = 6
#: Values from here on are not rounded: times 1e6 they would not fit a long.
ROUND_LIMIT = 1e12


def c_(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num, den, default: float = 0.0) -> Column:
    """num / den, ``default`` when den is 0 or null."""
    num, den = c_(num), c_(den)
    return F.when(F.coalesce(den, F.lit(0)) == 0, F.lit(default)).otherwise(
        F.try_divide(num.cast("double"), den.cast("double")))


def r6(x) -> Column:
    """Round a double to 6 decimals as floor(x * 1e6 + 0.5) / 1e6.

    The same IEEE operations in Spark and in the SQL oracle give bit-identical results (Spark's
    ``round`` goes through BigDecimal and breaks ties differently from binary rounding). Values too
    large for the integer in between (or infinite, or NaN) have no such decimals and stay as they are.
    """
    x = c_(x).cast("double")
    scale = float(10 ** DECIMALS)
    return F.when(F.isnan(x) | (F.abs(x) >= ROUND_LIMIT), x).otherwise(
        F.floor(x * scale + 0.5).cast("double") / scale)


def nan_inf_to_zero(x) -> Column:
    """NaN, +inf, -inf and null become 0."""
    x = c_(x).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def repaired(x) -> Column:
    """P7 for every element of an array; a null array stays null."""
    return F.transform(c_(x), nan_inf_to_zero)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(c_(a), c_(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(c_(a), lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0), lambda acc, v: acc + v))


def cosine(a, b) -> Column:
    """Zero-safe cosine similarity; 0.0 when either vector has zero norm."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), den))


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(c_(a), c_(b), lambda x, y: F.pow(y.cast("double") - x.cast("double"), 2)),
                              F.lit(0.0), lambda acc, v: acc + v))


def manhattan(a, b) -> Column:
    return F.aggregate(F.zip_with(c_(a), c_(b), lambda x, y: F.abs(y.cast("double") - x.cast("double"))),
                       F.lit(0.0), lambda acc, v: acc + v)


def vsub(a, b) -> Column:
    """Element-wise a - b as doubles."""
    return F.zip_with(c_(a), c_(b), lambda x, y: x.cast("double") - y.cast("double"))


def jaccard(inter, a_size, b_size) -> Column:
    """|A∩B| / |A∪B| from counts, 0 when the union is empty."""
    union = c_(a_size) + c_(b_size) - c_(inter)
    return safe_div(inter, union)


def array_jaccard(a, b) -> Column:
    a, b = F.array_distinct(c_(a)), F.array_distinct(c_(b))
    return safe_div(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
