"""Native column mathematics: safe ratios and distribution functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Coefficients of the published Chebyshev fit of erfc (fractional error below 1.2e-7).
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(_c(a), _c(b))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(float(low))), F.lit(float(high)))


def erfc_positive(z: Column) -> Column:
    """Complementary error function for z >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + z * 0.5)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-z * z + poly)


def two_sided_normal_p(z: Column | str) -> Column:
    """P(|Z| >= |z|) of a standard normal."""
    return erfc_positive(F.abs(_c(z)) / F.sqrt(F.lit(2.0)))


def normal_cdf(z: Column | str) -> Column:
    z = _c(z)
    tail = two_sided_normal_p(z) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def sql_two_sided_normal_p(z: str) -> str:
    """The same expression as SQL text, for oracles."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + {x} * 0.5))"
    poly = repr(ERFC_COEFFICIENTS[-1]) + "::DOUBLE"
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({c!r}::DOUBLE + {t} * {poly})"
    return f"({t} * exp(-{x} * {x} + {poly}))"
