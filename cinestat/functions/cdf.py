"""Column builders for discretised cumulative distributions on the support 0..BINS-1.

Two forms are used: an ``ARRAY<DOUBLE>`` of BINS probabilities (one row per
subject) and the long form ``(key, bin, p)``.  Expressions on ``bin`` rows stay
inside whole-stage codegen and are preferred wherever every bin is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cinestat.functions.bind import let

BINS = 600

# Coefficients of Abramowitz-Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A1 = 0.254829592
ERF_A2 = -0.284496736
ERF_A3 = 1.421413741
ERF_A4 = -1.453152027
ERF_A5 = 1.061405429

SQRT2 = 1.4142135623730951


def bins(n: int = BINS) -> Column:
    """``ARRAY<INT>`` 0..n-1, meant for ``explode``."""
    return F.sequence(F.lit(0), F.lit(n - 1))


def norm_cdf(x: Column, mu: Column, sigma: Column) -> Column:
    """Gaussian CDF; absolute error below 1e-7 (neither engine has ``erf``)."""
    z = (x - mu) / (sigma * F.lit(SQRT2))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(z))
    poly = F.lit(ERF_A5) * t + F.lit(ERF_A4)
    for a in (ERF_A3, ERF_A2, ERF_A1):
        poly = poly * t + F.lit(a)
    erf = F.lit(1.0) - poly * t * F.exp(-z * z)
    return F.lit(0.5) * (F.lit(1.0) + F.signum(z) * erf)


def step_cdf(bin_: Column, value: Column, convention: str = "strict") -> Column:
    """Step CDF at ``bin``; the conventions differ only where ``value == bin``."""
    if convention == "strict":
        return F.when(value < bin_, 1.0).otherwise(0.0)
    if convention == "half":
        return F.when(value < bin_, 1.0).when(value == bin_, 0.5).otherwise(0.0)
    if convention == "closed":
        return F.when(F.ceil(value) <= bin_, 1.0).otherwise(0.0)
    raise ValueError(f"unknown step convention {convention!r}")


def step_array(value: Column, n: int = BINS, convention: str = "strict") -> Column:
    """Step encoding of a label as an array."""
    return F.transform(bins(n), lambda j: step_cdf(j, value, convention))


def norm_array(mu: Column, sigma: Column, n: int = BINS) -> Column:
    """Gaussian CDF as an array."""
    return F.transform(bins(n), lambda j: norm_cdf(j, mu, sigma))


def ordinal_encode(cls: Column, n_classes: int = 4) -> Column:
    """Thermometer code: the first ``cls`` entries are 1."""
    return F.transform(bins(n_classes), lambda i: F.when(i < cls, 1.0).otherwise(0.0))


def ordinal_decode(code: Column) -> Column:
    """Number of leading non-zero entries."""
    first_zero = F.array_position(F.transform(code, lambda v: (v != 0).cast("int")), 0)
    return let(first_zero, lambda at: F.when(at == 0, F.size(code)).otherwise(at - 1).cast("int"))


def running_max(p: Column) -> Column:
    """Monotone correction of an array-valued CDF."""
    start = F.struct(
        F.lit(float("-inf")).alias("top"), F.array().cast("array<double>").alias("out")
    )

    def step(acc: Column, v: Column) -> Column:
        top = F.greatest(acc["top"], v)
        return F.struct(top.alias("top"), F.array_append(acc["out"], top).alias("out"))

    return F.aggregate(p, start, step, lambda acc: acc["out"])


def crps(label: Column, pred: Column) -> Column:
    """Mean squared difference of two array CDFs."""
    squares = F.zip_with(label, pred, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v) / F.size(label)


def harmonic_mean(a: Column, b: Column) -> Column:
    """2ab/(a+b), 0 where both are 0."""
    return F.coalesce(F.try_divide(F.lit(2.0) * a * b, a + b), F.lit(0.0))


def luminance(b: Column, g: Column, r: Column) -> Column:
    """Perceived brightness of a colour (fixed weights)."""
    return F.lit(0.114) * b + F.lit(0.587) * g + F.lit(0.299) * r


def regularized_heaviside(x: Column, eps: float = 1.0) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + F.lit(2.0) / F.pi() * F.atan(x / F.lit(eps)))


def regularized_delta(x: Column, eps: float = 1.0) -> Column:
    return F.lit(eps) / (F.pi() * (F.lit(eps * eps) + x * x))


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    """max(lo, min(x, hi)); NULL stays NULL (``greatest`` would skip it)."""
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)
