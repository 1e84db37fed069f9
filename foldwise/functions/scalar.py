"""Scalar helpers: NaN handling, log-spaced lists, funnel widths, key names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldwise import constants as K


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def nan_if(condition: Column, c: Column) -> Column:
    return F.when(condition, F.lit(float("nan"))).otherwise(c)


def is_missing(c: Column, dtype: str) -> Column:
    """Null, or NaN where the type can hold one."""
    return c.isNull() | F.isnan(c) if dtype in ("double", "float") else c.isNull()


def bad_prediction(p: Column) -> Column:
    """Null, NaN, infinite, or beyond the overflow limit."""
    return p.isNull() | F.isnan(p) | (F.abs(p) > K.PREDICTION_LIMIT)


def param_key(model: Column, i: Column) -> Column:
    """``<model>_hp_<i>``."""
    return F.concat(model, F.lit("_hp_"), i.cast("string"))


def is_default_key(key: Column) -> Column:
    return F.lower(key).endswith(K.DEFAULT_KEY_SUFFIX)


def logspace(low: Column, high: Column, n: Column) -> Column:
    """``n`` powers of ten with exponents evenly spaced from ``low`` to ``high``."""
    low, high, n = low.cast("double"), high.cast("double"), n.cast("int")
    step = F.when(n > 1, (high - low) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)
    return F.when(n < 1, F.array().cast("array<double>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.pow(F.lit(10.0), low + i * step))
    )


def _stepped(value: Column) -> Column:
    return (F.bround(value / K.FUNNEL_STEP, 0) * K.FUNNEL_STEP).cast("int")


def linear_funnel(n: Column) -> Column:
    """Widths falling evenly from 256 to 8, each a multiple of 8 and at least 8."""
    n = n.cast("int")
    start, end = float(K.FUNNEL_START), float(K.FUNNEL_END)
    step = (F.lit(end) - start) / F.greatest(n - 1, F.lit(1))
    last = F.greatest(n, F.lit(1)) - 1
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.greatest(
            _stepped(F.when((i == last) & (n > 1), F.lit(end)).otherwise(i * step + start)), F.lit(K.FUNNEL_END)
        ),
    )


def log_funnel(n: Column) -> Column:
    """Widths falling by a constant ratio from 256 to 8; a single layer keeps 256."""
    n = n.cast("int")
    ratio = F.pow(F.lit(K.FUNNEL_END / K.FUNNEL_START), F.lit(1.0) / F.greatest(n - 1, F.lit(1)))
    return F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
        lambda i: _stepped(F.lit(float(K.FUNNEL_START)) * F.pow(ratio, i)),
    )


def hidden_widths(n: Column, explicit: Column) -> Column:
    """Widths given by a map for up to nine layers, the linear funnel beyond that or without an entry."""
    listed = F.try_element_at(explicit, n)
    return F.when((n <= K.EXPLICIT_WIDTHS_MAX_LAYERS) & listed.isNotNull(), listed).otherwise(linear_funnel(n))


def flatten_pairs(real: Column, pred: Column) -> Column:
    """Two lists of lists as one list of (real, pred) pairs."""
    return F.arrays_zip(F.flatten(real).alias("real"), F.flatten(pred).alias("pred"))


def run_stamp() -> Column:
    """Time text for run names."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd-HHmmss")


# Published coefficients of Acklam's approximation, for the middle (numerator, denominator) and the tails.
ACKLAM = (
    [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00],
    [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0],
    [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00],
    [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0],
)
ACKLAM_CUT = 0.02425


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal by Acklam's rational approximation."""
    a, b, c, d = ACKLAM

    def poly(coefs: list[float], x: Column) -> Column:
        out = F.lit(coefs[0])
        for k in coefs[1:]:
            out = out * x + k
        return out

    low_t = F.sqrt(F.log(p) * -2.0)
    high_t = F.sqrt(F.log(F.lit(1.0) - p) * -2.0)
    q = p - 0.5
    r = q * q
    return (
        F.when(p < ACKLAM_CUT, poly(c, low_t) / poly(d, low_t))
        .when(p > 1 - ACKLAM_CUT, -poly(c, high_t) / poly(d, high_t))
        .otherwise(poly(a, r) * q / poly(b, r))
    )
