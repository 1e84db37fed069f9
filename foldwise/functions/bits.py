"""Order-preserving whole-number keys of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BITS = 64
_FRACTION = 52
_BIAS = 1023


def with_order_key(df: DataFrame, x: Column, name: str) -> DataFrame:
    """``df`` with a long that sorts as the double ``x`` does: sign, exponent and fraction of the stored value, negative values mirrored.

    Both zeros have key 0, the infinities the two outermost keys; null and NaN have none. Every step is exact: scaling by a
    power of two, taking 1 off a number in [1, 2), and whole numbers below 2^53. The steps are columns of their own, as each is used more than once.
    """
    kept = df.columns
    a, e = F.col("_size"), F.col("_power")
    two = F.lit(2.0)
    df = df.withColumn("_x", x.cast("double")).withColumn("_size", F.abs("_x"))
    # The logarithm may round to the next whole number on either side of a power of two.
    df = df.withColumn("_power", F.least(F.greatest(F.floor(F.log2(a)), F.lit(1 - _BIAS)), F.lit(_BIAS)).cast("int"))
    over, under = F.pow(two, e) > a, (e < _BIAS) & (F.pow(two, F.least(e + 1, F.lit(_BIAS))) <= a)
    df = df.withColumn("_power", e - over.cast("int") + under.cast("int"))
    fraction = ((a / F.pow(two, e) - 1.0) * float(2**_FRACTION)).cast("long")
    size = (
        F.when(a == float("inf"), F.lit((2 * _BIAS + 1) << _FRACTION))
        .when(a >= 2.0 ** (1 - _BIAS), F.shiftleft((e + _BIAS).cast("long"), _FRACTION) + fraction)
        # Below the smallest normal number the fraction alone counts.
        .otherwise((a * 2.0**537 * 2.0**537).cast("long"))
    )
    df = df.withColumn("_size", F.when(F.col("_x").isNotNull() & ~F.isnan("_x"), size))
    return df.select(*kept, F.when(F.col("_x") < 0, -F.col("_size")).otherwise(F.col("_size")).alias(name))
