"""Label bins as plain column expressions.

Bin edges are the doubles ``i * (1 / n)``. A label is placed by ``floor(y * n)``
and then moved by one bin where a comparison with the real edges says so; the
product alone puts a few labels on the wrong side of their edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldwise.constants import N_EDGES


def _missing(y: Column) -> Column:
    return y.isNull() | F.isnan(y)


def _left_closed(y: Column, n: int) -> Column:
    step = 1.0 / n
    guess = F.floor(y * F.lit(float(n)))
    return (
        guess
        - F.when(y < guess * F.lit(step), 1).otherwise(0)
        + F.when(y >= (guess + 1) * F.lit(step), 1).otherwise(0)
    )


def label_bin(y: Column, n_edges: int = N_EDGES) -> Column:
    """Left-closed bin number; the last bin takes 1 and anything above it.

    A label below 0 has no bin and stops the job.
    """
    n = n_edges - 1
    y = y.cast("double")
    placed = F.least(_left_closed(y, n), F.lit(n - 1)).cast("int")
    return (
        F.when(_missing(y), F.lit(None).cast("int"))
        .when(y < 0, F.raise_error(F.lit("label below 0")).cast("int"))
        .otherwise(placed)
    )


def bin_text(b: Column, n_edges: int = N_EDGES) -> Column:
    """Bin range such as ``[0.10, 0.11)``."""
    step = 1.0 / (n_edges - 1)
    return F.format_string("[%.2f, %.2f)", b * F.lit(step), (b + 1) * F.lit(step))


def report_bin(y: Column) -> Column:
    """Right-closed bins with exact 0 and 1 apart: 0 is {0}, i is ((i-1)/100, i/100], 101 is {1}."""
    y = y.cast("double")
    guess = F.ceil(y * 100.0)
    placed = (
        guess
        - F.when(y <= (guess - 1) / F.lit(100.0), 1).otherwise(0)
        + F.when(y > guess / F.lit(100.0), 1).otherwise(0)
    )
    return (
        F.when(_missing(y) | (y < 0) | (y > 1), F.lit(None))
        .when(y == 0, 0)
        .when(y == 1, 101)
        .otherwise(placed)
        .cast("int")
    )


def report_bin_centre(b: Column) -> Column:
    """Middle of a report bin; 0 and 1 stand for themselves."""
    return (
        F.when(b == 0, 0.0)
        .when(b == 101, 1.0)
        .otherwise(((b - 1) / F.lit(100.0) + b / F.lit(100.0)) / 2)
    )


def histogram_bin(y: Column, n: int) -> Column:
    """Equal-width bin on [0, 1]; the last bin is closed, outside values have none."""
    y = y.cast("double")
    return (
        F.when(_missing(y) | (y < 0) | (y > 1), F.lit(None))
        .otherwise(F.least(_left_closed(y, n), F.lit(n - 1)))
        .cast("int")
    )


def bin_centre(b: Column, n: int) -> Column:
    """Middle of an equal-width bin."""
    step = 1.0 / n
    return (b * F.lit(step) + (b + 1) * F.lit(step)) / 2
