"""Sample statistics that Spark only has for populations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(x: str) -> Column:
    """Skewness with the bias correction sqrt(n (n-1)) / (n-2); null below three rows."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def sample_excess_kurtosis(x: str) -> Column:
    """Excess kurtosis with the bias correction; null below four rows."""
    n = F.count(x)
    return F.when(n > 3, (n - 1) * ((n + 1) * F.kurtosis(x) + 6) / F.nullif((n - 2) * (n - 3), F.lit(0)))
