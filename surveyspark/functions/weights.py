"""Survey weights.  The multiplier carries two implied decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_weight(multiplier: str = "Multiplier", nss: str = "NSS", nsc: str = "NSC") -> Column:
    """Multiplier over 100 where both sampling counts agree, over 200 where they differ.

    A missing count never equals anything, so it takes the 200 branch.
    """
    same = F.coalesce(F.col(nss) == F.col(nsc), F.lit(False))
    return F.col(multiplier).cast("double") / F.when(same, F.lit(100.0)).otherwise(F.lit(200.0))


def annual_weight(multiplier: str = "Multiplier", nss: str = "NSS", nsc: str = "NSC",
                  quarters: str = "Contributing_quarters") -> Column:
    """Quarter weight spread over the quarters that the sampling group contributes."""
    return quarter_weight(multiplier, nss, nsc) / F.col(quarters).cast("double")


def historical_weight(multiplier: str = "Multiplier", nss: str = "NSS", nsc: str = "NSC") -> Column:
    """Quarter weight kept in single precision.

    Here two missing counts agree (``<=>``), unlike in :func:`quarter_weight`.
    """
    same = F.col(nss).eqNullSafe(F.col(nsc))
    weight = F.col(multiplier).cast("double") / F.when(same, F.lit(100.0)).otherwise(F.lit(200.0))
    return weight.cast("float").cast("double")


def unconditional_weight(multiplier: str = "Multiplier") -> Column:
    return (F.col(multiplier).cast("double") / F.lit(100.0)).cast("float").cast("double")
