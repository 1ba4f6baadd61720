"""Names for intermediate values within an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once; keeps trees small where it is used several times."""
    return F.transform(F.array(value), f)[0]
