"""Latest value of each source in a stream: older frames are replaced, none is queued."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, source: str, at: str, tie: str) -> DataFrame:
    """The newest row of each source, by `at`, then `tie`; for batches, and for streams in complete or update mode."""
    rest = [c for c in df.columns if c != source]
    return df.groupBy(source).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(source, *(F.col(f"r.{c}").alias(c) for c in rest))
