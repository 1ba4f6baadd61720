"""Every n-th row of each source, in batches and in streams, and streams that keep the latest row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.streaming.latest import latest


def every_nth(df: DataFrame, source: str, order: list[str], n: int) -> DataFrame:
    """Rows n, 2n, ... of each source in order."""
    w = Window.partitionBy(source).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") % n == 0).drop("__k")


def every_nth_stream(stream: DataFrame, source: str, order: list[str], n: int) -> DataFrame:
    """every_nth() of a stream: a count per source lives in the state store; rows of one trigger are taken in order."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(parts).sort_values(order, kind="stable")
        state.update((seen + len(rows),))
        yield rows[[(seen + k) % n == 0 for k in range(1, len(rows) + 1)]]

    return stream.groupBy(source).applyInPandasWithState(step, stream.schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def run_latest(stream: DataFrame, source: str, at: str, tie: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps each source's newest row in a Parquet table under `path`; older rows are replaced and none is queued.

    Each trigger writes the table anew beside the last two, so readers of the last one aren't disturbed
    and a trigger that is run again writes the same. Nothing passes through the driver; a row per source is kept.
    """

    def keep(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        found = [k for k in _epochs(spark, path) if k < epoch]
        whole = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/epoch={found[-1]}")) if found else batch
        latest(whole, source, at, tie).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        for old in found[:-1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={old}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The table of run_latest() as the last whole trigger left it."""
    return spark.read.parquet(f"{path}/epoch={_epochs(spark, path)[-1]}")


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """The triggers whose table is wholly written, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName().removeprefix("epoch=")) for f in found or [])


def read_stream(spark, path: str, schema) -> DataFrame:
    """Parquet files as they arrive, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)
