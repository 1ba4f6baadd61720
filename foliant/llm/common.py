"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that makes up one in so many rows or more is looked up in a broadcast table, of so many rows at most.
SHARE_KEYS = 1 << 14
#: Python-side operators hand on a batch whenever it holds this many bytes of payload.
FLUSH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", binary: bool = True) -> DataFrame:
    """Just the id and the text (as UTF-8 bytes if `binary`), so other columns of any name can't clash."""
    text = df[text_col].cast("string")
    # An alias that changes nothing would keep equal exchanges of one query from being shared.
    same = id_col == "doc_id" and dict(df.dtypes)[id_col] == "bigint"
    return df.select(df[id_col] if same else df[id_col].cast("long").alias("doc_id"), (text.cast("binary") if binary else text).alias("text"))


def batched(rows: Iterable[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about FLUSH_BYTES each; weigh(row) is a row's size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weigh(row) + 64
        if size >= FLUSH_BYTES:
            yield to_batch(held, schema)
            held, size = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes | None]]:
    """(doc_id, text bytes) of each row of id_text()."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, doc_id in enumerate(ids):
            yield doc_id, texts[i].as_py()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; a temporary one only where it is unset and the session is local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        named = getattr(shared_dir, "own", None)
        if named is None:
            named = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="foliant-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def look_up(left: DataFrame, right: DataFrame, keys: list[str], share: int = SHARE_KEYS) -> DataFrame:
    """left with the other columns of right (null where there is none), whose `keys` are unique; both have them by these names.

    Rows of keys that make up 1 / `share` of left or more, at most `share`
    keys, stay where they are: their part of right is broadcast. Null keys match
    nothing and aren't moved. left is read several times.
    """
    known = left.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    rows = left.agg(F.count(F.lit(1)).alias("rows"))
    heavy = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(rows), F.col("n") * share >= F.col("rows")).select(*keys)
    often = known.join(F.broadcast(heavy), keys, "left_semi").join(F.broadcast(right.join(F.broadcast(heavy), keys, "left_semi")), keys, "left")
    others = known.join(F.broadcast(heavy), keys, "left_anti").join(right, keys, "left")
    empty = [F.lit(None).cast(t).alias(c) for c, t in right.dtypes if c not in keys]
    unknown = left.where(" OR ".join(f"{k} IS NULL" for k in keys)).select(*left.columns, *empty)
    columns = [*left.columns, *(c for c in right.columns if c not in keys)]
    return often.select(*columns).union(others.select(*columns)).union(unknown.select(*columns))


def unused(df: DataFrame, name: str) -> str:
    """name, or with underscores before it one that df has no column of."""
    while name.lower() in map(str.lower, df.columns):
        name = "_" + name
    return name


def cut(spark: SparkSession, df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(spark)
    return df.checkpoint(eager)
