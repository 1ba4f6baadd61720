"""Ranks and running sums over one long order, without a task that holds all of it.

A window over a whole class or table runs in one task. Here rows fall into
steps by `coarse`, expressions that rise with the order; sums of the steps are
small, and their running sums are joined back to a window within each step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(df: DataFrame, keys: Sequence[str], coarse: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """The rows with their step's columns; a falling order is given by negated expressions."""
    names = [f"__s{k}" for k in range(len(coarse))]
    return df.withColumns(dict(zip(names, coarse, strict=True))), [*keys, *names]


def before(stepped: DataFrame, keys: Sequence[str], by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Each step's sums over all earlier steps of its keys."""
    whole = stepped.groupBy(*by).agg(*(f.alias(name) for name, f in sums.items()))
    return _running(whole, keys, [c for c in by if c not in keys], list(sums))


def _running(whole: DataFrame, keys: Sequence[str], own: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Running sums level by level: a window holds the steps of one value of the level above, and one of a key only the first level's."""
    above, inner = [*keys, *own[:-1]], own[-1]
    w = Window.partitionBy(*above).orderBy(inner).rowsBetween(Window.unboundedPreceding, -1)
    out = whole.select(*above, inner, *(F.coalesce(F.sum(name).over(w), F.lit(0)).alias(name) for name in names))
    if len(own) == 1:
        return out
    upper = whole.groupBy(*above).agg(*(F.sum(name).alias(name) for name in names))
    earlier = _running(upper, keys, own[:-1], names).withColumnsRenamed({name: f"up_{name}" for name in names})
    return joined(out, earlier, above).select(*above, inner, *((F.col(name) + F.col(f"up_{name}")).alias(name) for name in names))


def joined(stepped: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the columns of their step."""
    right = offsets.withColumnsRenamed({c: f"r{c}" for c in by})
    match = [stepped[c].eqNullSafe(right[f"r{c}"]) for c in by]
    on = match[0]
    for m in match[1:]:
        on = on & m
    return stepped.join(right, on).drop(*(f"r{c}" for c in by))


def global_rank(df: DataFrame, coarse: Sequence[Column], order: Sequence[Column], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows numbered from 0 in the whole order of each key."""
    stepped, by = steps(df, keys, coarse)
    out = joined(stepped, before(stepped, keys, by, {"__before": F.count("*")}), by)
    inner = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return out.withColumn(name, (F.col("__before") + inner - 1).cast("long")).drop("__before", *(c for c in by if c not in keys))


def batches(df: DataFrame, coarse: Sequence[Column], order: Sequence[Column], size: int, name: str = "batch") -> DataFrame:
    """Rows with the number of their batch of `size` rows, in the whole order; ids make scattering the results back a join."""
    return global_rank(df, coarse, order, "__rank").withColumn(name, F.floor(F.col("__rank") / size)).drop("__rank")


def places(df: DataFrame, batch: str, key: str, name: str = "place") -> DataFrame:
    """Rows with their image's number within its batch, from 0 in the order of its key; an image may have several rows."""
    images = df.select(batch, key).distinct()
    numbered = images.withColumn(name, (F.row_number().over(Window.partitionBy(batch).orderBy(key)) - 1).cast("long"))
    return joined(df, numbered, [batch, key])


def first_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of a total order; each task hands on n at most."""
    return df.orderBy(*order).limit(n)


def shape_batches(df: DataFrame, ratio: Column, coarse: Sequence[Column], order: Sequence[Column], size: int, image: int = 640, stride: int = 32, pad: float = 0.5) -> DataFrame:
    """Rows in batches of `size` by falling width over height; batch, batch_h and batch_w (multiples of stride).

    ratio is height over width. A batch of only wide or only tall images is as
    long as needed on the other side.
    """
    ranked = global_rank(df.withColumn("__ratio", ratio), coarse, order, "__rank").withColumn("batch", F.floor(F.col("__rank") / size))
    w = Window.partitionBy("batch")
    low, high = F.min("__ratio").over(w), F.max("__ratio").over(w)
    side = lambda x: (F.ceil(x * image / stride + pad) * stride).cast("long")
    out = ranked.withColumn("batch_h", side(F.when(high < 1, high).otherwise(1.0))).withColumn("batch_w", side(F.when(low > 1, 1 / low).otherwise(1.0)))
    return out.drop("__ratio", "__rank")
