"""Joins and suppression over detected boxes. Every join carries the page's key, so none is a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import geometry as g


def cells(rows: DataFrame, columns: DataFrame, key: str) -> DataFrame:
    """Cells where a table's rows and columns overlap: their intersection and the lesser confidence."""
    r, c = rows.alias("r"), columns.alias("c")
    a, b = g.box("r."), g.box("c.")
    joined = r.join(c, (F.col(f"r.{key}") == F.col(f"c.{key}")) & g.overlaps(a, b))
    return joined.select(
        F.col(f"r.{key}").alias(key), F.col("r.idx").alias("row_idx"), F.col("c.idx").alias("col_idx"),
        F.greatest(a[0], b[0]).alias("x1"), F.greatest(a[1], b[1]).alias("y1"), F.least(a[2], b[2]).alias("x2"), F.least(a[3], b[3]).alias("y2"),
        F.least("r.conf", "c.conf").alias("conf"),
    )


def pairs(left: DataFrame, right: DataFrame, key: str, least: float, kind: str = "iou") -> DataFrame:
    """Pairs of one page whose overlap ratio is over `least`; columns are prefixed l_ and r_."""
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    return a.join(b, F.col(f"l_{key}") == F.col(f"r_{key}")).withColumn("iou", g.iou(g.box("l_"), g.box("r_"), kind)).where(F.col("iou") > least)


def best_matches(found: DataFrame, detection: Sequence[str], truth: Sequence[str]) -> DataFrame:
    """Of pairs, the best for each detection, then of those the best for each truth; not greedy."""
    order = [F.desc("iou"), *(F.col(c) for c in (*detection, *truth))]
    once = found.withColumn("__n", F.row_number().over(Window.partitionBy(*detection).orderBy(*order))).where("__n = 1")
    return once.withColumn("__n", F.row_number().over(Window.partitionBy(*truth).orderBy(*order))).where("__n = 1").drop("__n")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in the given total order; rows are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*(F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns))


def _fold(s: Column, clash) -> Column:
    """Of a sorted array, the members that clash with no kept one before them."""
    return F.aggregate(s, F.slice(s, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: clash(k, x)), kept).otherwise(F.array_append(kept, x)))


def _kept(boxes: np.ndarray, cls: np.ndarray, threshold: float, most: int) -> list[int]:
    """Places of the boxes (sorted, the best first) that no kept one of their class overlaps more than `threshold`; `most` at most."""
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    open_, out = np.ones(len(boxes), bool), []
    while len(out) < most and open_.any():
        k = int(open_.argmax())
        out.append(k)
        side = np.minimum(boxes[:, 2:], boxes[k, 2:]) - np.maximum(boxes[:, :2], boxes[k, :2])
        inter = np.maximum(side, 0).prod(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            open_ &= ~((inter / (area + area[k] - inter) > threshold) & (cls == cls[k]))
        open_[k] = False
    return out


def suppress(df: DataFrame, page: str, cls: str, order: Sequence[str], threshold: float, most: int = 300, most_in: int = 30000, small: int = 64) -> DataFrame:
    """Non-maximum suppression on each page: by falling confidence, a box goes if a kept one of its class overlaps it more than `threshold`.

    Of a page's boxes the `most_in` best are looked at, and the `most` best kept
    ones returned, over all classes: these limits are part of the operator. `order` settles equal
    confidences. A page is one array: one of up to `small` boxes is folded in place, larger ones go to Python, many at
    once, where each kept box is compared with all others by numpy. Which way a page goes changes no result.
    """
    rest = [c for c in df.columns if c != page]
    rows = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("__neg"), *order, *(c for c in rest if c not in order)))), 1, most_in)

    @F.pandas_udf("array<int>")
    def kept(corners: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else _kept(np.asarray(c, float).reshape(-1, 4), np.asarray(k), threshold, most) for c, k in zip(corners, kinds, strict=True)], dtype=object)

    def clash(k: Column, x: Column) -> Column:
        a, b = (tuple(z[c].cast("double") for c in ("x1", "y1", "x2", "y2")) for z in (k, x))
        inter = g.intersection(a, b)
        return (k[cls] == x[cls]) & (inter / F.nullif(g.area(a) + g.area(b) - inter, F.lit(0.0)) > threshold)

    pages = df.groupBy(page).agg(rows.alias("__s"))
    corners = F.flatten(F.transform("__s", lambda x: F.array(*(x[c].cast("double") for c in ("x1", "y1", "x2", "y2")))))
    large = lambda x: F.when(F.size("__s") > small, x)
    told = pages.select(page, "__s", kept(large(corners), large(F.transform("__s", lambda x: x[cls]))).alias("__i"))
    rows = F.when(F.size("__s") > small, F.transform("__i", lambda i: F.get("__s", i))).otherwise(F.slice(_fold(F.col("__s"), clash), 1, most))
    found = told.select(page, F.explode(rows).alias("__x"))
    return found.select(*(F.col(c) if c == page else F.col(f"__x.{c}").alias(c) for c in df.columns))


def of_classes(df: DataFrame, classes: Sequence, cls: str = "cls") -> DataFrame:
    """The rows of the given classes."""
    return df.where(F.col(cls).isin(*classes))


def ensemble(*predictions: DataFrame) -> DataFrame:
    """Several models' or pages' rows as one table, columns matched by name."""
    out = predictions[0]
    for more in predictions[1:]:
        out = out.unionByName(more)
    return out


def with_given(predictions: DataFrame, given: DataFrame, conf: str = "conf") -> DataFrame:
    """Predictions and labels known beforehand, which are sure: confidence 1."""
    return ensemble(predictions, given.withColumn(conf, F.lit(1.0).cast(predictions.schema[conf].dataType)))


def confirmed(df: DataFrame, second: DataFrame, key: Sequence[str], cls: str) -> DataFrame:
    """The rows for which a second classifier (key, cls) says the same class."""
    other = second.select(*(F.col(k).alias(f"__{k}") for k in key), F.col(cls).alias("__second"))
    same = F.col(cls) == F.col("__second")
    for k in key:
        same &= F.col(k) == F.col(f"__{k}")
    return df.join(other, same, "left_semi")


def unmatched(rows: DataFrame, matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that no match names."""
    return rows.join(matched, list(keys), "left_anti")


def smallest_half(df: DataFrame, page: str, order: Sequence[str]) -> DataFrame:
    """Of each page's boxes the half with the least mean side, rounded."""
    w = Window.partitionBy(page)
    ranked = df.withColumn("__n", F.row_number().over(w.orderBy(F.col("x2") - F.col("x1") + F.col("y2") - F.col("y1"), *order))).withColumn("__of", F.count("*").over(w))
    return ranked.where(F.col("__n") <= F.bround(F.col("__of") / 2)).drop("__n", "__of")


def greedy_match(found: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """One-to-one matching by falling overlap in each page: key, left, right, iou."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("neg"), F.col(left).alias("a"), F.col(right).alias("b"))))
    kept = _fold(F.col("__s"), lambda k, x: (k["a"] == x["a"]) | (k["b"] == x["b"]))
    return found.groupBy(key).agg(rows.alias("__s")).select(key, F.explode(kept).alias("m")).select(key, F.col("m.a").alias(left), F.col("m.b").alias(right), (-F.col("m.neg")).alias("iou"))


def quad_pairs(left: DataFrame, right: DataFrame, key: str, least: float) -> DataFrame:
    """pairs() for quads, given as points: the overlap ratio of convex hulls. Only pairs whose bounds overlap reach Python, in Arrow batches."""
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    found = a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & g.overlaps(g.bounds(F.col("l_points")), g.bounds(F.col("r_points"))))
    return found.withColumn("iou", _quad_iou()("l_points", "r_points")).where(F.col("iou") > least)


def _quad_iou():
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([g.polygon_iou(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio


def nearest_line(cells: DataFrame, lines: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """Cells with the idx of the nearest line of their table by centre `at`, the least idx on a tie; null without lines.

    A table's lines travel as one array, so cells meet them without pairs.
    """
    of = lines.groupBy(F.col(key).alias("__key")).agg(F.collect_list(F.struct(F.col(at).alias("at"), F.col("idx").alias("idx"))).alias("__lines"))
    best = F.array_min(F.transform("__lines", lambda x: F.struct(F.abs(x["at"] - F.col(at)).alias("far"), x["idx"].alias("idx"))))
    return cells.join(of, F.col(key) == F.col("__key"), "left").withColumn(name, best["idx"]).drop("__key", "__lines")


def merged(kept: DataFrame, all_boxes: DataFrame, key: str, threshold: float) -> DataFrame:
    """Kept boxes moved to the mean, weighted by confidence, of all boxes of their page and class that overlap them."""
    found = pairs(kept, all_boxes, key, threshold).where("l_cls = r_cls")
    mean = [(F.sum(F.col(f"r_{c}") * F.col("r_conf")) / F.sum("r_conf")).alias(c) for c in ("x1", "y1", "x2", "y2")]
    rest = [c for c in kept.columns if c not in ("x1", "y1", "x2", "y2")]
    return found.groupBy(*(F.col(f"l_{c}").alias(c) for c in rest)).agg(*mean)


def labelled(df: DataFrame, scores: str, least: float) -> DataFrame:
    """A row for each class whose score times objectness is over `least`: columns cls and conf."""
    rest = [c for c in df.columns if c not in (scores, "obj")]
    each = df.where(F.col("obj") > least).select(*rest, "obj", F.posexplode(scores).alias("cls", "__s"))
    return each.select(*rest, "cls", (F.col("obj") * F.col("__s")).alias("conf")).where(F.col("conf") > least)


def mask_iou(a: Column, b: Column) -> Column:
    """Overlap ratio of two masks as flat arrays of 0 and 1."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda n, v: n + v)
    inter = total(F.zip_with(a, b, lambda x, y: x * y))
    return inter / (total(a) + total(b) - inter + g.EPS)
