"""Reading order: lines of a page grouped into rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: str, at: Column, gap, order: list[Column], name: str) -> DataFrame:
    """Numbers groups of rows from 0: a new one starts where `at` is `gap` or more after that of the row before."""
    w = Window.partitionBy(key).orderBy(at, *order)
    new = F.when(at - F.lag(at).over(w) >= gap, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def row_groups(lines: DataFrame, key: str, order: list[Column], gap: int = 10) -> DataFrame:
    """Lines with row_id (chained by vertical centre) and pos, their place in the row from left to right."""
    rows = islands(lines, key, F.col("cy"), gap, order, "row_id")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(key, "row_id").orderBy("cx", *order)) - 1)


def matrix(cells: DataFrame, key: str) -> DataFrame:
    """Each row's texts by column, as arrays."""
    return cells.groupBy(key, "row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("texts"))


def grid(cells: DataFrame, key: str) -> DataFrame:
    """Each table's texts as an array of rows, empty where a cell is missing. cells: key, row_idx, col_idx, text."""
    at = F.map_from_entries(F.collect_list(F.struct(F.concat_ws(",", "row_idx", "col_idx"), "text")))
    found = cells.dropDuplicates([key, "row_idx", "col_idx"]).groupBy(key).agg(at.alias("at"), F.max("row_idx").alias("r"), F.max("col_idx").alias("c"))
    text = lambda i, j: F.coalesce(F.try_element_at("at", F.concat_ws(",", i, j)), F.lit(""))
    rows = F.transform(F.sequence(F.lit(0).cast("long"), F.col("r").cast("long")), lambda i: F.transform(F.sequence(F.lit(0).cast("long"), F.col("c").cast("long")), lambda j: text(i, j)))
    return found.select(key, rows.alias("rows"))


def ordinal(df: DataFrame, key: str, at: Column, order: list[Column], name: str) -> DataFrame:
    """Numbers a table's rows or columns from 0 by their centres."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(at, *order)) - 1)


def _order(tops: list[tuple], near: float) -> list[tuple]:
    """Boxes by (y, x), each then moved left past neighbours of about its height that start to the right of it."""
    out: list[tuple] = []
    for box in sorted(tops, key=lambda b: (b[1], b[0])):
        at = len(out)
        while at and abs(box[1] - out[at - 1][1]) < near and box[0] < out[at - 1][0]:
            at -= 1
        out.insert(at, box)
    return out


def reading_order(df: DataFrame, key: str, x: str, y: str, name: str = "place", near: float = 10) -> DataFrame:
    """Boxes with their place in reading order. Each depends on those before it, so a page is one array; Python sees many pages at once."""

    @F.pandas_udf("array<int>")
    def places(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([[t[2] for t in _order(list(zip(a, b, range(len(a)), strict=True)), near)] for a, b in zip(xs, ys, strict=True)], dtype=object)

    rest = [c for c in df.columns if c not in (key, x, y)]
    pages = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(y, x, *rest))).alias("__s"))
    at = lambda c: F.transform("__s", lambda r: r[c].cast("double"))
    each = pages.select(key, "__s", F.posexplode(places(at(x), at(y))).alias(name, "__i")).select(key, name, F.get("__s", F.col("__i")).alias("__r"))
    return each.select(*(F.col(c) if c == key else F.col(f"__r.{c}").alias(c) for c in df.columns), F.col(name).cast("long").alias(name))


_ROW = "row_id long, text string, x1 double, y1 double, x2 double, y2 double"


def _rows(boxes: list[dict], alpha: float) -> list[dict]:
    rows: list[list] = []
    for b in boxes:
        near = rows and all(abs(b["cy"] - m["cy"]) / max(0.01, min(b["h"], m["h"]) / 2) <= alpha for m in rows[-1])
        rows[-1].append(b) if near else rows.append([b])
    edge = lambda row, pick, at, size, sign: pick(m[at] + sign * m[size] / 2 for m in row)
    return [
        {"row_id": k, "text": " ".join(m["text"] or "" for m in sorted(row, key=lambda m: m["cx"])), "x1": edge(row, min, "cx", "w", -1), "y1": edge(row, min, "cy", "h", -1), "x2": edge(row, max, "cx", "w", 1), "y2": edge(row, max, "cy", "h", 1)}
        for k, row in enumerate(rows)
    ]


def merged_rows(df: DataFrame, key: str, order: str, alpha: float = 0.1) -> DataFrame:
    """Boxes (cx, cy, w, h, text) in the given order as rows: key, row_id, text, x1, y1, x2, y2.

    A box stays in the open row only if its centre is within alpha half heights of every
    member's; half of the lesser height counts. A row has its texts from left to right and the box around its members.
    """

    @F.pandas_udf(f"array<struct<{_ROW.replace(' ', ':').replace(',:', ',')}>>")
    def rows(pages: pd.Series) -> pd.Series:
        return pd.Series([_rows(list(p), alpha) for p in pages], dtype=object)

    sized = (F.col(c).cast("double").alias(c) for c in ("cx", "cy", "w", "h"))
    pages = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), *sized, "text"))).alias("__s"))
    lean = F.transform("__s", lambda r: F.struct(*(r[c].alias(c) for c in ("cx", "cy", "w", "h", "text"))))
    return pages.select(key, F.explode(rows(lean)).alias("r")).select(key, "r.*")
