"""Files as DataFrames: image listings, payloads, class lists, metric tables, OFD invoices, addresses."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as t

# Endings of files that are taken.
IMAGES = ("bmp", "dng", "jpeg", "jpg", "mpo", "png", "tif", "tiff", "webp", "pfm")
VIDEOS = ("asf", "avi", "gif", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "ts", "wmv")


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def read_files(spark: SparkSession, path: str, endings: tuple[str, ...] = IMAGES, content: bool = True) -> DataFrame:
    """path, kind, class (the folder's name), size, modified and content of the files below a folder; empty ones are left out.

    Without content the scan lists files and opens none.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(ending(F.col("path")).isin(*endings) & (F.col("length") > 0))
    kind = F.when(ending(F.col("path")).isin(*VIDEOS), "video").otherwise("image")
    return found.select("path", kind.alias("kind"), F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("class"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def with_labels(files: DataFrame, labels: DataFrame) -> DataFrame:
    """Each file's state by its label rows (label_path, valid; one row per line): missing, corrupt or found."""
    of = labels.groupBy(F.col("label_path").alias("__path")).agg(F.min("valid").alias("__valid"))
    state = F.when(F.col("__path").isNull(), "missing").when(F.col("__valid"), "found").otherwise("corrupt")
    joined = files.withColumn("label_path", t.label_path(F.col("path"))).join(of, F.col("label_path") == F.col("__path"), "left")
    return joined.withColumn("state", state).drop("__path", "__valid")


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """cls (from 0, in file order) and name of a class list, one name on each line."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("cls", "name"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric tables whose header and cells are padded with spaces."""
    raw = spark.read.csv(path, header=True, inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.toDF(*(c.strip() for c in raw.columns))


def read_flat_lines(spark: SparkSession, path: str, truth: bool) -> DataFrame:
    """page, idx, points, text (and ignored for true lines) of evaluation files: eight coordinates, tab-separated, and what follows.

    Lines with too few parts are left out of true ones. The page is the file's name.
    """
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("page"), F.posexplode(F.split("value", "\n")).alias("idx", "line"))
    p = F.split(t.strip(F.col("line")), "\t")
    corners = F.array(*(F.array(*(F.get(p, F.lit(2 * k + j)).try_cast("double") for j in (0, 1))) for k in range(4)))
    at = 9 if truth else 8
    rows = raw.where(F.size(p) >= (9 if truth else 8)).select("page", "idx", corners.alias("points"), F.coalesce(F.get(p, F.lit(at)), F.lit("")).alias("text"), *([(F.get(p, F.lit(8)) != "0").alias("ignored")] if truth else []))
    return rows.where("page IS NOT NULL")


def _entries(blob: bytes | None) -> list[tuple[str, str]] | None:
    """Name and value of the custom data in an OFD file's OFD.xml, null if it is no such file; of equal names the last."""
    try:
        with zipfile.ZipFile(io.BytesIO(blob or b"")) as z:
            root = ET.fromstring(z.read("OFD.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return None
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    found = {child.get("Name") or "": child.text or "" for e in root.iter() if local(e) == "CustomDatas" for child in e}
    return list(found.items())


def read_ofd(spark: SparkSession, path: str) -> DataFrame:
    """path, info (name to value) of OFD files; info is null for broken ones."""

    @F.pandas_udf("array<struct<name:string,value:string>>")
    def entries(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if (e := _entries(b)) is None else [{"name": n, "value": v} for n, v in e] for b in blobs], dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", F.map_from_entries(entries("content")).alias("info"))


def fetch(df: DataFrame, url: str, get: Callable[[str], bytes]) -> DataFrame:
    """Rows with content and error: what `get` brings for each address, in batches of rows. A failure stays with its row."""
    names = df.columns

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [_tried(get, u) for u in part[url]]
            yield part.assign(content=[g[0] for g in got], error=[g[1] for g in got])[[*names, "content", "error"]]

    return df.mapInPandas(batches, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "content binary", "error string"]))


def _tried(get, value):
    try:
        return get(value), None
    except Exception as e:  # whatever the caller's function raises belongs to this row alone
        return None, f"{type(e).__name__}: {e}"
