"""Results as files: responses, line files, page files, metric tables, splits, galleries, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def responses(items: DataFrame, request: str) -> DataFrame:
    """request, body, succeeded: JSON of each request's items (attachment_id, success, message, data) in order of their ids."""
    parts = F.sort_array(F.collect_list(F.struct("attachment_id", "success", "message", F.to_json("data").alias("data"))))
    # Data are JSON already; sorting needs a type with an order, which maps don't have.
    each = F.transform(parts, lambda p: F.concat(F.lit('{"attachment_id":'), F.coalesce(p["attachment_id"].cast("string"), F.lit("null")), F.lit(',"success":'), F.coalesce(p["success"], F.lit(False)).cast("string"), F.lit(',"message":'), _quoted(p["message"]), F.lit(',"data":'), F.coalesce(p["data"], F.lit("{}")), F.lit("}")))
    grouped = items.groupBy(request).agg(each.alias("__e"), F.count_if("success").alias("succeeded"))
    return grouped.select(request, F.concat(F.lit('{"result":['), F.array_join("__e", ","), F.lit('],"code":200}')).alias("body"), "succeeded")


def _quoted(s: Column) -> Column:
    """A JSON string; the array around it goes."""
    j = F.to_json(F.array(F.coalesce(s, F.lit(""))))
    return F.substr(j, F.lit(2), F.length(j) - 2)


def write_json_lines(df: DataFrame, key: str, value: str, path: str) -> None:
    """Lines of a key, a tab and JSON."""
    df.select(F.concat_ws("\t", F.col(key).cast("string"), F.to_json(value)).alias("value")).write.text(path)


def write_pages(lines: DataFrame, page: str, order: str, line: str, path: str) -> None:
    """A folder per page with its lines in order; pages are written by many tasks, each by one."""
    lines.select(page, order, F.col(line).alias("value")).repartition(page).sortWithinPartitions(page, order).drop(order).write.partitionBy(page).text(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """One more CSV part with a header of its own; readers skip each part's header."""
    df.coalesce(1).write.mode("append").option("header", True).csv(path)  # a row per step: always small


def write_splits(df: DataFrame, file: str, split: str, path: str) -> None:
    """List files of each split."""
    df.select(split, F.concat(F.lit("./"), file).alias("value")).write.partitionBy(split).text(path)


def write_cache(df: DataFrame, path: str, version: str) -> None:
    """Rows as Parquet with their version and hash."""
    df.withColumn("cache_version", F.lit(version)).withColumn("row_hash", F.xxhash64(*df.columns)).write.parquet(path)


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Rows of write_cache(); those of another version or with a changed hash are left out."""
    raw = spark.read.parquet(path)
    own = [c for c in raw.columns if c not in ("cache_version", "row_hash")]
    return raw.where((F.col("cache_version") == version) & (F.col("row_hash") == F.xxhash64(*own))).select(*own)


def gallery(df: DataFrame, group: str, name: str, src: str) -> DataFrame:
    """group, html: a table of each group's images by file name."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct(name, src))), lambda x: F.concat(F.lit("<tr><td>"), x[name], F.lit('</td><td><img src="'), x[src], F.lit('"></td></tr>')))
    return df.groupBy(group).agg(F.concat(F.lit("<table>"), F.array_join(cells, ""), F.lit("</table>")).alias("html"))
