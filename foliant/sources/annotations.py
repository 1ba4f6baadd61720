"""Annotation and label files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "array<struct<transcription:string,points:array<array<double>>,score:string>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """image, line_no, text, points, score of annotation files: a path, a tab and a JSON array on each line."""
    raw = spark.read.text(path).select(F.split("value", "\t", 2).alias("p"))
    return raw.select(F.col("p")[0].alias("image"), F.posexplode(F.from_json(F.get("p", F.lit(1)), LINE))).select(
        "image", F.col("pos").alias("line_no"), F.col("col.transcription").alias("text"), F.col("col.points").alias("points"), F.col("col.score").try_cast("double").alias("score")
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """The reverse of read_lines()."""
    rows = F.sort_array(F.collect_list(F.struct("line_no", F.struct(F.col("text").alias("transcription"), "points", F.col("score").cast("string").alias("score")).alias("x"))))
    lines.groupBy("image").agg(F.to_json(F.transform(rows, lambda r: r["x"])).alias("j")).select(F.concat_ws("\t", "image", "j").alias("value")).write.text(path)


def true_lines(lines: DataFrame, least: float = 0.5) -> DataFrame:
    """Annotated lines as truth: those scored below `least` go (unscored ones stay), wide blanks are plain ones, and ### is ignored."""
    kept = lines.where(F.col("score").isNull() | (F.col("score") >= least))
    text = F.translate("text", "\u3000", " ")
    return kept.withColumn("text", text).withColumn("ignored", F.col("text") == "###")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """label_rows() of label files, which are read whole."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.trim("value"), "\n")).alias("line_no", "line"))
    return label_rows(raw)


def label_rows(raw: DataFrame) -> DataFrame:
    """file, line_no, cls, x, y, w, h (centre and size), points and valid of label lines (file, line_no, line), repeated rows once.

    Where any line of a file has more than six parts, its lines are polygons, and the box is that around the points;
    otherwise points is null. A row is valid with a class of 0 at least and all values within 0 to 1.
    """
    v = F.split(F.trim("line"), r"\s+")
    parts = raw.where("trim(line) <> ''").select("file", "line_no", F.transform(v, lambda s: s.try_cast("double")).alias("v"))
    outlined = parts.groupBy(F.col("file").alias("__file")).agg((F.max(F.size("v")) > 6).alias("__outlined"))
    points = F.slice("v", 2, 1 << 30)
    xs, ys = F.filter(points, lambda _, i: i % 2 == 0), F.filter(points, lambda _, i: i % 2 == 1)
    box = lambda a: ((F.array_min(a) + F.array_max(a)) / 2, F.array_max(a) - F.array_min(a))
    (cx, w), (cy, h) = box(xs), box(ys)
    n = lambda k: F.get("v", F.lit(k))
    pick = lambda a, b: F.when(F.col("__outlined"), a).otherwise(b)
    rows = parts.join(outlined, F.col("file") == F.col("__file")).select(
        "file", "line_no", n(0).cast("int").alias("cls"), pick(cx, n(1)).alias("x"), pick(cy, n(2)).alias("y"), pick(w, n(3)).alias("w"), pick(h, n(4)).alias("h"),
        F.when(F.col("__outlined"), F.arrays_zip(xs.alias("x"), ys.alias("y"))).alias("points"), "v", "__outlined",
    )
    size = F.when(F.col("__outlined"), (F.size("v") >= 7) & (F.size("v") % 2 == 1)).otherwise(F.size("v") == 5)
    whole = F.forall("v", lambda x: F.coalesce(x >= 0, F.lit(False))) & F.forall(points, lambda x: F.coalesce(x <= 1, F.lit(False)))
    first = rows.groupBy("file", "v").agg(F.min("line_no").alias("line_no"), *(F.first(c).alias(c) for c in ("cls", "x", "y", "w", "h", "points", "__outlined")))
    return first.select("file", "line_no", "cls", "x", "y", "w", "h", "points", (size & whole).alias("valid"))

