"""Scores over detections: running precision and recall, average precision, confusion, weights, histograms, series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as t_
from foliant.operators import boxes, ranking


def running_precision(df: DataFrame, cls: str, order: list[Column], n_true: Column, coarse: list[Column] | None = None) -> DataFrame:
    """By falling confidence: tp_sum, fp_sum, precision, recall and envelope (the greatest precision from here on).

    Without `coarse` a class is one window. With it, expressions that rise with
    the order split a class into steps, so that no task holds all of it.
    """
    stepped, by = ranking.steps(df, [cls], coarse or [F.lit(0)])
    own = [c for c in by if c != cls]
    if coarse:
        out = ranking.joined(stepped, ranking.before(stepped, [cls], by, {"__t": F.sum("tp"), "__f": F.sum(1 - F.col("tp"))}), by)
    else:
        out = stepped.withColumn("__t", F.lit(0)).withColumn("__f", F.lit(0))
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # A frame to the end is made anew for each row; the same rows from the end are one running frame.
    after = Window.partitionBy(*by).orderBy(F.desc("__n")).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("__n", F.row_number().over(w)).withColumn("tp_sum", F.col("__t") + F.sum("tp").over(w)).withColumn("fp_sum", F.col("__f") + F.sum(1 - F.col("tp")).over(w))
    out = out.withColumn("precision", F.col("tp_sum") / (F.col("tp_sum") + F.col("fp_sum"))).withColumn("recall", F.col("tp_sum") / n_true)
    out = out.withColumn("envelope", F.max("precision").over(after)).drop("__n", "__t", "__f")
    if coarse:
        best = out.groupBy(*by).agg(F.max("precision").alias("__p"))
        later = Window.partitionBy(cls).orderBy(*(F.desc(c) for c in own)).rowsBetween(Window.unboundedPreceding, -1)
        out = ranking.joined(out, best.select(*by, F.max("__p").over(later).alias("__later")), by)
        out = out.withColumn("envelope", F.greatest("envelope", "__later")).drop("__later")  # null beside a number counts as none
    return out.drop(*own)


def score_curves(df: DataFrame, cls: str, n_true: DataFrame, n: int = 1000) -> DataFrame:
    """cls, k, score, precision, recall, f1 and n_true at n even confidences from 0 to 1, between detections on a straight line.

    Rows of one confidence count together, so their order is no matter. Above a class's greatest confidence recall is 0
    and precision 1; a class without detections has 0 for both. n_true has cls and n_true. Rows fall into n cells of
    confidence, combined before the shuffle, so a window holds n rows of a class however many detections it has.
    """
    cell = F.least(F.greatest(F.floor(F.col("conf") * (n - 1)), F.lit(0)), F.lit(n - 1)).cast("int")
    tied = df.where(F.col("conf").isNotNull()).groupBy(F.col(cls).alias("__cls"), F.col("conf").cast("double").alias("__c")).agg(F.sum("tp").alias("__t"), F.count("tp").alias("__m"), F.first(cell).alias("__cell"))
    at = F.struct(F.col("__c").alias("c"), F.col("__t").alias("t"), F.col("__m").alias("m"))
    cells = tied.groupBy("__cls", "__cell").agg(F.sum("__t").alias("__t"), F.sum("__m").alias("__m"), F.min("__c").alias("__low"), F.max(at).alias("__high"))
    grid = n_true.select(cls, "n_true", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    rows = grid.join(cells, (F.col(cls) == F.col("__cls")) & (F.col("k") == F.col("__cell")), "left")
    w = Window.partitionBy(cls)
    up, down = w.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0), w.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__t": F.coalesce(F.sum("__t").over(up), F.lit(0)), "__m": F.coalesce(F.sum("__m").over(up), F.lit(0)), "__a": F.last("__low", True).over(up), "__b": F.last("__high", True).over(down)})
    x, t, m, a, b, eps = F.col("k") / (n - 1), F.col("__t"), F.col("__m"), F.col("__a"), F.col("__b"), 1e-16
    part = F.when(b.isNull(), 0.0).otherwise((a - x) / (a - b["c"]))
    line = lambda here, below: here + F.when(b.isNull(), 0.0).otherwise((below - here) * part)
    found = a.isNotNull() | b.isNotNull()
    precision = F.when(a.isNotNull(), line(t / m, (t + b["t"]) / (m + b["m"]))).when(found, 1.0).otherwise(0.0)
    recall = F.when(a.isNotNull(), line(t / (F.col("n_true") + eps), (t + b["t"]) / (F.col("n_true") + eps))).otherwise(0.0)
    out = rows.select(cls, "k", x.alias("score"), precision.alias("precision"), recall.alias("recall"), "n_true")
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", 2 * p * r / (p + r + eps))


def best_scores(curves: DataFrame, cls: str, n: int = 1000, share: float = 0.1) -> DataFrame:
    """The rows of score_curves() at the confidence where the smoothed mean f1 of all classes is greatest (the least one on a tie), with tp and fp as counts."""
    mean = curves.groupBy("k").agg(F.avg("f1").alias("f1")).withColumn("__all", F.lit(0))
    top = best_row(smooth(mean, "__all", "k", "f1", n, share).select("k", F.round("smooth", 12).alias("smooth")), "smooth", "k").select(F.col("k").alias("__k"))  # one row
    rows = curves.join(F.broadcast(top), F.col("k") == F.col("__k")).drop("__k")
    tp = F.rint(F.col("recall") * F.col("n_true"))
    return rows.withColumn("tp", tp.cast("long")).withColumn("fp", F.rint(tp / (F.col("precision") + 1e-16) - tp).cast("long"))


def study_curve(lines: DataFrame, file: str = "file", order: str = "line_no", line: str = "line") -> DataFrame:
    """file, line_no, ms and score (percent) of study files: the lines after the first, up to that of the greatest score (the first of equals).

    A line has numbers between blanks: the score is the fourth, the time the ninth. Lines without them are left out.
    """
    parts = F.split(F.trim(line), r"\s+")
    rows = lines.select(file, order, F.get(parts, F.lit(3)).try_cast("double").alias("__s"), F.get(parts, F.lit(8)).try_cast("double").alias("__ms")).where("__s IS NOT NULL AND __ms IS NOT NULL")
    ends = rows.groupBy(F.col(file).alias("__file")).agg(F.min(order).alias("__first"), F.max_by(order, F.struct("__s", -F.col(order))).alias("__last"))
    kept = rows.join(ends, F.col(file) == F.col("__file")).where((F.col(order) > F.col("__first")) & (F.col(order) <= F.col("__last")))
    return kept.select(file, order, F.col("__ms").alias("ms"), (F.col("__s") * 100).alias("score"))


def average_precision(curve: DataFrame, cls: str, n_true: DataFrame) -> DataFrame:
    """cls, n_true, tp, ap of running_precision()'s rows: the envelope over recall by 101 points and trapezoids.

    n_true has cls and n_true; classes without detections have 0. Between two
    correct detections the envelope is a straight line, so each one adds the sum of a line
    over the points it passes and no point is made a row. Beyond the last one the
    line falls to 0 at recall 1. Points and recalls are compared as fractions.
    """
    # An inner join, whose larger side can be split where a class has most of the rows; absent classes are added to the result.
    rows = curve.join(n_true, cls).withColumn("__hit", F.coalesce(F.col("tp") == 1, F.lit(False)))
    t, n = F.col("tp_sum"), F.col("n_true")
    earlier = F.when(t > 1, (t - 1) / (t - 1 + F.col("fp_sum"))).when(F.col("fp_sum") == 0, 1.0).otherwise(0.0)
    left = F.greatest(earlier, F.col("envelope"))
    up = lambda x: F.floor((100 * x + n - 1) / n)
    low, high = up(t - 1), up(t) - 1
    line = lambda a, b, r0, r1, lo, hi: F.when(hi >= lo, (hi - lo + 1) * (a + ((lo + hi) / 200 - r0) / (r1 - r0) * (b - a))).otherwise(0.0)
    found = rows.groupBy(cls, "n_true").agg(
        F.sum(F.when(F.col("__hit"), line(left, F.col("envelope"), (t - 1) / n, t / n, low, high))).alias("__sum"),
        F.max(F.when(F.col("__hit") & (t == 1), left)).alias("__first"), F.coalesce(F.max("tp_sum"), F.lit(0)).alias("tp"), F.count("tp").alias("__n"),
    )
    last, reach = F.col("tp") / F.col("__n"), F.col("tp") / n
    tail = F.when(F.col("tp") < n, line(last, F.lit(0.0), reach, F.lit(1.0), up(F.col("tp")), F.lit(99))).otherwise(0.0)
    ap = F.when(F.col("tp") > 0, (F.col("__sum") + tail - F.col("__first") / 2) / 100).otherwise(0.0)
    own = found.select(F.col(cls).alias("__cls"), F.col("tp").alias("__tp"), ap.alias("__ap"))
    whole = n_true.join(own, F.col(cls) == F.col("__cls"), "left")
    return whole.select(cls, "n_true", F.coalesce("__tp", F.lit(0)).alias("tp"), F.coalesce("__ap", F.lit(0.0)).alias("ap"))


def class_table(scores: DataFrame, found: DataFrame, cls: str) -> DataFrame:
    """average_precision()'s rows with fp, precision, recall, f1 and support. found: cls, n (detections of the class)."""
    rows = scores.join(found.select(F.col(cls).alias("__cls"), F.col("n").alias("__n")), F.col(cls) == F.col("__cls"), "left")
    tp, n, eps = F.col("tp"), F.coalesce("__n", F.lit(0)), 1e-16
    p, r = tp / (n + eps), tp / (F.col("n_true") + eps)
    return rows.select(cls, "ap", "tp", (n - tp).alias("fp"), p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + eps)).alias("f1"), F.col("n_true").alias("support"))


def mean_scores(table: DataFrame) -> DataFrame:
    """One row: mean precision, recall and ap over the classes of class_table()."""
    return table.agg(F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("ap").alias("mean_ap"))


def filled_scores(table: DataFrame, classes: DataFrame, cls: str) -> DataFrame:
    """cls, ap of all classes: those without a row have the mean."""
    mean = mean_scores(table).select("mean_ap")  # one row
    own = table.select(F.col(cls).alias("__cls"), "ap")
    return classes.select(cls).join(own, F.col(cls) == F.col("__cls"), "left").join(F.broadcast(mean)).select(cls, F.coalesce("ap", "mean_ap").alias("ap"))


def image_confidence(df: DataFrame, key: str, cls: str, least: float = 0.25) -> DataFrame:
    """key, cls, n and mean_conf of an image's detections of at least `least` confidence."""
    return df.where(F.col("conf") >= least).groupBy(key, cls).agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"))


def throughput(df: DataFrame, seconds: Column, group: str) -> DataFrame:
    """group, n, per_second (rows over the time they took) and latency (mean time of one)."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.try_divide(F.count(seconds), F.sum(seconds)).alias("per_second"), F.avg(seconds).alias("latency"))


def dataset_stats(images: DataFrame, labels: DataFrame, classes: DataFrame, key: str, cls: str, split: str) -> DataFrame:
    """split, cls, instances, images; a class without instances has 0. A row of null cls has all instances, all images and, in unlabelled, those without a label.

    images: key and split, one row each; labels: key and cls, one row per instance; classes: cls.
    """
    named = images.select(F.col(key).alias("__key"), split)
    counts = labels.groupBy(F.col(key).alias("__key"), cls).agg(F.count("*").alias("__n"))  # one row for each image and class
    per_class = named.join(counts, "__key").groupBy(split, cls).agg(F.sum("__n").alias("instances"), F.count("*").alias("images"))
    splits = images.select(split).distinct()
    zero = splits.join(F.broadcast(classes.select(cls))).select(F.col(split).alias("__split"), F.col(cls).alias("__cls"))  # a class list beside three names
    filled = zero.join(per_class, (F.col("__split") == F.col(split)) & (F.col("__cls") == F.col(cls)), "left")
    each = filled.select(F.col("__split").alias(split), F.col("__cls").alias(cls), F.coalesce("instances", F.lit(0)).alias("instances"), F.coalesce("images", F.lit(0)).alias("images"), F.lit(None).cast("long").alias("unlabelled"))
    totals = counts.groupBy("__key").agg(F.sum("__n").alias("__n"))
    whole = named.join(totals, "__key", "left").groupBy(split).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("instances"), F.count("*").alias("images"), F.count_if(F.col("__n").isNull()).alias("unlabelled"))
    return each.unionByName(whole.select(split, F.lit(None).cast(classes.schema[cls].dataType).alias(cls), "instances", "images", "unlabelled"))


def scan_summary(df: DataFrame, missing: Column, empty: Column, corrupt: Column) -> DataFrame:
    """One row: files whose labels are found, missing, empty or corrupt; the first that holds counts, null as false."""
    is_ = [F.coalesce(c, F.lit(False)) for c in (missing, empty, corrupt)]
    return df.agg(
        F.count_if(~is_[0] & ~is_[1] & ~is_[2]).alias("found"), F.count_if(is_[0]).alias("missing"), F.count_if(~is_[0] & is_[1]).alias("empty"), F.count_if(~is_[0] & ~is_[1] & is_[2]).alias("corrupt")
    )


def centers(df: DataFrame, cls: str, vector: str, right: Column | None = None) -> DataFrame:
    """cls, dim, mean of the feature vectors of each class; only of rows that are `right`, if given."""
    rows = df if right is None else df.where(right)
    return rows.select(cls, F.posexplode(vector).alias("dim", "__v")).groupBy(cls, F.col("dim").cast("long").alias("dim")).agg(F.avg(F.col("__v").cast("double")).alias("mean"))


def moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, mean and (population) deviation."""
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def correlations(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """a, b, corr of every two of the columns, in one pass."""
    both = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(both)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(both)))).alias("r")).select("r.*")


def sparsity(df: DataFrame, group: str, array: str) -> DataFrame:
    """group, n_values and the share of zeros among all values of an array column."""
    zeros, n = F.sum(F.size(F.filter(array, lambda x: x == 0))), F.sum(F.size(array))
    return df.groupBy(group).agg(n.cast("long").alias("n_values"), F.try_divide(zeros, n).alias("sparsity"))


def best_angle(df: DataFrame, key: str, angle: str, value: str) -> DataFrame:
    """key and the angle at which the row means of a page (a row per line of pixels) vary most; the least of those equal to nine places."""
    spread = df.groupBy(key, angle).agg(F.round(F.var_pop(value), 9).alias("__v"))
    return spread.groupBy(key).agg(F.max_by(angle, F.struct("__v", -F.col(angle))).alias(angle))


def mean_angle(df: DataFrame, key: str, angle: str, most: float = 45) -> DataFrame:
    """key and the mean of its lines' angles of at most `most` degrees either way; 0 if there is none."""
    return df.groupBy(key).agg(F.coalesce(F.avg(F.when(F.abs(angle) <= most, F.col(angle))), F.lit(0.0)).alias(angle))


def confusion(detections: DataFrame, truth: DataFrame, key: str, det: Sequence[str], gt: Sequence[str], conf: float = 0.25, iou: float = 0.45) -> DataFrame:
    """pred, true, n over pages; null stands for the background.

    det and gt name a row on its page. Unmatched ones are what is left of a class's count. Detections
    of pages without any match are not counted.
    """
    seen = detections.where(F.col("conf") > conf)
    best = boxes.best_matches(boxes.pairs(seen, truth, key, iou), [f"l_{key}", *(f"l_{c}" for c in det)], [f"r_{key}", *(f"r_{c}" for c in gt)])
    hits = best.select(F.col(f"l_{key}").alias(key), F.col("l_cls").alias("pred"), F.col("r_cls").alias("true"))
    none, one, less = F.lit(None).cast(truth.schema["cls"].dataType), F.lit(1), F.lit(-1)
    pages = hits.select(key).distinct()
    parts = [
        hits.select("pred", "true", one.alias("n")), hits.select(none.alias("pred"), "true", less.alias("n")), hits.select("pred", none.alias("true"), less.alias("n")),
        truth.select(none.alias("pred"), F.col("cls").alias("true"), one.alias("n")), seen.join(pages, key, "left_semi").select(F.col("cls").alias("pred"), none.alias("true"), one.alias("n")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("pred", "true").agg(F.sum("n").alias("n")).where("n > 0")


def right_and_wrong(matrix: DataFrame) -> DataFrame:
    """cls, tp, fp of a confusion matrix."""
    return matrix.where("pred IS NOT NULL").groupBy(F.col("pred").alias("cls")).agg(F.sum(F.when(F.col("pred").eqNullSafe(F.col("true")), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("pred").eqNullSafe(F.col("true")), 0).otherwise(F.col("n"))).alias("fp"))


def matches_at(found: DataFrame, detection: Sequence[str], truth: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Matches at each IoU threshold, with a column threshold; the pairs are made once."""
    each = found.withColumn("threshold", F.explode(F.array(*(F.lit(float(x)) for x in thresholds)))).where(F.col("iou") > F.col("threshold"))
    return boxes.best_matches(each, ["threshold", *detection], ["threshold", *truth])


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    """cls, n, weight: inverse frequency, adding up to 1."""
    inverse = df.groupBy(cls).agg(F.count("*").alias("n")).withColumn("inv", 1 / F.col("n"))
    total = inverse.agg(F.sum("inv").alias("all_inv"))  # one row
    return inverse.join(F.broadcast(total)).select(cls, "n", (F.col("inv") / F.col("all_inv")).alias("weight"))


def text_scores(matched: DataFrame) -> DataFrame:
    """n, hits, edits of matched texts (truth, read)."""
    return matched.agg(F.count("*").alias("n"), F.sum((F.col("truth") == F.col("read")).cast("long")).alias("hits"), F.sum(F.levenshtein("truth", "read")).alias("edits"))


def patience(df: DataFrame, series: str, step: str, value: str) -> DataFrame:
    """Running best value, and steps since it was reached."""
    w = Window.partitionBy(series).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    best = df.withColumn("best", F.max(value).over(w))
    return best.withColumn("since", F.col(step) - F.max(F.when(F.col(value) >= F.col("best"), F.col(step))).over(w))


def image_weights(df: DataFrame, key: str, cls: str) -> DataFrame:
    """key and weight: the weights of an image's instances added up."""
    counts = df.groupBy(key, cls).agg(F.count("*").alias("__n"))
    return counts.join(class_weights(df, cls).select(cls, F.col("weight").alias("__w")), cls).groupBy(key).agg(F.sum(F.col("__w") * F.col("__n")).alias("weight"))


def summary(df: DataFrame, key: str, cls: str) -> DataFrame:
    """key and summary: an image's classes with their counts, as in `3 cats, 1 dog`."""
    counts = df.groupBy(key, cls).agg(F.count("*").alias("n"))
    words = F.transform(F.sort_array(F.collect_list(F.struct(cls, "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x[cls].cast("string"), F.when(x["n"] > 1, "s").otherwise("")))
    return counts.groupBy(key).agg(F.array_join(words, ", ").alias("summary"))


def fitness(precision: Column, recall: Column, map50: Column, map_: Column) -> Column:
    """A model's figure of merit; precision and recall have no weight."""
    return precision * 0.0 + recall * 0.0 + map50 * 0.1 + map_ * 0.9


def mask_fitness(box: Sequence[Column], mask: Sequence[Column]) -> Column:
    """fitness() of boxes and masks together; each is precision, recall, map50, map."""
    return fitness(*box) + fitness(*mask)


def best_row(df: DataFrame, value: str, step: str) -> DataFrame:
    """The row of the greatest value, the first on a tie."""
    return df.agg(F.max_by(F.struct(*df.columns), F.struct(F.col(value), -F.col(step))).alias("r")).select("r.*")


def smooth(df: DataFrame, series: str, step: str, value: str, n: int, share: float = 0.05) -> DataFrame:
    """Moving mean (column smooth) over a share of the n rows of each series; the ends are carried on outwards."""
    half = round(n * share * 2) // 2 // 2
    w = Window.partitionBy(series).orderBy(step)
    frame, up, down = w.rowsBetween(-half, half), w.rowsBetween(-half, 0), w.rowsBetween(0, half)
    missing = lambda side: half + 1 - F.count("*").over(side)
    total = F.sum(value).over(frame) + missing(up) * F.first(value).over(frame) + missing(down) * F.last(value).over(frame)
    return df.withColumn("smooth", total / (2 * half + 1))


def moving_average(df: DataFrame, series: str, step: str, value: str, decay: float = 0.9999, ramp: float = 2000) -> DataFrame:
    """series, ema: the exponential average after all steps, whose decay grows towards `decay`. A series is one array."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(step, value))), lambda x: x[value].cast("double"))
    start = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("v"))
    d = lambda k: decay * (1 - F.exp(-k / ramp))
    add = lambda s, x: F.struct((s["k"] + 1).alias("k"), F.when(s["k"] == 0, x).otherwise(d(s["k"]) * s["v"] + (1 - d(s["k"])) * x).alias("v"))
    return df.groupBy(series).agg(rows.alias("__v")).select(series, F.aggregate("__v", start, add)["v"].alias("ema"))


def _bin(x: Column, low: Column, high: Column, n: int) -> Column:
    return F.when(high == low, 0).otherwise(F.least(F.floor((x - low) * n / (high - low)), F.lit(n - 1))).cast("long")


def _ranged(df: DataFrame, values: Sequence[str]) -> DataFrame:
    ends = df.agg(*(f(v).alias(f"__{name}_{v}") for v in values for name, f in (("low", F.min), ("high", F.max))))  # one row
    return df.join(F.broadcast(ends))


def histogram(df: DataFrame, value: str, n: int) -> DataFrame:
    """bin and count of n equal bins from least to greatest; the last holds its right end."""
    found = _ranged(df.select(value).where(F.col(value).isNotNull()), [value])
    return found.groupBy(_bin(F.col(value), F.col(f"__low_{value}"), F.col(f"__high_{value}"), n).alias("bin")).agg(F.count("*").alias("n"))


def histogram2d(df: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """bin_x, bin_y, n and log_n of the filled cells of an n by n grid."""
    found = _ranged(df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()), [x, y])
    at = lambda v: _bin(F.col(v), F.col(f"__low_{v}"), F.col(f"__high_{v}"), n)
    return found.groupBy(at(x).alias("bin_x"), at(y).alias("bin_y")).agg(F.count("*").alias("n")).withColumn("log_n", F.ln("n"))


def end_to_end(truth: DataFrame, read: DataFrame, key: str, least: float = 0.5, quads: bool = False, no_blanks: bool = False) -> DataFrame:
    """One row of figures for read lines against true ones: hits, counts, edits, precision, recall, f, and per character, line and page.

    truth has key, idx, text, ignored and read key, idx, text, with x1 to y2, or points if quads. Lines are matched one to
    one by falling overlap of at least `least`. Matched texts are compared in half width; a line matched to an ignored one counts nowhere.
    """
    found = (boxes.quad_pairs if quads else boxes.pairs)(truth, read, key, math.nextafter(least, 0))
    matched = boxes.greedy_match(found.withColumn(key, F.col(f"l_{key}")), key, "l_idx", "r_idx").drop("iou")
    t = truth.select(key, F.col("idx").alias("l_idx"), F.col("text").alias("__t"), "ignored").join(matched, [key, "l_idx"], "left")
    whole = t.join(read.select(key, F.col("idx").alias("r_idx"), F.col("text").alias("__r"), F.lit(1).alias("__read")), [key, "r_idx"], "full")
    both = F.col("l_idx").isNotNull() & F.col("__read").isNotNull()
    even = lambda c: F.when(both, F.replace(t_.half_width(F.col(c)), F.lit(" "), F.lit("")) if no_blanks else t_.half_width(F.col(c))).otherwise(F.coalesce(c, F.lit("")))
    counted = whole.where("l_idx IS NULL OR NOT ignored").select(key, "l_idx", "__read", both.alias("__both"), even("__t").alias("a"), even("__r").alias("b"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    sums = counted.agg(
        n(F.col("__both") & (F.col("a") == F.col("b"))).alias("hits"), n(F.col("__read").isNotNull()).alias("n_read"), n(F.col("l_idx").isNotNull()).alias("n_true"),
        F.coalesce(F.sum(F.levenshtein("a", "b")), F.lit(0)).alias("edits"), F.coalesce(F.sum(F.when(F.col("l_idx").isNotNull(), F.length("a"))), F.lit(0)).alias("n_chars"),
    )
    pages = truth.agg(F.countDistinct(key).alias("n_pages"))  # one row
    eps, out = 1e-9, sums.join(F.broadcast(pages))
    p, r = F.col("hits") / (F.col("n_read") + eps), F.col("hits") / (F.col("n_true") + eps)
    out = out.withColumns({"precision": p, "recall": r}).withColumn("f", 2 * p * r / (p + r + eps))
    return out.withColumns({"char_accuracy": 1 - F.col("edits") / (F.col("n_chars") + eps), "edits_per_line": F.col("edits") / (F.col("n_true") + eps), "edits_per_page": F.try_divide(F.col("edits"), F.col("n_pages"))})


def rates(steps: DataFrame, step: str, total: int, first: float = 1.0, last: float = 0.1) -> DataFrame:
    """Rows with rate: half a cosine from first to last over `total` steps."""
    return steps.withColumn("rate", (1 - F.cos(F.col(step) * F.pi() / total)) / 2 * (last - first) + first)
