"""Fit of anchor sizes to box sizes, and anchors by clustering and mutation. Anchors are a short list of (w, h)."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import geometry as g

Anchors = Sequence[tuple[float, float]]


def ratios(anchors: Anchors) -> Column:
    """How well each anchor fits a row's w and h, as an array."""
    return F.array(*(g.size_ratio(F.col("w"), F.col("h"), float(w), float(h)) for w, h in anchors))


def _fitness(anchors: Anchors, least: float, n: Column | None = None) -> Column:
    best = F.array_max(ratios(anchors))
    value = F.when(best > least, best).otherwise(0.0)
    return F.avg(value) if n is None else F.sum(value * n) / F.sum(n)


def fit(sizes: DataFrame, anchors: Anchors, threshold: float = 4.0) -> DataFrame:
    """One row: best possible recall, anchors over the threshold per box, and the fitness."""
    x, least = ratios(anchors), 1 / threshold
    over = F.size(F.filter(x, lambda r: r > least))
    return sizes.agg(F.avg(F.when(F.array_max(x) > least, 1.0).otherwise(0.0)).alias("recall"), F.avg(over).alias("per_box"), _fitness(anchors, least).alias("fitness"))


def cluster(sizes: DataFrame, n: int, seed: int = 0, rounds: int = 30) -> list[tuple[float, float]]:
    """n anchors, sorted by area: the centres of clusters of sizes in units of their deviation. Only the centres reach the driver."""
    spread = sizes.agg(F.stddev_pop("w").alias("w"), F.stddev_pop("h").alias("h")).first()
    sw, sh = spread["w"] or 1.0, spread["h"] or 1.0
    white = sizes.select((F.col("w") / sw).alias("w"), (F.col("h") / sh).alias("h"))
    model = KMeans(k=n, seed=seed, maxIter=rounds, featuresCol="v").fit(VectorAssembler(inputCols=["w", "h"], outputCol="v").transform(white))
    return sorted(((float(c[0]) * sw, float(c[1]) * sh) for c in model.clusterCenters()), key=lambda a: a[0] * a[1])


def evolve(sizes: DataFrame, anchors: Anchors, threshold: float = 4.0, rounds: int = 50, brood: int = 20, seed: int = 0) -> list[tuple[float, float]]:
    """The fittest anchors found by random changes. The candidates of a round are judged in one pass over the sizes."""
    dice, least = random.Random(seed), 1 / threshold
    counted, n = sizes.groupBy("w", "h").agg(F.count("*").alias("n")).persist(), F.col("n")  # sizes repeat; the passes are over different ones
    best, score = [tuple(a) for a in anchors], counted.agg(_fitness(anchors, least, n).alias("f")).first()["f"] or 0.0

    def changed(x: float) -> float:
        return max(2.0, x * min(3.0, max(0.3, 1 + dice.random() * dice.gauss(0, 0.1)))) if dice.random() < 0.9 else x

    for _ in range(rounds):
        tried = [[(changed(w), changed(h)) for w, h in best] for _ in range(brood)]
        found = counted.agg(*(_fitness(c, least, n).alias(f"f{k}") for k, c in enumerate(tried))).first()
        k = max(range(brood), key=lambda k: found[k] or 0.0)
        if (found[k] or 0.0) > score:
            best, score = tried[k], found[k]
    counted.unpersist()
    return sorted(best, key=lambda a: a[0] * a[1])
