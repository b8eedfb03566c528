"""Clusters of vectors by Lloyd rounds, and codebooks of one-dimensional histograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import numbers as N
from trailmark.sources.sinks import cut_lineage

from .grouped import per_group

#: Packed centroids that may be broadcast: numbers over all groups.
SENT_NUMBERS = 4_000_000


def _unit(v: Column) -> Column:
    """A vector of length 1 (as it is where it has no length)."""
    return F.transform(v, lambda x: x / F.greatest(F.sqrt(N.dot(v, v)), F.lit(1e-12)))


def kmeans(points: DataFrame, start: DataFrame, metric: str = "euclid", rounds: int = 100, bound: float = 1e-4) -> tuple[DataFrame, DataFrame, int]:
    """(assigned (grp, id, cluster), centroids (grp, cluster, c, size), rounds) of points (grp, id, v) from start centroids (grp, cluster, c).

    euclid: the nearest centroid, which moves to the mean; cosine: the largest product of unit vectors; dot: of vectors as they are; both
    move to the mean's direction. Ties go to the smaller cluster; a cluster without points keeps its place. A round counts the points of
    every cluster with one aggregation; rounds end when no centroid moves by bound, and that last move is not made. Points or starts that are null take no
    part, nor do groups without a start.
    """
    if metric not in ("euclid", "cosine", "dot"):
        raise ValueError(f"no such metric: {metric}")
    wide = lambda c: F.col(c).cast("array<double>")
    points = points.where("v IS NOT NULL").select("grp", "id", (_unit(wide("v")) if metric == "cosine" else wide("v")).alias("v"))
    centroids = start.where("c IS NOT NULL").select("grp", "cluster", (_unit(wide("c")) if metric == "cosine" else wide("c")).alias("c"))
    centroids = cut_lineage(centroids)
    size = centroids.agg(F.max(F.size("c")).alias("d"), F.count("*").alias("n")).first()
    dims, small = size.d or 0, (size.d or 0) * size.n <= SENT_NUMBERS

    def worth(v: Column, c: Column) -> Column:
        return N.square_distance(v, c) if metric == "euclid" else -N.dot(v, c)

    def assign(centroids: DataFrame) -> DataFrame:
        packed = centroids.groupBy("grp").agg(F.collect_list(F.struct("cluster", "c")).alias("all"))
        nearest = F.array_min(F.transform("all", lambda c: F.struct(worth(F.col("v"), c["c"]).alias("d"), c["cluster"].alias("cluster"))))
        return points.join(F.broadcast(packed) if small else packed, "grp").select("grp", "id", "v", nearest["cluster"].alias("cluster"))

    done = 0
    for done in range(1, rounds + 1):
        sums = assign(centroids).groupBy("grp", "cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)))
        mean = F.array(*(F.col(f"s{i}") / F.col("n") for i in range(dims))) if dims else F.col("c")
        moved = centroids.join(sums, ["grp", "cluster"], "left").select("grp", "cluster", "c", F.when(F.col("n").isNull(), F.col("c")).otherwise(mean if metric == "euclid" else _unit(mean)).alias("new"), F.coalesce("n", F.lit(0)).alias("size"))
        moved = cut_lineage(moved)
        shift = moved.agg(F.max(F.sqrt(N.square_distance(F.col("c"), F.col("new")))).alias("s")).first().s
        last = shift is None or shift < bound or done == rounds
        if last:
            break
        centroids = moved.select("grp", "cluster", F.col("new").alias("c"))
    return assign(centroids).drop("v"), (moved if rounds else centroids.withColumn("size", F.lit(0))).select("grp", "cluster", "c", "size"), done


def codebook(counts: DataFrame, bins: int, size: int, rounds: int = 150, bound: float = 1e-9) -> DataFrame:
    """(grp, idx, centroid, low, high, mse) of the least-squares quantiser of each group's histogram over [-1, 1].

    counts: (grp, bin, n), absent bins are empty. Centroids start at even shares of the cumulative counts, and each moves to the mean of the bins
    between the midpoints to its neighbours until none moves by bound; one without weight stays. A group without counts has no codebook.
    """
    if bins < 1 or size < 1:
        raise ValueError("bins and size must be positive")
    middle = (np.arange(bins) + 0.5) * (2 / bins) - 1

    def one(c: dict[str, np.ndarray]) -> list[tuple]:
        weight = np.zeros(bins)
        np.add.at(weight, c["bin"], c["n"])
        if weight.sum() < 1e-30:
            return []
        weight /= weight.sum()
        centroids = np.sort(np.interp((np.arange(size) + 0.5) / size, np.cumsum(weight), middle))
        first = lambda x: np.concatenate(([0.0], np.cumsum(x)))
        mass, moment = first(weight), first(weight * middle)

        def cuts(centroids):
            between = (centroids[1:] + centroids[:-1]) / 2
            return between, np.concatenate(([0], np.searchsorted(middle, between), [bins]))  # a bin on a midpoint belongs to the upper side

        for _ in range(rounds):
            at = cuts(centroids)[1]
            share = np.diff(mass[at])
            new = np.where(share > 1e-30, np.diff(moment[at]) / np.where(share > 1e-30, share, 1), centroids)
            moved, centroids = np.abs(new - centroids).max(), new
            if moved < bound:
                break
        between, at = cuts(centroids)
        owner = np.repeat(np.arange(size), np.diff(at))
        mse = float((weight * (centroids[owner] - middle) ** 2).sum())
        edges = np.concatenate(([-1.0], between, [1.0]))
        return [(i, float(centroids[i]), float(edges[i]), float(edges[i + 1]), mse) for i in range(size)]

    return per_group(counts.select("grp", F.col("bin").cast("long").alias("bin"), F.col("n").cast("double").alias("n")), "grp", one, "idx int, centroid double, low double, high double, mse double")
