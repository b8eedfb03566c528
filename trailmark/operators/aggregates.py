"""Aggregates: summaries with zero-filled groups, distributions, histograms, geometry, voxels, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import numbers as N


def summary(df: DataFrame, group: str, values: tuple[str, ...], passed: str) -> DataFrame:
    """Count, passes and pass rate of every known group, zeros where it has no rows."""
    known = df.sparkSession.createDataFrame([(v,) for v in values], f"{group} string")
    got = df.groupBy(group).agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"))
    out = known.join(F.broadcast(got.where(F.col(group).isin(*values))), group, "left")  # at most a row per known group
    out = out.fillna({"total": 0, "passed": 0})
    return out.withColumn("pass_rate", F.when(F.col("total") > 0, F.bround(F.col("passed") / F.col("total"), 6)).otherwise(0.0))


def distribution(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, extremes, mean and linearly interpolated percentiles."""
    p = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = df.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("min"), p.alias("_p"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return out.select(group, "n", "min", F.col("_p")[0].alias("p05"), F.col("_p")[1].alias("median"), "mean", F.col("_p")[2].alias("p95"), "max")


def cumulative_histogram(df: DataFrame, group: str, value: str, edges: list[float]) -> DataFrame:
    """Counts of values at or below each edge, and of all: one pass, no edge join."""
    counts = [F.count_if(F.col(value) <= e).alias(f"_{k}") for k, e in enumerate(edges)]
    wide = df.groupBy(group).agg(*counts, F.count(value).alias("_all"))
    cells = F.array(*(F.struct(F.lit(str(e)).alias("le"), F.col(f"_{k}").alias("n")) for k, e in enumerate(edges)), F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n")))
    return wide.select(group, F.explode(cells).alias("c")).select(group, "c.le", "c.n")


def mask_geometry(runs: DataFrame, key: str) -> DataFrame:
    """Area, centroid and compactness of masks given as run-length rows (y, x0, x1): sums in closed form per run."""
    n, s = F.col("x1") - F.col("x0"), F.col("x0") + F.col("x1")
    first = (n * s / 2).cast("double")  # sum of pixel centres x + 0.5
    square = (F.pow("x1", F.lit(3)) - F.pow("x0", F.lit(3))) / 3 - n / 12.0  # sum of (x + 0.5)^2
    y = F.col("y") + 0.5
    out = runs.groupBy(key).agg(F.sum(n).alias("area"), F.sum(first).alias("sx"), F.sum(y * n).alias("sy"), F.sum(square).alias("sxx"), F.sum(y * y * n).alias("syy"))
    a = F.col("area")
    # Every pixel is a unit square with a moment of its own, 1/6.
    inertia = F.col("sxx") + F.col("syy") - (F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")) / a + a / 6
    return out.select(key, "area", (F.col("sx") / a).alias("cx"), (F.col("sy") / a).alias("cy"), F.least(F.lit(1.0), a * a / (2 * F.lit(3.141592653589793) * inertia)).alias("compactness"))


def token_coverage(cells: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """Weighted coverage and precision of masks from pixel counts by token; null where all weights are zero.

    cells: (key, token, pixels, overlap); grid: (token, weight, cell_area), as many rows as tokens.
    """
    total = grid.agg(F.sum("weight").alias("total"))
    got = cells.join(grid, "token").groupBy(key).agg(F.sum(F.col("pixels") / F.col("cell_area") * F.col("weight")).alias("captured"), F.sum("pixels").alias("area"), F.sum("overlap").alias("overlap"))
    out = got.crossJoin(F.broadcast(total))  # a single row
    return out.select(key, "area", F.when(F.col("total") > 0, F.col("captured") / F.col("total")).alias("weighted_coverage"), F.when(F.col("area") > 0, F.col("overlap") / F.col("area")).otherwise(0.0).alias("precision"))


def voxel_mean(df: DataFrame, size: float, axes: tuple[str, ...], values: tuple[str, ...], weight: str | None = None) -> DataFrame:
    """Means by grid cell, weighted where a weight is named."""
    cell = [F.floor(F.col(a) / size).alias(f"v_{a}") for a in axes]
    if weight is None:
        aggs = [F.avg(v).alias(v) for v in values]
    else:
        aggs = [(F.sum(F.col(v) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-8))).alias(v) for v in values]
    return df.groupBy(*cell).agg(*aggs, F.count("*").alias("n"))


def merge_softmax(parts: DataFrame, key: str) -> DataFrame:
    """Partial (m, s, v): maximum, sum of exponentials and weighted value, merged by rescaling."""
    top = parts.groupBy(key).agg(F.max("m").alias("top"))
    scale = F.exp(F.col("m") - F.col("top"))
    return parts.join(top, key).groupBy(key).agg(F.first("top").alias("m"), F.sum(F.col("s") * scale).alias("s"), (F.sum(F.col("v") * F.col("s") * scale) / F.sum(F.col("s") * scale)).alias("v"))


def ordered_digest(df: DataFrame, group: str, order: str, text: Column) -> DataFrame:
    """SHA-256 of a group's texts in order, joined by line ends (one group is one digest, so its ids meet in one task)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return df.groupBy(group).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["t"]), "\n"), 256).alias("digest"))


def latency(df: DataFrame, stamps: list[str], key: str) -> DataFrame:
    """Differences of consecutive stamps, and their sum only where all are known."""
    parts = [(F.col(b) - F.col(a)).alias(f"{a}_to_{b}") for a, b in zip(stamps, stamps[1:])]
    out = df.select(key, *parts)
    names = [c for c in out.columns if c != key]
    known = F.lit(True)
    for c in names:
        known = known & F.col(c).isNotNull()
    return out.withColumn("total", F.when(known, sum((F.col(c) for c in names), F.lit(0.0))))


#: Queues whose work has not begun, by service; names that begin so count too.
BEFORE_WORK = {"encoder": (("req_queue", "exec_queue"), None), "transformer": (("req_queue", "waiting_queue", "exec_queue"), "phase1_"), "decoder": (("req_queue", "waiting_queue", "exec_queue"), "transfer_")}


def precompute_pending(service: Column, sizes: Column) -> Column:
    """Work that waits before a service's own step, from its queue sizes (map of name to size); negative sizes count as none, other services are -1."""
    entries = F.map_entries(sizes)
    rows = F.lit(-1).cast("long")
    for name, (keys, prefix) in reversed(BEFORE_WORK.items()):
        counts = lambda e: e["key"].isin(*keys) | (e["key"].startswith(prefix) if prefix else F.lit(False))  # noqa: B023, E731
        total = F.aggregate(F.filter(entries, counts), F.lit(0).cast("long"), lambda s, e: s + F.greatest(e["value"].cast("long"), F.lit(0).cast("long")))
        rows = F.when(service == name, total).otherwise(rows)
    return F.when(sizes.isNull(), F.lit(-1).cast("long")).otherwise(rows)


def record_summary(records: DataFrame, routes: tuple[str, ...] = ("global", "local", "dual"), errors: int = 0, requested: int | None = None) -> DataFrame:
    """One row over records (generated, passed, status, rounds_used, first_passed, route): counts, pass rates, and a struct of counts for every route.

    Only generated records pass; reflected ones took more than one round, improved ones passed after a first round that had not. Rates are
    rounded to six places, 0 without generated records.
    """
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    made, good = true("generated"), true("generated") & true("passed")
    reflected = made & (F.coalesce("rounds_used", F.lit(0)) > 1)
    rate = lambda a, b: F.coalesce(N.round_even(a / F.nullif(b, F.lit(0)), 6), F.lit(0.0))
    counts = {"records": F.count("*"), "generated": F.count_if(made), "skipped": F.count_if(F.col("status") == "skipped"), "router_failed": F.count_if(F.col("status") == "router_failed"), "passed": F.count_if(good), "reflected": F.count_if(reflected), "reflection_improved": F.count_if(reflected & (F.col("first_passed") == F.lit(False)) & true("passed"))}
    by = {f"{n}_{r}": F.count_if(c & (F.col("route") == r)) for r in routes for n, c in (("generated", made), ("passed", good))}
    row = records.agg(*(c.alias(n) for n, c in (counts | by).items()))
    stats = [F.struct(F.col(f"generated_{r}").alias("generated"), F.col(f"passed_{r}").alias("passed"), rate(F.col(f"passed_{r}"), F.col(f"generated_{r}")).alias("pass_rate")).alias(r) for r in routes]
    return row.select(
        (F.lit(requested) if requested is not None else F.col("records") + errors).cast("long").alias("requested"), "records", F.lit(errors).cast("long").alias("errors"), "generated", "skipped", "router_failed", "passed",
        rate(F.col("passed"), F.col("generated")).alias("verifier_pass_rate"), "reflected", "reflection_improved", *stats,
    )


def merge_splats(splats: DataFrame, size: float) -> DataFrame:
    """Splats (x, y, z, scale: 3 numbers, quat: 4, color: 3, opacity, weight) merged by cubes of a size, weighted means of each.

    Quaternions are summed by weight and made unit again, the opacity is the weighted mean of the weights. Where no two splats share a cube, all stay as they are.
    """
    w = F.col("weight").cast("double")
    cube = [F.floor(F.col(c) / size).alias(f"v{c}") for c in "xyz"]
    parts = [(c, F.col(c), c) for c in "xyz"] + [(f"{n}{k}", F.col(n)[k], n) for n, size_ in (("scale", 3), ("quat", 4), ("color", 3)) for k in range(size_)]
    sums = splats.groupBy(*cube).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("ww"), *(F.sum(v.cast("double") * w).alias(a) for a, v, _ in parts))
    if not sums.where("n > 1").limit(1).count():
        return splats.select("x", "y", "z", "scale", "quat", "color", "opacity")
    total = F.greatest("w", F.lit(1e-8))
    length = F.greatest(F.sqrt(sum((F.col(f"quat{k}") * F.col(f"quat{k}") for k in range(1, 4)), F.col("quat0") * F.col("quat0"))), F.lit(1e-8))
    array = lambda n, k, by: F.array(*(F.col(f"{n}{i}") / by for i in range(k))).alias(n)
    return sums.select(*((F.col(c) / total).alias(c) for c in "xyz"), array("scale", 3, total), array("quat", 4, length), array("color", 3, total), (F.col("ww") / total).alias("opacity"))


def service_load(metrics: DataFrame, transfer: DataFrame, utilisation: float, most_pending: int) -> DataFrame:
    """Load and scores of every service from its instances' metrics (service, instance, gpu, pending, precompute), and whether it should grow.

    transfer: (service, waiting), a row per service. Null pending counts as none in the mean and as -1 in the maximum; negative precompute is unknown and
    leaves the score to what waits in transfer.
    """
    known = F.when(F.col("precompute") >= 0, F.col("precompute"))
    got = metrics.groupBy("service").agg(
        F.avg("gpu").alias("avg_gpu"), F.avg(F.coalesce("pending", F.lit(0))).alias("avg_pending"), F.max(F.coalesce("pending", F.lit(-1))).alias("max_pending"), F.avg(known).alias("avg_precompute"),
        F.min_by("instance", F.struct("gpu", "instance")).alias("least_used"),
    )
    out = got.join(transfer.select("service", F.col("waiting").alias("_w")), "service", "left").withColumn("waiting", F.coalesce("_w", F.lit(0))).drop("_w")
    return out.withColumns({
        "queue_score": F.col("waiting") + F.col("avg_pending"), "precompute_score": F.col("waiting") + F.coalesce("avg_precompute", F.lit(0.0)),
        "grow": (F.col("avg_gpu") > utilisation) | (F.col("max_pending") > most_pending),
    })
