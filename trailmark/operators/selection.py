"""Choosing rows: candidates of a sample, matches of a pair, blocks of a map, windows of a track."""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHORT = "weighted_coverage_below_threshold"


def select_candidates(samples: DataFrame, rows: DataFrame, mode: str = "frozen") -> DataFrame:
    """The best feasible candidate of each sample (image_key, editable, families), with allowed: whether the scene decision permits its family.

    rows: (image_key, candidate_id, family, reasons, feasible, weighted_coverage, target_precision, area_fraction, distance). frozen takes
    rows without reasons, render_semantics also those whose only reason is too little coverage. Samples without a candidate are left out.
    """
    if mode not in ("frozen", "render_semantics"):
        raise ValueError(f"mode {mode}")
    left = F.col("reasons") if mode == "frozen" else F.array_remove("reasons", SHORT)
    order = F.struct((-F.col("weighted_coverage")).alias("c"), (-F.col("target_precision")).alias("p"), "area_fraction", "distance", "candidate_id")
    best = rows.where((F.size(left) == 0) & F.col("feasible")).groupBy("image_key").agg(F.min(F.struct(order.alias("order"), "family")).alias("best"))
    out = samples.join(best, "image_key").withColumn("candidate_id", F.col("best.order.candidate_id")).withColumn("family", F.col("best.family"))
    return out.withColumn("allowed", F.col("editable") & F.array_contains("families", F.col("family"))).drop("best")


def sample_matches(flow: DataFrame, key: str, many: int, mode: str, height: int, width: int, least: float = 0.0, seed: int = 0) -> DataFrame:
    """Up to `many` pixels (key, y, x, conf) of each pair with conf above least.

    topk: the surest, ties by place. grid: those at an even grid of about the square root of many columns. probabilistic: without
    replacement, with probability in proportion to conf (the smallest of -ln(u) / conf, u from a hash of seed and place).
    """
    sure = flow.where(F.col("conf") > least)
    if mode == "grid":
        cols = max(1, isqrt(many))
        lines = ceil(many / cols)
        spread = lambda i, n, size: F.floor(i * F.lit((size - 1) / max(n - 1, 1)) + 1e-9)
        i = F.col("id")
        grid = flow.sparkSession.range(many).select(spread(F.floor(i / cols), lines, height).alias("y"), spread(i % cols, cols, width).alias("x"))
        return sure.join(F.broadcast(grid), ["y", "x"]).select(key, "y", "x", "conf")  # `many` rows
    if mode == "topk":
        rank = -F.col("conf")
    elif mode == "probabilistic":
        u = (F.pmod(F.xxhash64(F.lit(seed), key, "y", "x"), F.lit(1 << 52)) + 0.5) / (1 << 52)
        rank = -F.log(u) / F.col("conf")
    else:
        raise ValueError(f"mode {mode}")
    place = F.row_number().over(Window.partitionBy(key).orderBy(rank, F.col("y"), F.col("x")))
    return sure.withColumn("_place", place).where(F.col("_place") <= many).select(key, "y", "x", "conf")


def block_map(scores: DataFrame, row: str, col: str, score: str, forced: Column, causal: Column, share: float | None = None, count: int | None = None, sink: bool = False) -> DataFrame:
    """(row, col) of the blocks kept in each row of a map.

    Of the causal blocks that are not forced, softmax shares are taken in descending order (ties by column) while their running sum is at most
    `share`, or `count` of them. Forced ones are kept too where causal, and with sink column 0 always.
    """
    if (share is None) == (count is None):
        raise ValueError("give share or count")
    open_ = causal & ~forced
    w = Window.partitionBy(row)
    ranked = w.orderBy(F.col("_e").desc(), col)
    out = scores.withColumns({"_forced": forced, "_causal": causal, "_x": F.when(open_, F.col(score).cast("double"))})
    out = out.withColumn("_e", F.when(F.col("_x").isNotNull(), F.exp(F.col("_x") - F.max("_x").over(w))).otherwise(0.0))
    if share is None:
        taken = F.row_number().over(ranked) <= count
    else:
        taken = F.sum("_e").over(ranked.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_e").over(w) <= share
    kept = F.col("_causal") & (F.coalesce(F.col("_taken"), F.lit(False)) & (F.col("_e") > 0) | F.col("_forced"))
    out = out.withColumn("_taken", taken).where(kept | (F.col(col) == 0) if sink else kept)
    return out.select(row, col)


def random_window(df: DataFrame, key: str, order: str, length: int, seed: int = 0) -> DataFrame:
    """A run of `length` neighbouring rows of each key from a seeded random start; keys with fewer rows keep all."""
    w = Window.partitionBy(key)
    out = df.withColumn("_n", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy(order)) - 1)
    start = F.pmod(F.xxhash64(F.lit(seed), key), F.greatest(F.lit(1), F.col("_n") - length + 1))
    return out.where((F.col("_at") >= start) & (F.col("_at") < start + length)).drop("_n", "_at")


def ordered_union(*lists: Column) -> Column:
    """All values of the lists once, in ascending order."""
    return F.array_sort(F.array_distinct(F.concat(*lists)))


def _draw(seed: int, *keys: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *keys), 256)


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same in any partitioning: the first by a seeded digest of their key (unique), cut inside the tasks."""
    return df.withColumn("_draw", _draw(seed, key)).orderBy("_draw").limit(n).drop("_draw")


def best_mask(errors: DataFrame, head: str, mask: str, row: str, error: str, rows: int, seed: int = 0) -> DataFrame:
    """(head, mask, mse): the mask with the smallest mean error over `rows` sampled rows of each head, ties to the smaller mask.

    The same rows are looked at for every mask of a head: the first by a seeded digest of head and row.
    """
    drawn = errors.select(head, row).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(head).orderBy(_draw(seed, head, row), row))).where(F.col("_k") <= rows).drop("_k")
    mse = errors.join(drawn, [head, row], "left_semi").groupBy(head, mask).agg(F.round(F.avg(error), 9).alias("mse"))
    return mse.groupBy(head).agg(F.min(F.struct("mse", mask)).alias("_m")).select(head, f"_m.{mask}", "_m.mse")


def within_quantile(df: DataFrame, value: str, share: float, group: str | None = None) -> DataFrame:
    """Rows at or under the interpolated quantile of a value, over all rows or by group; null values go."""
    keys = [group] if group else []
    limit = df.groupBy(*keys).agg(F.percentile(value, F.lit(share)).alias("_limit"))
    joined = df.join(limit, group) if group else df.join(F.broadcast(limit))  # a single row without groups
    return joined.where(F.col(value) <= F.col("_limit")).drop("_limit")
