"""Ordered and windowed operators: attempts, interval merges, selections, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attempts(df: DataFrame, key: str, order: str, passed: Column) -> DataFrame:
    """Attempts that run: up to the first that passed; the last of them is final. Adds rounds_used and final."""
    w = Window.partitionBy(key)
    out = df.withColumn("_first", F.min(F.when(passed, F.col(order))).over(w)).where(F.col("_first").isNull() | (F.col(order) <= F.col("_first"))).drop("_first")
    return out.withColumn("rounds_used", F.count("*").over(w)).withColumn("final", F.col(order) == F.max(order).over(w))


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a key united."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) <= reach, 0).otherwise(1)).over(w)
    flagged = df.withColumn("_island", island)
    return flagged.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("_island")


def top_p(df: DataFrame, key: str, weight: str, tie: str, p: float, least: float = 0.0) -> DataFrame:
    """The heaviest rows of a key until their share passes p; the first always, and a least share of the rows."""
    w = Window.partitionBy(key).orderBy(F.desc(weight), tie)
    total = F.sum(weight).over(Window.partitionBy(key))
    before = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / total
    rank, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_b", before).withColumn("_r", rank).withColumn("_n", n).where((F.col("_b") <= p) | (F.col("_r") <= F.floor(F.col("_n") * least))).drop("_b", "_r", "_n")


def best_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def softmax_top_k(df: DataFrame, key: str, logit: str, tie: str, k: int, renormalise: bool = True) -> DataFrame:
    """The k highest rows with their softmax share, over the k or over all rows of the key."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(F.desc(logit), tie)))
    if renormalise:
        ranked = ranked.where(F.col("_r") <= k)
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    out = ranked.withColumn("_e", e).withColumn("share", F.col("_e") / F.sum("_e").over(w))
    return out.where(F.col("_r") <= k).drop("_r", "_e")


def sink_window(df: DataFrame, key: str, order: str, sink: int, evict: int) -> DataFrame:
    """A rolling cache: the first `sink` rows stay, the next `evict` go, the rest move up. Adds slot."""
    pos = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    out = df.withColumn("_p", pos).where((F.col("_p") < sink) | (F.col("_p") >= sink + evict))
    return out.withColumn("slot", F.when(F.col("_p") < sink, F.col("_p")).otherwise(F.col("_p") - evict)).drop("_p")


def evenly_spaced(df: DataFrame, key: str, order: str, count: int) -> DataFrame:
    """`count` rows of a key at evenly spaced places (half to even), all rows if fewer."""
    w = Window.partitionBy(key)
    placed = df.withColumn("_p", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    wanted = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (count - 1)).cast("int")))
    return placed.where((F.col("_n") <= count) | F.array_contains(wanted, F.col("_p").cast("int"))).drop("_p", "_n")


def retention(df: DataFrame, key: str, finished: Column, when: str, tie: str, most: int) -> DataFrame:
    """Rows that stay when each key keeps at most `most`: the oldest finished ones beyond go."""
    w = Window.partitionBy(key)
    over = F.count("*").over(w) - most
    rank = F.row_number().over(Window.partitionBy(key, "_f").orderBy(when, tie))
    out = df.withColumn("_f", finished).withColumn("_over", over)
    return out.withColumn("_r", rank).where(~(F.col("_f") & (F.col("_r") <= F.col("_over")))).drop("_f", "_over", "_r")


def round_robin(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return df.withColumn("slot", ((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) % n).cast("int"))


def label_places(df: DataFrame, label: str, order: str) -> DataFrame:
    """df with its place when rows are sorted by label, then order: counts by label give the starts, so no task sorts more than a label."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    starts = n.select(F.col(label).alias("_label"), (F.sum("_n").over(Window.orderBy(label)) - F.col("_n")).alias("_start"))  # a row by label
    placed = df.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1)
    return placed.join(starts, F.equal_null(F.col(label), F.col("_label"))).withColumn("place", F.col("_k") + F.col("_start")).drop("_k", "_start", "_label")


def unpermuted(df: DataFrame, place: str, own: str) -> DataFrame:
    """Rows sorted by place carry their place in their own order again: the inverse of a permutation is a sort by what it moved."""
    return df.drop(place).sort(own)


def attempt_faults(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, fault) of attempts that can't stand: a round that comes twice, or one after a gap; rounds count from 1."""
    w = Window.partitionBy(key).orderBy(order)
    seen = df.select(key, order).withColumns({"_copies": F.count("*").over(Window.partitionBy(key, order)), "_before": F.lag(order).over(w)})
    fault = F.when(F.col("_copies") > 1, "duplicate round").when(F.col(order) != F.coalesce(F.col("_before"), F.lit(0)) + 1, "round after a gap")
    return seen.select(key, order, fault.alias("fault")).where("fault IS NOT NULL").distinct()


def memory_frames(cur: Column, total: Column, memory: int = 20, recent: int = 12, clip: int = 4) -> Column:
    """Frames to remember before frame cur of total: the recent ones, the first clip, and clips of the history between at even steps, as many as fit.

    All frames before cur while they fit into memory; the first ones where cur lies beyond the track or in its first three frames.
    """
    none = F.array().cast("array<bigint>")
    span = lambda a, b: F.when(b > a, F.sequence(a.cast("long"), (b - 1).cast("long"))).otherwise(none)
    first = F.when(cur > clip, clip).otherwise(0)
    past = F.greatest(F.ceil((cur - recent - clip) / clip), F.lit(0))  # clips of the history
    slots = F.lit(memory - recent) - first
    step = F.greatest(F.lit(1), F.floor(past / (F.floor(slots / clip) + 1)))
    clips = F.when(slots > 0, F.least(F.ceil(past / step), F.ceil(slots / clip))).otherwise(0)
    history = F.flatten(F.transform(span(F.lit(0), clips), lambda k: span(clip + clip * k * step, F.least(2 * clip + clip * k * step, cur))))
    chosen = F.array_sort(F.array_distinct(F.concat(span(F.lit(0), first), history, span(F.greatest(F.lit(0), cur - recent), cur))))
    return F.when(cur <= memory, span(F.lit(0), cur)).when((cur >= total) | (cur < 3), span(F.lit(0), F.least(cur, F.lit(memory)))).otherwise(chosen)
