"""Join operators: last-wins and strict joins, interval, nearest and as-of joins, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.numbers import dot, square_distance


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order (kept whole by a partial aggregate, no sort)."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), order)
    return df.groupBy(key).agg(best.alias("_x")).select(key, "_x.*")


def strict_matches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of left with the number of matches in right, and whether it is exactly one."""
    n = right.groupBy(key).agg(F.count("*").alias("matches"))
    return left.select(key).distinct().join(n, key, "left").fillna({"matches": 0}).withColumn("strict", F.col("matches") == 1)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the value of the last right row of the key at or before its time: one sort of the union, no range join."""
    both = left.select(key, time, *[c for c in left.columns if c not in (key, time)], F.lit(1).alias("_left"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(
        right.select(key, time, F.lit(0).alias("_left"), value), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(time, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_left = 1").drop("_left")


def strict_prompt_faults(wanted: DataFrame, prompts: DataFrame, routes: tuple[str, ...] = ("global", "local", "dual")) -> DataFrame:
    """(name, fault) of a strict selection: wanted (source_id) must each have one prompt (source_id, sample_id, route), with sample ids of their own, and all routes.

    Faults name a source, a sample, or a route that none of the selected prompts has. No rows: the selection holds.
    """
    want = wanted.select("source_id").distinct()
    met = want.join(prompts, "source_id", "left").withColumn("_there", F.col("route").isNotNull() | F.col("sample_id").isNotNull())
    by = met.groupBy("source_id").agg(F.count_if("_there").alias("n"), F.count_if(F.col("_there") & (F.trim(F.coalesce("sample_id", F.lit(""))) == "")).alias("blank"))
    source = by.select(F.col("source_id").alias("name"), F.when(F.col("n") == 0, "missing prompt").when(F.col("n") > 1, "more than one prompt").when(F.col("blank") > 0, "no sample_id").alias("fault"))
    twice = met.where("sample_id IS NOT NULL").groupBy("sample_id").agg(F.countDistinct("source_id").alias("n")).where("n > 1").select(F.col("sample_id").alias("name"), F.lit("repeated sample_id").alias("fault"))
    had = met.where("_there").agg(F.collect_set("route").alias("had"))  # a route is one of few
    absent = had.select(F.explode(F.array_except(F.array(*map(F.lit, routes)), F.col("had"))).alias("name"), F.lit("route not covered").alias("fault"))
    return source.where("fault IS NOT NULL").unionByName(twice).unionByName(absent)


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of left that right lacks, null among them; none if every row of left finds its partner."""
    wanted, had = left.select(key).distinct(), right.select(F.col(key).alias("_k")).distinct()
    return wanted.join(had, F.equal_null(F.col(key), F.col("_k")) & F.col("_k").isNotNull(), "left_anti")


def clearest_in_window(frames: DataFrame, targets: DataFrame, key: str, at: str, target: str, worth: str, reach: int) -> DataFrame:
    """(key, target, clearest): the frame of most worth within reach of each target, the first of equals, else the nearest one.

    frames (key, at, worth) are numbered from 0 without gaps, so the nearest frame of a target beyond a track is its last one. Targets spread over the
    places of their window, an equi-join; null keys are a track of their own.
    """
    ends = frames.groupBy(key).agg(F.max(at).alias("_last"))
    asked = targets.select(F.col(key).alias("_key"), target).join(ends, F.equal_null(F.col("_key"), F.col(key))).select("_key", target, "_last")
    near = asked.select("*", F.explode(F.sequence(F.col(target) - reach, F.col(target) + reach)).alias("_at"))
    found = near.join(frames.select(key, at, worth), F.equal_null(F.col("_key"), F.col(key)) & (F.col("_at") == F.col(at)), "left")
    best = F.max_by(at, F.when(F.col(at).isNotNull(), F.struct(worth, -F.col(at))))
    return found.groupBy(F.col("_key").alias(key), target).agg(F.coalesce(best, F.max("_last")).alias("clearest"))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: float, closed: bool = False) -> DataFrame:
    """Points with the intervals of the key that hold them; buckets of `width` turn the range into an equi-join."""
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = intervals.withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end)))
    return points.withColumn("_b", bucket(at)).join(spread, [key, "_b"]).where(inside).drop("_b")


def nearest_bucket(value: Column, buckets: list[float], one_sided: bool = False) -> Column:
    """Place of the nearest bucket in a short list; one_sided keeps to buckets on the value's own side of 1."""
    rows = []
    for k, b in enumerate(buckets):
        far = F.struct(F.abs(value - b).alias("far"), F.lit(k).alias("k"))
        rows.append(F.when((value >= 1) == F.lit(b >= 1), far) if one_sided else far)
    return F.array_min(F.filter(F.array(*rows), lambda x: x.isNotNull()))["k"]


def _distance(a: Column, b: Column, metric: str) -> Column:
    """l2 of number arrays, or hamming: bits that differ in arrays of longs."""
    if metric == "hamming":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.cast("long").bitwiseXOR(y.cast("long")))), F.lit(0), lambda s, n: s + n).cast("double")
    if metric != "l2":
        raise ValueError(f"no such metric: {metric}")
    return F.sqrt(square_distance(a, b))


def _nearest_two(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, a, b, d, d2): the nearest of each a inside a key, and the distance of the second (null if there is none).

    All pairs of a key are made: a key is one pair of images, whose descriptors are bounded; keys spread over tasks.
    """
    pairs = a.select(key, F.col("id").alias("a"), F.col("v").alias("va")).join(b.select(key, F.col("id").alias("b"), F.col("v").alias("vb")), key)
    d = pairs.select(key, "a", "b", _distance(F.col("va"), F.col("vb"), metric).alias("d"))
    # Ranks up to two are cut inside the tasks before the shuffle, and sorting spills: no list of a group is gathered.
    two = d.withColumn("_r", F.row_number().over(Window.partitionBy(key, "a").orderBy("d", "b"))).where("_r <= 2")
    near = two.groupBy(key, "a").agg(F.min(F.struct("_r", "b", "d")).alias("n1"), F.max(F.when(F.col("_r") == 2, F.col("d"))).alias("d2"))
    return near.select(key, "a", F.col("n1.b").alias("b"), F.col("n1.d").alias("d"), "d2")


def ratio_matches(a: DataFrame, b: DataFrame, key: str, limit: float = 0.75, metric: str = "l2") -> DataFrame:
    """Nearest neighbours inside a key, kept where the first is clearly nearer: d1 < limit * d2."""
    return _nearest_two(a, b, key, metric).where(F.col("d") < limit * F.col("d2")).select(key, "a", "b", "d")


def mutual_matches(a: DataFrame, b: DataFrame, key: str, ratio: float | None = None) -> DataFrame:
    """Pairs inside a key that are each other's most similar by dot product; with a ratio, each other's nearest that both pass the ratio test."""
    if ratio is not None:
        up, down = (_nearest_two(x, y, key, "l2").where(F.col("d") < ratio * F.col("d2")) for x, y in ((a, b), (b, a)))
        return up.select(key, "a", "b", (-F.col("d")).alias("s")).join(down.select(key, F.col("b").alias("a"), F.col("a").alias("b")), [key, "a", "b"])
    pairs = a.select(key, F.col("id").alias("a"), F.col("v").alias("va")).join(b.select(key, F.col("id").alias("b"), F.col("v").alias("vb")), key)
    s = pairs.select(key, "a", "b", dot(F.col("va"), F.col("vb")).alias("s"))
    up = s.groupBy(key, "a").agg(F.max(F.struct("s", (-F.col("b")).alias("k"), "b")).alias("m")).select(key, "a", F.col("m.b").alias("b"), F.col("m.s").alias("s"))
    down = s.groupBy(key, "b").agg(F.max(F.struct("s", (-F.col("a")).alias("k"), "a")).alias("m")).select(key, F.col("m.a").alias("a"), "b")
    return up.join(down, [key, "a", "b"])


def resample(points: DataFrame, track: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Linear interpolation of a track at given places, clamped at its ends."""
    marks = points.select(key, at, F.lit(None).cast("double").alias(value)).union(track.select(key, at, F.col(value).cast("double")))
    w = Window.partitionBy(key).orderBy(at, F.col(value).isNull())
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    back = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(value).isNull().desc())  # the same order backwards: both frames only grow
    seen = (Window.unboundedPreceding, Window.currentRow)
    marks = marks.withColumn("_p", F.last(pair, ignorenulls=True).over(w.rowsBetween(*seen))).withColumn("_n", F.last(pair, ignorenulls=True).over(back.rowsBetween(*seen)))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col(at) - F.col("_p.t")) / F.nullif(F.col("_n.t") - F.col("_p.t"), F.lit(0))
    return marks.where(F.col(value).isNull()).select(key, at, F.coalesce(line, F.col("_p.v"), F.col("_n.v")).alias("value"))


def double_softmax(a: DataFrame, b: DataFrame, key: str, temperature: float, limit: float) -> DataFrame:
    """The best b of each a by the product of the softmax shares of both directions, where it passes the limit."""
    pairs = a.select(key, F.col("id").alias("a"), F.col("v").alias("va")).join(b.select(key, F.col("id").alias("b"), F.col("v").alias("vb")), key)
    e = pairs.select(key, "a", "b", F.exp(dot(F.col("va"), F.col("vb")) / temperature).alias("e"))
    rows, cols = e.groupBy(key, "a").agg(F.sum("e").alias("ra")), e.groupBy(key, "b").agg(F.sum("e").alias("rb"))
    p = e.join(rows, [key, "a"]).join(cols, [key, "b"]).select(key, "a", "b", (F.col("e") / F.col("ra") * F.col("e") / F.col("rb")).alias("p"))
    best = p.groupBy(key, "a").agg(F.max(F.struct("p", (-F.col("b")).alias("k"), "b")).alias("m"))
    return best.where(F.col("m.p") > limit).select(key, "a", F.col("m.b").alias("b"), F.col("m.p").alias("p"))


def adapter_faults(lora: DataFrame, base: DataFrame) -> DataFrame:
    """(key, fault) of adapter tensors (key, shape) that do not pair up: every up needs its down and a base weight of the product's shape.

    unmatched: an up without down or base; shape: sizes that do not multiply to the base's; unused: a key that no up takes in. No rows: all is consumed.
    """
    kind = F.regexp_extract("key", r"\.(lora_up\.weight|lora_down\.weight|alpha)$", 1)
    parts = lora.select("key", "shape", kind.alias("part")).withColumn("stem", F.when(F.col("part") != "", F.expr("substring(key, 1, length(key) - length(part) - 1)")))
    by_stem = parts.where("stem IS NOT NULL").groupBy("stem").agg(*(F.max(F.when(F.col("part") == p, F.struct("shape", "key"))).alias(n) for n, p in (("up", "lora_up.weight"), ("down", "lora_down.weight"), ("alpha", "alpha"))))
    met = by_stem.join(base.select(F.expr("substring(key, 1, length(key) - 7)").alias("stem"), F.col("shape").alias("base")).where(F.col("stem").isNotNull()), "stem", "left")
    up, down = F.col("up.shape"), F.col("down.shape")
    fits = (F.size(up) == 2) & (F.size(down) == 2) & F.coalesce(F.get(up, F.lit(1)) == F.get(down, F.lit(0)), F.lit(False)) & (F.col("base") == F.array(F.get(up, F.lit(0)), F.get(down, F.lit(1))))
    faults = met.where("up IS NOT NULL").select(F.col("up.key").alias("key"), F.when(F.col("down").isNull() | F.col("base").isNull(), "unmatched").when(~F.coalesce(fits, F.lit(False)), "shape").alias("fault")).where("fault IS NOT NULL")
    lone = met.where("up IS NULL").select(F.explode(F.array_compact(F.array(F.col("down.key"), F.col("alpha.key")))).alias("key"), F.lit("unused").alias("fault"))
    return faults.unionByName(lone).unionByName(parts.where("stem IS NULL").select("key", F.lit("unused").alias("fault")))
