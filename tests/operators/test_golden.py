"""Hand-written expected values of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import numbers as N
from trailmark.functions import text as T
from trailmark.operators import rules
from trailmark.operators.aggregates import mask_geometry, token_coverage
from trailmark.operators.grouped import components8, homographies, suppress
from trailmark.operators.ordered import merge_intervals
from trailmark.operators.scheduler import schedule
from trailmark.sources import readers, sinks
from trailmark.streaming import streams


def test_schedule_cycles_through_routes(spark):
    rows = spark.createDataFrame([("a", i, 0.9, 0.9, False) for i in range(12)], "run string, ord long, w double, o double, bad boolean")
    assert [r.route for r in schedule(rows).orderBy("ord").collect()] == ["global", "local", "dual"] * 4


def test_token_coverage_identities(spark):
    side = 160
    weights = np.ones((16, 16))
    weights[8:, 8:] = 10
    grid = spark.createDataFrame([(int(k), float(w), 100) for k, w in enumerate(weights.ravel())], "token int, weight double, cell_area int")
    cells = [("exact", y * 16 + x, 100, 100) for y in range(4) for x in range(4)]
    more = [("more", t, n, o) for _, t, n, o in cells] + [("more", 8 * 16 + 8, 100, 0)]
    got = {r.mask: r for r in token_coverage(spark.createDataFrame(cells + more, "mask string, token int, pixels int, overlap int"), grid, "mask").collect()}
    assert side == 160 and got["exact"].precision == 1 and got["exact"].weighted_coverage == pytest.approx(16 / weights.sum())
    assert got["more"].precision == pytest.approx(16 / 17)
    none = token_coverage(spark.createDataFrame(cells, "mask string, token int, pixels int, overlap int"), grid.withColumn("weight", F.lit(0.0)), "mask").first()
    assert none.weighted_coverage is None


def test_thresholds(spark):
    row = spark.createDataFrame([(0.5, 0.7, 0.1, 0.0, 1.0, 0, 1), (0.5, 0.6999, 0.1, 0.0, 1.0, 0, 1)], "weighted_coverage double, target_precision double, area_fraction double, area_low double, area_high double, clipped_pixels int, num_components int")
    got = rules.thresholds(row).orderBy("target_precision", "tau").collect()
    assert [r.passes for r in got] == [False] * 3 + [True, True, False]


def test_mask_geometry_equals_pixels(spark):
    runs = [("m", 0, 2, 9), ("m", 1, 0, 4), ("m", 3, 5, 6)]
    px = np.array([(x + 0.5, y + 0.5) for _, y, a, b in runs for x in range(a, b)])
    got = mask_geometry(spark.createDataFrame(runs, "k string, y long, x0 long, x1 long"), "k").first()
    inertia = ((px - px.mean(0)) ** 2).sum()
    assert (got.area, got.cx, got.cy) == (len(px), pytest.approx(px[:, 0].mean()), pytest.approx(px[:, 1].mean()))
    assert got.compactness == pytest.approx(len(px) ** 2 / (2 * np.pi * (inertia + len(px) / 6)))  # a pixel is a unit square


def test_components_touch_at_corners(spark):
    runs = [("a", 0, 0, 2), ("a", 1, 2, 4), ("a", 3, 0, 5), ("b", 0, 0, 1), ("b", 0, 2, 3), (None, 0, 0, 1)]
    got = {r.k: (r.components, r.largest) for r in components8(spark.createDataFrame(runs, "k string, y long, x0 long, x1 long"), "k").collect()}
    assert got == {"a": (2, 5), "b": (2, 1), None: (1, 1)}


def test_suppression_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    boxes = [(g, i, *map(float, (x, y, x + 10, y + 10)), float(s)) for g in range(3) for i, (x, y, s) in enumerate(zip(rng.integers(0, 40, 60), rng.integers(0, 40, 60), rng.integers(0, 9, 60)))]
    want = set()
    for g in range(3):
        kept = []
        for b in sorted((b for b in boxes if b[0] == g), key=lambda b: (-b[6], b[1])):
            shared = [max(min(b[4], k[4]) - max(b[2], k[2]), 0) * max(min(b[5], k[5]) - max(b[3], k[3]), 0) for k in kept]
            if all(s <= 0.5 * (200 - s) for s in shared):
                kept.append(b)
        want |= {(g, k[1]) for k in kept}
    got = suppress(spark.createDataFrame(boxes, "g long, id long, x0 double, y0 double, x1 double, y1 double, score double"), "g")
    assert {tuple(r) for r in got.collect()} == want


def test_homography_of_a_known_warp(spark):
    h = np.array([[1.1, 0.05, 4], [-0.02, 0.9, 7], [1e-4, 2e-4, 1]])
    p = np.array([(x, y, 1) for x in range(0, 200, 25) for y in range(0, 200, 25)], float)
    q = p @ h.T
    q = q[:, :2] / q[:, 2:]
    q[::5] += 90
    rows = [("pair", *map(float, (*a[:2], *b))) for a, b in zip(p, q)] + [("few", 0.0, 0.0, 1.0, 1.0)]
    got = {r.k: r for r in homographies(spark.createDataFrame(rows, "k string, x0 double, y0 double, x1 double, y1 double"), "k").collect()}
    assert np.allclose(np.reshape(got["pair"].h, (3, 3)), h, atol=0.05) and got["pair"].inliers == len(p) - len(p[::5]) and got["few"].h is None


def test_merge_intervals(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 4, 6), ("a", 6, 7), ("a", 9, 10)], "k string, s long, e long")
    assert sorted((r.s, r.e, r.merged) for r in merge_intervals(rows, "k", "s", "e").collect()) == [(0, 7, 3), (9, 10, 1)]


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.safe_id(F.lit(" ..a b/c?.jpg_ "))) == "a_b_c_.jpg" and one(T.safe_id(F.lit("..."))) is None
    assert tuple(one(T.condition(F.lit(" Rainy-Night + vehicle ")))) == ("rainy_night", "vehicle")
    assert one(T.json_part(F.lit("so: {\"k\": 1} ok"))) == '{"k": 1}'
    assert one(N.score(F.lit("7"))) == 0.7 and one(N.score(F.lit("x"))) == 0.0


def test_json_lines(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"sample_id": "a", "n": 1}\n\n[1]\n{"sample_id": "a", "n": 2}\n{"sample_id": "b", "n": 3, "n": 4}\n{"sample_id": "..", "n": 5}\n')
    rows, faults = readers.json_lines(spark, str(f), "sample_id string, n int", strict=True)
    assert sorted((r.line, r.reason) for r in faults.collect()) == [(2, "blank line"), (3, "not an object"), (4, "repeated sample_id"), (5, "repeated key"), (6, "empty sample_id")]
    assert readers.merged_settings({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}, "b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4}


def test_write_lines_sorted(spark, tmp_path):
    sinks.write_lines(spark.createDataFrame([("b", 2), ("a", 1)], "sample_id string, n int"), str(tmp_path / "out"), "sample_id")
    assert [r.sample_id for r in spark.read.json(str(tmp_path / "out")).orderBy("n").collect()] == ["a", "b"]


def test_task_state_stream_equals_fold(spark, tmp_path):
    rows = [("t1", 1, "submit"), ("t1", 2, "start"), ("t1", 3, "finish"), ("t2", 1, "submit"), ("t2", 2, "finish"), ("t2", 3, "cancel")]
    for k, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, "task string, seq long, action string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    src = spark.readStream.schema("task string, seq long, action string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = streams.task_states(src, "task", "seq", "action").writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = {r.task: r.state for r in spark.table("states").collect() if r.state in ("COMPLETED", "CANCELLED")}
    assert seen == {"t1": streams.fold_states(["submit", "start", "finish"]), "t2": "CANCELLED"}


def test_request_stream_drops_repeats(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:06"), (9, "2024-01-01 00:00:07")], "room long, ts string").coalesce(1).write.json(str(tmp_path / "in"))
    src = spark.readStream.schema("room long, ts timestamp").json(str(tmp_path / "in"))
    known = spark.createDataFrame([(1,), (2,)], "room long")
    q = streams.once(src, "room", "ts", "1 minute", known).writeStream.format("memory").queryName("requests").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.room for r in spark.table("requests").collect()) == [1, 2]


def test_rules_of_skipped_and_rejected_rows(spark):
    """Literal cases: skipped routes never pass, rainy nights are relaxed, rejected rows place nothing, crowding is local, service errors."""
    from trailmark.functions import text as T
    from trailmark.operators import rules

    rows = [(1, "skip", "rain", "vehicle", 0.99, 0.99), (2, "dual", "rainy-night", "vehicle", 0.80, 0.13), (3, "dual", "rainy-night", "person", 0.80, 0.13), (4, "odd", "fog", None, 0.80, 0.25)]
    got = {r.k: (r.skipped, r.passed) for r in rules.verify(spark.createDataFrame(rows, "k int, route string, weather string, occlusion string, s_geo double, s_div double")).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, False), 4: (False, True)}
    bad = spark.createDataFrame([(True, "sky", "none", "sign", "a sign", 0.9)], "editable boolean, region_type string, support_surface string, occluder_family string, object_name string, confidence double")
    r = rules.hard_rules(bad).first()
    assert (r.editable, r.accepted, r.occluder_family, r.object_name) == (False, False, "none", "none")
    crowd = spark.createDataFrame([(1, "local", "vehicle"), (2, "dual", "vehicle"), (3, "local", "person"), (4, None, None)], "k int, route string, occlusion string").withColumn("text", F.lit("A Traffic Jam ahead"))
    assert {r.k: (r.crowded, r.reasons) for r in T.crowding(crowd).collect()} == {1: (True, ["traffic jam"]), 2: (False, []), 3: (False, []), 4: (False, [])}
    errors = spark.createDataFrame([("Timed out",), ("HTTP Error code: 502",), ("Connection error",), ("Insufficient_Quota",), (None,)], "e string")
    assert [r.s for r in errors.select(T.systemic_error(F.col("e")).alias("s")).collect()] == [False, True, False, True, False]
    assert [r.s for r in spark.createDataFrame([("skip",), ("",), ("weather",)], "e string").select(T.judged_route(F.col("e")).alias("s")).collect()] == ["pass", "dual", "global"]


def test_schedule_counts_after_policies(spark):
    rows = spark.createDataFrame([("a", i, 0.9, 0.9, False, "global", "skip", "dual") for i in range(6)], "run string, ord long, w double, o double, bad boolean, after_global string, after_local string, after_dual string")
    # A local row that a policy skips is not counted as local, so local still lacks rows and is asked for again.
    assert [r.route for r in schedule(rows).orderBy("ord").collect()] == ["global", "skip", "skip", "skip", "skip", "skip"]


def test_weather_by_quota(spark):
    cols = "run string, ord long, w double, o double, bad boolean, restricted boolean, safe array<string>, tie long, passed boolean"
    row = lambda i, restricted=False, safe=None, tie=0, passed=True, run="a": (run, i, 0.9, 0.0, False, restricted, safe, tie, passed)
    rows = [row(0), row(1), row(2, True), row(3, False, ["snow", "hail"]), row(4, False, ["hail"], 1), row(0, run="b", passed=False, tie=3), row(1, run="b", tie=3)]
    got = [(r.run, r.weather) for r in schedule(spark.createDataFrame(rows, cols)).orderBy("run", "ord").collect()]
    # The second row can't take overcast again (all made so far); a failed snow leaves the passed counts as they were, but stays made.
    assert got == [("a", "overcast"), ("a", "fog"), ("a", "overcast"), ("a", "snow"), ("a", "night"), ("b", "snow"), ("b", "night")]


def test_long_keys_beside_a_null_stay_whole(spark):
    from trailmark.operators.scheduler import accumulate_select

    keys = [None, 9007199254740993, 9007199254740995, 9007199254740996]
    df = spark.createDataFrame([(k, i, 1.0) for k in keys for i in range(3)], "k long, ord long, gap double").repartition(1)
    got = accumulate_select(df, "k", "ord", "gap", 2.0).collect()
    assert sorted((r.k or 0, r.ord) for r in got) == sorted((k or 0, i) for k in keys for i in (0, 2))
    runs = spark.createDataFrame([(k, 0, 0, 2) for k in keys], "k long, y long, x0 long, x1 long").repartition(1)
    assert {r.k for r in components8(runs, "k").collect()} == set(keys)


def plain_motion(samples, fps, most):
    """samples: (idx, motion, hist) in order."""
    same = lambda a, b: (np.corrcoef(a, b)[0, 1] if np.std(a) * np.std(b) > 0 else 1.0) > 0.999
    total = sum(m for _, m, _ in samples[1:])
    limit, kept, moved = max(5.0, total / most), [samples[0]], 0.0
    for s in samples[1:]:
        moved += s[1] if s[1] >= 1 else 0
        if (moved >= limit or s[0] - kept[-1][0] > 4 * fps) and not any(same(s[2], k[2]) for k in kept):
            kept.append(s)
            moved = 0.0
    if samples[-1][0] != kept[-1][0] and not any(same(samples[-1][2], k[2]) for k in kept):
        kept.append(samples[-1])
    return [k[0] for k in kept]


def test_motion_frames_against_a_plain_loop(spark):
    from trailmark.operators.scheduler import motion_frames

    rng = np.random.default_rng(9)
    tracks = {k: [(int(i) * 3, float(m), rng.integers(0, 3, 4).astype(float).tolist()) for i, m in enumerate(rng.random(n) * (4, 0.9, 12)[k % 3])] for k, n in enumerate((60, 40, 80, 1, 2))}
    tracks[None] = [(0, 9.0, [1.0, 1.0]), (1, 9.0, [1.0, 2.0]), (2, 0.0, [5.0, 6.0])]
    rows = [(k, *s) for k, v in tracks.items() for s in v]
    df = spark.createDataFrame(rows, "k long, idx long, motion double, hist array<double>").repartition(4)
    got = {}
    for r in motion_frames(df, "k", 5.0, 10).collect():
        got.setdefault(r.k, []).append(r.idx)
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_motion(v, 5.0, 10) for k, v in tracks.items()}
