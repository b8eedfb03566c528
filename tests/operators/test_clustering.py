"""Clusters, codebooks, poses and views against plain loops."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import poses as P
from trailmark.operators import views as V
from trailmark.operators.clustering import codebook, kmeans
from trailmark.plans import ordered_plans  # noqa: F401
from trailmark.plans.registry import ORACLES, QUERIES


def plain_kmeans(x, c, metric, rounds, bound):
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-12)
    if metric == "cosine":
        x, c = unit(x), unit(c)
    for k in range(1, rounds + 1):
        worth = ((x[:, None] - c[None]) ** 2).sum(-1) if metric == "euclid" else -x @ c.T
        of = worth.argmin(1)
        new = c.copy()
        for j in set(of.tolist()):
            mean = x[of == j].mean(0)
            new[j] = mean if metric == "euclid" else unit(mean)
        if np.linalg.norm(new - c, axis=1).max() < bound or k == rounds:
            return of, c, k
        c = new


@pytest.mark.parametrize("metric", ["euclid", "cosine", "dot"])
@pytest.mark.parametrize("rounds", [2, 100])
def test_kmeans_equals_a_plain_loop(spark, metric, rounds):
    rng = np.random.default_rng(21)
    groups = {"a": rng.normal(size=(90, 5)) + rng.integers(0, 3, (90, 1)) * 4, "b": rng.normal(size=(40, 5))}
    points = [(g, i, v.tolist(), 1) for g, x in groups.items() for i, v in enumerate(x)] + [("a", 999, None, 1), ("c", 0, [1.0] * 5, 1)]
    far = [1000.0] * 5 if metric == "euclid" else [-1000.0, 0.0, 0.0, 0.0, 0.0]
    start = [(g, j, x[j].tolist()) for g, x in groups.items() for j in range(3)] + [("a", 3, far)]
    p = spark.createDataFrame(points, "grp string, id long, v array<double>, cluster int").drop("cluster").repartition(4)
    assigned, centroids, done = kmeans(p, spark.createDataFrame(start, "grp string, cluster long, c array<double>"), metric, rounds)
    got = {(r.grp, r.id): r.cluster for r in assigned.collect()}
    means = {(r.grp, r.cluster): r for r in centroids.collect()}
    ran = {g: plain_kmeans(x, np.array([s[2] for s in start if s[0] == g]), metric, rounds, 1e-4) for g, x in groups.items()}
    assert done == max(k for _, _, k in ran.values())
    for g, x in groups.items():
        of, c, _ = plain_kmeans(x, np.array([s[2] for s in start if s[0] == g]), metric, done, -1.0)
        assert [got[g, i] for i in range(len(x))] == of.tolist()
        assert all(np.allclose(means[g, j].c, c[j], atol=1e-9) and means[g, j].size == (of == j).sum() for j in range(len(c)))
    assert ("c", 0) not in got and ("a", 999) not in got


def test_kmeans_refuses_an_unknown_metric(spark):
    with pytest.raises(ValueError):
        kmeans(spark.range(1), spark.range(1), "manhattan")


def plain_codebook(w, size):
    bins = len(w)
    mid = [-1 + (k + 0.5) * 2 / bins for k in range(bins)]
    total = sum(w)
    w = [x / total for x in w]
    c = sorted(np.interp([(k + 0.5) / size for k in range(size)], np.cumsum(w), mid).tolist())
    for _ in range(150):
        cut = [(a + b) / 2 for a, b in zip(c, c[1:])]
        of = [sum(m >= b for b in cut) for m in mid]
        new = []
        for j in range(size):
            s = sum(x for x, o in zip(w, of) if o == j)
            new.append(sum(x * m for x, m, o in zip(w, mid, of) if o == j) / s if s > 1e-30 else c[j])
        moved, c = max(abs(a - b) for a, b in zip(new, c)), new
        if moved < 1e-9:
            break
    cut = [(a + b) / 2 for a, b in zip(c, c[1:])]
    return c, [-1, *cut], [*cut, 1], sum(x * (m - c[sum(m >= b for b in cut)]) ** 2 for x, m in zip(w, mid))


def test_codebook_equals_a_plain_loop(spark):
    rng = np.random.default_rng(30)
    hists = {"n": np.histogram(rng.normal(0, 0.3, 5000), 64, (-1, 1))[0], "one": np.eye(64)[20] * 7, "two": np.eye(64)[3] + np.eye(64)[60], "none": np.zeros(64)}
    rows = [(g, k, float(n)) for g, h in hists.items() for k, n in enumerate(h) if n or g == "none"]
    got = codebook(spark.createDataFrame(rows, "grp string, bin int, n double").repartition(3), 64, 5).collect()
    assert {r.grp for r in got} == {"n", "one", "two"}
    for g in ("n", "one", "two"):
        mine = sorted((r for r in got if r.grp == g), key=lambda r: r.idx)
        c, low, high, mse = plain_codebook(hists[g].tolist(), 5)
        assert np.allclose([(r.centroid, r.low, r.high, r.mse) for r in mine], list(zip(c, low, high, [mse] * 5)), atol=1e-9)


def rotation(rng):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else -q


def rigid(rng, spread=1.0):
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = rotation(rng), rng.normal(size=3) * spread
    return m


def test_rigid_algebra(spark):
    rng = np.random.default_rng(7)
    pairs = [(rigid(rng), rigid(rng)) for _ in range(20)]
    df = spark.createDataFrame([(i, a.ravel().tolist(), b.ravel().tolist()) for i, (a, b) in enumerate(pairs)], "i long, a array<double>, b array<double>")
    for r in df.select("i", P.inverse(F.col("a")).alias("inv"), P.product(F.col("a"), F.col("b")).alias("ab"), F.array(*P.moved(F.col("a"), F.lit(1.0), F.lit(2.0), F.lit(-3.0))).alias("p")).collect():
        a, b = pairs[r.i]
        assert np.allclose(r.inv, np.linalg.inv(a).ravel()) and np.allclose(r.ab, (a @ b).ravel()) and np.allclose(r.p, (a @ [1, 2, -3, 1])[:3])


def test_pose_actions(spark):
    rng = np.random.default_rng(8)
    track = [rigid(rng, 0.2) for _ in range(40)]
    rows = [("t", i, m.ravel().tolist()) for i, m in enumerate(track)] + [("still", i, np.eye(4).ravel().tolist()) for i in range(2)]
    got = {(r.k, r.i): r.action for r in V.pose_actions(spark.createDataFrame(rows, "k string, i long, pose array<double>"), "k", "i").collect()}
    assert got["t", 0] == got["still", 0] == 0 and got["still", 1] == 27 + 9 + 3 + 1
    step = lambda x, t: 2 if x > t else 0 if x < -t else 1
    for i in range(1, 40):
        rel = np.linalg.inv(track[i - 1]) @ track[i]
        assert got["t", i] == step(rel[2, 3], 0.1) * 27 + step(rel[0, 3], 0.1) * 9 + step(rel[1, 3], 0.1) * 3 + step(math.atan2(rel[0, 2], rel[2, 2]), 0.05)


def test_turns_of_just_the_limit_go_by_the_heading(spark):
    turns = [(k, round(k * 0.37, 2) / 10 + d) for k in range(300) for d in (0.0, 0.5)]
    rows = [(k, i, a, math.cos(a), math.sin(a)) for i, (k, a) in enumerate(turns)]
    f = spark.createDataFrame(rows, "k long, i long, a double, c double, s double").selectExpr("k", "i", "a", "array(c, 0D, s, 0D, 0D, 1D, 0D, 0D, -s, 0D, c, 0D, 0D, 0D, 0D, 1D) AS pose")
    got = {r.i: r.action for r in V.pose_actions(f, "k", "i", move=0.5, turn=0.5, heading="a").collect()}
    for i in range(1, 600, 2):
        d = turns[i][1] - turns[i - 1][1]
        assert got[i - 1] == 0 and got[i] == 39 + (2 if math.atan2(math.sin(d), math.cos(d)) > 0.5 else 1)


def test_depth_points_project_back(spark):
    rng = np.random.default_rng(9)
    m, d = rigid(rng), rng.random((4, 6)) * 5
    d[1, 2] = 0
    depths = spark.createDataFrame([(0, y, d[y].tolist()) for y in range(4)], "frame long, row long, depth array<double>")
    camera = spark.createDataFrame([(0, m.ravel().tolist(), 7.0, 8.0, 2.5, 1.5)], "frame long, pose array<double>, fx double, fy double, cx double, cy double")
    got = V.depth_points(depths, camera).collect()
    assert len(got) == 23
    for r in got:
        x, y, z, _ = m @ [r.x, r.y, r.z, 1]
        assert np.allclose((x / z * 7 + 2.5, y / z * 8 + 1.5, z), (r.col, r.row, d[r.row, r.col]))


def test_best_overlap_against_all_pairs(spark):
    rng = np.random.default_rng(18)
    frames = []
    for track in range(2):
        for i in range(25):
            m, a = np.eye(4), rng.uniform(-3, 3)
            m[:3, :3] = [[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]]
            m[:3, 3] = rng.normal(size=3) * (10, 1, 10) + (500 if i % 6 == 5 else 0)
            frames.append((track, i, m))
    lattice = np.array([(x * z, y * z, z) for x in np.linspace(-1, 1, 5) for y in np.linspace(-1, 1, 5) for z in np.linspace(0.1, 30, 5)])
    bases = [(0, 20, 20), (0, 24, 20), (1, 24, 3), (1, 3, 1), (1, 11, 2)]
    f = spark.createDataFrame([(t, i, m.ravel().tolist()) for t, i, m in frames], "track long, idx long, pose array<double>").repartition(3)
    got = {(r.track, r.idx): (r.best, r.ratio) for r in V.best_overlaps(f, spark.createDataFrame(bases, "track long, idx long, before long"), side=5).collect()}
    at = {(t, i): m for t, i, m in frames}
    for t, i, before in bases:
        world = lattice @ at[t, i][:3, :3].T + at[t, i][:3, 3]
        ratios = []
        for j in range(1, before):
            p = (world - at[t, j][:3, 3]) @ at[t, j][:3, :3]
            z = np.maximum(p[:, 2], 1e-6)
            u, v = p[:, 0] * 640 / z + 640, p[:, 1] * 360 / z + 360
            # Points on the very edge of a view may fall to either side; a frame sees its own edge.
            ratios.append(((p[:, 2] > 0.1) & (p[:, 2] < 30) & (u >= 0) & (u <= 1280) & (v >= 0) & (v <= 720)).mean())
        want = (int(np.argmax(ratios)) + 1, max(ratios)) if ratios else (0, 0.0)
        assert got[t, i][0] == want[0] and abs(got[t, i][1] - want[1]) < 0.05


def test_views_meet_without_broadcasts(spark):
    """Small shuffles grow by cells and points after them, so no join may choose a broadcast by their bytes."""
    f = spark.range(400).selectExpr("id % 8 AS track", "id div 8 AS idx", "CAST(id % 5 AS DOUBLE) AS x").select("track", "idx", P.yaw_pose(F.col("x") / 9, [F.col("x"), F.lit(0.0), F.lit(1.0)]).alias("pose")).repartition(4)
    out = V.best_overlaps(f, f.select("track", "idx", F.col("idx").alias("before")), side=3)
    assert out.where("best > 0").count() == 8 * 48
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_overlap_of_repeated_poses_equals_sql(spark, tmp_path):
    """Frames of one pose see each other's edges: the last digit decides, in angles as in sums."""
    odd = [6.9, 13.2] + [k * 0.37 for k in range(400)]
    rows = [(7 * i + 450 * 1000 * copy, user, odd[(31 * i + user) % len(odd)]) for copy in range(6) for i in range(60) for user in range(3)]
    spark.createDataFrame([(e * 3 + u, u, "view", v) for e, u, v in rows], "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in QUERIES["j18_view_overlap"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert len(got) == 3 * 36 and got == set(con.execute(ORACLES["j18_view_overlap"]).fetchall())


def test_turns_have_the_digits_of_the_system(spark):
    angles = [k * 0.001 for k in range(-20_000, 20_000)]
    df = spark.createDataFrame([(a,) for a in [*angles, None, math.inf]], "a double").select("a", P.turned("a").alias("t"))
    for r in df.collect():
        assert (r.t.cos, r.t.sin) == ((None, None) if r.a is None or math.isinf(r.a) else (math.cos(r.a), math.sin(r.a)))
