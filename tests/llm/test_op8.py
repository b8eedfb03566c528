import math

import numpy as np

from trailmark.llm.op8_ann import adaptive_scan, nearest


def brute(vectors, k, every):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids.tolist()], float)
    out = {}
    for i, v in zip(ids.tolist(), x):
        if i % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), d[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    want = brute({r.vec_id: r.embedding for r in rows.collect()}, 10, 20)
    got = {}
    for r in nearest(rows, every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (10 * len(want))
    assert hit >= 0.9, hit
    exact = dict(((q, i), s) for q, v in want.items() for i, s in v)
    assert all(math.isclose(s, exact[q, i], rel_tol=1e-12) for q, v in got.items() for i, s in v if (q, i) in exact)


def test_ties_copies_and_odd_rows(spark):
    same, nan = [1.0, 2.0, 0.0], float("nan")
    rows = [(i, same, 1) for i in range(300)] + [(400, [1.0, 2.0, 1.0], 1), (400, [1.0, 2.0, 1.0], 1), (500, None, 1), (600, [0.0] * 3, 1), (700, [nan, 1.0, 1.0], 1), (800, [None, 1.0, 1.0], 1), (None, same, 1), (900, [1.0], 1), (1000, [5.0, -0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got) == [0, 100, 200, 400, 1000]
    assert got[0] == list(range(1, 11)) and got[200] == list(range(10)) and got[400] == list(range(10)) and got[1000] == list(range(10))
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.where("vec_id in (0, 400)")).count() == 2


def test_scan_keeps_the_near():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(64, 500)), rng.normal(size=64)
    d = ((x - q[:, None]) ** 2).sum(0)
    limit = np.sort(d)[10]
    kept = adaptive_scan(x, q, limit)
    assert len(kept) < 400 and len(set(np.flatnonzero(d <= limit)) - set(kept)) <= 1


def test_every_query_gets_its_number(spark):
    rng = np.random.default_rng(3)
    for n in (7, 30, 600):
        rows = [(i, rng.normal(size=24).tolist()) for i in range(n)]
        got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=3).groupBy("query_id").count().collect()
        assert len(got) == -(-n // 3) and {r["count"] for r in got} == {min(10, n - 1)}


def test_blocks_of_large_lists(spark, monkeypatch):
    """Lists that need several blocks, and blocks whose queries need several parts."""
    import trailmark.llm.op8_ann as op8

    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=16) * 0.01 + (i % 3 == 0)).tolist()) for i in range(900)]
    monkeypatch.setattr(op8, "BLOCK_ROWS", 50)
    monkeypatch.setattr(op8, "QUERY_ROWS", 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, every=10, lists=4, probe=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(dict(rows), 10, 10)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (10 * len(want))
    assert got.keys() == want.keys() and hit >= 0.99
