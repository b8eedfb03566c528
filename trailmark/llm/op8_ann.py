"""Operator 8, approximate nearest neighbours by an adaptive dimension scan over inverted lists.

1.  Equal vectors become one (their `k` + 1 smallest ids stay: ties go to smaller ids, so no other can be named).
2.  Lists: many small ones (LIST_ROWS vectors each, MAX_LISTS at most) around k-means centroids fitted on a bounded sample (`sample` vectors
    by hash of the id); every vector goes to the list of its nearest centroid. Lists of near centroids share a block of bounded
    rows, and a list too large for a block is dealt over several.
3.  All vectors are rotated by one random orthogonal matrix, so that the first dimensions are fair samples of a distance; a block is
    held column by column.
4.  A query probes its nearest lists until they hold the share `probe` of all vectors, and goes once to each block with
    such a list. It brings a limit: its distance to the k-th other of the sampled vectors in these lists, which no true neighbour exceeds;
    those vectors are candidates at once, so that a query never has too few.
5.  A block's probed lists are scanned by groups of columns, nearest list first. After each group a hypothesis test compares
    the partial distance, scaled to all dimensions, with the limit, which falls with every better find; candidates that it
    rejects are abandoned. Survivors get their distance on the original vectors in double precision.
6.  The k + 1 best of each block merge by query.

Vectors that are null, zero, of another length than the most common one, or hold null or non-finite components take no part; nor do
rows with a null id. Repeated ids with equal vectors count once. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

LIST_ROWS, MAX_LISTS = 5, 4096
BLOCK_ROWS = 4096
QUERY_ROWS = 8192
CHUNK_ROWS = 512  # rows of a block between two updates of the limit
COLUMNS = 16  # columns of a group between two tests
DOUBT = 2.1  # standard deviations of the test
LEAST_ROWS = 20  # least vectors in the probed lists, by the wanted ones
NEAR_SAMPLE = 512  # sampled vectors near a query that its first limit comes from


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(8).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _fit(x: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Lloyd's rounds from a random start; empty lists take the points farthest from their centroid."""
    rng = np.random.default_rng(80)
    x = x.astype(np.float32)
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        at, near = _nearest_list(x, c)
        n = np.bincount(at, minlength=lists)
        order = np.argsort(at, kind="stable")
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some], axis=0) / n[some, None]
        if len(some) < lists:
            c[n == 0] = x[np.argsort(-near)[: int((n == 0).sum())]]
    return c.astype(float)


def _nearest_list(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, near = np.zeros(len(x), np.int64), np.zeros(len(x))
    for a in range(0, len(x), 2048):
        d = _squares(x[a : a + 2048], c)
        at[a : a + 2048] = d.argmin(1)
        near[a : a + 2048] = d.min(1)
    return at, near


def _blocks(centroids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every list: lists in an order that keeps near centroids together, cut at BLOCK_ROWS."""
    coarse = _fit(centroids, max(1, round(math.sqrt(len(centroids)))), 4)
    at, near = _nearest_list(centroids, coarse)
    first, many, block, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for j in np.lexsort((near, at)):
        if held and held + sizes[j] > BLOCK_ROWS:
            block, held = block + 1, 0
        first[j], many[j] = block, max(1, math.ceil(sizes[j] / BLOCK_ROWS))
        block, held = block + many[j] - 1, held + int(sizes[j]) // int(many[j])
    return first, many


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def adaptive_scan(columns: np.ndarray, query: np.ndarray, limit: float) -> np.ndarray:
    """Rows of a block (dimensions x rows, rotated) whose squared distance may be within limit."""
    dim, n = columns.shape
    if not math.isfinite(limit):
        return np.arange(n)
    alive, part = np.arange(n), np.zeros(n)
    for a in range(0, dim, COLUMNS):
        b = min(a + COLUMNS, dim)
        part = part + ((columns[a:b, alive] - query[a:b, None]) ** 2).sum(0)
        if b == dim:
            break
        # Under the hypothesis that the whole distance is at most limit, part * dim / b stays below this with the chosen doubt.
        bound = limit * (1 + DOUBT / math.sqrt(b)) ** 2 * b / dim
        keep = part <= bound
        alive, part = alive[keep], part[keep]
        if not len(alive):
            break
    return alive


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None, probe: float = 0.35, sample: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each row whose id is divisible by `every`; probe: share of the vectors in the probed lists."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    inf = float("inf")
    raw = raw.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("v", lambda x: x != 0))
    dims = raw.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], out)
    dim = int(dims["d"])
    raw = raw.where(F.size("v") == dim).select("vec_id", F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)).alias("v"))
    same = Window.partitionBy("v").orderBy("vec_id")
    few = raw.distinct().withColumn("k", F.row_number().over(same)).where(F.col("k") <= k + 1)
    unique = save(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("uid"), "ids", "v"), "op8-vectors")
    queries = save(raw.where(F.col("vec_id") % every == 0).distinct().join(unique.select("v", "uid"), "v").select(F.col("vec_id").alias("query_id"), "uid"), "op8-queries")

    n = unique.count()
    got = unique.orderBy(F.xxhash64("uid")).limit(sample).select("uid", "v").toArrow()
    names, x = got.column("uid").to_numpy(), _matrix(got.column("v").combine_chunks(), dim).astype(float)
    lists = max(1, min(lists or n // LIST_ROWS, MAX_LISTS, len(x)))
    turn = _rotation(dim)
    centroids = _fit(x @ turn, lists)
    home = _nearest_list(x @ turn, centroids)[0]
    shared = spark.sparkContext.broadcast((turn, centroids))

    def place(batches):
        turn, centroids = shared.value
        for batch in batches:
            if batch.num_rows:
                at, _ = _nearest_list(_matrix(batch.column("v"), dim) @ turn, centroids)
                yield pa.record_batch([batch.column("uid"), batch.column("v"), pa.array(at.astype(np.int32))], names=["uid", "v", "list"])

    placed = save(unique.select("uid", "v").mapInArrow(place, "uid long, v array<double>, list int"), "op8-placed")
    sizes = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["count"]
    first, many = _blocks(centroids, sizes)
    order = np.argsort(home, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(home, minlength=lists))))
    plan = spark.sparkContext.broadcast((sizes, first, many, names[order], x[order], starts))

    def ask(batches):
        """A row for each block that a query probes: its limit, and the probed lists there, nearest first."""
        turn, centroids = shared.value
        sizes, first, many, names, near, starts = plan.value
        schema = pa.schema([("uid", pa.int64()), ("v", pa.list_(pa.float64())), ("block", pa.int64()), ("limit", pa.float64()), ("lists", pa.list_(pa.int32())), ("uids", pa.list_(pa.int64())), ("squares", pa.list_(pa.float64()))])
        most = max(probe * sizes.sum(), LEAST_ROWS * (k + 1))
        for batch in batches:
            for uid, v in zip(batch.column("uid").to_pylist(), _matrix(batch.column("v"), dim)):
                by = np.argsort(_squares((v @ turn)[None], centroids)[0], kind="stable")
                by = by[: int(np.searchsorted(np.cumsum(sizes[by]), most)) + 1].astype(np.int32)
                by = by[sizes[by] > 0]
                close = by[: int(np.searchsorted(np.cumsum(starts[by + 1] - starts[by]), NEAR_SAMPLE)) + 1]
                rows = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in close])
                d = ((near[rows] - v) ** 2).sum(1)
                best = np.lexsort((names[rows], d))[: k + 1]
                limit = float(d[best[k]]) if len(best) > k else math.inf
                here = np.repeat(by, many[by])
                block = np.repeat(first[by], many[by]) + np.arange(len(here)) - np.repeat(np.cumsum(many[by]) - many[by], many[by])
                turned = np.argsort(block, kind="stable")
                blocks, cut = np.unique(block[turned], return_index=True)
                parts, rest = np.split(here[turned], cut[1:]), [None] * (len(blocks) - 1)
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(blocks), uid)),
                        pa.array([v] * len(blocks), pa.list_(pa.float64())),
                        pa.array(blocks),
                        pa.array(np.full(len(blocks), limit)),
                        pa.array(parts, pa.list_(pa.int32())),
                        pa.array([names[rows[best]], *rest], pa.list_(pa.int64())),
                        pa.array([d[best], *rest], pa.list_(pa.float64())),
                    ],
                    schema=schema,
                )

    asked = queries.select("uid").distinct().join(unique.select("uid", "v"), "uid")
    asked = save(asked.mapInArrow(ask, "uid long, v array<double>, block long, limit double, lists array<int>, uids array<long>, squares array<double>"), "op8-asked")
    sampled = asked.where("uids is not null").select(F.col("uid").alias("query"), F.inline(F.arrays_zip(F.col("uids").alias("uid"), F.col("squares").alias("square"))))
    asked = asked.drop("uids", "squares")
    where = spark.createDataFrame([(int(j), int(first[j]), int(many[j])) for j in np.flatnonzero(sizes)], "list int, first long, many long")  # at most MAX_LISTS rows
    placed = placed.join(F.broadcast(where), "list").select("uid", "v", "list", (F.col("first") + F.pmod(F.xxhash64("uid"), "many")).alias("block"))
    # Many queries of a block are dealt over parts, each with a copy of the block.
    counts = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
    placed = placed.join(counts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    asked = asked.join(counts, "block").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("parts")

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        turn, _ = shared.value
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "uid": [], "square": []}).astype({"query": "int64", "uid": "int64", "square": "float64"})
        vec = np.stack(left["v"].to_numpy())
        ids, columns, of = left["uid"].to_numpy(), np.ascontiguousarray((vec @ turn).T), left["list"].to_numpy()
        place = np.full(int(of.max()) + 1, -1)
        q, u, s = [], [], []
        for query, v, limit, probed in zip(right["uid"], right["v"], right["limit"], right["lists"]):
            probed = probed[probed < len(place)]
            place[probed] = np.arange(len(probed))
            rows = np.flatnonzero(place[of] >= 0)
            rows = rows[np.argsort(place[of[rows]], kind="stable")]
            place[probed] = -1
            rotated, near, square = v @ turn, np.zeros(0, np.int64), np.zeros(0)
            for a in range(0, len(rows), CHUNK_ROWS):
                part = rows[a : a + CHUNK_ROWS]
                alive = part[adaptive_scan(columns[:, part], rotated, limit * (1 + 1e-9))]
                near, square = np.concatenate((near, ids[alive])), np.concatenate((square, ((vec[alive] - v) ** 2).sum(1)))
                best = np.lexsort((near, square))[: k + 1]
                near, square = near[best], square[best]
                if len(square) > k:
                    limit = min(limit, square[k])  # the k-th other vector so far
            q.append(np.full(len(near), query))
            u.append(near)
            s.append(square)
        return pd.DataFrame({"query": np.concatenate(q), "uid": np.concatenate(u), "square": np.concatenate(s)})

    keys = ["block", "part"]
    found = placed.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(scan, "query long, uid long, square double")
    found = found.union(sampled).groupBy("query", "uid").agg(F.min("square").alias("square"))
    best = Window.partitionBy("query").orderBy("square", "uid")
    merged = save(found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k + 1).drop("k"), "op8-found")
    # Ids of equal vectors come back, and a query leaves itself out.
    named = merged.join(unique.select("uid", "ids"), "uid").select("query", "square", F.explode("ids").alias("vec_id"))
    named = queries.join(named, queries["uid"] == named["query"]).where("vec_id <> query_id").select("query_id", "vec_id", F.sqrt("square").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
