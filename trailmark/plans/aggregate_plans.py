"""Queries of the aggregations, sources and sinks (2.1, 2.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.operators import aggregates as A
from trailmark.operators import clustering as C
from trailmark.operators import masks as M
from trailmark.operators.grouped import components8, homographies, suppress
from trailmark.plans.registry import query, table
from trailmark.sources import sinks


@query("ag3_vocabulary_counts", "SELECT v.kind, count(e.event_id) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('refund')) v(kind) LEFT JOIN events e ON e.event_type = v.kind GROUP BY v.kind")
def vocabulary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a closed vocabulary, zero where nothing occurs (AG2, AG3)."""
    got = table(spark, sf_dir, "events", "event_type AS kind").groupBy("kind").agg(F.count("*").alias("n"))
    return spark.createDataFrame([("click",), ("view",), ("purchase",), ("refund",)], "kind string").join(got, "kind", "left").fillna({"n": 0})


@query("ag4_exploded_counts", "WITH w AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS word FROM benchmark) SELECT word, count(*) AS n, count(DISTINCT item_id) AS items FROM w GROUP BY word")
def exploded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"))


@query(
    "ag6_distribution",
    """SELECT l_returnflag, count(l_quantity) AS n, min(l_quantity) AS min, quantile_cont(l_quantity, 0.05) AS p05, quantile_cont(l_quantity, 0.5) AS median, round(avg(l_quantity), 6) AS mean, quantile_cont(l_quantity, 0.95) AS p95, max(l_quantity) AS max FROM lineitem GROUP BY l_returnflag""",
)
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distribution(table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity"), "l_returnflag", "l_quantity").withColumn("mean", F.round("mean", 6))


_EDGES = [1.0, 5.0, 10.0, 50.0, 100.0]


@query(
    "ag13_histogram",
    """WITH e AS (SELECT * FROM (VALUES (1, '1.0'), (5, '5.0'), (10, '10.0'), (50, '50.0'), (100, '100.0'), (1e300, '+Inf')) e(edge, le)), t AS (SELECT DISTINCT event_type FROM events)
SELECT t.event_type, e.le, count(v.event_id) AS n FROM t CROSS JOIN e LEFT JOIN events v ON v.event_type = t.event_type AND v.value <= e.edge GROUP BY t.event_type, e.le""",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets by label set (AG13, SK15)."""
    return A.cumulative_histogram(table(spark, sf_dir, "events", "event_type", "value"), "event_type", "value", _EDGES)


@query(
    "ag14_utilisation",
    """WITH s AS (SELECT event_id // 8 AS sample, CASE WHEN event_type <> 'error' THEN value END AS util, CASE WHEN event_type <> 'signup' THEN user_id * 100.0 / 150 END AS mem FROM events WHERE event_type <> 'view')
SELECT sample, printf('%.3f', floor(avg(util) * 1000 + 0.5) / 1000) AS util, printf('%.3f', floor(avg(mem) * 1000 + 0.5) / 1000) AS mem FROM s GROUP BY sample HAVING avg(util) IS NOT NULL AND avg(mem) IS NOT NULL""",
)
def utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages by sample time, printed with three places (half up); samples that lack either metric go (AG14, SK12)."""
    s = table(spark, sf_dir, "events", "event_id div 8 AS sample", "CASE WHEN event_type <> 'error' THEN value END AS util", "CASE WHEN event_type <> 'signup' THEN user_id * 100.0D / 150 END AS mem", "event_type").where("event_type <> 'view'")
    out = s.groupBy("sample").agg(F.avg("util").alias("util"), F.avg("mem").alias("mem")).where("util IS NOT NULL AND mem IS NOT NULL")
    return out.select("sample", *(F.format_string("%.3f", F.floor(F.col(c) * 1000 + 0.5) / 1000).alias(c) for c in ("util", "mem")))


_SERVICE = "['encoder', 'transformer', 'decoder', 'other'][CAST(user_id % 4 + 1 AS INT)]"


@query("ag17_precompute_pending", f"""WITH e AS (SELECT event_id, {_SERVICE} AS service, event_id % 5 AS req, event_id % 3 - 1 AS waiting, event_id % 4 AS execs, event_id % 7 - 2 AS p1, event_id % 6 - 1 AS tr FROM events)
SELECT event_id, service, CAST(CASE service WHEN 'encoder' THEN req + execs WHEN 'transformer' THEN req + greatest(waiting, 0) + execs + greatest(p1, 0) WHEN 'decoder' THEN req + greatest(waiting, 0) + execs + greatest(tr, 0) ELSE -1 END AS BIGINT) AS pending FROM e""")
def precompute_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that waits before a service's own step, by the names of its queues (AG17)."""
    return _instances(spark, sf_dir).select("event_id", "service", A.precompute_pending(F.col("service"), F.col("sizes")).alias("pending"))


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "value", "element_at(array('encoder', 'transformer', 'decoder', 'other'), CAST(user_id % 4 + 1 AS INT)) AS service")
    return e.withColumn("sizes", F.expr("map('req_queue', event_id % 5, 'waiting_queue', event_id % 3 - 1, 'exec_queue', event_id % 4, 'phase1_in', event_id % 7 - 2, 'phase2_out', 9L, 'transfer_in', event_id % 6 - 1)"))


@query(
    "ag15_service_load",
    f"""WITH m AS (SELECT {_SERVICE} AS service, event_id, value AS gpu, CASE WHEN event_id % 11 > 0 THEN event_id % 13 END AS pending, CASE WHEN user_id % 4 < 2 THEN event_id % 5 ELSE -1 END AS pre FROM events),
w AS (SELECT {_SERVICE} AS service, count(*) AS waiting FROM events WHERE event_type = 'error' AND user_id % 4 > 0 GROUP BY 1)
SELECT service, round(avg(gpu), 6) AS avg_gpu, CAST(max(coalesce(pending, -1)) AS BIGINT) AS max_pending, arg_min(event_id, (gpu, event_id)) AS least_used, round(coalesce(any_value(waiting), 0) + avg(coalesce(pending, 0)), 6) AS queue_score, round(coalesce(any_value(waiting), 0) + coalesce(avg(pre) FILTER (pre >= 0), 0), 6) AS precompute_score,
  avg(gpu) > 50 OR max(coalesce(pending, -1)) > 11 AS grow FROM m LEFT JOIN w USING (service) GROUP BY service""",
)
def service_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load by service with its scores, the least used instance and whether it should grow (AG15)."""
    i = _instances(spark, sf_dir)
    m = i.selectExpr("service", "event_id AS instance", "value AS gpu", "CASE WHEN event_id % 11 > 0 THEN event_id % 13 END AS pending", "CASE WHEN user_id % 4 < 2 THEN event_id % 5 ELSE -1 END AS precompute")
    waiting = table(spark, sf_dir, "events", "user_id", "event_type", "element_at(array('encoder', 'transformer', 'decoder', 'other'), CAST(user_id % 4 + 1 AS INT)) AS service").where("event_type = 'error' AND user_id % 4 > 0").groupBy("service").agg(F.count("*").alias("waiting"))
    out = A.service_load(m, waiting, 50.0, 11)
    return out.select("service", F.round("avg_gpu", 6).alias("avg_gpu"), "max_pending", "least_used", F.round("queue_score", 6).alias("queue_score"), F.round("precompute_score", 6).alias("precompute_score"), "grow")


_STAGES = "CAST(max(CASE WHEN l_linenumber = {0} THEN l_quantity END) AS DOUBLE) AS s{0}"


@query(
    "ag16_latency",
    f"""WITH s AS (SELECT l_orderkey, {', '.join(_STAGES.format(k) for k in range(1, 5))} FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, s2 - s1 AS s1_to_s2, s3 - s2 AS s2_to_s3, s4 - s3 AS s3_to_s4, (s2 - s1) + (s3 - s2) + (s4 - s3) AS total FROM s""",
)
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage differences of a request; their sum only if all are known."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    stamps = li.groupBy("l_orderkey").agg(*(F.max(F.when(F.col("l_linenumber") == k, F.col("l_quantity"))).alias(f"s{k}") for k in range(1, 5)))
    return A.latency(stamps, ["s1", "s2", "s3", "s4"], "l_orderkey")


@query("ag18_gauges", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus IN ('P', 'O')) AS active, count(*) FILTER (o_orderstatus IN ('P', 'O')) < 100 AS accepts FROM orders GROUP BY o_orderpriority")
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue gauges and back-pressure (AG18, ST10)."""
    active = F.count_if(F.col("o_orderstatus").isin("P", "O"))
    return table(spark, sf_dir, "orders", "o_orderpriority", "o_orderstatus").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "P").alias("pending"), active.alias("active"), (active < 100).alias("accepts"))


@query("ag19_voxel_mean", "SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS v_x, CAST(floor(l_discount / 0.025) AS BIGINT) AS v_y, round(avg(l_extendedprice), 4) AS c, count(*) AS n FROM (SELECT *, l_discount + 0.001 AS d FROM lineitem) GROUP BY 1, 2")
def voxel_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "lineitem", "floor(l_quantity / 5) AS v_x", "floor(l_discount / 0.025D) AS v_y", "l_extendedprice").groupBy("v_x", "v_y")
    return out.agg(F.round(F.avg("l_extendedprice"), 4).alias("c"), F.count("*").alias("n"))


@query("ag20_weighted_voxels", "SELECT CAST(floor(l_quantity / 10.0) AS BIGINT) AS v_l_quantity, round(sum(l_extendedprice * l_tax) / greatest(sum(l_tax), 1e-8), 4) AS l_extendedprice, count(*) AS n FROM lineitem GROUP BY 1")
def weighted_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means by grid cell (AG20, AG31)."""
    out = A.voxel_mean(table(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice", "l_tax"), 10.0, ("l_quantity",), ("l_extendedprice",), "l_tax")
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query("ag22_softmax_merge", "WITH e AS (SELECT user_id, value / 100 AS x, CAST(event_id % 7 AS DOUBLE) AS v FROM events) SELECT user_id, round(max(x) + ln(sum(exp(x - m))), 6) AS lse, round(sum(v * exp(x - m)) / sum(exp(x - m)), 6) AS v FROM (SELECT *, max(x) OVER (PARTITION BY user_id) AS m FROM e) GROUP BY user_id")
def softmax_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial softmax sums of shards, merged by rescaling (AG22)."""
    e = table(spark, sf_dir, "events", "user_id", "event_id % 3 AS shard", "value / 100 AS x", "CAST(event_id % 7 AS DOUBLE) AS v")
    top = e.groupBy("user_id", "shard").agg(F.max("x").alias("m"))
    w = F.exp(F.col("x") - F.col("m"))
    parts = e.join(top, ["user_id", "shard"]).groupBy("user_id", "shard").agg(F.first("m").alias("m"), F.sum(w).alias("s"), (F.sum(F.col("v") * w) / F.sum(w)).alias("v"))
    return A.merge_softmax(parts, "user_id").select("user_id", F.round(F.col("m") + F.log("s"), 6).alias("lse"), F.round("v", 6).alias("v"))


@query("ag23_repeat_mean", "SELECT l_orderkey, l_linenumber, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber")
def repeat_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.count("*").alias("n"))


@query(
    "ag25_percentile_bounds",
    """SELECT user_id, CASE WHEN count(*) > 60 THEN quantile_cont(value, 0.05) ELSE min(value) END AS low, CASE WHEN count(*) > 60 THEN quantile_cont(value, 0.95) ELSE max(value) END AS high FROM events GROUP BY user_id""",
)
def percentile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile bounds for large groups, extremes for small ones (AG25)."""
    many = F.count("*") > 60
    return table(spark, sf_dir, "events", "user_id", "value").groupBy("user_id").agg(F.when(many, F.percentile("value", F.lit(0.05))).otherwise(F.min("value")).alias("low"), F.when(many, F.percentile("value", F.lit(0.95))).otherwise(F.max("value")).alias("high"))


@query("ag27_distinct", "SELECT count(DISTINCT doc_id) AS ids, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT sha256(coalesce(text, ''))) AS texts FROM documents")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text").agg(F.countDistinct("doc_id").alias("ids"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.countDistinct(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("texts"))


@query("ag28_ordered_digest", "SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ordered_digest(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", F.coalesce("text", F.lit("")))


@query("ag29_block_bytes", "SELECT CAST(regexp_extract(c_name, '#0*(\\d+)\\d\\d$', 1) AS BIGINT) AS block, count(*) AS tensors, CAST(sum(length(c_mktsegment)) AS BIGINT) AS bytes FROM customer GROUP BY 1")
def block_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by a block number in the key (AG29)."""
    block = F.regexp_extract("c_name", r"#0*(\d+)\d\d$", 1).cast("bigint")
    return table(spark, sf_dir, "customer", "c_name", "c_mktsegment").groupBy(block.alias("block")).agg(F.count("*").alias("tensors"), F.sum(F.length("c_mktsegment")).alias("bytes"))


@query("ag32_binned_counts", "SELECT label, CAST(least(31, greatest(0, floor((v + 0.5) * 32))) AS INT) AS bin, count(*) AS n FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1, 2")
def binned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings", "label", "embedding").select("label", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    return v.groupBy("label", F.expr("CAST(least(31, greatest(0, floor((v + 0.5) * 32))) AS INT)").alias("bin")).agg(F.count("*").alias("n"))


def _lloyd_sql(rounds: int) -> str:
    """Lloyd rounds one after the other: assignments a1, a2, ... and centroids c1, c2, ..., the last assignment to the centroids before the last move."""
    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"a{k} AS (SELECT p.grp, id, v, arg_min(cluster, (list_distance(v, c), cluster)) AS cluster FROM p JOIN c{k - 1} USING (grp) GROUP BY p.grp, id, v)")
        mean = f"SELECT grp, cluster, list(m ORDER BY i) AS m FROM (SELECT grp, cluster, i, avg(v[i]) AS m FROM a{k}, range(1, 65) AS r(i) GROUP BY ALL) GROUP BY ALL"
        steps.append(f"c{k} AS (SELECT c.grp, c.cluster, coalesce(m, c) AS c FROM c{k - 1} c LEFT JOIN ({mean}) USING (grp, cluster))")
    return ", ".join(steps)


@query(
    "ag21_kmeans",
    f"""WITH p AS (SELECT label % 2 AS grp, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c0 AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS cluster, v AS c FROM p QUALIFY cluster < 4), {_lloyd_sql(3)}
SELECT CAST(grp AS BIGINT) AS grp, cluster, count(*) AS size, CAST(min(id) AS BIGINT) AS first_id, CAST(sum(id) AS BIGINT) AS ids FROM a3 GROUP BY ALL""",
)
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three Lloyd rounds by label parity from the first four vectors of each (AG21)."""
    p = table(spark, sf_dir, "embeddings", "CAST(label % 2 AS BIGINT) AS grp", "vec_id AS id", "embedding AS v")
    place = F.row_number().over(Window.partitionBy("grp").orderBy("id")).cast("long") - 1
    start = p.withColumn("cluster", place).where("cluster < 4").select("grp", "cluster", F.col("v").alias("c"))
    assigned, _, _ = C.kmeans(p, start, rounds=3, bound=0.0)
    return assigned.groupBy("grp", "cluster").agg(F.count("*").alias("size"), F.min("id").alias("first_id"), F.sum("id").alias("ids"))


@query("ag30_codebook")
def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight levels for each label's values from their histogram (AG30); rounds until they rest, so SQL can't state it (tests hold it against a plain loop)."""
    counts = table(spark, sf_dir, "embeddings", "label AS grp", "explode(embedding) AS v").groupBy("grp", F.expr("CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 1) * 128))) AS INT)").alias("bin")).agg(F.count("*").alias("n"))
    return C.codebook(counts, 256, 8)


_RUNS = "SELECT l_orderkey AS mask, l_linenumber AS y, CAST(l_suppkey % 40 AS BIGINT) AS x0, CAST(l_suppkey % 40 + l_quantity AS BIGINT) AS x1 FROM lineitem"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as run-length rows; an order is a mask."""
    return table(spark, sf_dir, "lineitem", "l_orderkey AS mask", "l_linenumber AS y", "CAST(l_suppkey % 40 AS BIGINT) AS x0", "CAST(l_suppkey % 40 + l_quantity AS BIGINT) AS x1")


@query(
    "ag7_mask_geometry",
    f"""WITH p AS (SELECT mask, y + 0.5 AS y, unnest(range(x0, x1)) + 0.5 AS x FROM ({_RUNS}))
SELECT mask, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(least(1.0, count(*) * count(*) / (2 * pi() * (sum(x * x + y * y) - (sum(x) * sum(x) + sum(y) * sum(y)) / count(*) + count(*) / 6))), 6) AS compactness FROM p GROUP BY mask""",
)
def mask_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, centroid and compactness in closed form by run, no pixel rows (AG7)."""
    return A.mask_geometry(runs(spark, sf_dir), "mask").select("mask", "area", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "compactness")))


@query(
    "ag9_token_coverage",
    f"""WITH p AS (SELECT mask, (y % 8) * 2 + x // 64 AS token, x >= 20 AND x < 60 AS hit FROM (SELECT mask, y, unnest(range(x0, x1)) AS x FROM ({_RUNS}))),
c AS (SELECT mask, token, count(*) AS pixels, count(*) FILTER (hit) AS overlap FROM p GROUP BY mask, token), g AS (SELECT token, (token + 1) / 16 AS weight FROM range(16) r(token))
SELECT mask, CAST(sum(pixels) AS BIGINT) AS area, round(sum(pixels / 64 * weight) / (SELECT sum(weight) FROM g), 6) AS weighted_coverage, round(sum(overlap) / sum(pixels), 6) AS precision FROM c JOIN g USING (token) GROUP BY mask""",
)
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted coverage and precision; runs are cut at token borders, so pixels are never rows (AG9, J9, J10, J11)."""
    cut = runs(spark, sf_dir).select("*", F.explode(F.sequence(F.floor(F.col("x0") / 64), F.floor((F.col("x1") - 1) / 64))).alias("col"))
    a, b = F.greatest("x0", F.col("col") * 64), F.least("x1", F.col("col") * 64 + 64)
    shared = F.greatest(F.lit(0), F.least(b, F.lit(60)) - F.greatest(a, F.lit(20)))
    cells = cut.groupBy("mask", ((F.col("y") % 8) * 2 + F.col("col")).alias("token")).agg(F.sum(b - a).alias("pixels"), F.sum(shared).alias("overlap"))
    grid = spark.range(16).selectExpr("id AS token", "(id + 1) / 16 AS weight", "64 AS cell_area")
    return A.token_coverage(cells, grid, "mask").withColumns({c: F.round(c, 6) for c in ("weighted_coverage", "precision")})


@query(
    "ag24_change_metrics",
    """WITH p AS (SELECT a.vec_id AS vec_id, unnest(range(64)) AS i, unnest(CAST(a.embedding AS DOUBLE[])) AS x, unnest(CAST(b.embedding AS DOUBLE[])) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, count(*) FILTER (i < 16 AND abs(x - y) > 0.1) AS inside, count(*) FILTER (i >= 16 AND abs(x - y) > 0.1) AS outside, round(avg(abs(x - y)), 6) AS mean FROM p GROUP BY vec_id""",
)
def change_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed cells inside and outside a region, and the mean difference (AG12, AG24), inside the arrays."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding AS x")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id").withColumn("d", F.expr("zip_with(x, y, (p, q) -> abs(CAST(p AS DOUBLE) - CAST(q AS DOUBLE)))"))
    return both.selectExpr("vec_id", "CAST(size(filter(slice(d, 1, 16), v -> v > 0.1D)) AS BIGINT) AS inside", "CAST(size(filter(slice(d, 17, size(d)), v -> v > 0.1D)) AS BIGINT) AS outside", "round(aggregate(d, 0D, (s, v) -> s + v) / size(d), 6) AS mean")


@query("ag_grouping_sets", "SELECT event_type, user_id % 5 AS band, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY GROUPING SETS ((event_type, band), (event_type), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in the reference; Spark's own."""
    e = table(spark, sf_dir, "events", "event_type", "user_id % 5 AS band", "value")
    return e.groupingSets([["event_type", "band"], ["event_type"], []], "event_type", "band").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("sk2_record_upsert", "WITH r AS (SELECT o_custkey AS k, max(o_orderkey) AS rec FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), e AS (SELECT o_custkey AS k, max(o_orderkey) AS err FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT k, 'record' AS kind, rec AS o_orderkey FROM r UNION ALL SELECT k, 'error', err FROM e WHERE k NOT IN (SELECT k FROM r)")
def record_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest records by key; errors of keys without one (SK2)."""
    o = table(spark, sf_dir, "orders", "o_custkey AS k", "o_orderkey", "o_orderstatus")
    errors = o.where("o_orderstatus = 'P'").groupBy("k").agg(F.max("o_orderkey").alias("o_orderkey"))
    records, left = sinks.upsert(o.where("o_orderstatus <> 'P'").select("k", "o_orderkey"), errors, "k", "o_orderkey")
    return records.select("k", F.lit("record").alias("kind"), "o_orderkey").union(left.select("k", F.lit("error"), "o_orderkey"))


@query("sk4_accepted_manifest", "SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, l_linenumber AS candidate, l_quantity / 50 AS s_geo FROM lineitem WHERE l_quantity >= 25 AND l_returnflag <> 'R'")
def accepted_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates inside records that passed and are eligible (SK4)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    one = F.struct(F.col("l_linenumber").alias("candidate"), (F.col("l_quantity") / 50).alias("s_geo"), (F.col("l_quantity") >= 25).alias("passed"), (F.col("l_returnflag") != "R").alias("eligible_for_training"))
    records = li.groupBy(F.col("l_orderkey").cast("string").alias("sample_id")).agg(F.collect_list(one).alias("training_candidates"))  # a record holds its few attempts
    return sinks.accepted(records).select("sample_id", "candidate", "s_geo")


@query(
    "sk5_output_paths",
    """WITH r AS (SELECT o_orderkey, ['dual', 'global', 'local'][CAST(o_orderkey % 3 + 1 AS INT)] AS route, CASE WHEN o_orderkey % 3 < 2 THEN 'rain' WHEN o_orderkey % 2 = 0 THEN '' END AS w, CASE WHEN o_orderkey % 3 <> 1 THEN 'vehicle' END AS o, o_totalprice > 200000 AS ok FROM orders)
SELECT o_orderkey, CASE WHEN ok THEN '' ELSE 'rejected/' END || route || '/' || o_orderkey || '__' || concat_ws('_', route, nullif(w, ''), o) || CASE WHEN ok THEN '__final.jpg' ELSE '__rejected.jpg' END AS path FROM r""",
)
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by route, weather and occlusion, of which some are null or empty (SK5)."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "element_at(array('dual', 'global', 'local'), CAST(o_orderkey % 3 + 1 AS INT)) AS route", "CASE WHEN o_orderkey % 3 < 2 THEN 'rain' WHEN o_orderkey % 2 = 0 THEN '' END AS w", "CASE WHEN o_orderkey % 3 <> 1 THEN 'vehicle' END AS o")
    return o.select("o_orderkey", sinks.output_path(F.col("o_orderkey").cast("string"), F.col("route"), F.col("w"), F.col("o"), F.col("o_totalprice") > 200000).alias("path"))


@query("sk8_prefix_check", "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 3 THEN 'not in the new list' ELSE 'changed' END AS reason FROM orders WHERE o_orderkey % 50 = 3 OR o_orderkey % 70 = 5")
def prefix_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that keep a task list from being resumed (SK8)."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    new = o.where("o_orderkey % 50 <> 3").withColumn("o_custkey", F.when(F.col("o_orderkey") % 70 == 5, -1).otherwise(F.col("o_custkey")))
    return sinks.prefix_faults(o, new, "o_orderkey")


@query("j21_suppression")
def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy non-maximum suppression inside an image and class; a loop that SQL can't state (tests hold it against a plain loop)."""
    b = table(spark, sf_dir, "lineitem", "l_orderkey AS image", "l_linenumber * 1000000 + l_partkey AS id", "l_quantity AS x0", "l_discount * 100 AS y0", "l_quantity + 10 AS x1", "l_discount * 100 + 10 AS y1", "l_extendedprice AS score")
    return suppress(b, "image", 0.3)


@query("ag8_components")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components8(runs(spark, sf_dir), "mask")


@query("geo_homographies")
def pair_homographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RANSAC on the matches of each pair; random picks, so SQL can't state it."""
    m = table(spark, sf_dir, "events", "user_id AS pair", "CAST(event_id * 37 % 640 AS DOUBLE) AS x0", "CAST(event_id * 91 % 480 AS DOUBLE) AS y0", "event_type")
    far = F.when(F.col("event_type") == "error", 60.0).otherwise(0.0)
    return homographies(m.select("pair", "x0", "y0", (F.col("x0") * 1.1 + F.col("y0") * 0.05 + 4 + far).alias("x1"), (F.col("y0") * 0.9 - F.col("x0") * 0.02 + 7 - far).alias("y1")), "pair").select("pair", "matches", "inliers")


@query(
    "ag26_orientation",
    """WITH px AS (SELECT vec_id // 4 AS image, vec_id % 4 * 4 + k // 16 AS y, k % 16 AS x, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding) AS v FROM embeddings)),
n AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS rr, lag(v) OVER c AS u, lead(v) OVER c AS d FROM px WINDOW r AS (PARTITION BY image, y ORDER BY x), c AS (PARTITION BY image, x ORDER BY y)),
g AS (SELECT image, CASE WHEN l IS NULL THEN rr - v WHEN rr IS NULL THEN v - l ELSE (rr - l) / 2 END AS gx, CASE WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END AS gy FROM n),
m AS (SELECT *, sqrt(gx * gx + gy * gy) AS w FROM g), e AS (SELECT *, degrees(atan2(gy, gx)) + 135 AS a FROM m QUALIFY w >= quantile_cont(w, 0.85) OVER (PARTITION BY image) AND w > 0),
t AS (SELECT image, w, a - 90 * floor(a / 90) - 45 AS turn FROM e), b AS (SELECT image, least(CAST(floor(turn + 45.5) AS INT), 90) AS bin, sum(w) AS w FROM t GROUP BY ALL),
f AS (SELECT i.image, r.bin, sum(coalesce(w, 0)) OVER (PARTITION BY i.image ORDER BY r.bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM (SELECT DISTINCT image FROM t) i CROSS JOIN range(91) r(bin) LEFT JOIN b ON b.image = i.image AND b.bin = r.bin),
a AS (SELECT image, arg_max(bin, (round(s, 9), -bin)) - 45 AS axis FROM f GROUP BY image),
o AS (SELECT image, any_value(axis) AS axis, count(*) AS n, sum(w) FILTER (abs(turn - axis) <= 2.5) / sum(w) AS share, sum(turn * w) FILTER (abs(turn - axis) <= 2.5) / sum(w) FILTER (abs(turn - axis) <= 2.5) AS mean FROM t JOIN a USING (image) GROUP BY image)
SELECT image, n >= 16 AND share >= 0.15 AND abs(axis) <= 30 AS found, round(CASE WHEN n >= 16 AND share >= 0.15 AND abs(axis) <= 30 THEN mean ELSE 0 END, 6) AS angle, round(CASE WHEN n >= 16 THEN share ELSE 0 END, 6) AS share FROM o""",
)
def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest edge direction of images of 16 x 16 pixels, four vectors each (AG26)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "vec_id div 4 AS image", "CAST(embedding AS array<double>) AS v")
    whole = e.groupBy("image").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda r: r["v"])).alias("values"))  # four rows
    images = whole.select("image", (F.size("values") / 16).cast("int").alias("height"), F.lit(16).alias("width"), "values")
    return M.facade_angles(images).select("image", (F.col("method") != "image_axis_fallback").alias("found"), F.round("angle_degrees", 6).alias("angle"), F.round("evidence_fraction", 6).alias("share"))

