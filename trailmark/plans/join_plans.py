"""Queries of the joins, vector matching and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions import numbers as N
from trailmark.operators import joins as J
from trailmark.operators.ordered import round_robin
from trailmark.plans.registry import query, table

EPOCH = "CAST(epoch_us(ts) AS BIGINT) // 1000000"


def events(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Events with their whole seconds."""
    return table(spark, sf_dir, "events", *cols, "unix_seconds(CAST(ts AS TIMESTAMP)) AS t")


@query(
    "j1_last_wins_join",
    """WITH p AS (SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS last_order, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey)
SELECT c_custkey, last_order, status FROM customer JOIN p ON o_custkey = c_custkey""",
)
def last_wins_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = J.last_wins(table(spark, sf_dir, "orders", "o_custkey AS c_custkey", "o_orderkey AS last_order", "o_orderstatus AS status"), "c_custkey", "last_order")
    return table(spark, sf_dir, "customer", "c_custkey").join(prompts, "c_custkey")


@query("j2_strict_join", "SELECT c_custkey, count(o_orderkey) AS matches, count(o_orderkey) = 1 AS strict FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def strict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.strict_matches(table(spark, sf_dir, "customer", "c_custkey"), table(spark, sf_dir, "orders", "o_custkey AS c_custkey"), "c_custkey")


@query(
    "j3_record_equality",
    """SELECT l_orderkey, count(*) AS n, count(*) FILTER (NOT (l_linestatus IS NOT DISTINCT FROM o_orderstatus)) AS status_differs, count(*) FILTER (NOT (CAST(l_shipdate AS DATE) IS NOT DISTINCT FROM CAST(o_orderdate AS DATE))) AS date_differs
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""",
)
def record_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-safe equality of columns that two tables share by key."""
    both = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linestatus", "l_shipdate").join(table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate"), F.expr("l_orderkey = o_orderkey"))
    return both.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.expr("NOT (l_linestatus <=> o_orderstatus)")).alias("status_differs"), F.count_if(F.expr("NOT (DATE(l_shipdate) <=> DATE(o_orderdate))")).alias("date_differs"))


@query(
    "j6_resume_anti_join",
    "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)",
)
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run still has to do."""
    return table(spark, sf_dir, "documents", "doc_id", "source").join(table(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1"), "doc_id", "left_anti")


@query(
    "j14_interval_join",
    f"""WITH p AS (SELECT event_id, user_id, {EPOCH} AS t FROM events WHERE event_type = 'click'),
i AS (SELECT user_id, {EPOCH} AS s, {EPOCH} + 600 * (1 + event_id % 30) AS e FROM events WHERE event_type = 'view')
SELECT event_id, count(*) AS frames, min(s) AS first_start FROM p JOIN i USING (user_id) WHERE t >= s AND t < e GROUP BY event_id""",
)
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks inside view intervals of the same user, by time buckets instead of a range join."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type")
    spans = e.where("event_type = 'view'").selectExpr("user_id", "t AS s", "t + 600 * (1 + event_id % 30) AS e")
    got = J.interval_join(e.where("event_type = 'click'").select("event_id", "user_id", "t"), spans, "user_id", "t", "s", "e", 7200.0)
    return got.groupBy("event_id").agg(F.count("*").alias("frames"), F.min("s").alias("first_start"))


_RATIOS = [0.42, 0.75, 1.0, 1.33, 1.78, 2.4]


@query(
    "j15_nearest_bucket",
    """WITH r AS (SELECT p_partkey, p_retailprice / 1000 * (1 + p_size / 50) AS x FROM part), b AS (SELECT * FROM (VALUES (0, 0.42), (1, 0.75), (2, 1.0), (3, 1.33), (4, 1.78), (5, 2.4)) b(k, v)),
c AS (SELECT p_partkey, x, k, CAST(v AS DOUBLE) AS v FROM r, b)
SELECT p_partkey, CAST(arg_min(k, (abs(x - v), k)) AS INT) AS nearest, CAST(arg_min(k, (abs(x - v), k)) FILTER ((x >= 1) = (v >= 1)) AS INT) AS same_side FROM c GROUP BY p_partkey""",
)
def nearest_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest aspect bucket, free and on the value's own side of 1."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_retailprice / 1000 * (1 + p_size / 50) AS x")
    return p.select("p_partkey", J.nearest_bucket(F.col("x"), _RATIOS).alias("nearest"), J.nearest_bucket(F.col("x"), _RATIOS, True).alias("same_side"))


@query(
    "j17_nearest_in_window",
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, value AS clarity FROM events), t AS (SELECT user_id, idx * 10 AS target FROM e)
SELECT t.user_id, t.target, coalesce(arg_max(e.idx, (e.clarity, -e.idx)) FILTER (abs(e.idx - t.target) <= 3), arg_min(e.idx, (abs(e.idx - t.target), e.idx))) AS clearest FROM t JOIN e ON e.user_id IS NOT DISTINCT FROM t.user_id GROUP BY t.user_id, t.target""",
)
def nearest_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clearest frame within three of each target, else the nearest frame (J17): targets spread over their seven frames, an equi-join.

    Frames are numbered from 0 without gaps, so the nearest frame of a target beyond the track is its last one.
    """
    e = table(spark, sf_dir, "events", "event_id", "user_id", "value").withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint") - 1)
    return J.clearest_in_window(e, e.select("user_id", (F.col("idx") * 10).alias("target")), "user_id", "idx", "target", "value", 3)


@query(
    "j16_as_of",
    f"""WITH e AS (SELECT event_id, user_id, event_type, value, {EPOCH} AS t FROM events),
v AS (SELECT user_id, t, max_by(value, event_id) AS value FROM e WHERE event_type = 'purchase' GROUP BY user_id, t)
SELECT l.event_id, r.value AS last_value FROM (SELECT * FROM e WHERE event_type = 'error') l ASOF LEFT JOIN v r ON l.user_id = r.user_id AND l.t >= r.t""",
)
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of the user before each error: one sort, no range join."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type", "value")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "t").agg(F.max_by("value", "event_id").alias("last_value"))
    return J.as_of(e.where("event_type = 'error'").select("event_id", "user_id", "t"), right, "user_id", "t", "last_value").select("event_id", "last_value")


_STAGES = (("warm", 3600.0), ("ramp", 86400.0), ("peak", 432000.0), ("cool", 604800.0))


@query(
    "j19_stage_at_time",
    f"""WITH s AS (SELECT * FROM (VALUES ('warm', 0, 3600), ('ramp', 3600, 90000), ('peak', 90000, 522000), ('cool', 522000, 1e18)) s(stage, a, b)), e AS (SELECT {EPOCH} - min({EPOCH}) OVER () AS sec, value FROM events)
SELECT stage, count(*) AS n, round(sum(value), 2) AS total FROM e JOIN s ON sec >= a AND sec < b GROUP BY stage""",
)
def stage_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load stages on cumulative durations (J19, ST13); times past the end belong to the last stage."""
    e = events(spark, sf_dir, "value")
    start = e.agg(F.min("t").alias("t0"))  # a single row
    at, end, name = F.col("t") - F.col("t0"), 0.0, None
    for stage, lasts in _STAGES[:-1]:
        end += lasts
        name = F.when(at < end, stage) if name is None else name.when(at < end, stage)
    return e.crossJoin(F.broadcast(start)).groupBy(name.otherwise(_STAGES[-1][0]).alias("stage")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "j22_variant_pick",
    "SELECT event_id, ['base', 'fast', 'wide'][CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 3 + 1 AS INT)] AS variant FROM events",
)
def variant_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin variants."""
    slots = round_robin(table(spark, sf_dir, "events", "event_id", "user_id"), "user_id", "event_id", 3)
    return slots.select("event_id", F.element_at(F.array(*map(F.lit, ("base", "fast", "wide"))), F.col("slot") + 1).alias("variant"))


@query(
    "j23_resample",
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, value FROM events), tr AS (SELECT user_id, t, value FROM e WHERE t % 4 = 0), p AS (SELECT user_id, t FROM e WHERE t % 4 <> 0),
b AS (SELECT p.user_id, p.t, max(tr.t) FILTER (tr.t <= p.t) AS a, min(tr.t) FILTER (tr.t >= p.t) AS z FROM p JOIN tr USING (user_id) GROUP BY p.user_id, p.t)
SELECT b.user_id, b.t, round(coalesce(x.value + (y.value - x.value) * (b.t - b.a) / (b.z - b.a), x.value, y.value), 6) AS value FROM b LEFT JOIN tr x ON x.user_id = b.user_id AND x.t = b.a LEFT JOIN tr y ON y.user_id = b.user_id AND y.t = b.z""",
)
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear interpolation of each user's track, clamped at the ends."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "value").withColumn("t", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint") - 1)
    return J.resample(e.where("t % 4 <> 0").select("user_id", "t"), e.where("t % 4 = 0").select("user_id", "t", "value"), "user_id", "t", "value").withColumn("value", F.round("value", 6))


_SIDES = """a AS (SELECT vec_id // 256 AS pair, vec_id AS a, CAST(embedding AS DOUBLE[]) AS va FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id // 256 AS pair, vec_id AS b, CAST(embedding AS DOUBLE[]) AS vb FROM embeddings WHERE vec_id % 2 = 1),
d AS (SELECT pair, a, b, sqrt(list_sum(list_transform(list_zip(va, vb), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d, list_sum(list_transform(list_zip(va, vb), lambda z: z[1] * z[2])) AS s FROM a JOIN b USING (pair))"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two images of each pair by the parity of their descriptors' id; a pair holds 256 descriptors whatever the size of the table."""
    e = table(spark, sf_dir, "embeddings", "vec_id AS id", "embedding AS v", "vec_id div 256 AS pair")
    return e.where("id % 2 = 0"), e.where("id % 2 = 1")


@query("j12_ratio_matches", f"WITH {_SIDES}, r AS (SELECT *, row_number() OVER (PARTITION BY pair, a ORDER BY d, b) AS k, lead(d) OVER (PARTITION BY pair, a ORDER BY d, b) AS d2 FROM d) SELECT pair, a, b, round(d, 6) AS d FROM r WHERE k = 1 AND d < 0.9 * d2")
def ratio_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nearest neighbours and the ratio test inside each image pair."""
    return J.ratio_matches(*sides(spark, sf_dir), "pair", 0.9).withColumn("d", F.round("d", 6))


@query("j13_mutual_matches", f"WITH {_SIDES}, u AS (SELECT *, row_number() OVER (PARTITION BY pair, a ORDER BY s DESC, b) AS x, row_number() OVER (PARTITION BY pair, b ORDER BY s DESC, a) AS y FROM d) SELECT pair, a, b, round(s, 6) AS s FROM u WHERE x = 1 AND y = 1")
def mutual_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.mutual_matches(*sides(spark, sf_dir), "pair").select("pair", "a", "b", F.round("s", 6).alias("s"))


@query(
    "j13_double_softmax",
    f"WITH {_SIDES}, e AS (SELECT pair, a, b, exp(s / 0.1) AS e FROM d), p AS (SELECT pair, a, b, e / sum(e) OVER (PARTITION BY pair, a) * e / sum(e) OVER (PARTITION BY pair, b) AS p FROM e) SELECT pair, a, arg_max(b, (p, -b)) AS b, round(max(p), 6) AS p FROM p GROUP BY pair, a HAVING max(p) > 0.01",
)
def double_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided match by the product of both softmax shares at temperature 0.1."""
    return J.double_softmax(*sides(spark, sf_dir), "pair", 0.1, 0.01).withColumn("p", F.round("p", 6))


@query(
    "ag11_pair_diversity",
    """WITH p AS (SELECT a.vec_id AS vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(greatest(0, least(1, 1 - list_cosine_similarity(x, y))), 6) AS s_div FROM p""",
)
def pair_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 - cosine of neighbours, clipped (AG11)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding AS x")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return both.select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - N.cosine(F.col("x"), F.col("y")))), 6).alias("s_div"))


_LORA = """l AS (SELECT p_partkey AS k, 'b' || p_partkey || '.lora_up.weight' AS key, [8, 4 + CAST(p_partkey % 7 = 3 AS INT)] AS shape FROM part UNION ALL SELECT p_partkey, 'b' || p_partkey || '.lora_down.weight', [4, 16] FROM part WHERE p_partkey % 11 <> 2
  UNION ALL SELECT p_partkey, 'b' || p_partkey || '.alpha', [] FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'b' || p_partkey || '.dora_scale', [8] FROM part WHERE p_partkey % 13 = 5), w AS (SELECT 'b' || p_partkey || '.weight' AS key, [8, 16 + CAST(p_partkey % 17 = 4 AS INT)] AS shape FROM part WHERE p_partkey % 19 <> 6)"""


@query(
    "j20_pairing_residue",
    f"""WITH {_LORA}, s AS (SELECT l.*, regexp_replace(key, '\\.(lora_up\\.weight|lora_down\\.weight|alpha)$', '') AS stem, regexp_extract(key, '\\.(lora_up\\.weight|lora_down\\.weight|alpha)$', 1) AS part FROM l),
u AS (SELECT u.stem, u.key, u.shape AS up, d.shape AS down, w.shape AS base FROM s u LEFT JOIN s d ON d.stem = u.stem AND d.part = 'lora_down.weight' LEFT JOIN w ON w.key = u.stem || '.weight' WHERE u.part = 'lora_up.weight')
SELECT key, CASE WHEN down IS NULL OR base IS NULL THEN 'unmatched' ELSE 'shape' END AS fault FROM u WHERE down IS NULL OR base IS NULL OR up[2] <> down[1] OR base <> [up[1], down[2]]
UNION ALL SELECT key, 'unused' FROM s WHERE part = '' OR (part <> 'lora_up.weight' AND stem NOT IN (SELECT stem FROM u))""",
)
def pairing_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter keys that do not pair up with each other and with a base weight."""
    p = table(spark, sf_dir, "part", "p_partkey AS k")
    rows = "array(named_struct('n', '.lora_up.weight', 's', array(8, 4 + int(k % 7 = 3))), CASE WHEN k % 11 <> 2 THEN named_struct('n', '.lora_down.weight', 's', array(4, 16)) END, CASE WHEN k % 3 = 0 THEN named_struct('n', '.alpha', 's', CAST(array() AS array<int>)) END, CASE WHEN k % 13 = 5 THEN named_struct('n', '.dora_scale', 's', array(8)) END)"
    lora = p.selectExpr("k", f"explode(array_compact({rows})) AS r").selectExpr("concat('b', k, r.n) AS key", "r.s AS shape")
    base = p.where("k % 19 <> 6").selectExpr("concat('b', k, '.weight') AS key", "array(8, 16 + int(k % 17 = 4)) AS shape")
    return J.adapter_faults(lora, base)


@query(
    "so3_set_differences",
    """SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'extra', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
UNION ALL SELECT 'both', doc_id FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents)""",
)
def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, extra and common keys of two tables in one pass (SO1 to SO4)."""
    d, n = (table(spark, sf_dir, t, "doc_id").select("doc_id", F.lit(t).alias("t")) for t in ("documents", "labels"))
    sides_ = d.unionByName(n).groupBy("doc_id").agg(F.bool_or(F.col("t") == "documents").alias("d"), F.bool_or(F.col("t") == "labels").alias("n"))
    return sides_.select(F.when(F.col("d") & F.col("n"), "both").when(F.col("d"), "missing").otherwise("extra").alias("side"), "doc_id")


@query(
    "so6_interleave",
    """WITH u AS (SELECT l_orderkey AS batch, 0 AS kind, CAST(l_linenumber AS BIGINT) AS pos, l_partkey AS v FROM lineitem UNION ALL SELECT o_orderkey, 1, 0, o_custkey FROM orders)
SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY kind, pos, v) - 1 AS slot, v FROM u""",
)
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged sequences of two kinds concatenated by batch (SO5, SO6)."""
    u = table(spark, sf_dir, "lineitem", "l_orderkey AS batch", "0 AS kind", "CAST(l_linenumber AS BIGINT) AS pos", "l_partkey AS v").union(table(spark, sf_dir, "orders", "o_orderkey", "1", "0L", "o_custkey"))
    return u.select("batch", (F.row_number().over(Window.partitionBy("batch").orderBy("kind", "pos", "v")).cast("bigint") - 1).alias("slot"), "v")
