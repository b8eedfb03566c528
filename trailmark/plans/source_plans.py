"""Queries of sources, sinks and small geometry: listings and lines are made from ids of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import geometry as G
from trailmark.operators import aggregates as A
from trailmark.operators import joins as J
from trailmark.sources import readers, shards, sinks

from .registry import query, table

_PART_KEY = "'blocks.' || (p_partkey % 40) || '.w' || lpad(CAST(p_partkey AS VARCHAR), 7, '0')"


@query(
    "sk14_weight_shards",
    f"""WITH t AS (SELECT {_PART_KEY} AS key, CAST(p_size AS BIGINT) AS bytes FROM part), r AS (SELECT *, CAST((row_number() OVER (ORDER BY key) - 1) // 64 AS BIGINT) AS shard FROM t)
SELECT key, shard, CAST(sum(bytes) OVER (PARTITION BY shard ORDER BY key) - bytes AS BIGINT) AS "offset", CAST(sum(bytes) OVER (PARTITION BY shard) AS BIGINT) AS shard_bytes, CAST(sum(bytes) OVER () AS BIGINT) AS total_bytes FROM r""",
)
def weight_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors in shards of 64 keys with their places (SK14)."""
    t = table(spark, sf_dir, "part", "concat('blocks.', p_partkey % 40, '.w', lpad(p_partkey, 7, '0')) AS key", "p_size AS bytes")
    return shards.pack(t, per_shard=64).select("key", "shard", "offset", "shard_bytes", "total_bytes")


@query(
    "sk14_block_shards",
    f"""WITH t AS (SELECT CASE WHEN p_partkey % 17 = 3 THEN 'head.' || p_partkey ELSE {_PART_KEY} || CASE WHEN p_partkey % 5 = 0 THEN '.face_adapter' ELSE '' END END AS key, CAST(p_size AS BIGINT) AS bytes FROM part),
r AS (SELECT *, CAST(coalesce(TRY_CAST(nullif(regexp_extract(key, 'blocks\\.(\\d+)\\.', 1), '') AS BIGINT) * CASE WHEN contains(key, 'face_adapter') THEN 5 ELSE 1 END, -1) AS BIGINT) AS shard FROM t)
SELECT key, shard, CAST(sum(bytes) OVER (PARTITION BY shard ORDER BY key) - bytes AS BIGINT) AS "offset" FROM r""",
)
def block_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors in shards by the block in their key (SK14)."""
    key = "CASE WHEN p_partkey % 17 = 3 THEN concat('head.', p_partkey) ELSE concat('blocks.', p_partkey % 40, '.w', lpad(p_partkey, 7, '0'), CASE WHEN p_partkey % 5 = 0 THEN '.face_adapter' ELSE '' END) END AS key"
    return shards.pack(table(spark, sf_dir, "part", key, "p_size AS bytes"), by_block=True, block_factor={"face_adapter": 5}).select("key", "shard", "offset")


@query(
    "sc15_tensor_headers",
    f"""WITH t AS (SELECT {_PART_KEY} AS key, p_partkey % 40 AS shard, CAST(length(p_name) AS BIGINT) AS bytes FROM part)
SELECT key, 'U8' AS dtype, CAST(sum(bytes) OVER (PARTITION BY shard ORDER BY key) - bytes AS BIGINT) AS begin, CAST(sum(bytes) OVER (PARTITION BY shard ORDER BY key) AS BIGINT) AS "end" FROM t""",
)
def tensor_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names written as tensors into the shared folder, a file by block, and their headers read back by range (SC15)."""
    t = table(spark, sf_dir, "part", "concat('blocks.', p_partkey % 40, '.w', lpad(p_partkey, 7, '0')) AS key", "p_partkey % 40 AS shard", "'U8' AS dtype", "array(length(p_name)) AS shape", "CAST(p_name AS BINARY) AS data")
    folder = f"{sinks.shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    shards.write_shards(t, folder).write.format("noop").mode("overwrite").save()
    return shards.tensor_headers(spark, folder).where("fault IS NULL").select("key", "dtype", "begin", "end")


_FILES = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN '/img/c' || o_custkey || '/s' || o_orderkey ELSE '/img/s' || o_orderkey END AS path FROM orders WHERE o_orderkey % 7 > 0"


@query(
    "sc6_resolved_sources",
    f"""WITH f AS ({_FILES}), e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE 'c' || o_custkey END AS city, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '/img/s' || o_orderkey ELSE 's' || o_orderkey END AS id FROM orders),
p AS (SELECT *, CASE WHEN id[1] = '/' THEN id END AS p0, CASE WHEN trim(city) <> '' THEN '/img/' || city || '/' || id END AS p1, '/img/' || id AS p2 FROM e)
SELECT o_orderkey, coalesce(f0.path, f1.path, f2.path) AS path, CASE WHEN id IS NULL THEN 'missing source_id' WHEN coalesce(f0.path, f1.path, f2.path) IS NULL THEN 'source image not found; tried ' || concat_ws(', ', p1, p2) END AS fault
FROM p LEFT JOIN f f0 ON f0.path = p0 LEFT JOIN f f1 ON f1.path = p1 LEFT JOIN f f2 ON f2.path = p2""",
)
def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three places that exists (SC6)."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    files = o.where("o_orderkey % 7 > 0").selectExpr("CASE WHEN o_orderkey % 3 = 0 THEN concat('/img/c', o_custkey, '/s', o_orderkey) ELSE concat('/img/s', o_orderkey) END AS path")
    entries = o.selectExpr("o_orderkey", "o_orderkey AS sample_id", "CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE concat('c', o_custkey) END AS city", "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN concat('/img/s', o_orderkey) ELSE concat('s', o_orderkey) END AS source_id")
    return readers.resolve_sources(entries, files, "/img/").select("o_orderkey", "path", "fault")


@query(
    "sc9_image_pairs",
    """WITH f AS (SELECT 'o' || l_orderkey AS folder, '/p/o' || l_orderkey || '/' || l_linenumber AS path FROM lineitem), g AS (SELECT folder, list_sort(list(DISTINCT path)) AS p FROM f GROUP BY folder)
SELECT folder, CASE WHEN len(p) = 2 THEN p[1] END AS path0, CASE WHEN len(p) = 2 THEN p[2] END AS path1, CASE WHEN len(p) <> 2 THEN 'not a pair of files' END AS fault FROM g""",
)
def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that hold a pair of files (SC9)."""
    return readers.image_pairs(table(spark, sf_dir, "lineitem", "concat('/p/o', l_orderkey, '/', l_linenumber) AS path"), "/p")


@query(
    "sc12_training_records",
    """SELECT event_id AS line, CASE WHEN event_id % 4 > 0 THEN '/data/' || user_id || '.jpg' END AS target_image, CASE WHEN event_id % 3 > 0 THEN event_type END AS prompt, '/abs/' || event_id || '|/data/x.png' AS sources, CASE WHEN event_id % 3 = 0 THEN 'no prompt' END AS fault FROM events""",
)
def training_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata lines with their paths resolved (SC12)."""
    raw = "concat('{', CASE WHEN event_id % 3 > 0 THEN concat('\"prompt\": \" ', event_type, ' \", ') ELSE '' END, CASE WHEN event_id % 4 > 0 THEN concat('\"target_image\": \"', user_id, '.jpg\", ') ELSE '' END, '\"source_images\": [\"/abs/', event_id, '\", \"x.png\"]}') AS raw"
    out = readers.training_records(table(spark, sf_dir, "events", "event_id AS line", raw), "/data")
    return out.select("line", "target_image", "prompt", F.array_join("source_images", "|").alias("sources"), "fault")


@query("sk9_review_rows", "SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS roles, CAST(NULL AS VARCHAR) AS human_notes FROM conversations GROUP BY conv_id")
def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for reviewers: joined lists and an empty column (SK9)."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]).alias("roles"))
    return sinks.review_rows(c, ("roles",), ("human_notes",))


@query(
    "fn_corner_error",
    """WITH h AS (SELECT p_partkey, 640 AS w, 480 AS h, 1 + p_size / 100 AS a, p_partkey % 7 / 100 AS b, p_partkey % 31 AS tx, p_partkey % 5 / 100000 AS g FROM part),
c AS (SELECT p_partkey, a, b, tx, g, unnest([{'x': 0, 'y': 0}, {'x': w, 'y': 0}, {'x': w, 'y': h}, {'x': 0, 'y': h}]) AS p FROM h)
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'Infinity'::DOUBLE ELSE round(max(greatest(abs(p.x / 640 - (a * p.x + b * p.y + tx) / (g * p.x + 1) / 800), abs(p.y / 480 - (p.y - b * p.x) / (g * p.x + 1) / 600))), 9) END AS error FROM c GROUP BY p_partkey""",
)
def corner_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a homography takes an image's corners from where they lie (FN corner error, FN rescale)."""
    p = table(spark, sf_dir, "part", "p_partkey", "CASE WHEN p_partkey % 13 > 0 THEN array(1 + p_size / 100, p_partkey % 7 / 100, p_partkey % 31, -(p_partkey % 7 / 100), 1, 0, p_partkey % 5 / 100000, 0, 1) END AS h")
    w, h = F.lit(640.0), F.lit(480.0)
    corners = ((0.0, 0.0), (640.0, 0.0), (640.0, 480.0), (0.0, 480.0))
    true = F.array(*(c for x, y in corners for c in G.to_normalized(F.lit(x), F.lit(y), h, w)))
    return p.select("p_partkey", F.round(G.corner_error(F.col("h"), true, w, h, F.lit(800.0), F.lit(600.0)), 9).alias("error"))


@query(
    "j12_hamming_matches",
    """WITH v AS (SELECT vec_id // 256 AS pair, vec_id, list_transform(range(4), lambda k: list_sum(list_transform(range(16), lambda i: CASE WHEN embedding[k * 16 + i + 1] > 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END))) AS bits FROM embeddings),
d AS (SELECT a.pair, a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(1, 5), lambda k: bit_count(xor(CAST(a.bits[k] AS BIGINT), CAST(b.bits[k] AS BIGINT))))) AS d FROM v a JOIN v b ON a.pair = b.pair AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY pair, a ORDER BY d, b) AS k, lead(d) OVER (PARTITION BY pair, a ORDER BY d, b) AS d2 FROM d) SELECT pair, a, b, CAST(d AS DOUBLE) AS d FROM r WHERE k = 1 AND d < 0.95 * d2""",
)
def hamming_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio test on binary descriptors: signs of the numbers as bits."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.aggregate(F.transform(F.slice("embedding", k * 16 + 1, 16), lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, b: s + b))
    v = table(spark, sf_dir, "embeddings", "vec_id AS id", "vec_id div 256 AS pair", "embedding").select("id", "pair", bits.alias("v"))
    return J.ratio_matches(v.where("id % 2 = 0"), v.where("id % 2 = 1"), "pair", 0.95, "hamming")


@query(
    "j13_mutual_ratio",
    """WITH d AS (SELECT a.vec_id // 256 AS pair, a.vec_id AS a, b.vec_id AS b, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id // 256 = b.vec_id // 256 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
u AS (SELECT pair, a, b, d FROM d QUALIFY row_number() OVER (PARTITION BY pair, a ORDER BY d, b) = 1 AND d < 0.98 * lead(d) OVER (PARTITION BY pair, a ORDER BY d, b)),
w AS (SELECT pair, a, b FROM d QUALIFY row_number() OVER (PARTITION BY pair, b ORDER BY d, a) = 1 AND d < 0.98 * lead(d) OVER (PARTITION BY pair, b ORDER BY d, a)) SELECT pair, a, b, round(-d, 6) AS s FROM u JOIN w USING (pair, a, b)""",
)
def mutual_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual nearest neighbours that both pass the ratio test."""
    e = table(spark, sf_dir, "embeddings", "vec_id AS id", "embedding AS v", "vec_id div 256 AS pair")
    return J.mutual_matches(e.where("id % 2 = 0"), e.where("id % 2 = 1"), "pair", 0.98).withColumn("s", F.round("s", 6))


@query(
    "ag1_record_summary",
    """WITH r AS (SELECT o_orderstatus <> 'P' AND o_orderkey % 7 > 0 AS generated, o_totalprice > 100000 AS passed, CASE WHEN o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderstatus = 'P' THEN 'router_failed' ELSE 'done' END AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4 END AS rounds, o_custkey % 3 = 0 AS first, ['global', 'local', 'dual'][CAST(o_custkey % 3 + 1 AS INT)] AS route FROM orders)
SELECT count(*) + 2 AS requested, count(*) AS records, count(*) FILTER (generated) AS generated, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'router_failed') AS router_failed, count(*) FILTER (generated AND passed) AS passed,
  CAST(format('{:.6f}', count(*) FILTER (generated AND passed) / count(*) FILTER (generated)) AS DOUBLE) AS verifier_pass_rate, count(*) FILTER (generated AND coalesce(rounds, 0) > 1) AS reflected, count(*) FILTER (generated AND coalesce(rounds, 0) > 1 AND NOT first AND passed) AS reflection_improved,
  count(*) FILTER (generated AND route = 'dual') AS dual_generated, CAST(format('{:.6f}', count(*) FILTER (generated AND passed AND route = 'dual') / count(*) FILTER (generated AND route = 'dual')) AS DOUBLE) AS dual_rate FROM r""",
)
def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates over all records (AG1)."""
    r = table(spark, sf_dir, "orders", "o_orderstatus <> 'P' AND o_orderkey % 7 > 0 AS generated", "o_totalprice > 100000 AS passed", "CASE WHEN o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderstatus = 'P' THEN 'router_failed' ELSE 'done' END AS status", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4 END AS rounds_used", "o_custkey % 3 = 0 AS first_passed", "element_at(array('global', 'local', 'dual'), CAST(o_custkey % 3 + 1 AS INT)) AS route")
    return A.record_summary(r, errors=2).select("requested", "records", "generated", "skipped", "router_failed", "passed", "verifier_pass_rate", "reflected", "reflection_improved", F.col("dual.generated").alias("dual_generated"), F.col("dual.pass_rate").alias("dual_rate"))


@query(
    "ag20_merged_splats",
    """WITH s AS (SELECT l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, l_extendedprice / 1000 AS c, 1 + l_linenumber AS q, l_linenumber / 10 AS w FROM lineitem),
g AS (SELECT floor(x / 5) AS a, floor(y / 5) AS b, floor(z / 5) AS d, sum(w) AS w, sum(w * w) AS ww, sum(x * w) AS x, sum(c * w) AS c, sum(q * w) AS q, sum(2 * w) AS r FROM s GROUP BY ALL)
SELECT round(x / greatest(w, 1e-8), 6) AS x, round(c / greatest(w, 1e-8), 6) AS red, round(q / sqrt(q * q + r * r), 6) AS q0, round(r / sqrt(q * q + r * r), 6) AS q3, round(ww / greatest(w, 1e-8), 6) AS opacity FROM g""",
)
def merged_splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splats merged by cubes: unit quaternions, opacity from the weights (AG20, AG31)."""
    s = table(
        spark, sf_dir, "lineitem", "l_quantity AS x", "l_discount * 100 AS y", "l_tax * 100 AS z", "array(1D, 1D, 1D) AS scale", "array(CAST(1 + l_linenumber AS DOUBLE), 0D, 0D, 2D) AS quat", "array(l_extendedprice / 1000, 0D, 0D) AS color", "0.5D AS opacity", "l_linenumber / 10 AS weight",
    )
    out = A.merge_splats(s, 5.0)
    return out.select(F.round("x", 6).alias("x"), F.round(F.col("color")[0], 6).alias("red"), F.round(F.col("quat")[0], 6).alias("q0"), F.round(F.col("quat")[3], 6).alias("q3"), F.round("opacity", 6).alias("opacity"))


@query(
    "j2_strict_prompts",
    """WITH w AS (SELECT c_custkey AS source_id FROM customer WHERE c_custkey % 3 = 1), p AS (SELECT o_custkey AS source_id, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE 's' || o_orderkey // 40 END AS sample_id, ['global', 'local'][CAST(o_orderkey % 2 + 1 AS INT)] AS route FROM orders WHERE o_orderkey % 8 = 0),
m AS (SELECT w.source_id, p.sample_id, p.route FROM w LEFT JOIN p USING (source_id)), b AS (SELECT source_id, count(route) AS n, count(*) FILTER (trim(coalesce(sample_id, '')) = '' AND route IS NOT NULL) AS blank FROM m GROUP BY source_id)
SELECT CAST(source_id AS VARCHAR) AS name, CASE WHEN n = 0 THEN 'missing prompt' WHEN n > 1 THEN 'more than one prompt' ELSE 'no sample_id' END AS fault FROM b WHERE n <> 1 OR blank > 0
UNION ALL SELECT sample_id, 'repeated sample_id' FROM m WHERE sample_id IS NOT NULL GROUP BY sample_id HAVING count(DISTINCT source_id) > 1 UNION ALL SELECT r, 'route not covered' FROM (VALUES ('global'), ('local'), ('dual')) v(r) WHERE r NOT IN (SELECT route FROM m WHERE route IS NOT NULL)""",
)
def strict_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a strict selection of prompts from being used."""
    wanted = table(spark, sf_dir, "customer", "c_custkey").where("c_custkey % 3 = 1").selectExpr("CAST(c_custkey AS STRING) AS source_id")
    prompts = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").where("o_orderkey % 8 = 0").selectExpr("CAST(o_custkey AS STRING) AS source_id", "CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE concat('s', o_orderkey div 40) END AS sample_id", "element_at(array('global', 'local'), CAST(o_orderkey % 2 + 1 AS INT)) AS route")
    return J.strict_prompt_faults(wanted, prompts)
