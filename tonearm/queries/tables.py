"""The driver's tables in the roles of the domain, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

LAYERS = ["ddex", "metadata", "fraud", "audio", "artwork", "enrichment"]
PLATFORMS = ["spotify", "apple", "youtube"]


def load(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark, sf_dir):
    """Findings: a line item is one."""
    li = load(spark, sf_dir, "lineitem")
    layer = F.element_at(F.array(*[F.lit(x) for x in LAYERS]), (F.col("l_partkey") % 6).cast("int") + 1)
    targets = F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("spotify"), F.lit("apple"))).when(F.col("l_suppkey") % 3 == 1, F.array(F.lit("youtube"))).otherwise(F.array().cast("array<string>"))
    return li.select(
        F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "warning").otherwise("info").alias("severity"),
        (F.col("l_linestatus") == "F").alias("resolved"), F.concat(F.lit("rule_"), "l_suppkey").alias("rule_id"), layer.alias("layer"),
        targets.alias("targets"), F.col("l_shipdate").alias("created_at"), F.col("l_partkey").alias("partkey"),
    )


RESULTS = """results AS (SELECT l_orderkey AS scan_id, l_linenumber AS line,
 CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'warning' ELSE 'info' END AS severity, l_linestatus = 'F' AS resolved,
 'rule_' || l_suppkey AS rule_id, ['ddex','metadata','fraud','audio','artwork','enrichment'][(l_partkey % 6)::INT + 1] AS layer,
 CASE l_suppkey % 3 WHEN 0 THEN ['spotify','apple'] WHEN 1 THEN ['youtube'] ELSE [] END AS targets, l_shipdate AS created_at, l_partkey AS partkey FROM lineitem)"""


def scans(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("release_id"), F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS").otherwise("WARN").alias("grade"), F.col("o_orderdate").alias("created_at"))


SCANS = """scans AS (SELECT o_orderkey AS scan_id, o_custkey AS release_id,
 CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'WARN' END AS grade, o_orderdate AS created_at FROM orders)"""


def releases(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("release_id"), F.col("c_nationkey").alias("org_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("artist"))


RELEASES = "releases AS (SELECT c_custkey AS release_id, c_nationkey AS org_id, c_name AS title, c_mktsegment AS artist FROM customer)"


def index(spark, sf_dir):
    """Catalogue index: a part is a row; several parts share an EAN."""
    p = load(spark, sf_dir, "part")
    return p.select(
        F.lpad((F.col("p_partkey") % 700).cast("string"), 13, "0").alias("ean"), F.col("p_brand").alias("artist"), F.lower("p_brand").alias("artist_normalized"),
        F.col("p_type").alias("title"), F.lower("p_type").alias("title_normalized"), F.when(F.col("p_size") % 3 == 0, F.lpad(F.col("p_size").cast("string"), 16, "0")).when(F.col("p_size") % 3 == 1, "").alias("isni"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("T"), F.lpad(F.col("p_size").cast("string"), 10, "0"))).alias("iswc"), F.col("p_partkey").alias("scan_id"), (F.col("p_size") % 5).alias("org_id"),
    )


INDEX = """idx AS (SELECT lpad((p_partkey % 700)::VARCHAR, 13, '0') AS ean, p_brand AS artist, lower(p_brand) AS artist_normalized, p_type AS title,
 lower(p_type) AS title_normalized, CASE WHEN p_size % 3 = 0 THEN lpad(p_size::VARCHAR, 16, '0') WHEN p_size % 3 = 1 THEN '' END AS isni,
 CASE WHEN p_size % 2 = 0 THEN 'T' || lpad(p_size::VARCHAR, 10, '0') END AS iswc, p_partkey AS scan_id, p_size % 5 AS org_id FROM part)"""


def usage(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))
    return e.select(F.col("event_type").alias("endpoint"), F.col("user_id").alias("org_id"), F.when(k % 4 == 0, 500).otherwise(200).alias("status_code"), F.round(F.col("value")).cast("long").alias("latency_ms"), F.col("ts").alias("created_at"), "event_id")


USAGE = """usage AS (SELECT event_type AS endpoint, user_id AS org_id, CASE WHEN coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) % 4 = 0 THEN 500 ELSE 200 END AS status_code,
 round(value)::BIGINT AS latency_ms, ts AS created_at, event_id FROM events)"""
