"""Usage events: aggregates, windows, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import analytics as A
from ..sources import detect
from ..streaming import events as E
from ..streaming import ratelimit as L
from ..streaming import scanstate as M
from . import tables as T


def usage_summary(spark, d):
    return A.usage_summary(T.usage(spark, d), ["endpoint"])


def usage_history(spark, d):
    return A.usage_history(T.usage(spark, d))


def usage_daily(spark, d):
    w = E.usage_windows(T.usage(spark, d))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "endpoint", "calls", "errors", F.round("avg_latency", 4).alias("avg_latency"))


def tumbling_windows(spark, d):
    e = T.load(spark, d, "events")
    w = E.sliding_windows(e, "6 hours", "6 hours", ("event_type",))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


def sliding_windows(spark, d):
    e = T.load(spark, d, "events")
    w = E.sliding_windows(e, "1 day", "12 hours", ("event_type",))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def session_windows(spark, d):
    e = T.load(spark, d, "events")
    s = E.sessions(e, "30 minutes", "user_id")
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 3).alias("total"))


def json_props(spark, d):
    e = T.load(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


def search_page(spark, d):
    c = T.load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("artist"))
    return A.page(A.search(c, "BUIL"), ["id"], 2, 25).select("id", "title", "artist")


def tier_quota(spark, d):
    c = T.load(spark, d, "customer")
    tier = F.element_at(F.array(F.lit("starter"), F.lit("pro"), F.lit("enterprise")), (F.col("c_custkey") % 3).cast("int") + 1)
    limit = F.when(tier == "starter", 10).when(tier == "pro", 100).otherwise(-1)
    layers = A.allowed_layers(F.array(F.lit("ddex"), F.lit("audio")), F.when(tier == "starter", F.array(F.lit("ddex"))).otherwise(F.array(F.lit("audio"), F.lit("ddex"))))
    return c.select("c_custkey", A.tier_allows(tier, "pro").alias("allowed"), A.quota_left(F.col("c_custkey") % 150, limit).alias("quota_left"), F.array_join(layers, "|").alias("layers"))


def rate_limit_log(spark, d):
    e = T.load(spark, d, "events")
    return L.limit_batch(e, "user_id", "ts", "event_id", 5, 3600 * 24).select("user_id", "event_id", "allowed")


def rate_limit_tiers(spark, d):
    """A limit by tier, with what remains and when the window ends."""
    e = T.load(spark, d, "events").withColumn("tier", F.element_at(F.array(F.lit("starter"), F.lit("pro"), F.lit("none")), (F.col("user_id") % 3).cast("int") + 1))
    return L.limits(e, "user_id", "ts", "event_id", seconds=3600 * 48, tier="tier").select("user_id", "event_id", "allowed", "remaining", "reset")


def scan_moves(spark, d):
    """A line item is an event of its order's scan; some come out of turn, some too late. In the end all that still wait time out."""
    n = F.col("l_linenumber")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("l_orderkey") % 1000 * 60 + n * (3 + F.col("l_partkey") % 7) * 60 + F.col("l_suppkey") % 60)
    event = F.element_at(F.array(*[F.lit(x) for x in ("queue", "start", "complete", "fail", "cancel")]), ((n - F.when(F.col("l_partkey") % 5 > 0, 1).otherwise(0)) % 5).cast("int") + 1)
    rows = T.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), at.alias("at"), event.alias("event"), (n * 100_000 + F.col("l_partkey")).cast("long").alias("event_id"))
    return M.moves(rows, until=1_900_000_000_000_000)


def format_detect(spark, d):
    p = T.load(spark, d, "pages")
    name = F.when(F.col("page_id") % 3 == 0, "a.csv").when(F.col("page_id") % 3 == 1, "A.JSON").otherwise("")
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" [1, 2]"), "html")).otherwise(F.col("html")).cast("binary")
    return p.select("page_id", detect.detect_format(body, name).alias("format"))


_U = T.USAGE
QUERIES = {
    "usage_summary": (usage_summary, f"WITH {_U} SELECT endpoint, count(*) AS calls, count(*) FILTER (WHERE status_code >= 400) AS errors, round(avg(latency_ms), 1)::DOUBLE AS avg_latency, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_call FROM usage GROUP BY 1"),
    "usage_history": (usage_history, f"WITH {_U} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS calls, count(*) FILTER (WHERE status_code >= 400) AS errors FROM usage GROUP BY 1"),
    "usage_daily": (usage_daily, f"WITH {_U} SELECT strftime(created_at, '%Y-%m-%d') AS day, endpoint, count(*) AS calls, count(*) FILTER (WHERE status_code >= 400) AS errors, round(avg(latency_ms), 4)::DOUBLE AS avg_latency FROM usage GROUP BY ALL"),
    "tumbling_windows": (tumbling_windows, "SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL"),
    "sliding_windows": (sliding_windows, """WITH w AS (SELECT time_bucket(INTERVAL '12 hours', ts) - (k * INTERVAL '12 hours') AS s, event_type FROM events, (SELECT unnest([0, 1]) AS k))
        SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM w GROUP BY ALL"""),
    "session_windows": (session_windows, """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY user_id, sid"""),
    "json_props_extract": (json_props, "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "search_ilike_paged": (search_page, "SELECT c_custkey AS id, c_name AS title, c_mktsegment AS artist FROM customer WHERE c_name ILIKE '%buil%' OR c_mktsegment ILIKE '%buil%' ORDER BY id LIMIT 25 OFFSET 25"),
    "tier_quota": (tier_quota, """SELECT c_custkey, c_custkey % 3 > 0 AS allowed, CASE c_custkey % 3 WHEN 0 THEN greatest(10 - c_custkey % 150, 0) WHEN 1 THEN greatest(100 - c_custkey % 150, 0) END AS quota_left,
        CASE c_custkey % 3 WHEN 0 THEN 'ddex' ELSE 'ddex|audio' END AS layers FROM customer"""),
    "rate_limit_log": (rate_limit_log, """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        r AS (SELECT user_id, event_id, i, true AS allowed, [t] AS log FROM e WHERE i = 1 UNION ALL
        SELECT user_id, event_id, i, len(l) < 5, CASE WHEN len(l) < 5 THEN list_append(l, t) ELSE l END FROM (SELECT e.*, list_filter(r.log, lambda x: x >= e.t - 86400000000) AS l FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
        SELECT user_id, event_id, allowed FROM r"""),
    "rate_limit_tiers": (rate_limit_tiers, """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN user_id % 3 = 1 THEN 30 ELSE 5 END AS most FROM events),
        r AS (SELECT user_id, event_id, i, t, true AS allowed, [t] AS log, most FROM e WHERE i = 1 UNION ALL
        SELECT user_id, event_id, i, t, len(l) < most, CASE WHEN len(l) < most THEN list_append(l, t) ELSE l END, most FROM (SELECT e.*, list_filter(r.log, lambda x: x >= e.t - 172800000000) AS l FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
        SELECT user_id, event_id, allowed, CASE WHEN allowed THEN most - len(log) ELSE 0 END::BIGINT AS remaining, ceil((CASE WHEN allowed THEN t ELSE log[1] END + 172800000000) / 1000000.0)::BIGINT AS reset FROM r"""),
    "scan_moves": (scan_moves, """WITH RECURSIVE e AS (SELECT l_orderkey AS scan_id, l_linenumber * 100000 + l_partkey AS event_id, make_timestamp((1704067200 + l_orderkey % 1000 * 60 + l_linenumber * (3 + l_partkey % 7) * 60 + l_suppkey % 60)::BIGINT * 1000000) AS "at",
        ['queue', 'start', 'complete', 'fail', 'cancel'][((l_linenumber - CASE WHEN l_partkey % 5 > 0 THEN 1 ELSE 0 END) % 5)::INT + 1] AS event FROM lineitem),
        o AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY "at", event_id) AS i FROM e),
        s AS (SELECT scan_id, event_id, "at", event, i, NULL::VARCHAR AS was, NULL::TIMESTAMP AS fell, NULL::VARCHAR AS before, CASE WHEN event = 'queue' THEN 'queued' END AS status, CASE WHEN event = 'queue' THEN "at" END AS since, event = 'queue' AS legal FROM o WHERE i = 1 UNION ALL
        SELECT scan_id, event_id, "at", event, i, was, fell, b, coalesce(m, b), CASE WHEN m IS NOT NULL THEN "at" ELSE coalesce(fell, since) END, m IS NOT NULL FROM (SELECT *, CASE WHEN event = 'queue' AND b IS NULL THEN 'queued' WHEN event = 'start' AND b = 'queued' THEN 'running' WHEN event = 'complete' AND b = 'running' THEN 'complete'
            WHEN event = 'fail' AND b = 'running' OR event = 'cancel' AND b IN ('queued', 'running') THEN 'failed' END AS m FROM (SELECT *, CASE WHEN fell IS NULL THEN was ELSE 'failed' END AS b FROM (SELECT o.scan_id, o.event_id, o."at", o.event, o.i, s.status AS was, s.since, CASE WHEN s.status IN ('queued', 'running') AND s.since + INTERVAL 15 MINUTES < o."at" THEN s.since + INTERVAL 15 MINUTES END AS fell FROM s JOIN o ON o.scan_id = s.scan_id AND o.i = s.i + 1))))
        SELECT scan_id, "at", event_id, event, before, status, legal FROM s UNION ALL SELECT scan_id, fell, NULL, 'timeout', was, 'failed', true FROM s WHERE fell IS NOT NULL
        UNION ALL SELECT scan_id, since + INTERVAL 15 MINUTES, NULL, 'timeout', status, 'failed', true FROM (SELECT * FROM s QUALIFY i = max(i) OVER (PARTITION BY scan_id)) WHERE status IN ('queued', 'running')"""),
    "format_detect": (format_detect, """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'csv' WHEN page_id % 3 = 1 THEN 'json' WHEN page_id % 2 = 0 THEN 'json' ELSE 'xml' END AS format FROM pages"""),
}
