"""Reports, lists and shares over findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import media as M
from ..plans import analytics as A
from ..plans import reports as P
from ..plans import rules as R
from ..plans import ruleset
from ..sources import stores as K
from ..sources.uploads import shared_folder
from . import tables as T


def pass_share(spark, d):
    return P.pass_share(A.latest_scan(T.releases(spark, d).select("release_id", "org_id"), T.scans(spark, d)), ["org_id"])


def layer_shares(spark, d):
    issues = T.results(spark, d).groupBy("severity", "layer", "rule_id").agg(F.count("*").alias("occurrences"))
    return P.layer_shares(issues, ["severity"])


def layer_counts(spark, d):
    return P.layer_counts(T.results(spark, d).withColumn("org", F.col("partkey") % 7), ["org"])


def _bulk_results(spark, d):
    rules = sorted({r for g in P.RULE_GROUPS["bulk_registration"].values() for r in g})
    r = T.results(spark, d)
    named = F.element_at(F.array(*map(F.lit, rules)), (F.col("partkey") % len(rules)).cast("int") + 1)
    return r.select("scan_id", F.when(F.col("partkey") % 3 > 0, "bulk_registration").otherwise("fraud").alias("layer"), named.alias("rule_id"), F.when(F.col("line") % 4 == 0, "error").otherwise(F.col("severity")).alias("severity"), "resolved")


def rule_group_counts(spark, d):
    return P.group_counts(_bulk_results(spark, d), ["scan_id"])


def issue_groups(spark, d):
    r = T.results(spark, d).select("scan_id", "line", F.when(F.col("line") % 5 == 0, "error").otherwise(F.col("severity")).alias("severity"))
    return P.issue_groups(r, ["scan_id"], ["line"])


def report_rows(spark, d):
    k = F.col("p_partkey")
    p = T.load(spark, d, "part").select(k.alias("row_number"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    issues = p.where("row_number % 3 > 0").select("row_number", F.explode(F.array(F.lit("info"), F.lit("critical"), F.lit("warning"))).alias("severity")).withColumns({"rule_id": F.concat(F.lit("r_"), "severity"), "message": F.lit("m")})
    enrichment = p.where("row_number % 4 = 0").select("row_number", F.lit("0000").alias("suggested_isni"), F.concat(F.lit("T"), F.col("row_number").cast("string")).alias("suggested_iswc"))
    shown = lambda i: F.concat_ws(":", i["severity"], i["rule_id"])
    return P.report_rows(issues, p, enrichment).select("row_number", "artist", "title", F.array_join(F.transform("issues", shown), "|").alias("issues"), "enrichment.suggested_isni", "enrichment.suggested_iswc")


def org_isrcs(spark, d):
    li = T.load(spark, d, "lineitem")
    code = F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit("us-pr1-26-"), F.lpad((F.col("l_partkey") % 400).cast("string"), 5, "0"))).otherwise(" ")
    tracks = li.select(F.col("l_orderkey").alias("release_id"), code.alias("isrc"))
    releases = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("release_id"), (F.col("o_custkey") % 9).alias("org_id"))
    return P.org_isrcs(tracks, releases)


def newest_scans(spark, d):
    return P.newest(T.scans(spark, d), "created_at", "scan_id").select("scan_id", "grade")


def declared_checks(spark, d):
    k = F.col("p_partkey")
    side = lambda n: (F.col("p_size") * n * (k % 3)).cast("int")
    tracks = F.when(k % 5 > 0, F.array(F.struct(F.col("p_name").alias("title"), (F.col("p_size") * 2000).cast("long").alias("duration_ms")), F.struct(F.lit(None).cast("string").alias("title"), F.when(k % 4 == 0, 59_999).otherwise(0).cast("long").alias("duration_ms"))))
    r = T.load(spark, d, "part").select(k, side(100).alias("artwork_width"), side(60).alias("artwork_height"), tracks.alias("tracks"))
    return M.declared_findings(r, ["p_partkey"]).select("p_partkey", "rule_id", "severity", "actual")


def scan_reports(spark, d):
    scans = T.scans(spark, d).select("scan_id", "release_id")
    shown = lambda i: F.concat_ws(":", i["severity"], i["layer"], i["rule_id"])
    r = P.scan_report(scans, T.results(spark, d), "scan_id", T.LAYERS[:5])
    return r.select("scan_id", "release_id", "critical_count", "warning_count", "info_count", "score", F.col("layer_scores")["fraud"].alias("fraud_score"), F.array_join(F.transform("issues", shown), "|").alias("issues"), F.size("suggestions").alias("suggestions"))


def weekly_merge(spark, d):
    """Usage counters by week: two halves of the events are merged into one table, each into the weeks that it touches."""
    u = T.usage(spark, d)
    week = F.date_format(F.date_trunc("week", "created_at"), "yyyy-MM-dd").alias("week")
    path = shared_folder(spark, "weekly")
    for half in (0, 1):
        new = u.where(F.col("event_id") % 2 == half).groupBy("endpoint", week).agg(F.count("*").alias("calls")).select("endpoint", "calls", "week")
        K.merge_partitions(spark, path, new, lambda a, b: K.add_counters(a, b, ["endpoint", "week"]), "week")
    return spark.read.schema("endpoint string, calls long, week string").parquet(path)


def rule_lists(spark, d):
    """Rules of a platform and the universal ones, by the nation's platform."""
    frame = R.rule_frame(spark, ruleset.RULES)
    n = T.load(spark, d, "nation").select("n_nationkey", F.element_at(F.array(F.lit("spotify"), F.lit("apple"), F.lit("none")), (F.col("n_nationkey") % 3).cast("int") + 1).alias("platform"))
    counts = [R.list_rules(frame, p).agg(F.count("*").alias("rules")).withColumn("platform", F.lit(p)) for p in ("spotify", "apple", "none")]
    return n.join(F.broadcast(counts[0].unionByName(counts[1]).unionByName(counts[2])), "platform").select("n_nationkey", "platform", "rules")


_G = "['" + "', '".join(sorted({r for g in P.RULE_GROUPS["bulk_registration"].values() for r in g})) + "']"
_GROUPS = " UNION ALL ".join(f"SELECT '{n}' AS rule_group, unnest({list(g)}) AS rule_id" for n, g in P.RULE_GROUPS["bulk_registration"].items())
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END"
_ACTIVE = {p: sum(r.active and r.platform in (None, p) for r in {r.id: r for r in ruleset.RULES}.values()) for p in ("spotify", "apple", "none")}

QUERIES = {
    "pass_share": (pass_share, f"""WITH {T.SCANS}, {T.RELEASES}, l AS (SELECT release_id, arg_max(grade, (created_at, scan_id)) AS grade FROM scans GROUP BY 1) SELECT org_id, count(*) AS releases, floor(count(*) FILTER (WHERE grade = 'PASS') * 100.0 / count(*) + 0.5)::BIGINT AS pass_rate FROM releases LEFT JOIN l USING (release_id) GROUP BY 1"""),
    "layer_shares": (layer_shares, f"""WITH {T.RESULTS}, c AS (SELECT severity, layer, count(*) AS occurrences FROM results GROUP BY ALL) SELECT severity, layer, occurrences, floor(occurrences * 100.0 / sum(occurrences) OVER (PARTITION BY severity) + 0.5)::BIGINT AS share FROM c"""),
    "layer_counts": (layer_counts, f"""WITH {T.RESULTS} SELECT partkey % 7 AS org, layer, count(*) FILTER (WHERE NOT resolved AND severity IN ('critical', 'error')) AS critical_count, count(*) FILTER (WHERE NOT resolved AND severity = 'warning') AS warning_count FROM results GROUP BY ALL"""),
    "rule_group_counts": (rule_group_counts, f"""WITH {T.RESULTS}, g AS ({_GROUPS}), b AS (SELECT scan_id, {_G}[(partkey % len({_G}))::INT + 1] AS rule_id, CASE WHEN line % 4 = 0 THEN 'error' ELSE severity END AS severity, resolved FROM results WHERE partkey % 3 > 0),
        c AS (SELECT scan_id, rule_group, count(*) FILTER (WHERE NOT resolved AND severity IN ('critical', 'error')) AS c, count(*) FILTER (WHERE NOT resolved AND severity = 'warning') AS w FROM b JOIN g USING (rule_id) GROUP BY ALL)
        SELECT scan_id, rule_group, coalesce(c, 0) AS critical_count, coalesce(w, 0) AS warning_count FROM (SELECT * FROM (SELECT DISTINCT scan_id FROM b), (SELECT DISTINCT rule_group FROM g)) LEFT JOIN c USING (scan_id, rule_group)"""),
    "issue_groups": (issue_groups, f"""WITH {T.RESULTS}, r AS (SELECT scan_id, line, CASE WHEN line % 5 = 0 THEN 'error' ELSE severity END AS severity FROM results) SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {_RANK}, line)::INT AS place FROM r"""),
    "report_rows": (report_rows, """SELECT p_partkey AS row_number, p_brand AS artist, p_name AS title, 'critical:r_critical|warning:r_warning|info:r_info' AS issues, CASE WHEN p_partkey % 4 = 0 THEN '0000' END AS suggested_isni, CASE WHEN p_partkey % 4 = 0 THEN 'T' || p_partkey END AS suggested_iswc FROM part WHERE p_partkey % 3 > 0"""),
    "org_isrcs": (org_isrcs, """SELECT o_custkey % 9 AS org_id, 'USPR126' || lpad((l_partkey % 400)::VARCHAR, 5, '0') AS isrc, min(o_orderkey) AS release_id, count(DISTINCT o_orderkey) AS releases FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 5 > 0 GROUP BY ALL"""),
    "newest_scans": (newest_scans, f"WITH {T.SCANS} SELECT scan_id, grade FROM scans ORDER BY created_at DESC, scan_id DESC LIMIT 50"),
    "declared_checks": (declared_checks, """WITH p AS (SELECT p_partkey, p_size * 100 * (p_partkey % 3) AS w, p_size * 60 * (p_partkey % 3) AS h, p_size * 2000 AS ms FROM part)
        SELECT p_partkey, 'declared.artwork.resolution' AS rule_id, 'critical' AS severity, w || 'x' || h AS actual FROM p WHERE w > 0 AND h > 0 AND least(w, h) < 3000 UNION ALL SELECT p_partkey, 'declared.track.short', 'warning', (ms // 1000) || 's' FROM p WHERE p_partkey % 5 > 0 AND ms > 0 AND ms < 60000
        UNION ALL SELECT p_partkey, 'declared.track.short', 'warning', '59s' FROM p WHERE p_partkey % 5 > 0 AND p_partkey % 4 = 0"""),
    "scan_reports": (scan_reports, f"""WITH {T.RESULTS}, {T.SCANS}, c AS (SELECT scan_id, count(*) FILTER (WHERE l AND severity = 'critical') AS c, count(*) FILTER (WHERE l AND severity = 'warning') AS w, count(*) FILTER (WHERE l AND severity = 'info') AS i,
        count(*) FILTER (WHERE l AND layer = 'fraud' AND severity = 'critical') AS fc, count(*) FILTER (WHERE l AND layer = 'fraud' AND severity = 'warning') AS fw, count(*) FILTER (WHERE l AND layer = 'fraud' AND severity = 'info') AS fi,
        string_agg(severity || ':' || layer || ':' || rule_id, '|' ORDER BY {_RANK}, layer, rule_id) FILTER (WHERE NOT resolved AND layer <> 'enrichment') AS issues, count(*) FILTER (WHERE NOT resolved AND layer = 'enrichment') AS s FROM (SELECT *, NOT resolved AND layer <> 'enrichment' AS l FROM results) GROUP BY scan_id)
        SELECT scan_id, release_id, coalesce(c, 0) AS critical_count, coalesce(w, 0) AS warning_count, coalesce(i, 0) AS info_count, CASE WHEN c IS NULL THEN 100 ELSE round_even(greatest(0, 100 - least(c * 10.0, 60) - least(w * 3.0, 25) - least(i * 0.5, 5)), 1) END::DOUBLE AS score,
        CASE WHEN c IS NOT NULL THEN round_even(greatest(0, 100 - least(fc * 10.0, 60) - least(fw * 3.0, 25) - least(fi * 0.5, 5)), 1) END::DOUBLE AS fraud_score, coalesce(issues, '') AS issues, coalesce(s, 0)::INT AS suggestions FROM scans LEFT JOIN c USING (scan_id)"""),
    "weekly_merge": (weekly_merge, f"WITH {T.USAGE} SELECT endpoint, count(*) AS calls, strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week FROM usage GROUP BY ALL"),
    "rule_lists": (rule_lists, f"SELECT n_nationkey, ['spotify', 'apple', 'none'][(n_nationkey % 3)::INT + 1] AS platform, [{_ACTIVE['spotify']}, {_ACTIVE['apple']}, {_ACTIVE['none']}][(n_nationkey % 3)::INT + 1]::BIGINT AS rules FROM nation"),
}
