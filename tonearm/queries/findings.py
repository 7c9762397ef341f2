"""Scores, rankings and joins over findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as O
from ..operators import scoring as S
from ..plans import analytics as A
from ..sources import stores as K
from . import tables as T

_COUNTS = "count(*) FILTER (WHERE live AND severity = 'critical') AS critical_count, count(*) FILTER (WHERE live AND severity = 'warning') AS warning_count, count(*) FILTER (WHERE live AND severity = 'info') AS info_count"
_SCORE = "round_even(greatest(0, least(100, 100 - least(critical_count * 10.0, 60) - least(warning_count * 3.0, 25) - {info})), 1)::DOUBLE"
_INFO = "least(info_count * 0.5, 5)"


def _graded(key: str, info: str, where: str = "NOT resolved AND layer <> 'enrichment'") -> str:
    return f"""c AS (SELECT {key}, {_COUNTS} FROM (SELECT *, {where} AS live FROM results) GROUP BY {key}),
    g AS (SELECT *, {_SCORE.format(info=info)} AS score FROM c)"""


_GRADE = "CASE WHEN score >= 80 THEN 'PASS' WHEN score >= 60 THEN 'WARN' ELSE 'FAIL' END AS grade"


def scan_score(spark, d):
    return S.readiness(T.results(spark, d), ["scan_id"])


def bulk_score(spark, d):
    return S.readiness(T.results(spark, d), ["scan_id"], with_info=False).drop("info_count")


def layer_scores(spark, d):
    return S.layer_scores(T.results(spark, d), "scan_id", T.LAYERS[:5])


def platform_readiness(spark, d):
    return S.platform_readiness(T.results(spark, d), "scan_id", T.PLATFORMS)


def top_issues(spark, d):
    return A.top_issues(T.results(spark, d), T.scans(spark, d), 10)


def pass_rate_daily(spark, d):
    return A.pass_rate(T.scans(spark, d))


def platform_breakdown(spark, d):
    return A.platform_breakdown(T.results(spark, d))


def platform_matrix(spark, d):
    return A.platform_matrix(T.results(spark, d), T.scans(spark, d))


def top3_rules_per_layer(spark, d):
    return A.top_per_group(T.results(spark, d), "layer", "rule_id", 3)


def severity_trend_30d(spark, d):
    return A.severity_trend(T.results(spark, d), "1996-06-01", 30)


def latest_scan(spark, d):
    return A.latest_scan(T.releases(spark, d).select("release_id", "org_id"), T.scans(spark, d))


def org_rollup(spark, d):
    orgs = T.load(spark, d, "nation").select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("name"))
    return A.org_rollup(orgs, T.releases(spark, d), T.scans(spark, d))


def worst_by_rule(spark, d):
    w = O.worst_by(T.results(spark, d), ["rule_id"], "layer", "layers")
    return w.select("rule_id", "severity", F.array_join("layers", "|").alias("layers"))


def cross_layer_dedup(spark, d):
    r = T.results(spark, d)
    message = F.when((F.col("layer") == "ddex") & (F.col("partkey") % 5 == 0), "ISRC is malformed").when((F.col("layer") == "metadata") & (F.col("partkey") % 4 == 1), "artwork is too small").when(F.col("layer") == "metadata", "must match ISO 3901").otherwise("other")
    out = O.cross_layer_dedup(r.withColumn("message", message), "scan_id")
    return out.select("scan_id", "line", "layer", "duplicate")


def findings_union(spark, d):
    r = T.results(spark, d)
    u = O.union_findings(audio=r.where("layer = 'audio'").select("scan_id", "severity"), fraud=r.where("layer = 'fraud'").select("scan_id", "severity", "rule_id"))
    return u.groupBy("layer", "severity").agg(F.count("*").alias("n"), F.count("rule_id").alias("with_rule"))


def resolve_findings(spark, d):
    r = T.results(spark, d).withColumns({"resolution": F.lit(None).cast("string"), "resolved_by": F.lit(None).cast("string")})
    fixed = O.resolve(r, T.scans(spark, d).where("grade = 'PASS'"), "scan_id", "editor", "fixed")
    return fixed.groupBy("severity", "resolved", "resolved_by").agg(F.count("*").alias("n"))


def severity_order_page(spark, d):
    r = T.results(spark, d).select("scan_id", "line", "severity", "rule_id")
    return O.by_severity(r, False, "scan_id", "line").limit(50)


def severity_alphabetical_page(spark, d):
    r = T.results(spark, d).select("scan_id", "line", "severity", "rule_id")
    return O.by_severity(r, True, "scan_id", "line").limit(50)


def export_csv_rows(spark, d):
    r = T.results(spark, d).withColumns({"status": F.when(F.col("severity") == "info", "pass").otherwise("fail"), "message": F.concat("rule_id", F.lit(" failed")), "fix_hint": F.lit("see rule")})
    return K.findings_csv(r).groupBy("severity", "layer", "resolved", "platforms").agg(F.count("*").alias("n"))


def first_scan_per_release(spark, d):
    return O.keep_first(T.scans(spark, d), ["release_id"], ["created_at", "scan_id"]).select("release_id", "scan_id", "grade")


def insert_absent(spark, d):
    r = T.results(spark, d)
    old = r.where("severity = 'critical'").select("rule_id").distinct().withColumn("origin", F.lit("old"))
    new = r.where("severity = 'warning'").select("rule_id").distinct().withColumn("origin", F.lit("new"))
    return K.insert_absent(old, new, ["rule_id"])


def upsert_counters(spark, d):
    s = T.scans(spark, d)
    g = lambda df: df.groupBy("release_id").agg(F.count("*").alias("scan_count"), F.count_if(F.col("grade") == "FAIL").alias("failed"))
    return K.add_counters(g(s.where("grade <> 'WARN'")), g(s.where("grade = 'WARN'")), ["release_id"])


def latest_wins(spark, d):
    s = T.scans(spark, d)
    old = s.where("grade = 'FAIL'").groupBy("release_id").agg(F.max("scan_id").alias("scan_id"))
    new = s.where("grade = 'PASS'").groupBy("release_id").agg(F.max("scan_id").alias("scan_id"))
    return K.upsert(old, new, ["release_id"])


def batch_progress(spark, d):
    s = T.scans(spark, d)
    status = F.when(F.col("grade") == "FAIL", "failed").when(F.col("scan_id") % 7 == 0, "running").otherwise("complete")
    return A.batch_progress(s.select((F.col("release_id") % 100).alias("job_id"), status.alias("status")))


_R, _S = T.RESULTS, T.SCANS
QUERIES = {
    "scan_score": (scan_score, f"WITH {_R}, {_graded('scan_id', _INFO)} SELECT *, {_GRADE} FROM g"),
    "bulk_score": (bulk_score, f"WITH {_R}, {_graded('scan_id', '0')} SELECT scan_id, critical_count, warning_count, score, {_GRADE} FROM g"),
    "layer_scores": (layer_scores, f"""WITH {_R}, {_graded('scan_id, layer', _INFO)}, ids AS (SELECT DISTINCT scan_id FROM results), ls AS (SELECT unnest(['ddex','metadata','fraud','audio','artwork']) AS layer)
        SELECT scan_id, layer, coalesce(score, 100.0)::DOUBLE AS score FROM ids CROSS JOIN ls LEFT JOIN g USING (scan_id, layer)"""),
    "dsp_readiness": (platform_readiness, f"""WITH {_R}, p AS (SELECT unnest(['spotify','apple','youtube']) AS platform)
        SELECT scan_id, platform, NOT bool_or(severity = 'critical' AND NOT resolved AND (len(targets) = 0 OR list_contains(targets, platform))) AS ready FROM results CROSS JOIN p GROUP BY ALL"""),
    "top_issues": (top_issues, f"""WITH {_R}, {_S} SELECT rule_id, layer, severity, count(*) AS n FROM results SEMI JOIN scans USING (scan_id) WHERE NOT resolved GROUP BY ALL ORDER BY n DESC, rule_id, layer, severity LIMIT 10"""),
    "pass_rate_daily": (pass_rate_daily, f"""WITH {_S} SELECT strftime(created_at, '%Y-%m-%d') AS period, count(*) AS total, count(*) FILTER (WHERE grade = 'PASS') AS passed,
        round(count(*) FILTER (WHERE grade = 'PASS') * 100.0::DOUBLE / count(*), 1)::DOUBLE AS pass_rate FROM scans GROUP BY 1"""),
    "dsp_breakdown": (platform_breakdown, f"""WITH {_R}, e AS (SELECT unnest(targets) AS platform, severity FROM results) SELECT platform, count(*) AS total,
        count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM e GROUP BY 1"""),
    "dsp_matrix": (platform_matrix, f"""WITH {_R}, {_S}, hit AS (SELECT DISTINCT scan_id, unnest(targets) AS platform FROM results WHERE severity = 'critical'),
        m AS (SELECT scan_id, date_trunc('month', created_at)::DATE AS d FROM scans), t AS (SELECT d, count(*) AS scans FROM m GROUP BY 1),
        f AS (SELECT platform, d, count(*) AS failed FROM hit JOIN m USING (scan_id) GROUP BY ALL),
        r AS (SELECT platform, d, failed, scans, round(failed * 100.0::DOUBLE / scans, 1) AS failure_rate FROM f JOIN t USING (d))
        SELECT r.platform, strftime(r.d, '%Y-%m-%d') AS month, r.failed, r.scans, r.failure_rate::DOUBLE AS failure_rate, round(r.failure_rate - p.failure_rate, 1)::DOUBLE AS change
        FROM r LEFT JOIN r p ON p.platform = r.platform AND p.d = (r.d - INTERVAL 1 MONTH)::DATE"""),
    "top3_per_group": (top3_rules_per_layer, f"""WITH {_R}, c AS (SELECT layer, rule_id, count(*) AS n FROM results GROUP BY ALL)
        SELECT layer, rule_id, n, row_number() OVER (PARTITION BY layer ORDER BY n DESC, rule_id)::INT AS rank FROM c QUALIFY rank <= 3"""),
    "severity_trend_30d": (severity_trend_30d, f"""WITH {_R}, spine AS (SELECT (DATE '1996-06-01' + i::INT) AS d FROM range(30) t(i)),
        s AS (SELECT created_at::DATE AS d, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM results GROUP BY 1)
        SELECT strftime(spine.d, '%Y-%m-%d') AS day, strftime(spine.d, '%-m/%-d') AS label, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info FROM spine LEFT JOIN s USING (d)"""),
    "latest_scan_lateral": (latest_scan, f"""WITH {_S}, {T.RELEASES} SELECT r.release_id, r.org_id, s.scan_id, s.grade, strftime(s.created_at, '%Y-%m-%d') AS scanned
        FROM releases r LEFT JOIN LATERAL (SELECT * FROM scans WHERE scans.release_id = r.release_id ORDER BY created_at DESC, scan_id DESC LIMIT 1) s ON true"""),
    "org_rollup": (org_rollup, f"""WITH {_S}, {T.RELEASES} SELECT n_nationkey AS org_id, n_name AS name, count(DISTINCT r.release_id) AS releases, count(DISTINCT s.scan_id) AS scans
        FROM nation LEFT JOIN releases r ON r.org_id = n_nationkey LEFT JOIN scans s ON s.release_id = r.release_id GROUP BY ALL"""),
    "worst_by_rule": (worst_by_rule, f"""WITH {_R} SELECT rule_id, arg_min(severity, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 2 ELSE 3 END) AS severity, string_agg(DISTINCT layer, '|' ORDER BY layer) AS layers FROM results GROUP BY 1"""),
    "cross_layer_dedup": (cross_layer_dedup, f"""WITH {_R}, m AS (SELECT *, CASE WHEN layer = 'ddex' AND partkey % 5 = 0 THEN 'ISRC is malformed' WHEN layer = 'metadata' AND partkey % 4 = 1 THEN 'artwork is too small' WHEN layer = 'metadata' THEN 'must match ISO 3901' ELSE 'other' END AS message FROM results),
        f AS (SELECT *, bool_or(layer = 'artwork') OVER (PARTITION BY scan_id) AS art, bool_or(layer = 'ddex' AND message LIKE 'ISRC%') OVER (PARTITION BY scan_id) AS bad FROM m)
        SELECT scan_id, line, layer, (layer = 'metadata' AND ((art AND message LIKE 'artwork%') OR (bad AND message LIKE '%ISO 3901%'))) AS duplicate FROM f"""),
    "findings_union": (findings_union, f"""WITH {_R}, u AS (SELECT 'audio' AS layer, severity, NULL AS rule_id FROM results WHERE layer = 'audio' UNION ALL SELECT 'fraud', severity, rule_id FROM results WHERE layer = 'fraud')
        SELECT layer, severity, count(*) AS n, count(rule_id) AS with_rule FROM u GROUP BY ALL"""),
    "resolve_findings": (resolve_findings, f"""WITH {_R}, {_S}, x AS (SELECT r.severity, r.resolved OR s.grade = 'PASS' AS resolved, CASE WHEN s.grade = 'PASS' THEN 'editor' END AS resolved_by FROM results r JOIN scans s USING (scan_id))
        SELECT severity, resolved, resolved_by, count(*) AS n FROM x GROUP BY ALL"""),
    "severity_order": (severity_order_page, f"""WITH {_R} SELECT scan_id, line, severity, rule_id FROM results ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 2 ELSE 3 END, scan_id, line LIMIT 50"""),
    "severity_alphabetical": (severity_alphabetical_page, f"""WITH {_R} SELECT scan_id, line, severity, rule_id FROM results ORDER BY severity DESC, scan_id, line LIMIT 50"""),
    "export_csv_rows": (export_csv_rows, f"""WITH {_R} SELECT severity, layer, CASE WHEN resolved THEN 'yes' ELSE 'no' END AS resolved, array_to_string(targets, ', ') AS platforms, count(*) AS n FROM results WHERE severity <> 'info' GROUP BY ALL"""),
    "first_scan_per_release": (first_scan_per_release, f"""WITH {_S} SELECT release_id, scan_id, grade FROM scans QUALIFY row_number() OVER (PARTITION BY release_id ORDER BY created_at, scan_id) = 1"""),
    "insert_absent": (insert_absent, f"""WITH {_R}, o AS (SELECT DISTINCT rule_id FROM results WHERE severity = 'critical'), n AS (SELECT DISTINCT rule_id FROM results WHERE severity = 'warning')
        SELECT rule_id, 'old' AS origin FROM o UNION ALL SELECT rule_id, 'new' FROM n WHERE rule_id NOT IN (SELECT rule_id FROM o)"""),
    "upsert_counters": (upsert_counters, f"""WITH {_S} SELECT release_id, count(*) AS scan_count, count(*) FILTER (WHERE grade = 'FAIL') AS failed FROM scans GROUP BY 1"""),
    "latest_wins": (latest_wins, f"""WITH {_S} SELECT release_id, coalesce(max(scan_id) FILTER (WHERE grade = 'PASS'), max(scan_id) FILTER (WHERE grade = 'FAIL')) AS scan_id FROM scans WHERE grade IN ('PASS', 'FAIL') GROUP BY 1"""),
    "batch_progress": (batch_progress, f"""WITH {_S}, i AS (SELECT release_id % 100 AS job_id, CASE WHEN grade = 'FAIL' THEN 'failed' WHEN scan_id % 7 = 0 THEN 'running' ELSE 'complete' END AS status FROM scans),
        g AS (SELECT job_id, count(*) AS total, count(*) FILTER (WHERE status = 'complete') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed FROM i GROUP BY 1)
        SELECT *, CASE WHEN completed + failed >= total AND failed > 0 THEN 'failed' WHEN completed + failed >= total THEN 'complete' ELSE 'processing' END AS job_status FROM g"""),
}
