from pyspark.sql import functions as F

from tonearm.plans import rules as R
from tonearm.plans.ruleset import RULES
from tonearm.schema import with_release_defaults


def test_rule_set():
    assert len({r.id for r in RULES}) == len(RULES) == 101
    assert len(R.select_rules(RULES)) == 81 and len(R.select_rules(RULES, ("apple_music", "tidal"))) == 19 + 17
    assert len(R.select_rules(RULES, active_only=False)) == 84 and {r.layer for r in RULES} == {"metadata", "audio", "artwork"}
    assert all(r.platform in (None, "tiktok") for r in R.select_rules(RULES, ("tiktok",)))


def test_each_rule_compiles_and_empty_release(spark):
    df = with_release_defaults(spark.createDataFrame([(1,)], "id int"))
    out = R.evaluate(df, RULES, ["id"])
    assert out.count() == 81 and out.where(F.startswith("message", F.lit("expression error"))).count() == 0
    got = {r["rule_id"]: r["status"] for r in out.collect()}
    assert got["universal.metadata.release_title_required"] == "fail" and got["universal.artwork.minimum_resolution"] == "pass" and got["universal.artwork.no_text_overlay"] == "skip"


def test_shared_checks_keep_their_rules_apart(spark):
    df = with_release_defaults(spark.createDataFrame([(1, "T"), (2, None)], "id int, title string"))
    rules = [R.Rule("a", "has_value(metadata.title)", "error"), R.Rule("b", "has_value(metadata.title)", "info", "named", "spotify", fix_hint="it's \"so\""), R.Rule("c", "metadata.no"), R.Rule("a", "metadata.title == 'T'", "critical")]
    got = sorted(tuple(r) for r in R.evaluate(df, rules, ["id"]).select("id", "rule_id", "severity", "status", "message", "fix_hint", "platform", "checked_value").collect())
    refused = "expression error: unknown field no"
    assert got == [
        (1, "a", "critical", "pass", "a", "", None, "T"), (1, "b", "info", "pass", "named", "it's \"so\"", "spotify", "T"), (1, "c", "warning", "fail", refused, "", None, None),
        (2, "a", "critical", "fail", "a", "", None, ""), (2, "b", "info", "fail", "named", "it's \"so\"", "spotify", ""), (2, "c", "warning", "fail", refused, "", None, None),
    ]
    assert R.evaluate(df, [], ["id"]).count() == 0


def test_later_files_replace_rules(tmp_path):
    (tmp_path / "x.yml").write_text("dsp: x\nrules:\n- {id: x.a, check: null}\n- {id: x.b, check: 'True', active: false}\n")
    (tmp_path / "x.yaml").write_text("dsp: x\nrules:\n- {id: x.a, layer: audio, check: 'has_value(metadata.upc)'}\n")
    found = R.select_rules(R.load_rules(str(tmp_path)), ("x",))
    assert [(r.id, r.check, r.layer, r.platform) for r in found] == [("x.a", "has_value(metadata.upc)", "audio", "x")]
