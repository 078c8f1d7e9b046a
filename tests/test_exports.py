"""Member exports: documents of several versions, round trips, writes that are cut off."""

from __future__ import annotations

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from turnledger.operators import exports as E
from turnledger.operators import metrics as M
from turnledger.operators import team as Te
from turnledger.plans.mapping import DAYS, now, pr_sessions, turns

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def members(spark):
    t = turns(spark, SF)
    return t.withColumn("user", F.concat(F.lit("m"), F.col("user_id") % 8)).withColumn("host", F.lit("h"))


def docs(spark, *values):
    return spark.createDataFrame([(f"/x/{i}.json", v if isinstance(v, str) else json.dumps(v, indent=1)) for i, v in enumerate(values)], "file string, value string")


def test_versions_and_broken_documents(spark):
    key = base64.b64encode(b"key bytes").decode()
    full = {"version": 1, "user": "a", "host": "h", "generatedAt": "2026-01-02T00:00:00.000Z", "days": 30, "overall": {"inputTokens": 5, "cacheCreationTokens": 2, "coldRestartBaseTokens": 3, "byActivity": {"coding": {"tokens": 4, "share": 1}}}, "byProject": {"p": {"events": 1}},
        "plan": "pro", "coverage": [{"source": "codex", "staleDays": 4}], "sig": {"publicKey": f"-----BEGIN PUBLIC KEY-----\n{key}\n-----END PUBLIC KEY-----\n"}, "surprise": {"x": [1]}}
    old = {"version": 1, "user": "b", "host": "h", "overall": {"events": 7, "inputTokens": 5, "cacheCreationTokens": 2}}
    d = docs(spark, full, old, full | {"version": 2}, {k: v for k, v in full.items() if k != "overall"}, "{broken", "", "[1]", "null", full | {"version": None})
    rows = {r.user: r for r in E.member_exports(d).collect()}
    assert set(rows) == {"a", "b"}
    a, b = rows["a"], rows["b"]
    assert (a.main_fresh_tokens, a.coding_activity, a.plan, a.events, a.fingerprint) == (3, 4, "pro", 0, hashlib.sha256(b"key bytes").hexdigest()[:16])
    assert (b.main_fresh_tokens, b.events, b.plan, b.fingerprint, b.cost_usd, b.cost_estimated) == (7, 7, None, None, 0.0, False)
    assert [tuple(r) for r in E.export_projects(d).select("user", "project", "events").collect()] == [("a", "p", 1)]
    assert [tuple(r) for r in E.export_coverage(d).select("user", "source", "stale_days").collect()] == [("a", "codex", 4)]
    assert sorted((r.file[3], r.reason) for r in E.export_rejects(d).collect()) == [("2", "other version"), ("3", "no overall"), ("4", "no export"), ("5", "no export"), ("6", "no export"), ("7", "no export"), ("8", "other version")]


def test_round_trip(spark, members, tmp_path):
    plans = spark.createDataFrame([("m1", "pro"), ("m1", "team"), ("zz", "pro")], "user string, plan string")
    path = str(tmp_path / "export")
    E.write_export(E.build_exports(members, pr_sessions(members), now(), DAYS, plans), path, now())
    back = E.member_exports(E.read_export(spark, path))
    assert back.filter("plan is not null").select("user", "plan").collect() == [("m1", "pro")]
    want = M.compute_metrics(members, pr_sessions(members), now(), E.MEMBER)
    columns = [*E.METRICS, *E.AMOUNTS, *(f"{a}_activity" for a in E.ACTIVITIES), "cost_estimated"]
    plain = lambda df: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("user", *columns).collect()])
    assert plain(back) == plain(want)
    whole = Te.merge_metrics(back).select("events", "spend_tokens", "members").first()
    assert whole.events == members.count() and whole.members == want.count()
    by_project = M.compute_metrics(members, pr_sessions(members), now(), (*E.MEMBER, "project"))
    keys = lambda df: sorted(tuple(r) for r in df.select("user", "project", "events", "spend_tokens").collect())
    assert keys(E.export_projects(E.read_export(spark, path))) == keys(by_project)


def test_a_write_that_is_cut_off_leaves_the_old_snapshot(spark, tmp_path):
    path = str(tmp_path / "export")
    one = docs(spark, {"version": 1, "user": "a", "overall": {"events": 1}}).select(F.col("value").alias("doc")).withColumn("doc", F.regexp_replace("doc", r"\s", ""))
    E.write_export(one, path, F.lit("2026-01-01").cast("timestamp"))
    bad = one.withColumn("doc", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        E.write_export(bad, path, F.lit("2026-01-03").cast("timestamp"))
    assert [r.user for r in E.member_exports(E.read_export(spark, path)).collect()] == ["a"]
    two = docs(spark, {"version": 1, "user": "b", "overall": {"events": 1}}).select(F.regexp_replace("value", r"\s", "").alias("doc"))
    E.write_export(two, path, F.lit("2026-01-02").cast("timestamp"))
    assert [r.user for r in E.member_exports(E.read_export(spark, path)).collect()] == ["b"]


def test_members_turns_are_mapped_once(spark):
    """The documents' metrics read a table of turns, not the events that each of them would map anew."""
    from turnledger.plans.lookups import documents
    from turnledger.plans.mapping import turns

    files = documents(turns(spark, "/root/testdata/sf0.001")).inputFiles()
    assert files and not [f for f in files if "events.parquet" in f]
