"""Anonymised sessions: what stays, what goes, and files that parse to the same numbers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from turnledger.operators import anonymize as N
from turnledger.operators import metrics as M
from turnledger.plans.mapping import now, pr_sessions, turns
from turnledger.sources import bundles as B
from turnledger.sources.claude import claude_turns

SF = "/root/testdata/sf0.001"


def test_names_and_order(spark):
    at = lambda s: dt.datetime(2025, 5, 1) + dt.timedelta(seconds=s)
    secret = ["mcp__acme__read_file", "mcp__acme__zap", "mcp__beta corp__zap", "Bash"]
    base = {c: None for c in "project_raw agent_type".split()} | dict(source="codex", project="client x", model="m", input_tokens=1, output_tokens=0, cache_read_tokens=0, cache_creation_tokens=0, cache_creation_1h_tokens=0, thinking_tokens=0, has_thinking=False, is_error=False, git_branch="secret branch", activity="coding")
    rows = [
        base | dict(event_key="k2", session_id="s", ts=at(10.5), tools=["Bash", secret[1]], tool_result_chars={secret[1]: 7}, is_sidechain=False, parent_session_id=None),
        base | dict(event_key="k1", session_id="s", ts=at(0.000001), tools=[secret[2]], tool_result_chars=None, is_sidechain=False, parent_session_id=""),
        base | dict(event_key="k3", session_id="r1", ts=at(3), tools=[secret[0], secret[0]], tool_result_chars={secret[0]: 3, "Bash": 2}, is_sidechain=True, parent_session_id="s", agent_type="client agent"),
        base | dict(event_key="k4", session_id="r0", ts=at(-5), tools=[], tool_result_chars=None, is_sidechain=True, parent_session_id="s"),
        base | dict(event_key="k5", session_id="q", ts=at(-50), tools=None, tool_result_chars=None, is_sidechain=False, parent_session_id=None),
    ]
    from turnledger.schema import TURNS

    df = spark.createDataFrame([tuple(r[f.name] for f in TURNS) for r in rows], TURNS)
    got = {r.event_key: r for r in N.anonymize_sessions(df).collect()}
    assert set(got) == {"session-1-t0", "session-2-t0", "session-2-t1", "2-1-t0", "2-2-t0"}
    first, last, run = got["session-2-t0"], got["session-2-t1"], got["2-2-t0"]
    assert first.tools == ["mcp__server-1__tool-1"] and last.tools == ["Bash", "mcp__server-2__tool-2"] and run.tools == ["mcp__server-2__read_file"] * 2
    assert last.tool_result_chars == {"mcp__server-2__tool-2": 7} and run.tool_result_chars == {"mcp__server-2__read_file": 3, "Bash": 2}
    assert (run.agent_type, run.parent_session_id, got["2-1-t0"].agent_type) == ("general-purpose", "session-2", None)
    epoch = dt.datetime(2026, 1, 1, 9)
    assert got["2-1-t0"].ts == epoch and first.ts - epoch == dt.timedelta(seconds=5, microseconds=1) and last.ts - first.ts == dt.timedelta(seconds=10.499999)
    whole = repr(list(got.values()))
    assert not any(w in whole for w in ("acme", "beta", "zap", "client", "secret", "'s'", "'q'", "r0", "r1", "k1"))


def test_no_name_is_left(spark):
    t = turns(spark, SF).withColumns({"project": F.concat(F.lit("leak-"), "project"), "git_branch": F.concat(F.lit("leak-"), "git_branch"), "session_id": F.concat(F.lit("leak-"), "session_id"), "parent_session_id": F.concat(F.lit("leak-"), "parent_session_id"), "event_key": F.concat(F.lit("leak-"), "event_key"), "agent_type": F.concat(F.lit("leak-"), "agent_type"), "skill": F.lit("leak-skill"), "tools": F.transform("tools", lambda x: F.when(x.startswith("mcp__"), "mcp__leak-server__leak-tool").otherwise(x))})
    a = N.anonymize_sessions(t)
    assert a.count() == t.count()
    assert not [r for r in a.select(F.to_json(F.struct("*"))).collect() if "leak" in r[0]]
    assert not [r for r in N.anonymized_lines(a).collect() if "leak" in r.value or "leak" in r.file]


def test_bundles_parse_to_the_same_metrics(spark, tmp_path):
    t = turns(spark, SF).filter("input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens <> 0")
    a = N.anonymize_sessions(t)
    path = str(tmp_path / "given")
    lines = N.anonymized_lines(a)
    B.write_bundles(lines, path, 40_000)
    index = B.read_index(spark, path)
    assert index.select("bundle").distinct().count() > 3 and index.select("file").distinct().count() == lines.select("file").distinct().count()
    key = lambda df: sorted((r.file, r.value) for r in df.select("file", "value").collect())
    back = B.read_bundles(spark, path)
    assert key(back) == key(lines)
    some = index.select("file").orderBy("file").limit(2)
    assert key(B.read_bundles(spark, path, some)) == key(lines.join(some, "file", "left_semi"))
    columns = "events conversations input_tokens output_tokens cache_read_tokens cache_creation_tokens spend_tokens error_events returned_tokens carry_tokens cold_restart_tokens rework_tokens retry_tokens coding_activity testing_activity exploration_activity shipping_activity subagent_sessions subagent_tokens cost_usd".split()
    total = lambda df: tuple(round(x, 6) if isinstance(x, float) else x for x in M.compute_metrics(df, pr_sessions(t).limit(0), now()).select(*columns).first())
    read = claude_turns(back).withColumns({"project": F.lit("project-1"), "project_raw": F.lit(None).cast("string")})
    assert total(read) == total(a)


def test_the_payload_names_nothing(spark):
    import json

    from turnledger.operators.payload import aggregate_payload

    t = turns(spark, SF)
    t = t.withColumns({"git_branch": F.concat(F.lit("leak-"), "git_branch"), "session_id": F.concat(F.lit("leak-"), "session_id"), "parent_session_id": F.concat(F.lit("leak-"), "parent_session_id"), "agent_type": F.concat(F.lit("leak-"), "agent_type"), "tools": F.transform("tools", lambda x: F.when(x.startswith("mcp__"), "mcp__leak-server__search").when(x == "Bash", "mcp__leak-server__shell").otherwise(x))})
    doc = aggregate_payload(t, pr_sessions(t), now(), 30).first().doc
    d = json.loads(doc)
    assert "leak" not in doc
    assert d["overall"]["turns"] == t.count() and len(d["projects"]) <= 10 and len(d["expensiveSessions"]) == 8 and d["fanOutSessions"] and d["toolErrorRates"] and d["ruleBasedFindings"]
    assert {r.model for r in t.select("model").distinct().collect()} == set(d["overall"]["models"])
    nothing = json.loads(aggregate_payload(t.limit(0), pr_sessions(t), now(), 30).first().doc)
    assert nothing["overall"]["turns"] == 0 and nothing["projects"] == []


def test_long_results_are_not_exchanged(spark, tmp_path):
    """Neither the index of bundles nor the prompts before a turn take long results through an exchange that may put them together."""
    from turnledger.sources.claude import carry_prompt, parsed

    path = str(tmp_path / "long")
    lines = [("/a/s.jsonl", i, '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"c","content":"' + "x" * 50_000 + '"},{"type":"text","text":"ask ' + str(i) + '"}]}}') for i in range(20)]
    df = spark.createDataFrame(lines, "file string, ord long, value string")
    B.write_bundles(df, path, 100_000)
    back = B.read_bundles(spark, path)
    n = B.read_index(spark, path).select("bundle").distinct().count()
    assert n > 4 and [r.value for r in back.orderBy("ord").collect()] == [x[2] for x in lines]
    # One partition a bundle, although all texts together are compressed to next to nothing.
    assert back.select("value").rdd.getNumPartitions() == n
    said = carry_prompt(parsed(df)).orderBy("ord").collect()
    assert [r.intent_text for r in said] == [f"ask {i}" for i in range(20)] and not any(r.blocks for r in said)


def test_the_payloads_turns_are_mapped_once(spark):
    """All parts of the document read a table of turns, not the events that each of them would map anew."""
    from turnledger.plans.mapping import turns
    from turnledger.plans.sharing import payload

    files = payload(turns(spark, "/root/testdata/sf0.001")).inputFiles()
    assert files and not [f for f in files if "events.parquet" in f]


def test_bundles_take_little_disk(spark, tmp_path):
    """Bundles are compressed, and the table that they are cut from goes when their index is written."""
    import os

    size = lambda top: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)
    path, top = str(tmp_path / "long"), spark.conf.get("spark.checkpoint.dir")
    lines = [(f"/a/s{i % 3}.jsonl", i, f'{{"n":{i}}}\r' + "é" * (i % 7) + "x" * 40_000) for i in range(60)] + [("/a/s1.jsonl", 70, ""), ("/b", 0, "")]
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    B.write_bundles(spark.createDataFrame(lines, "file string, ord long, value string"), path, 100_000)
    assert size(path) < 300_000 and not [x for x in os.listdir(top) if x not in before]
    got = sorted((r.file, tuple(r.ord), r.value) for r in B.read_bundles(spark, path).collect())
    assert [(f, v) for f, _, v in got] == [(f, v) for f, _, v in sorted(lines)]
