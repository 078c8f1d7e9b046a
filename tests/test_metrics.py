"""Small hand-built windows with known numbers."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnledger.operators import metrics as M
from turnledger.operators import sessions as S
from turnledger.operators import team as Te
from turnledger.schema import TURNS

START = dt.datetime(2026, 6, 1)


@pytest.fixture
def make(spark):
    def turns(*rows):
        out = []
        for i, row in enumerate(rows):
            base = {
                "source": "claude-code", "event_key": f"{i:04d}", "session_id": "s1", "project": "proj", "project_raw": None, "ts": START + dt.timedelta(minutes=i), "model": "claude-opus-4-7",
                "input_tokens": 100, "output_tokens": 100, "cache_read_tokens": 0, "cache_creation_tokens": 0, "cache_creation_1h_tokens": 0, "thinking_tokens": 0, "tools": [], "tool_result_chars": None,
                "has_thinking": False, "is_error": False, "is_sidechain": False, "git_branch": None, "activity": "coding", "parent_session_id": None, "agent_type": None,
            } | row
            out.append(tuple(base[f.name] for f in TURNS))
        return spark.createDataFrame(out, TURNS)

    return turns


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_cold_restarts(make):
    t = make(
        {"ts": at(0), "input_tokens": 1000, "cache_creation_tokens": 500},
        {"ts": at(1), "input_tokens": 1000},
        {"ts": at(11), "input_tokens": 2000, "cache_creation_tokens": 1000},
    )
    r = M.cold_restarts(t).first()
    assert (r.cold_turns, r.cold_tokens, r.base_tokens) == (1, 3000, 5500)


def test_premium_waste(make):
    t = make({"activity": "exploration", "input_tokens": 500}, {"input_tokens": 200}, {"model": "claude-haiku-4-5", "activity": "conversation", "input_tokens": 0})
    r = M.premium_waste(t).first()
    assert r.premium_waste_tokens == 600 and r.premium_waste_share == pytest.approx(0.6)


def test_retry_spend(make):
    spend = lambda n, tool, err=False: {"tools": [tool], "is_error": err, "input_tokens": n, "output_tokens": 0}
    t = make(spend(100, "Bash", True), spend(400, "Bash"), spend(300, "Bash"), spend(100, "Read", True), spend(200, "Bash"))
    r = M.retry_spend(t).first()
    assert r.retry_tokens == 400 and r.retry_share == pytest.approx(400 / 1100)


def test_prices(make):
    t = make({"model": "claude-haiku-4-5", "input_tokens": 1_000_000, "output_tokens": 0}, {"model": "new-llm"})
    r = M.cost_totals(t).first()
    assert r.cost_usd == pytest.approx(1.0) and r.unpriced_tokens == 200 and not r.cost_estimated


def carry(make, contexts):
    rows = [{"cache_read_tokens": c, "input_tokens": 1000, "tool_result_chars": {"Read": 40_000} if i == 0 else None} for i, c in enumerate(contexts)]
    return M.tool_result_carry(make(*rows)).first().carry_tokens


def test_tool_result_carry(make):
    assert carry(make, [100_000] * 6) == 50_000
    assert carry(make, [100_000] * 3 + [10_000] * 3) == 20_000  # the context collapsed at turn 3
    assert carry(make, [0] * 6) == 6000  # never more than the context paid for


def test_session_floor(make):
    rows = [{"session_id": f"s{i}", "input_tokens": 10_000 * (i + 1)} for i in range(5)]
    side = {"session_id": "r", "is_sidechain": True, "parent_session_id": "s0", "input_tokens": 1}
    assert M.session_floor(make(*rows, side)).first().floor_tokens == 30_000
    assert M.session_floor(make(*rows[:4])).first().floor_tokens == 0


def test_session_stats(make):
    acts = ["coding", "testing", "coding", "testing", "coding"]
    rows = [{"activity": a, "is_error": i == 1, "ts": at(5 * i), "input_tokens": n} for i, (a, n) in enumerate(zip(acts, [1000, 500, 800, 500, 700]))]
    r = S.session_stats(make(*rows)).first()
    assert (r.turns, r.fix_iterations, r.error_turns, r.duration_min, r.avg_context, r.dominant) == (5, 2, 1, 20, 700, "coding")


def test_tool_stats(make):
    t = make({"tools": ["Bash", "Read"], "is_error": True}, {"tools": ["Bash"]}, {"tools": ["Read"]}, {"tools": None})
    rows = {r.tool: r for r in S.tool_stats(t).collect()}
    assert (rows["Bash"].turns, rows["Bash"].error_rate, rows["Read"].turns) == (2, 0.5, 2)


def test_work_streams(make, spark):
    now = F.lit(START + dt.timedelta(days=13)).cast("timestamp")
    none = spark.createDataFrame([], "session_id string")
    t = make(
        {"git_branch": "old", "ts": at(1440)},
        {"git_branch": "new", "ts": at(12 * 1440)},
        {"git_branch": "done"},
        {"git_branch": "done", "activity": "shipping"},
        {"git_branch": "read", "activity": "exploration"},
    )
    r = M.work_streams(t, none, now).first()
    assert (r.abandoned_streams, r.open_streams) == (1, 1)
    pr = spark.createDataFrame([("s1",)], "session_id string")
    assert M.shipped_outcomes(t, pr).first().shipped_sessions == 1


def test_shares_add_up_and_order_does_not_matter(make, spark):
    t = make(*({"activity": a, "session_id": f"s{i % 3}", "is_error": i % 4 == 0} for i, a in enumerate(["coding", "testing", "thinking", "exploration"] * 6)))
    assert sum(r.share for r in M.activity_breakdown(t).collect()) == pytest.approx(1)
    none, now = spark.createDataFrame([], "session_id string"), F.lit(START).cast("timestamp")
    one, other = (M.compute_metrics(x, none, now, ("project",)).collect() for x in (t, t.repartition(5).orderBy(F.rand(3))))
    assert one == other
    twice = Te.merge_metrics(M.compute_metrics(t, none, now, ("project",)).union(M.compute_metrics(t, none, now, ("project",)))).first()
    assert twice.events == 48 and twice.rework_ratio == pytest.approx(one[0].rework_ratio)
