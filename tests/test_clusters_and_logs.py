"""Clusters against the plain greedy merge, alias chains, project families and log files by hand."""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import pytest

from turnledger.operators import clusters
from turnledger.operators import project_family as P
from turnledger.operators.clusters import cluster_items
from turnledger.operators.state import resolve_alias_chains
from turnledger.sources import claude as C
from turnledger.sources.lines import read_lines


def by_force(items, tau, cap):
    n = len(items)
    df = Counter(t for _, ts in items for t in set(ts))
    idf = {t: math.log((n + 1) / (df[t] + 1)) + 1 for t in df}
    vec = []
    for _, ts in items:
        length = math.sqrt(sum(idf[t] ** 2 for t in set(ts))) or 1
        vec.append({t: idf[t] / length for t in set(ts)})
    pairs = []
    for i in range(n):
        for j in range(i + 1, n):
            s = 1.0 if items[i][1] and set(items[i][1]) == set(items[j][1]) else round(sum(vec[i][t] * vec[j].get(t, 0) for t in vec[i]), 12)
            if s >= tau:
                pairs.append((-s, i, j))
    parent, size = list(range(n)), [1] * n

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, i, j in sorted(pairs):
        a, b = top(i), top(j)
        if a != b and size[a] + size[b] <= cap:
            a, b = (a, b) if size[a] >= size[b] else (b, a)
            parent[b], size[a] = a, size[a] + size[b]
    groups = {}
    for i in range(n):
        groups.setdefault(top(i), set()).add(items[i][0])
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("cap, finish", [(3, 0), (5, 0), (10, 0), (50, 0), (4, 20), (50, 1 << 16)])
def test_clusters_equal_the_plain_greedy_merge(spark, monkeypatch, cap, finish):
    """In rounds to the end, in rounds and then in order, and all in order."""
    monkeypatch.setattr(clusters.merge_rounds, "__defaults__", (finish,))
    rng = random.Random(cap)
    words = [f"w{i}" for i in range(14)]
    items = [(f"i{i:03}", rng.sample(words, rng.randrange(0, 5)) if rng.random() > 0.2 else ["w1", "w2"]) for i in range(60)]
    rows = cluster_items(spark.createDataFrame(items, "item string, terms array<string>"), 0.5, cap).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.cluster, set()).add(r.item)
    assert {frozenset(g) for g in groups.values()} == by_force(items, 0.5, cap)
    assert all(min(g) == c for c, g in groups.items())


def test_a_hub_takes_few_rounds(spark, monkeypatch):
    """A hub takes in its neighbours one after the other; the tables made grow with blocks of links, not with neighbours."""
    made = []
    monkeypatch.setattr(clusters, "stored", lambda df, real=clusters.stored: made.append(1) or real(df))
    nodes = spark.createDataFrame([(f"n{i:02}", 1) for i in range(61)], "node string, size long")
    links = spark.createDataFrame([("n00", f"n{i:02}", 0.9 - i / 1000) for i in range(1, 61)], "a string, b string, similarity double")
    tops = {r.node: r.top for r in clusters.merge_rounds(nodes, links, 50, 0).collect()}
    assert {n for n, t in tops.items() if t == tops["n00"]} == {f"n{i:02}" for i in range(50)}
    assert len({t for n, t in tops.items() if n >= "n50"}) == 11
    assert len(made) <= 10


def test_links_of_frequent_terms_in_parts(spark, monkeypatch):
    """Few items meet at a time: every link is found, and once."""
    from turnledger.operators import similarity

    monkeypatch.setattr(similarity, "TERM_ITEMS", 3)
    rng = random.Random(5)
    items = [(f"i{i:03}", ["all"] + rng.sample([f"w{k}" for k in range(12)], 3)) for i in range(40)]
    links = [(r.a, r.b) for r in similarity.similar_sessions(spark.createDataFrame(items, "item string, terms array<string>"), 0.3).collect()]
    assert len(links) == len(set(links)) > 50
    sets = {}
    for i, ts in items:
        sets.setdefault(frozenset(ts), i)
    df = Counter(t for _, ts in items for t in ts)
    idf = {t: math.log(41 / (n + 1)) + 1 for t, n in df.items()}
    dot = lambda x, y: sum(idf[t] ** 2 for t in x & y) / math.sqrt(sum(idf[t] ** 2 for t in x) * sum(idf[t] ** 2 for t in y))
    assert set(links) == {(a, b) for x, a in sets.items() for y, b in sets.items() if a < b and dot(x, y) >= 0.3}


def test_alias_chains_of_any_length(spark):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(70)] + [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "b"), ("s", "s")]
    got = {r.alias: r.target for r in resolve_alias_chains(spark.createDataFrame(rows, "alias string, target string")).collect()}
    assert got == {f"n{i}": "n70" for i in range(70)} | {"a": "a", "b": "b", "c": "c", "x": "b", "y": "b", "s": "s"}


def test_project_of_a_session(spark):
    seen = {
        "adopts": ["/home/dev/mono", "/home/dev/mono/api/src", "/home/dev/mono/api"],
        "home": ["/home/dev", "/home/dev", "/home/dev", "/home/dev/repo"],
        "only home": ["/home/dev"],
        "mount": ["/mnt/c/Users/dev", "/mnt/c/Users/dev/repo"],
        "workspace": ["/workspaces/app", "/workspaces/app/lib", "/workspaces/app/lib"],
        "siblings": ["/a/b/one", "/a/b/two", "/a/b/two"],
        "windows": ["C:\\Users\\dev\\repo", "C:\\Users\\dev\\repo\\lib\\"],
        "tie": ["/a/b/one", "/a/b/two"],
    }
    rows = [(s, c, i) for s, cwds in seen.items() for i, c in enumerate(cwds)]
    got = {r.session_id: r.project for r in P.session_projects(spark.createDataFrame(rows, "session_id string, cwd string, ord long")).collect()}
    assert got == {"adopts": "mono", "home": "repo", "only home": "dev", "mount": "repo", "workspace": "app", "siblings": "two", "windows": "repo", "tie": "one"}


def test_transcript_files(spark, tmp_path):
    use = lambda i, *blocks, **more: {"type": "assistant", "uuid": f"u{i}", "sessionId": "s", "timestamp": f"2026-06-01T00:00:0{i}Z", "message": {"model": "m", "usage": {"input_tokens": 1}, "content": list(blocks)}} | more
    call = lambda i, name, **more: {"type": "tool_use", "id": i, "name": name, "input": more}
    answer = lambda i, content, **more: {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": content} | more]}}
    lines = [
        {"type": "user", "message": {"content": "  do it "}},
        use(0, {"type": "text", "text": "ok"}, call("t1", "Bash", command="pytest -q"), call("t2", "Grep")),
        answer("t1", "boom", is_error=True),
        answer("t2", [{"type": "text", "text": "abc"}, {"type": "text", "text": "de"}]),
        use(1, call("t1", "Edit")),  # the id again: later results are this call's
        answer("t1", "User rejected tool use", is_error=True),
        answer("none", "x", is_error=True),
        use(2, {"type": "thinking"}, message={"usage": {"input_tokens": 0}}),
        use(3, {"type": "thinking"}),
    ]
    folder = tmp_path / "p"
    (folder / "s" / "subagents").mkdir(parents=True)
    (folder / "s.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken", ""]))
    (folder / "s" / "subagents" / "agent-a1.jsonl").write_text(json.dumps(use(5, attributionAgent="Explore")) + "\n")
    rows = {r.event_key: r for r in C.claude_turns(read_lines(spark, str(folder))).collect()}
    assert set(rows) == {"u0", "u1", "u3", "u5"}
    assert rows["u0"].is_error and rows["u0"].activity == "testing" and rows["u0"].tool_result_chars == {"Bash": 4, "Grep": 5} and rows["u0"].intent_text == "do it" and rows["u0"].response_text == "ok"
    assert not rows["u1"].is_error and rows["u1"].activity == "coding" and rows["u1"].tool_result_chars == {"Edit": 22}
    assert rows["u3"].activity == "thinking" and rows["u3"].tool_result_chars is None
    sub = rows["u5"]
    assert (sub.session_id, sub.parent_session_id, sub.agent_type, sub.is_sidechain, sub.intent_text) == ("a1", "s", "Explore", True, None)


def test_runs_take_their_parents_project(spark):
    rows = [
        ("s", None, "/a/b/app", "/logs/-a-b-app/s.jsonl", 1),
        ("r1", "s", "/tmp/w/scratch", "/logs/-a-b-app/s/subagents/agent-r1.jsonl", 2),
        ("r2", "gone", "/a/b/other", "/logs/-a-b-dir/gone/subagents/agent-r2.jsonl", 3),
        ("r3", "gone", None, "/logs/-a-b-dir/gone/subagents/deep/agent-r3.jsonl", 4),
        ("q", "q", None, "/logs/-a-b-q/q.jsonl", 5),
    ]
    df = spark.createDataFrame(rows, "session_id string, parent_session_id string, cwd string, file string, ord long")
    assert {r.session_id: r.project for r in P.turn_projects(df).collect()} == {"s": "app", "r1": "app", "r2": "other", "r3": "-a-b-dir", "q": "-a-b-q"}
