"""Lookups from files: odd shapes, broken files, precedence."""

from __future__ import annotations

import json

from turnledger.sources import lookups as L


def docs(spark, **files):
    rows = [(f"/x/{n.replace('__', '.')}", v if isinstance(v, str) else json.dumps(v)) for n, v in files.items()]
    return spark.createDataFrame(rows, "file string, value string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


BAD = {"z1__json": "{no json", "z2__json": "", "z3__json": "null", "z4__json": "3", "z5__json": '"text"', "z6__json": '{"a": "1", "a": "2"}'}


def test_maps(spark):
    d = docs(spark, a__json={"x": "1", "n": 3, "": "e", "y": "", "o": {"a": "b"}, "l": ["q"]}, b__json={"x": "2"}, **BAD)
    assert rows(L.keyring_lookup(d)) == [("x", "2")]
    assert rows(L.alias_lookup(docs(spark, a__json={"a": "b", "b": "c", "p": "q", "q": "p"}, **BAD))) == [("a", "c"), ("b", "c"), ("p", "p"), ("q", "q")]
    assert rows(L.skill_lookup(docs(spark, a__json={"Api Auth": "helper", "k": 1, "e": ""}, **BAD))) == [("api auth", "helper")]


def test_prices_and_plans(spark):
    prices = [{"match": "b-.*", "input": 1, "output": 2.5}, {"match": "", "input": 1, "output": 1}, {"input": 1}, 7, {"match": "a", "input": 3, "output": 4, "cacheRead": 0.1, "cacheWrite": 2, "cacheWrite1h": 5, "estimated": True}]
    got = rows(L.price_lookup(docs(spark, a__json=prices, **BAD)))
    assert got == [(0, "b-.*", 1.0, 2.5, 0.0, 0.0, None, False), (1, "a", 3.0, 4.0, 0.1, 2.0, 5.0, True)]
    plans = [{"id": " Pro ", "monthlyUsd": 20, "annualUsd": 17}, {"id": "x"}, {"monthlyUsd": 3}, {"id": "m", "monthlyUsd": 9, "estimated": True}]
    assert rows(L.plan_lookup(docs(spark, a__json=plans, **BAD))) == [("m", 9.0, None, True), ("pro", 20.0, 17.0, False)]


def test_prices_are_used(spark):
    from turnledger.functions.pricing import price_turns

    t = spark.createDataFrame([("b-1", 1_000_000, 0, 0, 0), ("c", 5, 0, 0, 0)], "model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long")
    got = {r.model: (r.usd, r.priced) for r in price_turns(t, L.price_lookup(docs(spark, a__json=[{"match": "b-.*", "input": 1, "output": 2.5}]))).collect()}
    assert got == {"b-1": (1.0, True), "c": (0.0, False)}


def test_members(spark):
    yaml = "# team\nzoe: 'data eng'\nplatform:\n  alice: frontend # yes\n\n  \"bob b\": backend\ncarl: ops\n  dora: lost\nbad line\nweb:\n\teve: x\n"
    d = docs(spark, a__json={"ann": "frontend", "core": {"ben": "data", "cy": 3}, "n": 1, "l": ["x"]}, b__yaml=yaml, **BAD)
    assert rows(L.member_lookup(d)) == sorted(
        [("ann", None, "frontend"), ("ben", "core", "data"), ("cy", "core", "3"), ("zoe", None, "data eng"), ("alice", "platform", "frontend"), ("bob b", "platform", "backend"), ("carl", None, "ops"), ("dora", None, "lost"), ("eve", "web", "x")], key=repr
    )


def test_servers_are_names_only(spark):
    conf = {"mcpServers": {"docs": {"command": "secret"}, "db": 1}, "projects": {"/p": {"mcpServers": {"db": {}}, "enabledMcpjsonServers": ["web", 3, {"x": 1}]}, "/q": None, "/r": 5}}
    got = L.server_lookup(docs(spark, a__json=conf, b__json={"mcpServers": ["listed"]}, c__json={"mcpServers": 5, "projects": ["x"]}, **BAD))
    assert got.columns == ["server"] and rows(got) == [("db",), ("docs",), ("listed",), ("web",)]


def test_projects(spark):
    d = docs(spark, a__json={"projects": {"/src/app/": "h1", "h2": {"path": "/src/b c"}, "h3": {"x": 1}}}, b__json={"/src/other": "h4"}, **BAD)
    assert rows(L.project_lookup(d)) == [("h1", "app"), ("h2", "b c"), ("h4", "other")]


def test_read_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('{\n"x": "1"\n}\n')
    (tmp_path / "sub" / "b.json").write_text("{broken")
    (tmp_path / "c.txt").write_text('{"x": "2"}')
    assert rows(L.keyring_lookup(L.read_documents(spark, str(tmp_path), "*.json"))) == [("x", "1")]
