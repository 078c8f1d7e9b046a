"""Chats and exported tables of further agents: files on disk, broken and partial input."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from turnledger.sources import chats as H
from turnledger.sources import stores as D


def test_chat_files(spark, tmp_path):
    gemini = tmp_path / "g" / ("a" * 40) / "chats"
    gemini.mkdir(parents=True)
    turn = {"type": "gemini", "id": "m1", "tokens": {"input": 5, "output": 2, "tool": 3}, "toolCalls": [{"status": "error", "args": {"command": "pytest"}}]}
    other = {"type": "gemini", "id": "m2", "tokens": {}, "thoughts": ["x"], "timestamp": "no time"}
    chat = {"messages": [{"type": "user", "content": [{"text": "a"}, {"x": 1}, {"text": "b "}]}, turn, {"type": "user", "content": "  "}, other, {"type": "gemini", "tokens": {"input": 1}}, {"type": "gemini", "id": "m4"}]}
    (gemini / "s1.json").write_text(json.dumps(chat, indent=1))
    (gemini / "s2.json").write_text("{broken")
    none = spark.createDataFrame([], "hash string, project string")
    got = {r.event_key: r for r in H.gemini_turns(H.read_chats(spark, str(tmp_path / "g")), none).collect()}
    assert set(got) == {"s1.json:m1", "s1.json:m2"}
    one, two = got["s1.json:m1"], got["s1.json:m2"]
    assert (one.project, one.output_tokens, one.tools, one.is_error, one.activity, one.intent_text) == ("a" * 12, 5, ["unknown"], True, "testing", "a b")
    assert (two.input_tokens, two.tools, two.is_error, two.activity, two.intent_text, two.ts.year) == (0, [], False, "thinking", "a b", 1970)

    copilot = tmp_path / "c" / "w1" / "chatSessions"
    copilot.mkdir(parents=True)
    parts = [{"value": '{"value":"t"}'}, {"value": {"value": "ab"}}, None, "text", {"kind": "toolInvocation", "toolName": "runInTerminal", "invocationMessage": "`git push`"}]
    chat = {"requests": [{"message": {"text": "hello"}, "response": parts, "result": {"errorDetails": {}}}, {"response": []}, {"message": {"text": "x"}, "isCanceled": True, "result": {"errorDetails": {"m": 1}}}]}
    (copilot / "s1.jsonl").write_text(json.dumps({"kind": 0, "v": chat}) + "\n" + json.dumps({"kind": 1, "v": 1}) + "\n")
    (copilot / "s2.jsonl").write_text(json.dumps({"kind": 1, "v": chat}) + "\n")
    (copilot / "s3.json").write_text(json.dumps(chat | {"sessionId": "own", "creationDate": 1000}))
    spaces = spark.createDataFrame([("w1", "file:///src/a+b%20c/")], "workspace string, folder string")
    got = {r.event_key: r for r in H.copilot_turns(H.read_chats(spark, str(tmp_path / "c")), spaces).collect()}
    assert set(got) == {"s1:0", "s1:2", "own:0", "own:2"}
    one = got["s1:0"]
    assert (one.project, one.model, one.input_tokens, one.output_tokens, one.tools, one.commands, one.activity) == ("a+b c", "copilot (est)", 2, 4, ["runInTerminal"], ["git push"], "shipping")
    assert one.is_error and not got["s1:2"].is_error and got["own:2"].ts.second == 1


def test_composers_and_bubbles(spark):
    bubble = lambda **more: json.dumps(more)
    tool = bubble(type=2, toolFormerData={"name": "run_terminal_cmd", "status": "failed", "rawArgs": '{"command":"pytest"}'})
    end = bubble(type=2, tokenCount={"inputTokens": 3, "outputTokens": 1})
    items = [
        ("composerData:c1", json.dumps({"lastUpdatedAt": 1000, "modelConfig": {"modelName": "m"}, "fullConversationHeadersOnly": [{"bubbleId": b} for b in ("p", "t", "e2", "gone", "e1")]})),
        ("bubbleId:c1:e1", end),
        ("bubbleId:c1:e2", end),
        ("bubbleId:c1:t", tool),
        ("bubbleId:c1:p", bubble(type=1, text=" go ")),
        ("composerData:c2", "{}"),
        ("bubbleId:c2:b", end),
        ("bubbleId:c2:a", tool),
        ("composerData:c3", None),
        ("composerData:c4", "{broken"),
        ("bubbleId:c5:x", end),
        ("secret/token", end),
    ]
    df = spark.createDataFrame(items, "key string, value string")
    got = {r.event_key: r for r in D.cursor_turns(df, spark.createDataFrame([("c1", "p1")], "composer string, project string")).collect()}
    assert set(got) == {"c1:e1", "c1:e2", "c2:b"}
    assert (got["c1:e2"].tools, got["c1:e2"].is_error, got["c1:e2"].activity, got["c1:e2"].intent_text, got["c1:e2"].project, got["c1:e2"].model) == (["run_terminal_cmd"], True, "testing", "go", "p1", "m")
    assert (got["c1:e1"].tools, got["c1:e1"].is_error, got["c1:e1"].ts.second) == ([], False, 1)
    assert (got["c2:b"].tools, got["c2:b"].model, got["c2:b"].project) == (["run_terminal_cmd"], "cursor-auto", "unknown")
    assert D.cursor_turns(df.limit(0), spark.createDataFrame([], "composer string, project string")).count() == 0


def test_steps_between_generations(spark):
    g = [("c", 0, 1, 5), ("c", 1, 4, None), ("c", 2, 6, 7), ("c", 3, 6, 8), ("d", 0, 0, 1)]
    generations = spark.createDataFrame(g, "conversation string, idx long, last_step long, input_tokens long").select("*", *(F.lit(None).cast("long").alias(c) for c in ("output_tokens", "cache_read_tokens")), *(F.lit(None).cast("string").alias(c) for c in ("model", "project", "git_branch")), F.lit(None).cast("timestamp").alias("ts"))
    s = [(1, 8, 3, None), (2, 14, 3, None), (3, 21, 7, "user cancelled"), (4, 99, 7, None), (5, 9, 7, None), (6, 9, 3, None), (7, 23, 7, "boom")]
    steps = spark.createDataFrame([("c", i, t, st, None, e) for i, t, st, e in s], "conversation string, idx long, step_type int, status int, command string, error string")
    got = {r.event_key: (r.tools, r.is_error) for r in D.antigravity_turns(generations, steps).collect()}
    assert got == {"c:0": (["run_command", "step_99"], True), "c:2": ([], False), "c:3": (["update_plan"], True), "d:0": ([], False)}


def test_one_bad_line_among_good_ones(spark):
    """A line with a time that is none, or with no JSON, costs itself only."""
    from turnledger.sources import claude as C
    from turnledger.sources import codex as X

    def turn(key, time, **more):
        return json.dumps({"type": "assistant", "uuid": key, "sessionId": "s", "timestamp": time, "message": {"model": "m", "usage": {"input_tokens": 1}, "content": [{"type": "tool_use", "id": f"c{key}", "name": "Bash", "input": {}}]}} | more)

    said = [{"type": "text", "text": "the user"}, {"type": "text", "text": "declined"}]  # the phrase runs over two parts
    keys = [{"type": "text", "text": "x", "note": "user declined"}]  # a key that is no text
    result = lambda key, content: json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": f"c{key}", "is_error": True, "content": content}]}})
    lines = [turn("a", "2026-01-01T00:00:00Z"), result("a", said), turn("b", "not a time"), turn("c", ""), "{no json", "", "null", "[1]", turn("d", "2026-01-01T00:00:01.5Z"), result("d", keys)]
    df = spark.createDataFrame([("/x/s.jsonl", i, v) for i, v in enumerate(lines)], "file string, ord long, value string")
    got = {r.event_key: r for r in C.claude_turns(df).collect()}
    assert {k: r.is_error for k, r in got.items()} == {"a": False, "b": False, "c": False, "d": True}
    assert got["a"].ts.year == 2026 and got["b"].ts.year == got["c"].ts.year == 1970

    def tick(time, total):
        return json.dumps({"type": "event_msg", "timestamp": time, "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": total}}}})

    lines = [tick("2026-01-01T00:00:00Z", 5), tick("bad", 9), "{no json", tick("2026-01-01T00:00:01Z", 20)]
    df = spark.createDataFrame([("/x/s.jsonl", i, v) for i, v in enumerate(lines)], "file string, ord long, value string")
    assert sorted((r.event_key, r.input_tokens) for r in X.codex_turns(df).collect()) == [("s:1", 5), ("s:2", 4), ("s:3", 11)]

    one = {"type": "gemini", "id": "m1", "tokens": {"input": 5}, "timestamp": "2026-01-01T00:00:00Z"}
    chats = spark.createDataFrame([("/a/chats/x.json", json.dumps({"messages": [one, one | {"id": "m2", "timestamp": "bad"}]})), ("/a/chats/y.json", "{no json")], "file string, value string")
    assert H.gemini_turns(chats, spark.createDataFrame([], "hash string, project string")).count() == 2
    bad = {"requests": [{"message": {"text": "hello"}, "timestamp": "bad", "response": []}, {"message": {"text": "hello"}, "response": []}]}
    chats = spark.createDataFrame([("/w/chatSessions/x.json", json.dumps(bad)), ("/w/chatSessions/y.json", "{no json")], "file string, value string")
    assert H.copilot_turns(chats, spark.createDataFrame([], "workspace string, folder string")).count() <= 2
    items = [("composerData:c", "{}"), ("bubbleId:c:1", json.dumps({"type": 2, "createdAt": "bad", "tokenCount": {"inputTokens": 1}})), ("bubbleId:c:2", "{no json"), ("bubbleId:c:3", json.dumps({"type": 2, "createdAt": "2026-01-01T00:00:00Z", "tokenCount": {"inputTokens": 2}}))]
    got = D.cursor_turns(spark.createDataFrame(items, "key string, value string"), spark.createDataFrame([], "composer string, project string")).collect()
    assert sorted(r.input_tokens for r in got) == [1, 2]


def test_lines_are_parsed_and_folders_joined_once(spark, monkeypatch):
    """Turns, calls and results read one table of parsed lines; a folder's turns are counted before its label is joined."""
    from turnledger.operators import project_family as P
    from turnledger.sources import claude as C

    tool = '{"type":"tool_use","id":"c%d","name":"Bash","input":{"command":"ls"}}'
    lines = [("/logs/s.jsonl", 2 * i, '{"type":"assistant","uuid":"e%d","sessionId":"s","cwd":"/a/b/%s","message":{"usage":{"output_tokens":5},"content":[%s]}}' % (i, "cd"[i % 3 > 0], tool % i)) for i in range(6)]
    lines += [("/logs/s.jsonl", 2 * i + 1, '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"c%d","is_error":%s,"content":"abc"}]}}' % (i, "true" if i == 4 else "false")) for i in range(6)]
    lines += [("/logs/s.jsonl", 20, "{no json"), ("/logs/s.jsonl", 21, '{"type":"assistant","uuid":"plain","message":{"usage":{"output_tokens":1},"content":"[no blocks"}}')]
    df = spark.createDataFrame(lines, "file string, ord long, value string")
    turns = C.claude_turns(df)
    assert not re.search(r"\bvalue#", turns._jdf.queryExecution().optimizedPlan().toString())  # the lines' text is not read again
    rows = {r.event_key: r for r in turns.collect()}
    assert sorted(rows) == ["e0", "e1", "e2", "e3", "e4", "e5", "plain"]
    assert [rows[f"e{i}"].is_error for i in range(6)] == [False] * 4 + [True, False]
    assert all(rows[f"e{i}"].tool_result_chars == {"Bash": 3} for i in range(6)) and rows["plain"].tool_result_chars is None
    joined = []
    label = P.folder_labels
    monkeypatch.setattr(P, "folder_labels", lambda cwds: (joined.append(cwds.count()), label(cwds))[1])
    assert {(r.session_id, r.project) for r in P.turn_projects(turns).collect()} == {("s", "d")}
    assert joined == [0, 2]
