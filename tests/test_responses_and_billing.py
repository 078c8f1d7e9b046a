"""Models' answers against a plain scanner; vendors' pages that repeat and break."""

from __future__ import annotations

import json
import random
import re
import time

from pyspark.sql import functions as F

from turnledger.functions import responses as R
from turnledger.sources import billing as B


def plain_regions(text):
    out, i = [], 0
    while i < len(text):
        found = re.search(r"[\[{]", text[i:])
        if not found:
            break
        start = i + found.start()
        kind, depth, quoted, escaped, end = text[start], 0, False, False, None
        for j in range(start, len(text)):
            c = text[j]
            if quoted:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c == kind:
                depth += 1
            elif c == {"{": "}", "[": "]"}[kind]:
                depth -= 1
                if depth == 0:
                    end = j
                    break
        if end is None:
            break
        out.append(text[start : end + 1])
        i = end + 1
    return out


def plain_parse(text):
    tried = [text.strip()]
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.S | re.I)
    tried += ([fence[1].strip()] if fence else []) + plain_regions(text)
    fallback = ([], 0)
    for t in tried:
        try:
            data = json.loads(t)
        except ValueError:
            continue
        items = data if isinstance(data, list) else data.get("interventions") if isinstance(data, dict) and isinstance(data.get("interventions"), list) else []
        if not items:
            continue
        seen, rows, dropped = set(), [], 0
        for item in items:
            get = lambda k: str(item[k]).strip() if isinstance(item, dict) and isinstance(item.get(k), (str, int)) else ""  # noqa: B023, E731
            metric, title = get("metric"), get("title")[:120]
            if metric not in R.METRICS or not title or metric in seen:
                dropped += 1
                continue
            seen.add(metric)
            rows.append((metric, title, get("rationale")[:400]))
        if rows:
            return rows, dropped
        fallback = (rows, dropped)
    return fallback


def test_responses(spark):
    one = lambda **k: {"metric": "reworkRatio", "title": "t", "rationale": "r"} | k
    texts = [
        json.dumps([one()]),
        "prose {note} then [0] and " + json.dumps({"interventions": [one(title=" x" * 100), one(), one(metric="no"), one(metric="retryShare", title="  "), 5, None, "s"]}) + " after {",
        "```json\n" + json.dumps([one(metric="floorShare", rationale="é" * 500)]) + "\n``` and " + json.dumps([one()]),
        "```\n[]\n``` " + json.dumps({"interventions": []}) + json.dumps([one(metric="bad")]) + " x " + json.dumps([one(metric="bad"), 3]),
        'quotes "{" {"a": "}\\"]", "interventions": [{"metric": "retryShare", "title": "in \\"string\\" ] }"}]} tail',
        "{ never closed " + json.dumps([one()]),
        "", "no json", "[[[", '{"interventions": {"metric": "reworkRatio"}}', "[1, 2]", None, "🙂 é " + json.dumps([one(title="🙂" * 150)]) + "🙂",
    ]
    rng = random.Random(4)
    bits = ["{", "}", "[", "]", '"', "\\", "x", " ", json.dumps([one()]), json.dumps({"interventions": [one(metric="coldRestartShare"), one()]}), "```", "```json", "\n", ","]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows, dropped = {}, {r.id: r.dropped for r in R.dropped_interventions(df).collect()}
    for r in R.parse_interventions(df).orderBy("id", "place").collect():
        rows.setdefault(r.id, []).append((r.metric, r.title, r.rationale))
    for i, t in enumerate(texts):
        assert (rows.get(i, []), dropped[i]) == plain_parse(t or ""), t
    got = df.select("id", R.regions(F.coalesce("text", F.lit(""))).alias("r")).collect()
    assert all(r.r == plain_regions(texts[r.id] or "") for r in got)


def test_long_answers(spark):
    """What is folded are brackets, quotes and backslashes, not every character; the items are found once for both results."""
    one = json.dumps([{"metric": "reworkRatio", "title": "t", "rationale": "r" * 3_000_000}, {"metric": "x"}])
    df = spark.createDataFrame([(i, "see " + one + " \\" + "y" * 3_000_000) for i in range(4)], "id long, text string").coalesce(1)
    begin = time.monotonic()
    items = R.checked(df)
    assert [(r.id, r.metric, len(r.rationale)) for r in R.parse_interventions(df, items).orderBy("id").collect()] == [(i, "reworkRatio", 400) for i in range(4)]
    assert [r.dropped for r in R.dropped_interventions(df, items).collect()] == [1] * 4
    assert time.monotonic() - begin < 30


def test_pages(spark):
    a = lambda day, **k: {"starting_at": day, "results": [{"model": "m", "uncached_input_tokens": 5, "output_tokens": 1, "cache_read_input_tokens": 2, "cache_creation": {"ephemeral_5m_input_tokens": 3}} | k]}
    pages = [{"data": [a("d1"), a("d2")], "has_more": True}, {"data": [a("d2", uncached_input_tokens=50), a("d3", model=None, uncached_input_tokens=None, cache_creation=None)]}, "{broken", {"data": None}, {"data": [{"starting_at": "d4"}, a("d1", output_tokens="x")]}, {"data": [a("d1"), a("d1", output_tokens=9)]}]
    df = spark.createDataFrame([(f"p{i}", p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(pages)], "file string, value string")
    got = {r.model: (r.input_tokens, r.output_tokens, r.cache_read_tokens, r.cache_creation_tokens, r.api_tokens) for r in B.provider_usage(df, "anthropic").collect()}
    # d1 stands twice on the last page (two results of one bucket), d2 on the second.
    assert got == {"m": (60, 11, 6, 9, 86), "unknown": (0, 1, 2, 0, 3)}
    o = {"data": [{"start_time": 7, "results": [{"model": "g", "input_tokens": 10, "input_cached_tokens": 4, "output_tokens": 2}, {"model": "g", "input_tokens": 1}]}]}
    df = spark.createDataFrame([("a", json.dumps(o)), ("b", json.dumps(o))], "file string, value string")
    assert [tuple(r) for r in B.provider_usage(df, "openai").collect()] == [("g", 7, 2, 4, 0, 13)]


def test_windows(spark):
    day = lambda s: F.lit(s).cast("date")
    got = [(str(r.start), str(r.end)) for r in B.usage_windows(spark, day("2026-01-01"), day("2026-03-10")).orderBy("start").collect()]
    assert got == [("2026-01-01", "2026-02-01"), ("2026-02-01", "2026-03-04"), ("2026-03-04", "2026-03-10")]
    assert B.usage_windows(spark, day("2026-01-01"), day("2026-01-01")).count() == 0
