"""Relays over years of sessions, similar items against all pairs, and streams that keep their keys as state."""

from __future__ import annotations

import datetime as dt
import math
import os
import random
import tempfile
import time

from pyspark.sql import functions as F

from turnledger.functions.text import tokenize_text, word_list
from turnledger.operators.similarity import detect_relays, output_shingles, shared_shingles, similar_sessions
from turnledger.operators.state import append_turns, dedup_turns
from turnledger.streaming.intake import stream_collect

T0 = dt.datetime(2024, 1, 1)
TEXTS = "session_id string, ts timestamp, text string"
TURNS = "source string, event_key string, session_id string, ts timestamp, input_tokens bigint, output_tokens bigint, tools array<string>"


def words(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def test_relays_find_sources_of_any_age_within_the_days(spark):
    said, asked, want = [], [], []
    for k in range(45):
        # Ages run over the limit of 14 days and, as the start moves, over every place in a bucket.
        start, age = T0 + dt.timedelta(days=k, hours=5 * k), dt.timedelta(days=(k % 17), minutes=1 + k)
        said.append((f"from{k}", start, words(k) + " " + words(10_000)))
        asked.append((k, f"to{k}", start + age, words(k)))
        if age <= dt.timedelta(days=14):
            want.append((k, f"from{k}", 1.0))
    got = detect_relays(spark.createDataFrame(asked, "message_id long, " + TEXTS), spark.createDataFrame(said, TEXTS))
    assert sorted((r.message_id, r.from_session, round(r.overlap, 6)) for r in got.collect()) == want


def test_relays_of_texts_without_words_and_short_texts(spark):
    said = [("a", T0, None), ("a", T0, ""), ("b", T0, "... !!"), ("c", T0, words(1)), ("c", T0, words(1))]
    asked = [(1, "x", T0 + dt.timedelta(days=1), None), (2, "y", T0 + dt.timedelta(days=1), "short text"), (3, "z", T0 + dt.timedelta(days=1), words(1)), (4, "c", T0 + dt.timedelta(days=1), words(1))]
    got = detect_relays(spark.createDataFrame(asked, "message_id long, " + TEXTS), spark.createDataFrame(said, TEXTS))
    assert [(r.message_id, r.from_session) for r in got.collect()] == [(3, "c")]
    assert detect_relays(spark.createDataFrame([], "message_id long, " + TEXTS), spark.createDataFrame([], TEXTS)).count() == 0


def test_similar_items_equal_all_pairs(spark):
    r = random.Random(5)
    for threshold in (0.2, 0.4, 0.7, 1.0):
        sets = {f"i{k}": sorted({f"t{int(r.paretovariate(0.7)) % 40}" for _ in range(r.randint(1, 8))}) for k in range(90)}
        seen: dict = {}
        df: dict = {}
        for item in sorted(sets):
            seen.setdefault(tuple(sets[item]), item)
            for t in sets[item]:
                df[t] = df.get(t, 0) + 1
        idf = {t: math.log((len(sets) + 1) / (n + 1)) + 1 for t, n in df.items()}
        reps = sorted(seen.values())
        norm = {i: math.sqrt(sum(idf[t] ** 2 for t in sets[i])) for i in reps}
        want = {(a, b): sum(idf[t] ** 2 for t in set(sets[a]) & set(sets[b])) / norm[a] / norm[b] for a in reps for b in reps if a < b}
        want = {p: round(v, 6) for p, v in want.items() if round(v, 12) >= threshold}
        got = similar_sessions(spark.createDataFrame(list(sets.items()), "item string, terms array<string>"), threshold)
        assert {(x.a, x.b): round(x.similarity, 6) for x in got.collect()} == want


def turn(key, hour, session="s", source="a", tokens=1):
    return (source, key, session, T0 + dt.timedelta(hours=hour), tokens, 0, ["Read", "Edit"])


def test_stream_collect_reads_nothing_of_its_table(spark):
    top = tempfile.mkdtemp(prefix="spark-")
    runs = [
        [turn("k1", 5), turn("k1", 3, "early"), turn("k2", 1), turn(None, 1), turn("k1", 9, source="b")],
        # Repeats with other contents and a turn that comes years late.
        [turn("k1", 0, "too late"), turn("k2", 1), turn("old", -40_000), turn("k3", 2), turn("k3", 2), turn(None, 0)],
        [turn("k3", 1), turn("k4", 7)],
    ]
    got = []
    for n, rows in enumerate(runs):
        spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(f"{top}/in/{n}")
        schema = spark.read.parquet(f"{top}/in/{n}").schema
        stream_collect(spark, f"{top}/in/*", schema, f"{top}/table", f"{top}/state", chunks=4)
        found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{top}/table").collect()
        got.append(sorted((r.source, str(r.event_key), r.session_id, r.tools) for r in found))
        os.rename(f"{top}/table", f"{top}/moved{n}")
    tools = ["Read", "Edit"]
    assert got[0] == [("a", "None", "s", tools), ("a", "k1", "early", tools), ("a", "k2", "s", tools), ("b", "k1", "s", tools)]
    assert got[1] == [("a", "k3", "s", tools), ("a", "old", "s", tools)]
    assert got[2] == [("a", "k4", "s", tools)]


def test_stream_collect_of_one_batch_equals_dedup_turns(spark):
    top, r = tempfile.mkdtemp(prefix="spark-"), random.Random(3)
    rows = [turn(f"k{r.randint(0, 60)}", r.randint(0, 5), f"s{r.randint(0, 3)}", r.choice("ab"), r.randint(0, 9)) for _ in range(400)]
    turns = spark.createDataFrame(rows, TURNS)
    turns.repartition(5).write.parquet(f"{top}/in")
    stream_collect(spark, f"{top}/in", turns.schema, f"{top}/table", f"{top}/state", chunks=7)
    found = spark.read.schema(turns.schema).option("recursiveFileLookup", "true").parquet(f"{top}/table")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, dedup_turns(turns).collect()), key=repr)


def test_append_gives_what_it_wrote(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/table"
    turns = spark.createDataFrame([turn("k1", 1), turn("k1", 1), turn("k2", 30)], TURNS)
    assert append_turns(turns, None, path).count() == 2
    more = append_turns(turns.union(spark.createDataFrame([turn("k3", 1)], TURNS)), spark.read.parquet(path), path)
    assert [r.event_key for r in more.collect()] == ["k3"]
    assert spark.read.parquet(path).count() == 3


def test_words_in_linear_time(spark):
    """A long run of marks inside a word costs its length, not the square of it."""
    rows = [("a" + "." * 300_000 + "b c++ .net x.y.. node.js, #abc+ 1234 sk",)]
    begin = time.monotonic()
    got = spark.createDataFrame(rows, "text string").select(tokenize_text(F.col("text")).alias("t"), word_list(F.col("text")).alias("w")).first()
    assert got.t == ["net", "x.y", "node.js", "abc"]
    assert got.w == ["a", "b", "c", "net", "x", "y", "node", "js", "abc", "1234", "sk"]
    assert time.monotonic() - begin < 20


def test_only_shingles_of_two_sessions_go_on(spark):
    rows = "shingle long, who long, session long"
    # 1: one session on both sides; 2: two sessions; 3: nobody said it; 4: nobody holds it; 5: a message without a session of its own.
    said = spark.createDataFrame([(1, 10, 7), (2, 10, 7), (2, 11, 8), (4, 11, 8), (5, 12, -1)], rows)
    held = spark.createDataFrame([(1, 7, 7), (2, 7, 7), (3, 7, 7), (5, 8, 8)], rows)
    got = sorted(map(tuple, shared_shingles(said, held, 3).collect()))
    assert got == [(2, 7, True), (2, 11, False), (5, 8, True), (5, 12, False)]


def test_tasks_of_shingles_grow_with_texts(spark, monkeypatch):
    import turnledger.operators.similarity as S

    monkeypatch.setattr(S, "PART_CHARS", 1000)
    df = spark.createDataFrame([(f"s{k}", T0, words(k, 100)) for k in range(40)], TEXTS)
    read = output_shingles(df)
    assert S.text_parts(df) == 40 * 699 // 1000 > 4
    assert read.count() == 40 * 93


def test_relays_in_slices_equal_all_pairs(spark, monkeypatch):
    import turnledger.operators.similarity as S

    r = random.Random(11)
    blocks = [words(20_000 + k, 30) for k in range(15)]
    text = lambda: " ".join(r.choice(blocks) if r.random() < 0.6 else words(r.randint(0, 10**9), 12) for _ in range(r.randint(1, 6)))
    at = lambda: T0 + dt.timedelta(days=r.randint(0, 50), minutes=r.randint(0, 1440))
    # Sessions that only ask, that only say, and that do both, also the same text.
    said = [(f"s{r.randint(0, 40)}", at(), text()) for _ in range(70)]
    asked = [(k, f"s{r.randint(20, 60)}", at(), text()) for k in range(70)] + [(100 + k, s, t, x) for k, (s, t, x) in enumerate(said[:30])]
    held, last = {}, {}
    for s in {x[0] for x in said}:
        ws = [w for _, _, x in sorted((x for x in said if x[0] == s), key=lambda x: x[1]) for w in x.split()]
        held[s], last[s] = {tuple(ws[i : i + 8]) for i in range(len(ws) - 7)}, max(x[1] for x in said if x[0] == s)
    want = {}
    for k, s, t, x in asked:
        ws = x.split()
        own = {tuple(ws[i : i + 8]) for i in range(len(ws) - 7)}
        found = [(-len(own & held[f]) / len(own), last[f], f) for f in held if f != s and dt.timedelta(0) < t - last[f] <= dt.timedelta(days=14)] if len(own) >= 24 else []
        if found and min(found)[0] <= -0.35:
            want[k] = (min(found)[2], round(-min(found)[0], 6))
    assert len(want) > 10
    for most in (1, 8):
        monkeypatch.setattr(S, "SLICE_CHARS", 1)
        monkeypatch.setattr(S, "SLICES", most)
        got = detect_relays(spark.createDataFrame(asked, "message_id long, " + TEXTS), spark.createDataFrame(said, TEXTS))
        assert {x.message_id: (x.from_session, round(x.overlap, 6)) for x in got.collect()} == want


def test_relays_leave_no_tables_of_shingles(spark):
    """What a session says and holds is one row while shingles are compared, and no table with a row for each is left behind."""
    from turnledger.operators.similarity import output_spans, session_shingles

    rows = [(k, f"s{k}", T0 + dt.timedelta(minutes=k), words(k, 4000)) for k in range(30)]
    asked, said = spark.createDataFrame(rows, "message_id long, " + TEXTS), spark.createDataFrame([x[1:] for x in rows], TEXTS)
    span = output_spans(said).withColumn("no", F.monotonically_increasing_id())
    each = session_shingles(asked, said, span, 3, 14).filter("shingle is not null")
    assert each.count() == each.filter("mid is not null and no is not null").count() == 30 * 3993
    top = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    assert detect_relays(asked, said).count() == 0
    left = sum(os.path.getsize(f"{d}/{f}") for x in set(os.listdir(top)) - before for d, _, names in os.walk(f"{top}/{x}") for f in names)
    assert left < 30 * 3993


def test_shingles_meet_other_sessions_in_time_only(spark):
    from turnledger.operators.similarity import met_shingles

    rows = "shingle long, mid long, at long, no long, last long"
    df = spark.createDataFrame([
        (1, 10, 5, 7, 5),  # alone with itself
        (2, 10, 5, None, None), (2, None, None, 8, 4),  # the bucket before
        (3, 10, 5, None, None), (3, None, None, 8, 3), (3, None, None, 9, 6),  # too old, too new
        (4, 10, 5, 7, 5), (4, 11, 6, 8, 6),  # the second message meets the first one's session
        (5, 10, 5, None, None), (5, 11, 5, None, None),  # nobody holds it
    ], rows)
    got = sorted((r.shingle, r.source, r.who, r.bucket, r.often) for r in met_shingles(df, 3).collect())
    assert got == [(2, False, 10, 5, 1), (2, True, 8, 4, 1), (4, False, 11, 6, 1), (4, True, 7, 5, 1)]
