"""Repeated work by keyword similarity, and text carried by hand between sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import price_turns
from ..functions.text import SHINGLE_WORDS, redact_text, shingles, word_list
from ..tables import let_go, shared_dir, stored
from .annotate import with_sums

SIMILAR = 0.4
RELAY_THRESHOLD, RELAY_DAYS, MIN_SHINGLES = 0.35, 14, 24
TOKENS_PER_WORD = 1.3
#: Bands of the lengths that similar_sessions() tells apart.
BANDS = 8
#: Items that share a term meet in one task only so many at a time (of one side).
TERM_ITEMS = 1 << 12
#: Characters of text that one task reads shingles from.
PART_CHARS = 4 << 20
#: detect_relays() goes over texts of more characters in slices, so many at most.
SLICE_CHARS, SLICES = 64 << 20, 8


def term_idf(fingerprints: DataFrame) -> DataFrame:
    """(term, df, idf) over rows (item, terms)."""
    n = fingerprints.agg(F.count("*").alias("n"))
    df = fingerprints.select("item", F.explode("terms").alias("term")).groupBy("term").agg(F.countDistinct("item").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # one row


def term_vectors(fingerprints: DataFrame) -> DataFrame:
    """(item, term, w): vectors of length 1."""
    t = fingerprints.select("item", F.explode("terms").alias("term")).distinct().join(term_idf(fingerprints), "term")
    norm = t.groupBy("item").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    return t.join(norm, "item").select("item", "term", (F.col("idf") / F.col("norm")).alias("w"), "df")


def similar_sessions(fingerprints: DataFrame, threshold: float = SIMILAR, reps: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, similarity) of items with different term sets whose cosine reaches the threshold.

    Items with equal terms are one (their cosine is 1) and stand for each other. Of a vector
    only the rarest terms are indexed, up to where the rest is too short to reach the
    threshold, so a pair without a common indexed term cannot be similar. At the first term
    that two items share, no more than the product of what is left of both can still come
    together: items meet under a term only in bands of such lengths whose product reaches the
    threshold, which also spreads a frequent term over the bands, and one side of it over parts.
    A pair is counted at its first common term only, where both bring their whole vectors, so no
    table of candidates is made. Items are meant to have few terms, as fingerprints do. With reps
    only these items are compared; all still count for the terms' weights.
    """
    sets = fingerprints.withColumn("terms", F.array_sort(F.array_distinct("terms")))
    reps = sets.groupBy("terms").agg(F.min("item").alias("item")) if reps is None else reps
    v = term_vectors(fingerprints).join(reps.select("item"), "item", "left_semi")
    rare = Window.partitionBy("item").orderBy("df", "term")
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    v = v.withColumns({
        "rest": F.sqrt(F.sum(F.col("w") * F.col("w")).over(rare.rowsBetween(0, last))),
        "before": F.collect_list("term").over(rare.rowsBetween(first, -1)),
        "vector": F.collect_list(F.struct("term", "w")).over(rare.rowsBetween(first, last)),
    })
    part = F.floor(F.col("df") / TERM_ITEMS)
    indexed = stored(v.filter(F.col("rest") >= threshold - 1e-9).select("item", "term", "rest", F.floor(F.col("rest") * BANDS).cast("int").alias("band"), "before", "vector", part.alias("parts")))
    a = indexed.select("term", F.col("item").alias("a"), F.col("rest").alias("ra"), F.col("band").alias("ba"), F.col("before").alias("before_a"), F.col("vector").alias("va"), F.pmod(F.xxhash64("item"), F.col("parts") + 1).alias("part"))
    b = indexed.select("term", F.col("item").alias("b"), F.col("rest").alias("rb"), "band", F.col("before").alias("before_b"), F.map_from_entries("vector").alias("vb"), F.explode(F.sequence(F.lit(0).cast("long"), "parts")).alias("part"))
    # The lowest band of b that may hold partners of a; a rest of 1 may come out a little longer.
    lowest = F.greatest(F.lit(0), F.floor(F.lit(threshold - 1e-6) * BANDS * BANDS / (F.col("ba") + 1)).cast("int") - 1)
    near = a.withColumn("band", F.explode(F.sequence(lowest, F.lit(BANDS))))
    pairs = near.join(b, ["term", "band", "part"]).filter((F.col("a") < F.col("b")) & (F.col("ra") * F.col("rb") >= threshold - 1e-6) & ~F.arrays_overlap("before_a", "before_b"))
    dot = F.aggregate("va", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at("vb", x["term"]), F.lit(0.0)))
    # The generator keeps the filter from working the sum out again.
    return pairs.select("a", "b", F.explode(F.filter(F.array(F.round(dot, 12)), lambda x: x >= threshold)).alias("similarity"))


def prompt_messages(messages: DataFrame, parts: int | None = None, by: tuple = ("session_id", "_sha")) -> DataFrame:
    """The first occurrence of each distinct prompt of a session, redacted; messages has (session_id, ts, text)."""
    w = Window.partitionBy("session_id", "_sha").orderBy("ts")
    # With a number of its own the exchange is not made smaller than its texts' redaction wants it.
    spread = messages.filter(F.trim("text") != "").withColumn("_sha", F.sha2("text", 256)).repartition(parts or text_parts(messages), *by)
    first = spread.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_sha")
    return first.withColumn("text", redact_text(F.col("text")))


def text_chars(df: DataFrame) -> int:
    return df.agg(F.sum(F.length("text"))).first()[0] or 0


def text_parts(df: DataFrame, chars: int | None = None) -> int:
    """As many partitions as keep a few megabytes of text in each; what is made of texts is far larger than they are."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (text_chars(df) if chars is None else chars) // PART_CHARS)


def output_spans(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("session_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def output_shingles(outputs: DataFrame, span: DataFrame | None = None) -> DataFrame:
    """(session_id, shingle, first_ts, last_ts): the distinct shingles of a session's redacted responses, read as one text.

    A shingle may run over responses: each is read on from the last seven words before it, which
    stand in at most seven responses, so no session's text is ever gathered. Texts are exchanged
    by session first and redacted there, once. span: output_spans() with more columns, if these are wanted.
    """
    span = output_spans(outputs) if span is None else span
    return running_shingles(outputs, text_parts(outputs)).distinct().join(span, "session_id")


def running_shingles(outputs: DataFrame, parts: int) -> DataFrame:
    """(session_id, shingle) of output_shingles() in as many partitions by session, where responses share one repeated."""
    words = word_list(redact_text(F.col("text")))
    # The generator keeps the filter from being pushed below, where it would redact every text again.
    said = outputs.select("session_id", "ts", "text").repartition(parts, "session_id").select("session_id", "ts", F.explode(F.filter(F.array(words), lambda x: F.size(x) > 0)).alias("words"))
    reach = SHINGLE_WORDS - 1
    tail = F.slice("words", -F.least(F.size("words"), F.lit(reach)), F.lit(reach))
    before = F.flatten(F.collect_list("tail").over(Window.partitionBy("session_id").orderBy("ts", "words").rowsBetween(-reach, -1)))
    read = said.withColumn("tail", tail).withColumn("before", before)
    on = F.when(F.size("before") > 0, F.slice("before", -F.least(F.size("before"), F.lit(reach)), F.lit(reach))).otherwise(F.array().cast("array<string>"))
    return read.select("session_id", F.explode(shingles(F.concat(on, "words"))).alias("shingle"))


def shared_shingles(said: DataFrame, held: DataFrame, parts: int) -> DataFrame:
    """(shingle, who, source) of the rows that the other side holds in another session as well.

    said: (shingle, who, session) of messages, held: the same of sources. Most shingles stand in
    one session only; this takes one exchange of narrow rows, and all that follows works on what is left.
    """
    both = said.withColumn("source", F.lit(False)).unionByName(held.withColumn("source", F.lit(True)))
    w = Window.partitionBy("shingle")
    side = lambda source: F.when(F.col("source") == source, F.col("session"))
    both = both.repartition(parts, "shingle").withColumns({f"{f.__name__}_{n}": f(side(x)).over(w) for f in (F.min, F.max) for n, x in (("said", False), ("held", True))})
    other = lambda n: (F.col(f"min_{n}") != F.col("session")) | (F.col(f"max_{n}") != F.col("session"))
    return both.filter(F.when(F.col("source"), other("said")).otherwise(other("held"))).select("shingle", "who", "source")


def session_shingles(messages: DataFrame, outputs: DataFrame, span: DataFrame, parts: int, days: int) -> DataFrame:
    """Shingles that a session's messages (mid) and its sources (no) hold: (shingle, mid, at, no, last), and a row without shingle for each message.

    What a message says and its own session holds is one row. at and last are the buckets of days
    of the message and of the source's end. Rows of messages have message (message_id, to_session,
    ts, words, n); mid is unique in the result. All is exchanged by session once, as texts.
    """
    first = prompt_messages(messages, parts, ("session_id",)).filter("session_id is not null")
    said = F.transform(F.array(word_list(F.col("text"))), lambda x: F.struct(F.size(x).alias("words"), shingles(x).alias("sh")))
    long_enough = F.filter(said, lambda x: F.size(x["sh"]) >= MIN_SHINGLES)
    m = first.select("message_id", "session_id", "ts", F.explode(long_enough).alias("said")).withColumn("mid", F.monotonically_increasing_id())
    m = m.withColumn("shingle", F.explode(F.concat(F.array(F.lit(None).cast("long")), "said.sh")))
    # One column, so that rows of shingles stay narrow.
    message = F.struct("message_id", F.col("session_id").alias("to_session"), "ts", "said.words", F.size("said.sh").alias("n"))
    m = m.select("session_id", "shingle", "mid", bucket_of("ts", days).alias("at"), F.when(F.col("shingle").isNull(), message).alias("message"))
    both = m.unionByName(running_shingles(outputs.filter("session_id is not null"), parts), allowMissingColumns=True)
    # Sources' rows come first; the last of them goes into the first message's row.
    w = Window.partitionBy("session_id", "shingle").orderBy(F.col("mid").asc_nulls_first())
    both = both.withColumns({"_before": F.lag(F.coalesce("mid", F.lit(-1))).over(w), "_more": F.lead(F.lit(1)).over(w)})
    held = F.col("mid").isNull() | (F.coalesce("_before", F.lit(0)) == -1)
    both = both.withColumn("_held", held).filter(F.col("mid").isNotNull() | F.col("_more").isNull())
    ends = span.select("session_id", F.col("no").alias("_no"), bucket_of("last_ts", days).alias("_last"))
    both = both.join(ends, "session_id", "left")
    return both.select("shingle", "mid", "at", F.when(F.col("_held"), F.col("_no")).alias("no"), F.when(F.col("_held"), F.col("_last")).alias("last"), "message")


def bucket_of(ts: str, days: int) -> Column:
    return F.floor(F.unix_micros(ts) / (days * 86_400_000_000))


def met_shingles(rows: DataFrame, parts: int) -> DataFrame:
    """(shingle, who, source, bucket, often) of the rows of session_shingles() that another session's other side meets in time.

    who: mid or no. A message meets sources of its own bucket and of the one before, often of them;
    a source those of its own and the next one. Most shingles stand in one session only: this takes
    one exchange of narrow rows, and all that follows works on what is left.
    """
    sides = F.array(
        F.struct(F.lit(False).alias("source"), F.col("mid").alias("who"), F.col("at").alias("bucket"), F.col("last").alias("own")),
        F.struct(F.lit(True).alias("source"), F.col("no").alias("who"), F.col("last").alias("bucket"), F.when(F.col("mid").isNotNull(), F.col("at")).alias("own")),
    )
    # Those that stand alone go before the windows over time.
    rows = rows.select("shingle", "mid", "at", "no", "last").repartition(parts, "shingle").withColumn("_n", F.count("*").over(Window.partitionBy("shingle"))).filter("_n > 1")
    each = rows.select("shingle", F.explode(F.filter(sides, lambda x: x["who"].isNotNull())).alias("x")).select("shingle", "x.*")
    w = Window.partitionBy("shingle").orderBy("bucket")
    one = lambda c: F.when(c, 1).otherwise(0)
    sources = F.sum(one(F.col("source"))).over(w.rangeBetween(-1, 0)) - one(F.coalesce(F.col("bucket") - F.col("own"), F.lit(-1)).between(0, 1))
    asking = F.sum(one(~F.col("source"))).over(w.rangeBetween(0, 1)) - one(F.coalesce(F.col("own") - F.col("bucket"), F.lit(-1)).between(0, 1))
    each = each.withColumns({"_sources": sources, "_asking": asking}).withColumn("often", F.when(F.col("source"), F.col("_asking")).otherwise(F.col("_sources")))
    return each.filter("often > 0").select("shingle", "who", "source", "bucket", "often")


def detect_relays(messages: DataFrame, outputs: DataFrame, threshold: float = RELAY_THRESHOLD, days: int = RELAY_DAYS) -> DataFrame:
    """Messages whose text mostly comes out of an earlier session: one row per message, the strongest source.

    messages: (message_id, session_id, ts, text), outputs: (session_id, ts, text); both are redacted
    before anything is hashed. Only a session's first prompts that are long enough take part, and the
    source must have ended before and within the days. Shingles that no other session holds in time are
    left out first (met_shingles), and with them messages that have too few others. A source that holds
    the threshold's share of a message's shingles holds at least one of its rarest
    n - ceil(threshold * n) + 1, so only these look for candidates, and boilerplate that many sessions
    share brings none together by itself; candidates are then counted in full. Time is cut into
    buckets of as many days, and a message looks into its own bucket and the one before: a shingle
    meets no older sources, and is rare or frequent by what these two hold.

    Texts go in slices of their sessions, shingles in slices of their hashes: each slice's exchanges
    and tables go before the next one begins, so that the disk in use is little more than the
    narrow tables kept.
    """
    spark = messages.sparkSession
    chars = text_chars(messages) + text_chars(outputs)
    slices = max(1, min(SLICES, -(-chars // SLICE_CHARS)))
    parts = text_parts(messages, chars // slices)
    # Sessions go by numbers, which their table fixes.
    span = stored(output_spans(outputs).withColumn("no", F.monotonically_increasing_id()))
    top = shared_dir(spark)

    def each_slice(name: str, made) -> DataFrame:
        for i in range(slices):
            made(i).write.partitionBy(*["slice"] * (name == "held")).parquet(f"{top}/{name}/pass={i}")
            let_go(spark)
        return spark.read.schema(made(0).schema.add("pass", "integer")).parquet(f"{top}/{name}")

    def of_sessions(i: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("session_id"), F.lit(slices)) == i
        rows = session_shingles(messages.filter(mine), outputs.filter(mine), span, parts, days)
        return rows.withColumns({"mid": F.col("mid") * slices + i, "slice": F.coalesce(F.pmod("shingle", F.lit(slices)), F.lit(-1)).cast("int")})

    held = each_slice("held", of_sessions)
    own = span.select(F.col("session_id").alias("to_session"), F.col("no").alias("own"))
    m = held.filter("slice = -1").select("mid", "message.*").join(own, "to_session", "left")
    m = stored(m.withColumn("least", F.ceil(F.lit(threshold) * F.col("n") - 1e-9)))
    met = each_slice("met", lambda i: met_shingles(held.filter(F.col("slice") == i), parts))
    let_go(spark, f"{top}/held")
    ms = met.filter("not source").withColumnRenamed("who", "mid")
    # How many of a message's shingles other sessions hold; the rest come first in the count, though they find nothing.
    all_, rare = Window.partitionBy("mid"), Window.partitionBy("mid").orderBy("often", "shingle")
    place = F.row_number().over(rare) + F.col("n") - F.col("k")
    probe = ms.join(m.select("mid", "n", "least"), "mid").withColumn("k", F.count("*").over(all_)).withColumn("place", place)
    probe = probe.filter((F.col("k") >= F.col("least")) & (F.col("place") <= F.col("n") - F.col("least") + 1))
    probe.select("mid", "shingle", "bucket", "pass").write.partitionBy("pass").parquet(f"{top}/probe")
    probe = spark.read.schema("mid long, shingle long, bucket long, pass int").parquet(f"{top}/probe")
    let_go(spark)
    right = met.filter("source").select(F.col("who").alias("no"), "shingle", "bucket", "pass")
    asked = probe.select("mid", "shingle", F.explode(F.array(F.col("bucket") - 1, "bucket")).alias("bucket"), "pass")
    near = lambda i: asked.filter(F.col("pass") == i).drop("pass").join(right.filter(F.col("pass") == i).drop("pass"), ["shingle", "bucket"]).select("mid", "no").distinct()
    age = (F.unix_micros("ts") - F.unix_micros("last_ts")) / 86_400_000_000
    pairs = each_slice("near", near).select("mid", "no").distinct().join(m.select("mid", "own", "ts"), "mid").join(span.select("no", "last_ts"), "no")
    pairs = stored(pairs.filter((F.coalesce("own", F.lit(-1)) != F.col("no")) & (age > 0) & (age <= days)).select("mid", "no"))
    let_go(spark, f"{top}/probe")
    of = lambda df, i: df.filter(F.col("pass") == i)
    hits = lambda i: pairs.join(of(ms, i).select("mid", "shingle"), "mid").join(of(right, i).select("no", "shingle"), ["no", "shingle"]).groupBy("mid", "no").agg(F.count("*").alias("hit"))
    found = each_slice("hits", hits).groupBy("mid", "no").agg(F.sum("hit").alias("hit"))
    let_go(spark, f"{top}/met")
    scored = found.join(m, "mid").withColumn("overlap", F.col("hit") / F.col("n")).filter(F.col("overlap") >= threshold)
    scored = scored.join(span.select("no", F.col("session_id").alias("from_session"), "last_ts"), "no")
    w = Window.partitionBy("message_id").orderBy(F.desc("overlap"), "last_ts", "from_session")
    best = scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    gap = F.round((F.unix_micros("ts") - F.unix_micros("last_ts")) / 86_400_000_000).cast("long")
    return best.select("message_id", "to_session", "from_session", "overlap", "words", gap.alias("gap_days"))


def relay_cost(relays: DataFrame, turns: DataFrame) -> DataFrame:
    """to_session, words, usd of each relay: its words as tokens, at the receiving conversation's own price of input."""
    t = with_sums(turns)
    input_only = price_turns(turns.withColumns({c: F.lit(0).cast("long") for c in ("output_tokens", "cache_read_tokens", "cache_creation_tokens")})).select("source", "event_key", F.col("usd").alias("input_usd"))
    own = t.join(input_only, ["source", "event_key"]).groupBy(F.col("root").alias("to_session")).agg(F.sum("input_tokens").alias("input"), F.sum("input_usd").alias("cost"), F.max("estimated").alias("estimated"))
    j = relays.join(own.filter("input > 0"), "to_session")
    return j.select("to_session", "from_session", "words", (F.least(F.col("input"), F.col("words") * TOKENS_PER_WORD) * F.col("cost") / F.col("input")).alias("relay_usd"), "estimated")


def relay_summary(relays: DataFrame, messages: DataFrame) -> DataFrame:
    """Pairs, words relayed, receiving sessions, and their share of the words of all prompts."""
    all_ = messages.agg(F.sum(F.size(word_list(redact_text(F.col("text"))))).alias("prompt_words"))
    s = relays.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.countDistinct("to_session").alias("sessions"))
    return s.crossJoin(F.broadcast(all_)).withColumn("share", F.when(F.col("prompt_words") > 0, F.col("words") / F.col("prompt_words")).otherwise(0.0))  # one row each
