"""Categories of work: sessions of alike intent, duplicate work, candidates for a skill, routing and what skills saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import norm_tool
from ..functions.text import FINGERPRINT_TERMS, fnv1a_hex, label_of, tokenize_text
from .annotate import with_sums
from .clusters import cluster_terms
from .metrics import _sum, compute_metrics, ratio

# Words of skill names too common to link on.
GENERIC_TOKENS = "code file files data test tests task tasks work project session review build error errors fix update check user time name type list page line lines".split()
MIN_CLUSTER, EXPORTED = 2, 40
MIN_CATEGORY_SESSIONS, MIN_PER_SIDE, PREMIUM_SHARE, NOISE = 6, 2, 0.5, 0.05
MIN_SIDE_DAYS, MIN_BEFORE = 7, 3


def task_sessions(turns: DataFrame) -> DataFrame:
    """One row per conversation: source, project, date, tokens, cost, activity of most turns (ties by name), tools."""
    t = with_sums(turns)
    first = F.struct("ts", "event_key")
    s = t.groupBy("root").agg(
        F.min_by("source", first).alias("source"),
        F.min_by("project", first).alias("project"),
        F.min("ts").alias("date"),
        _sum("spend").alias("tokens"),
        _sum("usd").alias("cost_usd"),
        F.max("estimated").alias("estimated"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tools", F.array().cast("array<string>")))))).alias("tools"),
    )
    acts = t.groupBy("root", "activity").agg(F.count("*").alias("n"))
    most = acts.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("n"), "activity"))).filter("r = 1").select("root", "activity")
    return s.join(most, "root")


def session_prompts(messages: DataFrame) -> DataFrame:
    """The distinct prompts (session_id, text) of each session."""
    return messages.filter(F.trim("text") != "").select("session_id", "text").distinct()


def _top(words: DataFrame) -> DataFrame:
    """(root, terms): the eight most frequent words, ties by the alphabet; words: (root, term)."""
    n = words.groupBy("root", "term").agg(F.count("*").alias("n"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("n"), "term"))).filter(F.col("r") <= FINGERPRINT_TERMS)
    return r.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("terms"))


def session_intents(sessions: DataFrame, prompts: DataFrame) -> DataFrame:
    """root, terms, label, intent_id, has_text: from the prompts' words, or else from activity and tools.

    Every distinct prompt is redacted by itself.
    """
    words = prompts.select(F.col("session_id").alias("root"), F.explode(tokenize_text(F.col("text"))).alias("term"))
    enough = words.groupBy("root").agg(F.count("*").alias("n")).filter("n >= 2").select("root")
    said = _top(words.join(enough, "root", "left_semi")).withColumn("has_text", F.lit(True))
    rest = sessions.join(enough, "root", "left_anti")
    tools = F.filter(F.transform("tools", norm_tool), lambda t: F.length(t) >= 3)
    fallback = _top(rest.select("root", F.explode(F.concat(F.array("activity"), tools)).alias("term"))).withColumn("has_text", F.lit(False))
    i = sessions.select("root").join(said.unionByName(fallback), "root")
    return i.select("root", "terms", label_of(F.col("terms")).alias("label"), fnv1a_hex(F.array_join(F.array_sort("terms"), "|")).alias("intent_id"), "has_text")


def categories(sessions: DataFrame, intents: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per cluster of conversations: id, name, terms, sessions, projects, tokens, cost, has_text, duplicate."""
    members = clusters.withColumnRenamed("item", "root").join(sessions, "root").join(intents.select("root", "has_text"), "root")
    c = members.groupBy("cluster").agg(
        F.count("*").alias("sessions"),
        F.countDistinct("project").alias("projects"),
        _sum("tokens").alias("tokens"),
        _sum("cost_usd").alias("cost_usd"),
        F.max("estimated").alias("estimated"),
        F.max("has_text").alias("has_text"),
    )
    return c.join(cluster_terms(intents.select(F.col("root").alias("item"), "terms"), clusters), "cluster")


def duplicate_work(categories_: DataFrame, min_cluster: int = MIN_CLUSTER) -> DataFrame:
    """Categories that real prompts show in several sessions and projects, dearest first."""
    least = max(2, min_cluster)
    return categories_.filter((F.col("sessions") >= least) & (F.col("projects") >= 2) & F.col("has_text")).orderBy(F.desc("cost_usd"), F.desc("sessions"), "name", "cluster_id")


def skill_candidates(categories_: DataFrame, min_cluster: int = MIN_CLUSTER) -> DataFrame:
    return categories_.filter((F.col("sessions") >= max(2, min_cluster)) & F.col("has_text"))


def export_categories(categories_: DataFrame) -> DataFrame:
    """The 40 dearest categories that rest on prompts."""
    return categories_.filter("has_text").orderBy(F.desc("cost_usd"), F.desc("sessions"), "name", "cluster_id").limit(EXPORTED)


def duplicate_summary(categories_: DataFrame, min_cluster: int = MIN_CLUSTER) -> DataFrame:
    """Tasks, sessions and cost of duplicate work; no row without any."""
    s = duplicate_work(categories_, min_cluster).agg(F.count("*").alias("tasks"), _sum("sessions").alias("sessions"), _sum("cost_usd").alias("cost_usd"), F.max("estimated").alias("estimated"))
    return s.filter("tasks > 0")


# --- routing ---


def session_facts(turns: DataFrame, pr_sessions: DataFrame, now: Column) -> DataFrame:
    """Per conversation: premium (half of its tokens or more), project, rework and error rates, premium tokens and cost."""
    t = with_sums(turns)
    first = t.groupBy("root").agg(F.min_by("project", F.struct("ts", "event_key")).alias("project"), _sum("usd", F.col("premium")).alias("premium_cost_usd"), F.min("ts").alias("date"))
    m = compute_metrics(turns.withColumn("root", F.coalesce(F.nullif("parent_session_id", F.lit("")), "session_id")), pr_sessions, now, ("root",))
    m = m.select("root", (F.col("premium_share") >= PREMIUM_SHARE).alias("premium"), "rework_ratio", ratio("error_events", "events").alias("error_rate"), "premium_tokens")
    return m.join(first, "root")


def routing_by_category(facts: DataFrame, clusters: DataFrame, rates: DataFrame, days: int) -> DataFrame:
    """Whether cheap models do as well as premium ones in a category, compared inside one project where there are several."""
    f = clusters.select(F.col("item").alias("root"), "cluster").join(facts, "root")
    size = f.groupBy("cluster").agg(F.count("*").alias("all_sessions"), F.countDistinct("project").alias("n_projects")).filter(F.col("all_sessions") >= MIN_CATEGORY_SESSIONS)
    cheap = ~F.col("premium")
    p = f.groupBy("cluster", "project").agg(
        F.min(F.struct("date", "root")).alias("seen"),
        F.count(F.when(F.col("premium"), 1)).alias("premium_sessions"),
        F.count(F.when(cheap, 1)).alias("cheap_sessions"),
        _sum("premium_tokens", F.col("premium")).alias("premium_tokens"),
        _sum("premium_cost_usd", F.col("premium")).alias("premium_cost_usd"),
        *(F.avg(F.when(side, F.col(c))).alias(f"{c}_{n}") for c in ("rework_ratio", "error_rate") for n, side in (("premium", F.col("premium")), ("cheap", cheap))),
    )
    usable = p.filter((F.col("premium_sessions") >= MIN_PER_SIDE) & (F.col("cheap_sessions") >= MIN_PER_SIDE))
    first = usable.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("seen"))).filter("r = 1")
    j = first.join(size, "cluster").crossJoin(F.broadcast(rates.select("rate_premium", "rate_cheap")))  # one row
    rework, error = F.col("rework_ratio_cheap") - F.col("rework_ratio_premium"), F.col("error_rate_cheap") - F.col("error_rate_premium")
    worse, alike = (rework > NOISE) | (error > NOISE), (F.abs(rework) <= NOISE) & (F.abs(error) <= NOISE)
    saving = F.col("premium_tokens") * F.greatest(F.lit(0.0), F.col("rate_premium") - F.col("rate_cheap")) * (30 / days if days > 0 else 1)
    return j.select(
        "cluster", "project", (F.col("premium_sessions") + F.col("cheap_sessions")).alias("sessions"), "premium_sessions", "cheap_sessions", "premium_tokens", "premium_cost_usd",
        rework.alias("rework_delta"), error.alias("error_delta"), F.when(worse, "premium-better").when(alike, "no-measurable-gap").otherwise("cheap-worse-unclear").alias("verdict"),
        F.when(~worse & alike, saving).alias("monthly_usd"), (F.col("n_projects") > 1).alias("project_scoped"),
    )


# --- skills ---


def skill_tokens(skill: Column) -> Column:
    """Distinctive words of a skill's name, without its plugin's prefix."""
    words = F.split(F.regexp_replace(F.lower(skill), "^[^:]+:", ""), "[^a-z0-9]+")
    return F.filter(words, lambda t: (F.length(t) >= 4) & ~t.isin(GENERIC_TOKENS))


def skill_links(categories_: DataFrame, usage: DataFrame, skill_map: DataFrame) -> DataFrame:
    """(cluster, skill, link): by the user's map (name, skill), else the most used skill whose words are among the terms.

    usage: (skill, turns). A skill of one word needs that word, one of more words two of them.
    """
    words = usage.select("skill", "turns", F.explode(F.array_distinct(skill_tokens(F.col("skill")))).alias("term"), F.size(skill_tokens(F.col("skill"))).alias("words"))
    hits = categories_.select("cluster", F.explode("terms").alias("term")).join(words, "term").groupBy("cluster", "skill", "turns", "words").agg(F.count("*").alias("hits"))
    fits = hits.filter(F.col("hits") >= F.when(F.col("words") == 1, 1).otherwise(2))
    auto = fits.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("turns"), "skill"))).filter("r = 1").select("cluster", F.col("skill").alias("auto"))
    mapped = skill_map.select(F.lower("name").alias("name"), F.col("skill").alias("mapped")).dropDuplicates(["name"])
    j = categories_.select("cluster", F.lower("name").alias("name")).join(mapped, "name", "left").join(auto, "cluster", "left")
    return j.select("cluster", F.coalesce("mapped", "auto").alias("skill"), F.when(F.col("mapped").isNotNull(), "map").otherwise("terms").alias("link")).filter("skill is not null")


def skill_roi(categories_: DataFrame, links: DataFrame, usage: DataFrame, dates: DataFrame, start: Column, end: Column) -> DataFrame:
    """Sessions per 30 days before and after a linked skill's first use, and what fewer of them saved.

    usage: (skill, first_ts, dormant); dates: (cluster, date), one row per member. Only links from
    the user's own map, to a skill in use, are put in money.
    """
    days = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 86_400_000_000
    u = usage.select("skill", "first_ts", "dormant")
    j = dates.join(links, "cluster").join(u, "skill").groupBy("cluster", "skill", "link", "first_ts", "dormant").agg(F.count("*").alias("n"), F.count(F.when(F.col("date") < F.col("first_ts"), 1)).alias("before"))
    j = j.withColumns({"before_days": days(start, F.col("first_ts")), "after_days": days(F.col("first_ts"), end)}).join(categories_.select("cluster", "name", "sessions", "cost_usd"), "cluster")
    per30 = lambda n, d: F.when(d >= MIN_SIDE_DAYS, n / d * 30).otherwise(0.0)
    j = j.withColumns({"before_per_30": per30(F.col("before"), F.col("before_days")), "after_per_30": per30(F.col("n") - F.col("before"), F.col("after_days"))})
    drop = F.col("before_per_30") - F.col("after_per_30")
    thin = (F.col("before_days") < MIN_SIDE_DAYS) | (F.col("after_days") < MIN_SIDE_DAYS) | (F.col("before") < MIN_BEFORE)
    status = F.when(thin, "insufficient-history").when(drop <= 0, "no-change").when(F.col("dormant") | (F.col("link") != "map"), "tracking").otherwise("realized")
    j = j.withColumn("status", status)
    return j.select("cluster", "name", "skill", "link", "before_per_30", "after_per_30", "status", F.when(F.col("status") == "realized", drop * F.col("cost_usd") / F.col("sessions")).alias("realized_usd"))
