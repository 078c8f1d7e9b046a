"""Incremental collection: first-wins intake, upserts of state tables, relabelling, follow-through.

There is no transactional table format; every operator takes the stored and the new rows and
returns the next snapshot, which the caller writes to a new path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored


def dedup_turns(turns: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The first row of each (source, event_key), by time, that is not stored yet."""
    order = Window.partitionBy("source", "event_key").orderBy("ts", "session_id", "input_tokens", "output_tokens")
    first = turns.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
    return first if stored is None else first.join(stored.select("source", "event_key").distinct(), ["source", "event_key"], "left_anti")


def ingest_summary(turns: DataFrame, stored: DataFrame) -> DataFrame:
    """Per source: rows scanned, and rows that are new."""
    new = dedup_turns(turns, stored).groupBy("source").agg(F.count("*").alias("new_rows"))
    return turns.groupBy("source").agg(F.count("*").alias("scanned")).join(new, "source", "left").fillna(0, ["new_rows"])


def session_skills(turns: DataFrame) -> DataFrame:
    return turns.filter("skill is not null").groupBy("source", "session_id", "skill").agg(F.count("*").alias("turns"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def upsert_session_skills(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """Most turns, earliest first and latest last use of each (source, session, skill)."""
    both = stored.unionByName(scanned)
    return both.groupBy("source", "session_id", "skill").agg(F.max("turns").alias("turns"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def upsert_session_prs(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    return stored.unionByName(scanned).groupBy("source", "session_id").agg(F.max("pr_count").alias("pr_count")).filter("pr_count > 0")


def record_intents(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored intents stay as they are; sessions without one get theirs."""
    return stored.unionByName(found.join(stored.select("session_id").distinct(), "session_id", "left_anti").select(*stored.columns))


def resolve_alias_chains(aliases: DataFrame) -> DataFrame:
    """(alias, target): chains followed to their end. A key on a cycle maps to itself; a key that
    leads into a cycle stops at the first name seen twice, which is where it enters the cycle.

    By pointer doubling: each round a name knows where twice as many steps lead, so chains of
    any length take as many rounds as their length has binary digits.
    """
    pairs = stored(aliases.select("alias", "target").groupBy("alias").agg(F.min("target").alias("target")))
    names = pairs.select("alias").union(pairs.select("target")).distinct()
    # Ends point to themselves. After as many steps as there are names, all stand at an end or on a cycle.
    jump = stored(names.join(pairs, "alias", "left").select("alias", F.coalesce("target", "alias").alias("to")))
    steps, many = 1, jump.count()
    while steps < many:
        nxt = jump.join(jump.select(F.col("alias").alias("to"), F.col("to").alias("far")), "to").select("alias", F.col("far").alias("to"))
        jump, steps = stored(nxt), steps * 2
    # Names that something still stands at after so many steps, and that have a target, are on cycles.
    on = jump.select(F.col("to").alias("alias")).distinct().join(pairs, "alias").filter("alias <> target").select("alias")
    cycle = stored(on.union(pairs.filter("alias = target").select("alias")).distinct())
    entry = stored(_walk_to(pairs, cycle, many))
    ends = jump.join(pairs.select("alias"), "alias", "left_semi").join(entry, "alias", "left").join(cycle.withColumn("on", F.lit(True)), "alias", "left")
    return ends.select("alias", F.when(F.col("on"), F.col("alias")).otherwise(F.coalesce("entry", "to")).alias("target"))


def _walk_to(pairs: DataFrame, cycle: DataFrame, many: int) -> DataFrame:
    """(alias, entry): where the names that lead into a cycle enter it. Names on a cycle stand still."""
    if not cycle.limit(1).count():
        return pairs.select("alias", F.col("target").alias("entry")).limit(0)
    still = cycle.select("alias", F.lit(True).alias("on"))
    names = pairs.select("alias").union(pairs.select("target")).distinct()
    jump = stored(names.join(pairs, "alias", "left").join(still, "alias", "left").select("alias", F.when(F.col("on"), F.col("alias")).otherwise(F.coalesce("target", "alias")).alias("to")))
    steps = 1
    while steps < many:
        jump, steps = stored(jump.join(jump.select(F.col("alias").alias("to"), F.col("to").alias("far")), "to").select("alias", F.col("far").alias("to"))), steps * 2
    return jump.join(cycle.select(F.col("alias").alias("to")), "to", "left_semi").select("alias", F.col("to").alias("entry")).join(cycle, "alias", "left_anti")


def relabel_sessions(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """labels: (source, session_id, label). Rows that differ get the label; the first label stays in project_raw."""
    j = turns.join(labels.select("source", "session_id", "label"), ["source", "session_id"], "left")
    moved = F.col("label").isNotNull() & ~F.col("label").eqNullSafe(F.col("project"))
    return j.withColumn("project_raw", F.when(moved, F.coalesce("project_raw", "project")).otherwise(F.col("project_raw"))).withColumn("project", F.when(moved, F.col("label")).otherwise(F.col("project"))).drop("label")


def apply_project_aliases(turns: DataFrame, aliases: DataFrame) -> DataFrame:
    a = resolve_alias_chains(aliases).select(F.col("alias").alias("project"), "target")
    j = turns.join(a, "project", "left")
    moved = F.col("target").isNotNull() & (F.col("target") != F.col("project"))
    return j.withColumn("project_raw", F.when(moved, F.coalesce("project_raw", "project")).otherwise(F.col("project_raw"))).withColumn("project", F.when(moved, F.col("target")).otherwise(F.col("project"))).drop("target")


def sync_intent_projects(intents: DataFrame, turns: DataFrame) -> DataFrame:
    """An intent takes the project of its session's earliest turn if any turn of that session has another one."""
    first = turns.groupBy("source", "session_id").agg(F.min_by("project", F.struct("ts", "event_key")).alias("_p"), F.collect_set("project").alias("_all"))
    j = intents.join(first, ["source", "session_id"], "left")
    differs = F.exists("_all", lambda x: x != F.col("project"))
    return j.withColumn("project", F.when(F.coalesce(differs, F.lit(False)), F.col("_p")).otherwise(F.col("project"))).drop("_p", "_all")


def sync_findings(stored: DataFrame, current: DataFrame, fired: DataFrame, now: Column, noise: float = 0.02) -> DataFrame:
    """Follow-through of recommendations as the next snapshot.

    stored: (rule, metric, direction, baseline, created_at, resolved_at); current: (metric, value) of
    this run; fired: (rule, metric, direction) of this run. New rules start at the value now; a rule
    that stops firing is resolved (the first time stays), one that fires again is open again.
    """
    f = fired.select("rule", F.col("metric").alias("f_metric"), F.col("direction").alias("f_direction"), F.lit(True).alias("fires"))
    j = stored.join(f, "rule", "full")
    metric, direction = F.coalesce("metric", "f_metric"), F.coalesce("direction", "f_direction")
    j = j.select("rule", metric.alias("metric"), direction.alias("direction"), "baseline", "created_at", "resolved_at", F.coalesce("fires", F.lit(False)).alias("fires"))
    j = j.join(current.select("metric", "value"), "metric", "left")
    new = F.col("created_at").isNull()
    gain = F.when(F.col("direction") == "up", F.col("value") - F.col("baseline")).otherwise(F.col("baseline") - F.col("value"))
    return j.select(
        "rule",
        "metric",
        "direction",
        F.coalesce("baseline", "value").alias("baseline"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(~F.col("fires"), F.coalesce("resolved_at", now)).alias("resolved_at"),
        F.col("value").alias("current"),
        F.when(new, "new").when(~F.col("fires"), "resolved").when(gain > noise, "improving").when(gain < -noise, "regressing").otherwise("tracking").alias("status"),
    )


# The good direction of each tracked metric.
DIRECTIONS = {
    "cache_hit_ratio": "up", "rework_ratio": "down", "think_to_code": "up", "premium_share": "down", "bloat_share": "down", "cold_share": "down",
    "premium_waste_share": "down", "retry_share": "down", "carry_share": "down", "floor_share": "down", "shipped_share": "up", "abandoned_share": "down",
}


def record_interventions(state: DataFrame, proposed: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    """state with the proposed (metric, message) added under llm:<metric>, first wins; unknown metrics are left out.

    The direction is the metric's own, whatever was proposed; such rows are never resolved by themselves.
    """
    direction = F.lit(None).cast("string")
    for metric, way in DIRECTIONS.items():
        direction = F.when(F.col("metric") == metric, way).otherwise(direction)
    p = proposed.select("metric", "message", direction.alias("direction")).filter("direction is not null").groupBy("metric", "direction").agg(F.min("message").alias("message"))
    p = p.join(current.select("metric", F.col("value").alias("baseline")), "metric", "left")
    new = p.select(F.concat(F.lit("llm:"), "metric").alias("rule"), "metric", "direction", "baseline", now.alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"), "message")
    return state.unionByName(new.join(state.select("rule"), "rule", "left_anti"))


def upsert_relay_fingerprints(state: DataFrame, scanned: DataFrame) -> DataFrame:
    """Rows (session_id, source, project, shingles, first_ts, last_ts): a scan replaces a stored row if it has as many shingles; first_ts stays."""
    new = scanned.select("session_id", *(F.col(c).alias(f"n_{c}") for c in ("source", "project", "shingles", "first_ts", "last_ts")))
    j = state.join(new, "session_id", "full")
    fresh = F.col("shingles").isNull()
    take = fresh | F.coalesce(F.col("n_shingles") >= F.col("shingles"), F.lit(False))
    pick = lambda c, when: F.when(when, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return j.select("session_id", pick("source", fresh), pick("project", take), pick("shingles", take), pick("first_ts", fresh), pick("last_ts", take))


def upsert_relay_findings(state: DataFrame, found: DataFrame) -> DataFrame:
    """Rows keyed (to_session, from_session): what was found now replaces what was stored."""
    key = ["to_session", "from_session"]
    return state.join(found.select(*key).distinct(), key, "left_anti").unionByName(found.select(*state.columns))


def append_turns(turns: DataFrame, table: DataFrame | None, path: str) -> DataFrame:
    """Adds the turns that are not stored yet to the table at path, by source and day; gives what was added."""
    new = stored(dedup_turns(turns, table).withColumn("dt", F.to_date("ts")))
    new.repartition("source", "dt").write.mode("append").partitionBy("source", "dt").parquet(path)
    return new


def load_turns(table: DataFrame, now: Column | None = None, days: int | None = None, project: str | None = None, source: str | None = None, session: str | None = None) -> DataFrame:
    """The stored turns of a window, project, source or session; columns that older rows lack have their defaults."""
    t = table
    if days is not None:
        since = now - F.make_dt_interval(days=F.lit(days))
        t = t.filter(F.col("ts") >= since)
        if "dt" in t.columns:
            t = t.filter(F.col("dt") >= F.to_date(since))
    for name, value in (("project", project), ("source", source), ("session_id", session)):
        t = t.filter(F.col(name) == value) if value is not None else t
    return t.fillna(0, [c for c in ("cache_creation_1h_tokens", "thinking_tokens") if c in t.columns])


def find_sessions(table: DataFrame, prefix: str) -> DataFrame:
    """Sessions whose id begins with prefix: source, project, turns and last time, newest first."""
    first = F.struct("ts", "event_key")
    s = table.filter(F.col("session_id").startswith(prefix)).groupBy("session_id").agg(F.min_by("project", first).alias("project"), F.min_by("source", first).alias("source"), F.count("*").alias("turns"), F.max("ts").alias("last_ts"))
    return s.orderBy(F.desc("last_ts"), "session_id")
