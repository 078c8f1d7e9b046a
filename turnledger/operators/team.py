"""Several people's usage: exports, merging, billing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import small
from .annotate import with_sums
from .metrics import _sum, ratio

# Plans by id with monthly and annual price per seat, and whether the price is an estimate.
PLANS = [("pro", 20.0, 17.0, False), ("max-5x", 100.0, None, False), ("max-20x", 200.0, None, True), ("team-standard", 25.0, 20.0, False), ("team-premium", 125.0, 100.0, False)]
TOLERANCE = 1.05
MIN_PROJECTION_DAYS = 7


def plan_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan string, monthly_usd double, annual_usd double, plan_estimated boolean")


def seat_band(value: Column) -> Column:
    return F.when(value >= 1.5, "well-used").when(value >= 0.8, "about even").otherwise("under-used")


def seat_comparison(costs: DataFrame, days: int, annual: bool = False) -> DataFrame:
    """costs: (member, plan, cost_usd, cost_estimated). What the usage would cost by the token against the seat."""
    j = costs.withColumn("plan", F.lower(F.trim("plan"))).join(F.broadcast(plan_table(costs.sparkSession)), "plan")
    monthly = F.col("cost_usd") * (30 / days) if days > 0 else F.lit(0.0)
    seat = F.coalesce("annual_usd", "monthly_usd") if annual else F.col("monthly_usd")
    j = j.withColumn("api_usd", monthly).withColumn("seat_usd", seat).withColumn("seat_ratio", ratio("api_usd", "seat_usd"))
    return j.select("member", "plan", "api_usd", "seat_usd", "seat_ratio", seat_band(F.col("seat_ratio")).alias("band"), (F.col("cost_estimated") | F.col("plan_estimated")).alias("estimated"), F.lit(days < MIN_PROJECTION_DAYS).alias("thin"))


def team_seat_value(costs: DataFrame, days: int) -> DataFrame:
    s = seat_comparison(costs, days)
    t = s.agg(F.count("*").alias("seats"), _sum("api_usd").alias("api_usd"), _sum("seat_usd").alias("seat_usd"))
    return t.withColumn("seat_ratio", ratio("api_usd", "seat_usd"))


def dedupe_exports(exports: DataFrame) -> DataFrame:
    """The newest export of each identity; of equally new ones the first in order."""
    w = Window.partitionBy("identity").orderBy(F.desc("generated_at"), "position")
    return exports.withColumn("dropped", F.row_number().over(w) > 1)


#: Counts and sums of compute_metrics() that add up over members.
ADDITIVE = [
    "events", "conversations", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "thinking_tokens", "spend_tokens", "cost_usd", "unpriced_tokens", "error_events",
    "thinking_activity", "exploration_activity", "coding_activity", "rework_tokens", "retry_tokens", "premium_waste_tokens", "cold_restart_turns", "cold_restart_tokens", "main_fresh_tokens",
    "trend_sessions", "bloated_sessions", "subagent_sessions", "subagent_tokens", "returned_tokens", "carry_tokens", "floor_sessions", "floor_turns", "floor_base_tokens", "shipped_sessions",
    "abandoned_streams", "abandoned_tokens", "open_streams", "open_tokens",
]


def merge_metrics(metrics: DataFrame, scope=()) -> DataFrame:
    """Rows of compute_metrics() merged: amounts add up, ratios are taken anew, the floor is a mean weighted by turns."""
    m = metrics.groupBy(*scope).agg(
        *(_sum(c).alias(c) for c in ADDITIVE),
        F.count("*").alias("members"),
        _sum(F.col("floor_tokens") * F.col("floor_turns")).alias("_floor"),
        _sum("floor_turns", F.col("floor_tokens") > 0).alias("_floor_turns"),
        _sum(F.col("cost_per_shipped") * F.col("shipped_sessions")).alias("_shipped_cost"),
        F.max("cost_estimated").alias("cost_estimated"),
    )
    side = F.col("cache_read_tokens") + F.col("input_tokens") + F.col("cache_creation_tokens")
    return m.withColumns(
        {
            "cache_hit_ratio": ratio("cache_read_tokens", side),
            "rework_ratio": ratio("rework_tokens", "spend_tokens"),
            "think_to_code": (F.col("thinking_activity") + F.col("exploration_activity")) / F.greatest("coding_activity", F.lit(1)),
            "bloat_share": ratio("bloated_sessions", "trend_sessions"),
            "cold_share": ratio("cold_restart_tokens", "main_fresh_tokens"),
            "premium_waste_share": ratio("premium_waste_tokens", "spend_tokens"),
            "retry_share": ratio("retry_tokens", "spend_tokens"),
            "subagent_share": ratio("subagent_tokens", "spend_tokens"),
            "carry_share": ratio("carry_tokens", side),
            "floor_tokens": ratio("_floor", "_floor_turns"),
            "shipped_share": ratio("shipped_sessions", "conversations"),
            "cost_per_shipped": ratio("_shipped_cost", "shipped_sessions"),
            "abandoned_share": ratio("abandoned_tokens", "spend_tokens"),
        }
    ).drop("_floor", "_floor_turns", "_shipped_cost")


def team_rollup(member_metrics: DataFrame, member_map: DataFrame, by: str) -> DataFrame:
    """merge_metrics() by team or discipline; members without a row in the map are unassigned."""
    j = member_metrics.join(small(member_map), "member", "left").withColumn(by, F.coalesce(by, F.lit("unassigned")))
    return merge_metrics(j, (by,))


def reconcile_usage(turns: DataFrame, billed: DataFrame) -> DataFrame:
    """Local tokens per model against billed ones (model, api_tokens)."""
    t = with_sums(turns)
    local = t.groupBy("model").agg(_sum(F.col("spend") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")).alias("local_tokens"))
    j = billed.groupBy("model").agg(_sum("api_tokens").alias("api_tokens"), F.lit(True).alias("is_billed")).join(local, "model", "full").fillna(0, ["api_tokens", "local_tokens"])
    over = (F.col("api_tokens") > 0) & (F.col("local_tokens") > F.col("api_tokens") * TOLERANCE)
    return j.select("model", "local_tokens", "api_tokens", ratio("local_tokens", "api_tokens").alias("coverage"), F.when(F.col("is_billed").isNull(), "local-only").when(over, "local-exceeds-api").otherwise("ok").alias("verdict"))


def personas(metrics: DataFrame) -> Column:
    """The first persona whose condition holds for a row of compute_metrics(). The limits are fixed values."""
    share = lambda a: ratio(f"{a}_activity", "spend_tokens")
    rework, hit = F.col("rework_ratio"), F.col("cache_hit_ratio")
    return (
        F.when((share("testing") >= 0.2) & (rework >= 0.25), "firefighter")
        .when(share("exploration") >= 0.45, "explorer")
        .when((share("thinking") < 0.05) & (share("coding") >= 0.4) & (rework >= 0.15), "sprinter")
        .when((hit >= 0.7) & (rework < 0.1) & (share("exploration") < 0.25), "surgeon")
        .when((share("thinking") >= 0.15) & (rework < 0.15), "architect")
        .otherwise("balanced")
    )


def skill_usage(skills: DataFrame, now: Column, days: int) -> DataFrame:
    """skills: rows of session_skills(). A skill last used before the window is dormant."""
    s = skills.groupBy("skill").agg(F.sum("turns").alias("turns"), F.countDistinct("session_id").alias("sessions"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    age = (F.unix_micros(now) - F.unix_micros("last_ts")) / 86_400_000_000
    return s.select("skill", "turns", "sessions", F.to_date("first_ts").cast("string").alias("first_day"), F.to_date("last_ts").cast("string").alias("last_day"), (age > days).alias("dormant"))


STALE_DAYS = 3


def export_identity(exports: DataFrame, keyring: DataFrame) -> DataFrame:
    """exports: (user, host, fingerprint or null); keyring: (user, fingerprint). Adds identity, unsigned and name.

    A signed export is its key, and bears the name that the keyring has for it.
    """
    known = keyring.groupBy("fingerprint").agg(F.min("user").alias("known"))
    j = exports.join(known, "fingerprint", "left")
    return j.select(*exports.columns, F.coalesce("fingerprint", F.concat("user", F.lit("@"), "host")).alias("identity"), F.col("fingerprint").isNull().alias("unsigned"), F.coalesce("known", "user").alias("name"))


def keyring_check(exports: DataFrame, keyring: DataFrame) -> DataFrame:
    """user, fingerprint, verdict: ok, mismatch with the pinned key, or not enrolled. Signed exports only."""
    pinned = keyring.select("user", F.col("fingerprint").alias("pinned"))
    j = exports.filter("fingerprint is not null").select("user", "fingerprint").join(pinned, "user", "left")
    return j.select("user", "fingerprint", F.when(F.col("pinned").isNull(), "not-enrolled").when(F.col("pinned") != F.col("fingerprint"), "mismatch").otherwise("ok").alias("verdict"))


def stale_members(coverage: DataFrame) -> DataFrame:
    """coverage: (name, source, stale_days). Sources without turns for three days or more, worst first."""
    return coverage.filter(F.col("stale_days") >= STALE_DAYS).select("name", "source", "stale_days").orderBy(F.desc("stale_days"), "name", "source")


def usable_categories(categories: DataFrame) -> DataFrame:
    """Member categories (identity, name, unsigned, id, terms, sessions, projects, tokens, cost_usd, estimated, duplicate) that hold all they need.

    item is a name of its own for each; equal ids of one member are numbered.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    ok = F.col("id").isNotNull() & (F.size("terms") > 0) & F.forall("terms", lambda t: t.isNotNull() & (t != "")) & finite("sessions") & finite("tokens") & finite("cost_usd")
    w = Window.partitionBy("identity", "id").orderBy("cost_usd", "sessions", "tokens")
    n = F.row_number().over(w)
    return categories.filter(F.coalesce(ok, F.lit(False))).withColumn("item", F.concat("identity", F.lit(":"), "id", F.when(n > 1, F.concat(F.lit("#"), n)).otherwise("")))


def merge_categories(usable: DataFrame, clusters: DataFrame) -> DataFrame:
    """Categories of several members that mean the same work; score is sessions times members."""
    from .clusters import cluster_terms

    m = usable.join(clusters, "item")
    users = F.when(F.col("unsigned"), F.concat("name", F.lit(" (unsigned)"))).otherwise(F.col("name"))
    c = m.groupBy("cluster").agg(
        F.countDistinct("identity").alias("members"),
        F.countDistinct(users).alias("users"),
        _sum("sessions").alias("sessions"),
        _sum("tokens").alias("tokens"),
        _sum("cost_usd").alias("cost_usd"),
        F.max("estimated").alias("estimated"),
    )
    c = c.withColumns({"cross_user": F.col("members") >= 2, "score": F.col("sessions") * F.col("members")})
    return c.join(cluster_terms(usable.select("item", "terms"), clusters), "cluster")


def cross_user_duplicates(merged: DataFrame, min_cluster: int = 2) -> DataFrame:
    return merged.filter(F.col("cross_user") & (F.col("sessions") >= max(2, min_cluster)))


def org_skill_candidates(merged: DataFrame, min_cluster: int = 2) -> DataFrame:
    return merged.filter(F.col("sessions") >= max(2, min_cluster))


def within_member_dups(usable: DataFrame) -> DataFrame:
    """Cost of work that members' own exports call duplicate, how many of them, and whether any export is unsigned."""
    m = usable.groupBy("identity").agg(_sum("cost_usd", F.col("duplicate")).alias("dup"), F.max("unsigned").alias("unsigned"))
    return m.agg(F.count("*").alias("with_categories"), _sum("dup").alias("dup_cost_usd"), F.count(F.when(F.col("dup") > 0, 1)).alias("dup_members"), F.coalesce(F.max("unsigned"), F.lit(False)).alias("any_unsigned"))
