"""One project for each session, from the folders its turns ran in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", "")


def can_donate(path: Column) -> Column:
    """Whether a folder is deep enough to be a project: three segments beyond a drive, or a mounted workspace."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    drive = F.when(F.get(parts, F.lit(0)).rlike("^[A-Za-z]:$"), 1).otherwise(0)
    parts = F.slice(parts, drive + 1, F.size(parts) + 1)
    mount = F.get(parts, F.lit(0)).rlike("(?i)^(mnt|cygdrive)$") & F.get(parts, F.lit(1)).rlike("^[A-Za-z]$")
    parts = F.slice(parts, F.when(F.coalesce(mount, F.lit(False)), 3).otherwise(1), F.size(parts) + 1)
    return ((F.size(parts) == 2) & (F.get(parts, F.lit(0)) == "workspaces")) | (F.size(parts) >= 3)


def folder_labels(cwds: DataFrame) -> DataFrame:
    """(session_id, cwd, label): a folder's own last segment, or that of the shallowest visited folder above it.

    The folders above are found by an equi-join with each folder's own prefixes, so a session's
    folders are never compared in pairs.
    """
    c = cwds.select("session_id", "cwd").distinct().withColumn("path", normal_path(F.col("cwd")))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = c.select("session_id", "cwd", "path", F.explode(F.when(F.size(parts) > 1, above)).alias("up"))
    seen = c.select("session_id", F.col("path").alias("up")).distinct().filter(can_donate(F.col("up")))
    adopted = up.join(seen, ["session_id", "up"]).groupBy("session_id", "cwd").agg(F.min_by("up", F.length("up")).alias("up"))
    last = lambda x: F.coalesce(F.nullif(F.element_at(F.split(x, "/"), -1), F.lit("")), x)
    return c.join(adopted, ["session_id", "cwd"], "left").select("session_id", "cwd", "path", last(F.coalesce("up", "path")).alias("label"))


def visits(events: DataFrame, *by: str) -> DataFrame:
    """(by, session_id, cwd, n, first): how many rows ran in a folder and the first of them, as a table that is read several times."""
    return stored(events.filter("cwd is not null").groupBy(*by, "session_id", "cwd").agg(F.count("*").alias("n"), F.min("ord").alias("first")))


def session_projects(events: DataFrame) -> DataFrame:
    """(session_id, project) over rows (session_id, cwd, ord): the label of most rows, the first seen of equal ones.

    Folders too shallow to be a project have a vote only where no other was visited.
    """
    return most_visited(visits(events))


def most_visited(folders: DataFrame) -> DataFrame:
    """(session_id, project) over what visits() gives: rows are counted before any join, which then takes a row a folder."""
    votes = folders.join(folder_labels(folders), ["session_id", "cwd"]).withColumn("deep", can_donate(F.col("path")))
    counts = votes.groupBy("session_id", "label", "deep").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    # A label may stand for deep and shallow folders; the shallow ones count only without any deep one.
    w = Window.partitionBy("session_id").orderBy(F.desc("deep"), F.desc("n"), "first")
    return counts.withColumn("r", F.row_number().over(w)).filter("r = 1").select("session_id", F.col("label").alias("project"))


def turn_projects(turns: DataFrame) -> DataFrame:
    """turns of transcripts (with cwd, file and ord) with their project.

    A subagent's run has its parent's project, whatever folder it ran in; a run whose parent left
    no turns has that of its own folders. Without any folder the log's own directory gives the name.
    """
    run = F.coalesce(F.col("parent_session_id") != F.col("session_id"), F.lit(False))
    folders = visits(turns.withColumn("_run", run), "_run")
    own = most_visited(folders.filter("_run")).select("session_id", F.col("project").alias("_own"))
    main = most_visited(folders.filter("not _run")).select(F.col("session_id").alias("_owner"), F.col("project").alias("_main"))
    folder = F.when(run, F.regexp_extract("file", r"([^/]+)/[^/]+/subagents/", 1)).otherwise(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    t = turns.withColumn("_owner", F.when(run, F.col("parent_session_id")).otherwise(F.col("session_id")))
    t = t.join(main, "_owner", "left").join(own, "session_id", "left")
    return t.withColumn("project", F.coalesce("_main", F.when(run, F.col("_own")), folder)).drop("_owner", "_main", "_own")
