"""Queries of lookups and member exports: files written from the tables and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import exports as E
from ..operators import surface as U
from ..operators import team as Te
from ..sources import lookups as L
from ..tables import shared_dir, stored
from . import report
from .core import rounded, total
from .mapping import DAYS, NOW, now, pr_sessions, sql, turns

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def add(name: str, query, oracle: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(turns(spark, sf_dir)))
    if oracle:
        ORACLE_SQL[name] = sql(oracle)


def files(rows: DataFrame) -> DataFrame:
    """rows (kind, name, value) written as a file each, with one broken file a kind, and read again: (kind, file, value)."""
    path = shared_dir(rows.sparkSession)
    broken = rows.select("kind").distinct().select("kind", F.lit("zz").alias("name"), F.lit('{"p0": "no json').alias("value"))
    rows.unionByName(broken).select("value", "kind", "name").repartition("kind", "name").write.partitionBy("kind", "name").text(path)
    docs = L.read_documents(rows.sparkSession, path)
    return docs.withColumn("kind", F.regexp_extract("file", r"/kind=([^/]+)/", 1))


def _object(rows: DataFrame, kind: str, name, key, value) -> DataFrame:
    """A JSON object a name, with an entry for each distinct key: value is JSON text."""
    by = rows.select(name.alias("name"), key.alias("key"), value.alias("v")).distinct()
    pair = F.concat(F.to_json(F.struct(F.col("key"))), F.lit("\0"), "v")
    body = F.array_join(F.array_sort(F.collect_list(F.regexp_replace(pair, r'^\{"key":(.*)\}\x00', "$1:"))), ",")
    return by.groupBy("name").agg(F.concat(F.lit("{"), body, F.lit("}")).alias("value")).select(F.lit(kind).alias("kind"), "name", "value")


def _text(c):
    return F.concat(F.lit('"'), c, F.lit('"'))


def lookup_files(t: DataFrame) -> DataFrame:
    """Every kind of lookup, one file a source of turns (one for members, prices and plans)."""
    one, by_source = F.lit("all"), F.col("source")
    u = F.col("user_id")
    user = F.concat(F.lit("u"), u)
    kinds = [
        _object(t, "keyring", by_source, user, _text(F.sha2(user, 256))),
        _object(t, "aliases", by_source, F.col("project"), _text(F.concat(F.lit("p"), F.floor(F.substring("project", 2, 4).cast("int") / 2)))),
        _object(t.filter("skill is not null"), "skills", by_source, F.concat(F.lit("Work "), "skill"), _text(F.col("skill"))),
        _object(t, "projects", by_source, F.when(u % 2 == 0, F.concat(F.lit("/home/"), user, F.lit("/"), "project")).otherwise(F.sha2(user, 256)), F.when(u % 2 == 0, _text(F.sha2(user, 256))).otherwise(F.concat(F.lit('{"path":"/home/dev/'), "project", F.lit('/"}')))),
        _object(t, "servers", by_source, F.lit("projects"), F.lit("{}")).withColumn("value", F.concat(F.lit('{"mcpServers":{"tickets":{"command":"docs"}},"projects":{"/a":{"enabledMcpjsonServers":["'), "name", F.lit('",7]},"/b":null}}'))),
    ]
    inner = t.select((u % 3).alias("g"), user.alias("m"), (u % 2).alias("d")).distinct().groupBy("g").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "m", F.lit('":"d'), "d", F.lit('"')))), ",").alias("x"))
    members = inner.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"t'), "g", F.lit('":{'), "x", F.lit("}")))), ",").alias("x")).select(F.lit("members").alias("kind"), one.alias("name"), F.concat(F.lit("{"), "x", F.lit("}")).alias("value"))
    kinds.append(members)
    models = t.select("model").distinct().select("model", F.row_number().over(Window.orderBy("model")).alias("n"))
    price = F.concat(F.lit('{"match":"^'), "model", F.lit('$","input":'), "n", F.lit(',"output":'), F.col("n") * 5, F.lit(',"cacheWrite1h":2}'))
    kinds.append(models.groupBy().agg(F.concat(F.lit("[1,"), F.array_join(F.array_sort(F.collect_list(price)), ","), F.lit("]")).alias("value")).select(F.lit("prices").alias("kind"), one.alias("name"), "value"))
    plan = F.concat(F.lit('{"id":"'), "source", F.lit('","monthlyUsd":'), F.length("source"), F.lit("}"))
    kinds.append(t.select("source").distinct().agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(plan)), ","), F.lit("]")).alias("value")).select(F.lit("plans").alias("kind"), one.alias("name"), "value"))
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def read_all(t: DataFrame) -> DataFrame:
    """(kind, key, value) of all lookups."""
    docs = files(lookup_files(t))
    of = lambda kind: docs.filter(F.col("kind") == kind).select("file", "value")
    rows = [
        L.keyring_lookup(of("keyring")).select(F.lit("keyring").alias("kind"), F.col("user").alias("key"), F.col("fingerprint").alias("value")),
        L.alias_lookup(of("aliases")).select(F.lit("aliases").alias("kind"), F.col("alias").alias("key"), F.col("target").alias("value")),
        L.skill_lookup(of("skills")).select(F.lit("skills").alias("kind"), F.col("name").alias("key"), F.col("skill").alias("value")),
        L.project_lookup(of("projects")).select(F.lit("projects").alias("kind"), F.col("hash").alias("key"), F.col("project").alias("value")),
        L.server_lookup(of("servers")).select(F.lit("servers").alias("kind"), F.col("server").alias("key"), F.lit(None).cast("string").alias("value")),
        L.member_lookup(of("members")).select(F.lit("members").alias("kind"), F.col("member").alias("key"), F.concat("team", F.lit("/"), "discipline").alias("value")),
        L.price_lookup(of("prices")).select(F.lit("prices").alias("kind"), F.col("pattern").alias("key"), F.concat_ws("/", F.col("p_input").cast("int").cast("string"), F.col("p_output").cast("int").cast("string"), F.col("p_cache_write_1h").cast("int").cast("string")).alias("value")),
        L.plan_lookup(of("plans")).select(F.lit("plans").alias("kind"), F.col("plan").alias("key"), F.col("monthly_usd").cast("int").cast("string").alias("value")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


add(
    "read_lookups",
    read_all,
    """, us AS (SELECT DISTINCT user_id AS u, 'u' || user_id AS m, source, project FROM t),
    hp AS (SELECT sha256(m) AS key, source, CASE WHEN u % 2 = 0 THEN '/home/' || m || '/' || project ELSE sha256(m) END AS place, project FROM us),
    hl AS (SELECT key, project, row_number() OVER (PARTITION BY key ORDER BY source DESC, place DESC) AS r FROM hp),
    al(alias, target) AS (SELECT 'p' || i, 'p' || (i // 2) FROM range(0, 12) r(i) WHERE 'p' || i IN (SELECT project FROM t))
    SELECT 'keyring' AS kind, m AS key, sha256(m) AS value FROM us GROUP BY m
    UNION ALL SELECT 'aliases', alias, 'p0' FROM al
    UNION ALL SELECT DISTINCT 'skills', 'work ' || skill, skill FROM t WHERE skill IS NOT NULL
    UNION ALL SELECT 'projects', key, project FROM hl WHERE r = 1
    UNION ALL SELECT 'servers', 'tickets', NULL UNION ALL SELECT DISTINCT 'servers', source, NULL FROM t
    UNION ALL SELECT DISTINCT 'members', m, 't' || (u % 3) || '/d' || (u % 2) FROM us
    UNION ALL SELECT 'prices', '^' || model || '$', n || '/' || (n * 5) || '/2' FROM (SELECT model, dense_rank() OVER (ORDER BY model) AS n FROM (SELECT DISTINCT model FROM t))
    UNION ALL SELECT DISTINCT 'plans', source, CAST(length(source) AS VARCHAR) FROM t""",
)


def declared(t: DataFrame) -> DataFrame:
    """Servers of configuration files: one that turns use and one that they don't."""
    conf = t.select("source").distinct().select(F.lit("servers").alias("kind"), F.col("source").alias("name"), F.lit('{"mcpServers":{"tickets":{"env":"docs"}},"projects":{"/a":{"mcpServers":{"wiki":{}}}}}').alias("value"))
    return L.server_lookup(files(conf).select("file", "value"))


add(
    "server_set_difference",
    lambda t: U.server_set_difference(t, declared(t)),
    """SELECT 'tickets' AS server, 'unused' AS state UNION ALL SELECT 'wiki', 'unused' UNION ALL
    SELECT DISTINCT split_part(tool, '__', 2), 'undeclared' FROM (SELECT unnest(tools) AS tool FROM t) WHERE tool LIKE 'mcp#_#_%' ESCAPE '#'""",
)


# --- member exports ---


def documents(t: DataFrame) -> DataFrame:
    """(user, host, doc) of eight members."""
    # A table: the metrics read turns many times, each of which would map the events anew.
    m = stored(t.withColumn("user", F.concat(F.lit("m"), F.col("user_id") % 8)).withColumn("host", F.lit("host")))
    return E.build_exports(m, pr_sessions(m), now(), DAYS)


def exported(t: DataFrame) -> DataFrame:
    """The members' documents written as a snapshot and read again."""
    path = shared_dir(t.sparkSession)
    E.write_export(documents(t), path, now())
    return E.read_export(t.sparkSession, path)


def export_parts(t: DataFrame) -> DataFrame:
    """(user, part, name, a, b): what the documents hold, one row an entry."""
    d = stored(E.parsed(stored(documents(t).select(F.col("user").alias("file"), F.col("doc").alias("value")))))
    amount = lambda m: (F.col(f"{m}.events").alias("a"), F.col(f"{m}.spendTokens").alias("b"))
    rows = d.select("user", F.lit("overall").alias("part"), F.concat("generatedAt", F.lit(" "), "days").alias("name"), *amount("overall"))
    rows = rows.unionByName(d.select("user", F.explode("byProject").alias("name", "m")).select("user", F.lit("project").alias("part"), "name", *amount("m")))
    return rows.unionByName(d.select("user", F.explode("coverage").alias("c")).select("user", F.lit("coverage").alias("part"), F.col("c.source").alias("name"), F.col("c.activeDays").alias("a"), F.col("c.staleDays").alias("b")))


ME = ", me AS (SELECT 'm' || (user_id % 8) AS \"user\", user_id % 8 AS n, * FROM t)"
add(
    "build_export",
    export_parts,
    ME + f""" SELECT "user", 'overall' AS part, '{NOW.replace(" ", "T")}.000Z {DAYS}' AS name, count(*) AS a, {total('spend')} AS b FROM me GROUP BY 1
    UNION ALL SELECT "user", 'project', project, count(*), {total('spend')} FROM me GROUP BY 1, project
    UNION ALL SELECT "user", 'coverage', source, count(DISTINCT CAST(ts AS DATE)), greatest(0, date_diff('day', max(CAST(ts AS DATE)), DATE '{NOW[:10]}')) FROM me GROUP BY 1, source""",
)
add("write_export", lambda t: Te.merge_metrics(E.member_exports(exported(t))).select("members", "events", "spend_tokens", "cost_usd", "error_events", "cache_hit_ratio", "rework_ratio", "shipped_sessions"), None)
ORACLE_SQL["write_export"] = report.ORACLE_SQL["merge_metrics"]


def versions(t: DataFrame) -> DataFrame:
    """The members' documents: as they are, of another version, broken, without overall, without a field of later versions, with an unknown one."""
    d = stored(documents(t))
    n, doc = F.substring("user", 2, 1).cast("int"), F.col("doc")
    doc = (
        F.when(n.isin(1, 5), F.regexp_replace(doc, r'"coldRestartBaseTokens":\d+,', ""))
        .when(n == 2, F.replace(doc, F.lit('"version":1'), F.lit('"version":2')))
        .when(n == 3, F.substring(doc, F.lit(1), F.length(doc) - 5))
        .when(n == 6, F.replace(doc, F.lit('"overall"'), F.lit('"total"')))
        .when(n == 7, F.replace(doc, F.lit('"version":1'), F.lit('"version":1,"later":{"x":[1]}')))
        .otherwise(doc)
    )
    return files(d.select(F.lit("export").alias("kind"), F.col("user").alias("name"), doc.alias("value"))).select("file", "value")


def read_versions(t: DataFrame) -> DataFrame:
    docs = stored(versions(t))
    rows = E.member_exports(docs).select("user", F.lit(None).cast("string").alias("reason"), F.lit(1).cast("long").alias("n"), "events", "main_fresh_tokens")
    bad = E.export_rejects(docs).groupBy("reason").agg(F.count("*").alias("n"))
    none = F.lit(None)
    return rows.unionByName(bad.select(none.cast("string").alias("user"), "reason", "n", none.cast("long").alias("events"), none.cast("long").alias("main_fresh_tokens")))


add(
    "read_member_exports",
    read_versions,
    ME + f""" SELECT "user", CAST(NULL AS VARCHAR) AS reason, CAST(1 AS BIGINT) AS n, count(*) AS events, CASE WHEN n IN (1, 5) THEN {total('fresh')} ELSE {total('fresh', 'NOT is_sidechain')} END AS main_fresh_tokens FROM me WHERE n NOT IN (2, 3, 6) GROUP BY 1, me.n
    UNION ALL SELECT NULL, reason, count(*), NULL, NULL FROM (
      SELECT DISTINCT n, CASE n WHEN 2 THEN 'other version' WHEN 3 THEN 'no export' ELSE 'no overall' END AS reason FROM me WHERE n IN (2, 3, 6) UNION ALL SELECT 99, 'no export') GROUP BY reason""",
)
