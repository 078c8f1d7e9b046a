"""Small tables that people keep in files: prices, plans, members, keys, aliases, servers, skills, projects.

In most of them the keys of a JSON object are the data, so no schema is known beforehand: a file is
parsed as a variant and its entries become rows. A file that is missing from the folder, is no JSON
(or has a key twice) or has another shape gives no rows; an entry of another kind than asked for is
left out, the others stay. Of entries with one key in several files the last file by name holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pricing import PRICE_SCHEMA
from ..operators.state import resolve_alias_chains

#: A YAML line of a team file: a name, and what stands behind its colon. Fixed values.
YAML_LINE = r"""^["']?([\w.@ -]+?)["']?\s*:\s*(?:["']?([\w -]+?)["']?)?$"""


def read_documents(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """(file, value): every file below path whole."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=suffix)
    return text.select(F.col("_metadata.file_path").alias("file"), "value")


def entries(docs: DataFrame, of: Column) -> DataFrame:
    """docs with pos, key and value (a variant) for each entry of the object or array that of is; none for anything else."""
    spark = docs.sparkSession
    kept = docs.withColumn("_of", of).filter("_of is not null")
    return kept.lateralJoin(spark.tvf.variant_explode(F.col("_of").outer())).drop("_of")


def _json() -> Column:
    return F.try_parse_json("value")


def _at(variant: Column | str, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(variant, path, kind)


def _is_text(variant: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.col(variant)) == "STRING", F.lit(False))


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("file"), F.desc("pos"))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "file", "pos")


def text_map(docs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the files' objects, where both are texts that aren't empty."""
    e = entries(docs.select("file", _json().alias("_doc")), F.col("_doc")).filter(_is_text("value"))
    e = e.select("file", "pos", F.col("key").alias(key), _at(F.col("value"), "$", "string").alias(value))
    return _last(e.filter((F.col(key) != "") & (F.col(value) != "")), key)


def price_lookup(docs: DataFrame) -> DataFrame:
    """Price rows in the order of the array; a row needs a pattern that compiles as it stands and an input and output price."""
    e = entries(docs.select("file", _json().alias("_doc")), F.col("_doc"))
    number = lambda name: _at(F.col("value"), f"$.{name}", "double")
    place = F.row_number().over(Window.orderBy("file", "pos")) - 1  # one small table
    rows = e.select("file", "pos", _at(F.col("value"), "$.match", "string").alias("pattern"), number("input").alias("p_input"), number("output").alias("p_output"), F.coalesce(number("cacheRead"), F.lit(0.0)).alias("p_cache_read"),
        F.coalesce(number("cacheWrite"), F.lit(0.0)).alias("p_cache_write"), number("cacheWrite1h").alias("p_cache_write_1h"), F.coalesce(_at(F.col("value"), "$.estimated", "boolean"), F.lit(False)).alias("estimated"))
    rows = rows.filter("pattern <> '' and p_input is not null and p_output is not null").withColumn("position", place.cast("int"))
    return rows.select(*(c.split()[0] for c in PRICE_SCHEMA.split(", ")))


def plan_lookup(docs: DataFrame) -> DataFrame:
    """(plan, monthly_usd, annual_usd, plan_estimated)."""
    e = entries(docs.select("file", _json().alias("_doc")), F.col("_doc"))
    rows = e.select("file", "pos", F.lower(F.trim(_at(F.col("value"), "$.id", "string"))).alias("plan"), _at(F.col("value"), "$.monthlyUsd", "double").alias("monthly_usd"), _at(F.col("value"), "$.annualUsd", "double").alias("annual_usd"),
        F.coalesce(_at(F.col("value"), "$.estimated", "boolean"), F.lit(False)).alias("plan_estimated"))
    return _last(rows.filter("plan <> '' and monthly_usd is not null"), "plan")


def member_lookup(docs: DataFrame) -> DataFrame:
    """(member, team, discipline): from JSON ({member: discipline} or {team: {member: discipline}}) or the same as YAML of two levels."""
    json = docs.filter(F.col("file").endswith(".json") | F.ltrim("value").startswith("{"))
    e = entries(json.select("file", _json().alias("_doc")), F.col("_doc")).filter("key is not null")
    none = F.lit(None).cast("string")
    flat = e.filter(_is_text("value")).select("file", "pos", F.col("key").alias("member"), none.alias("team"), _at(F.col("value"), "$", "string").alias("discipline"))
    inner = entries(e.select("file", F.col("pos").alias("_p"), F.col("key").alias("team"), F.col("value").alias("_team")), F.col("_team"))
    deep = inner.filter("key is not null").select("file", F.col("_p").alias("pos"), F.col("key").alias("member"), "team", _at(F.col("value"), "$", "string").alias("discipline"))
    yaml = docs.join(json.select("file").distinct(), "file", "left_anti")
    lines = yaml.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line")).withColumn("line", F.regexp_replace("line", r"#.*$|\s+$", ""))
    part = lambda n: F.regexp_extract(F.regexp_replace("line", r"^\s+|\s+$", ""), YAML_LINE, n)
    lines = lines.withColumns({"name": part(1), "value": part(2), "indented": F.col("line").rlike(r"^\s")}).filter("name <> ''")
    # A header holds for the indented lines below it, up to the next header or line that isn't indented.
    header = F.when(F.col("value") == "", F.col("name")).when(~F.col("indented"), F.lit(""))
    above = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("team", F.nullif(F.last(header, True).over(above), F.lit(""))).filter("value <> ''")
    said = lines.select("file", "pos", F.col("name").alias("member"), F.when(F.col("indented"), F.col("team")).alias("team"), F.trim("value").alias("discipline"))
    return _last(flat.unionByName(deep).unionByName(said).filter("discipline is not null"), "member")


def keyring_lookup(docs: DataFrame) -> DataFrame:
    return text_map(docs, "user", "fingerprint")


def alias_lookup(docs: DataFrame) -> DataFrame:
    """(alias, target), chains followed to their end."""
    return resolve_alias_chains(text_map(docs, "alias", "target"))


def skill_lookup(docs: DataFrame) -> DataFrame:
    """(name, skill): names of categories in lower case."""
    e = entries(docs.select("file", _json().alias("_doc")), F.col("_doc")).filter(_is_text("value"))
    e = e.select("file", "pos", F.lower("key").alias("name"), _at(F.col("value"), "$", "string").alias("skill"))
    return _last(e.filter("name is not null and skill <> ''"), "name")


def server_lookup(docs: DataFrame) -> DataFrame:
    """(server): names of declared servers, of the user and of all projects. Only names are read, never what they stand for."""
    doc = docs.select("file", _json().alias("_doc"))
    projects = entries(doc, _at(F.col("_doc"), "$.projects")).filter("key is not null").select("file", F.col("value").alias("_project"))
    lists = doc.select("file", _at(F.col("_doc"), "$.mcpServers").alias("_names")).unionByName(
        projects.select("file", _at(F.col("_project"), "$.mcpServers").alias("_names"))
    ).unionByName(projects.select("file", _at(F.col("_project"), "$.enabledMcpjsonServers").alias("_names")))
    e = entries(lists, F.col("_names"))
    # An object's names are its keys, a list's its texts.
    return e.select(F.coalesce("key", F.when(_is_text("value"), _at(F.col("value"), "$", "string"))).alias("server")).filter("server is not null").distinct()


def project_lookup(docs: DataFrame) -> DataFrame:
    """(hash, project): from {path: hash} or {hash: {path}}, at the top or under "projects"."""
    doc = docs.select("file", _json().alias("_doc"))
    e = entries(doc, F.coalesce(_at(F.col("_doc"), "$.projects"), F.col("_doc"))).filter("key is not null")
    base = lambda path: F.regexp_extract(path, r"([^/]+)/*$", 1)
    plain, path = _is_text("value"), _at(F.col("value"), "$.path", "string")
    hash_ = F.when(plain, _at(F.col("value"), "$", "string")).otherwise(F.when(path.isNotNull(), F.col("key")))
    rows = e.select("file", "pos", hash_.alias("hash"), F.when(plain, base(F.col("key"))).otherwise(base(path)).alias("project"))
    return _last(rows.filter("hash is not null and project <> ''"), "hash")
