"""What a model's free text proposes: JSON found by balanced brackets, checked, first of each metric.

A small pushdown automaton folded over the brackets, quotes and backslashes finds the regions: from
a bracket to the one that closes it, counting only brackets of its kind and none inside strings; a
region that never closes ends the search. The whole text and a fenced block come before the regions. Of all that is
JSON, the first that yields a row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The metrics that can be measured again (by their names in documents), and lengths.
METRICS = ["cacheHitRatio", "reworkRatio", "thinkToCodeRatio", "contextBloatShare", "coldRestartShare", "premiumWasteShare", "retryShare", "toolResultCarryShare", "floorShare", "abandonedShare"]
TITLE, RATIONALE = 120, 400
FENCE = r"(?is)```(?:json)?\s*(.*?)```"

_STATE = "struct<at:int, open:string, depth:int, quoted:boolean, escaped:boolean, start:int, spans:array<struct<a:int, b:int>>>"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def regions(text: Column) -> Column:
    """The balanced regions of a text, from left to right."""
    # The text in pieces that end at a character that matters, the last one at the end of the text; i is the number of characters before that one.
    pieces = F.transform(F.regexp_extract_all(text, F.lit(r'([^\[\]{}"\\]*+(?:[\[\]{}"\\]|\z))'), 1), lambda p: F.struct(F.substring(p, -1, 1).alias("c"), F.length(p).alias("n")))
    nothing = F.from_json(F.lit('{"at":0,"open":"","depth":0,"quoted":false,"escaped":false,"start":0,"spans":[]}'), _STATE)

    def step(s: Column, piece: Column) -> Column:
        c, n = piece["c"], piece["n"]
        i = s["at"] + n - 1
        outside = s["open"] == ""
        # Only the character right after a backslash is escaped.
        escaped = s["escaped"] & (n == 1)
        opens = outside & c.isin("[", "{")
        # What holds inside a region; in strings only a quote that isn't escaped matters.
        plain = ~outside & ~s["quoted"]
        deeper = plain & (c == s["open"])
        closes = plain & (c == F.when(s["open"] == "{", "}").otherwise("]"))
        depth = F.when(opens, 1).when(deeper, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"])
        ends = closes & (s["depth"] == 1)
        quote = ~outside & (c == '"') & ~escaped
        return F.struct(
            (i + 1).alias("at"),
            F.when(opens, c).when(ends, "").otherwise(s["open"]).alias("open"),
            depth.cast("int").alias("depth"),
            F.when(quote, ~s["quoted"]).otherwise(s["quoted"] & ~outside).alias("quoted"),
            (s["quoted"] & ~escaped & (c == "\\")).alias("escaped"),
            F.when(opens, i).otherwise(s["start"]).alias("start"),
            F.when(ends, F.array_append(s["spans"], F.struct(s["start"].alias("a"), i.alias("b")))).otherwise(s["spans"]).alias("spans"),
        )

    spans = F.aggregate(pieces, nothing, step, lambda s: s["spans"])
    return F.transform(spans, lambda p: F.substring(text, p["a"] + 1, p["b"] - p["a"] + 1))


def candidates(text: Column) -> Column:
    """Texts that may be the JSON asked for, in the order in which they are tried."""
    fenced = F.array(trimmed(F.regexp_extract(text, FENCE, 1)))

    # Only arrays and objects can hold items, and these are one region from end to end.
    def tried(found: Column) -> Column:
        whole = F.filter(F.array(trimmed(text)), lambda c: F.get(found, F.lit(0)).eqNullSafe(c))
        return F.concat(whole, F.filter(fenced, lambda c: F.get(regions(c), F.lit(0)).eqNullSafe(c)), found)

    # Bound once: the regions are used twice.
    return F.get(F.transform(F.array(regions(text)), tried), F.lit(0))


def checked(responses: DataFrame) -> DataFrame:
    """responses: (id, text). One row for each item of the candidate that counts: id, place, metric, title, rationale, kept.

    Of a response none of whose candidates yields a row, the last one with items stands, all of them dropped.
    Responses compress well, so that few tasks may read them: they are spread by id, which the windows need anyway.
    """
    n = int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = responses.repartition(n, "id").select("id", F.posexplode(candidates(F.coalesce("text", F.lit("")))).alias("candidate", "json")).withColumn("json", F.try_parse_json("json"))
    # An array, or the array that an object has under "interventions".
    items = F.coalesce(F.try_variant_get("json", "$", "array<variant>"), F.try_variant_get("json", "$.interventions", "array<variant>"))
    c = c.select("id", "candidate", F.posexplode(items).alias("place", "item"))
    said = lambda name: F.coalesce(F.try_variant_get("item", f"$.{name}", "string"), F.lit(""))
    c = c.select("id", "candidate", "place", said("metric").alias("metric"), F.substring(trimmed(said("title")), 1, TITLE).alias("title"), F.substring(trimmed(said("rationale")), 1, RATIONALE).alias("rationale"))
    valid = F.col("metric").isin(METRICS) & (F.col("title") != "")
    nth = F.row_number().over(Window.partitionBy("id", "candidate", "metric", valid).orderBy("place"))
    c = c.withColumn("kept", valid & (nth == 1))
    one = Window.partitionBy("id")
    c = c.withColumns({"first": F.min(F.when(F.col("kept"), F.col("candidate"))).over(one), "last": F.max("candidate").over(one)})
    return c.filter(F.col("candidate") == F.coalesce("first", "last")).drop("candidate", "first", "last")


def parse_interventions(responses: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(id, place, metric, title, rationale) of the rows that hold. items: what checked() found in the responses, if at hand."""
    return (checked(responses) if items is None else items).filter("kept").drop("kept")


def dropped_interventions(responses: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(id, dropped): how many items of each response were turned down. items: as above."""
    found = (checked(responses) if items is None else items).groupBy("id").agg(F.count(F.when(~F.col("kept"), 1)).alias("dropped"))
    return responses.select("id").join(found, "id", "left").fillna(0, ["dropped"])
