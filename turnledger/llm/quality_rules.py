"""Quality rules as a short-circuit cascade, in Spark SQL functions only.

A rule is a column that says whether a text is rejected. The counts that all rows need are
computed first; what only one rule needs stands in that rule. On a bounded sample of rows that
pass the base the share that each rule rejects is measured, and what it costs a row: each rule
is evaluated many times over the sample, and the time of an empty rule is taken off. Rules then
stand in a CASE in falling order of rejection per cost, so a row that an early rule rejects
never has the later ones evaluated. The order changes the cost only: the verdict is the same
in any order.

Defined results: a null text is empty, has no words and fails the base rules. Rows are
independent, so null ids, ties, repeated rows and further columns have no effect. An empty
table gives no rows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: The word separators of the contract, as a regular expression class.
SPACES = r"\x20\x09-\x0D"
TRIMMED = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 5  # of the characters in words
MAX_UPPER_PERCENT = 40  # of the characters in words
MAX_DUP_LINE_PERCENT = 40  # of the lines with a word
MAX_MEAN_WORD = 15
MAX_BULLET_PERCENT = 90  # of the lines with a word
MAX_ELLIPSIS_PERCENT = 30  # of the lines with a word
MAX_BARE_PERCENT = 50  # of the words: those without a letter
#: Rows in the sample that costs and selectivities are measured on (expected number).
SAMPLE_ROWS = 1000
#: Evaluations of a rule over each row of the sample, and how often they are timed.
REPEATS, TIMINGS = 10, 2


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id, _text, _lines (those with a word) and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated words: the hashes of all three-word windows are sorted with their places; a
    window next to an equal one is repeated, and the words under such windows are counted
    from the gaps between their places. Texts without a repeated window skip the sort.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    df = df.withColumn("_trim", F.trim(F.col("_text"), F.lit(TRIMMED)))
    df = df.select(
        "doc_id",
        "_text",
        F.when(F.length("_trim") == 0, F.array().cast("array<string>")).otherwise(F.split("_trim", f"[{SPACES}]+")).alias("_w"),
        F.filter(F.split("_text", "\n"), lambda x: F.length(F.trim(x, F.lit(TRIMMED))) > 0).alias("_lines"),
        (F.length("_text") - F.regexp_count("_text", F.lit(f"[{SPACES}]"))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    df = df.select(
        "doc_id",
        "_text",
        "_lines",
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    ranked = F.when(some, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    kept = [c for c in df.columns if c != "_h"]
    df = df.select(*kept, ranked.alias("_r"))
    repeated = F.transform(
        F.sequence(F.lit(0), F.size("_r") - 1),
        lambda k: F.when((F.get("_r", k)["h"] == F.get("_r", k - 1)["h"]) | (F.get("_r", k)["h"] == F.get("_r", k + 1)["h"]), F.get("_r", k)["i"]),
    )
    df = df.select(*kept, F.when(F.size("_r") > 0, F.sort_array(F.array_compact(repeated))).otherwise(F.array().cast("array<int>")).alias("_p"))
    covered = F.aggregate(
        F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    return df.select(*kept, covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _more_lines(percent: int, pattern: str) -> Column:
    """Whether more than so many percent of the lines with a word match."""
    state = F.aggregate("_lines", F.lit(0), lambda n, x: n + F.when(x.rlike(pattern), 100 - percent).otherwise(-percent))
    return state > 0


def default_rules() -> list[Rule]:
    """The rules after the base; each is over the columns of with_features()."""
    return [
        Rule("symbols", 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")),
        Rule("upper_case", 100 * F.regexp_count("_text", F.lit(r"\p{Lu}")) > MAX_UPPER_PERCENT * F.col("word_chars")),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.size("_lines")),
        Rule("long_words", F.col("word_chars") > MAX_MEAN_WORD * F.col("n_words")),
        Rule("bullets", _more_lines(MAX_BULLET_PERCENT, rf"^[{SPACES}]*[-*\x{{2022}}\x{{25CF}}]")),
        Rule("ellipses", _more_lines(MAX_ELLIPSIS_PERCENT, rf"(\.\.\.|\x{{2026}})[{SPACES}]*$")),
        Rule("no_letters", 100 * F.regexp_count("_text", F.lit(rf"(?<![^{SPACES}])[^{SPACES}A-Za-z\x{{80}}-\x{{10FFFF}}]++(?![^{SPACES}])")) > MAX_BARE_PERCENT * F.col("n_words")),
    ]


def measure(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, share of the sample that it rejects, seconds for one evaluation over the sample)."""
    many = sample.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(rejects: Column) -> tuple[float, float]:
        share, best = 0.0, float("inf")
        for _ in range(TIMINGS):
            began = time.perf_counter()
            share = many.agg(F.avg(F.coalesce(rejects, F.lit(False)).cast("int"))).first()[0] or 0.0
            best = min(best, time.perf_counter() - began)
        return float(share), best

    # An empty rule takes what starting a job and reading the sample's texts take.
    _, idle = seconds(F.length("_text") + F.col("_turn") + F.col("n_words") < 0)
    found = [(rule, *seconds(rule.rejects)) for rule in rules]
    return [(rule, share, max(cost - idle, 1e-4) / REPEATS) for rule, share, cost in found]


def order_rules(measured: list[tuple[Rule, float, float]]) -> list[Rule]:
    """By rejection per cost, highest first."""
    return [r for r, share, cost in sorted(measured, key=lambda m: -m[1] / max(m[2], 1e-9))]


def verdict(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null; later rules aren't evaluated for that row."""
    case = F
    for rule in rules:
        case = case.when(rule.rejects, F.lit(rule.name))
    return case.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """with_features() and base_failed, rejected_by (null: none), kept."""
    rules = default_rules() if rules is None else rules
    n = docs.count()
    sample = docs.select("doc_id", "text")
    if n > sample_rows:
        sample = sample.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    # Timed over all cores, as far as there are rows for them.
    sample = sample.repartition(max(1, min(docs.sparkSession.sparkContext.defaultParallelism, sample_rows // 50)))
    ordered = order_rules(measure(durable(with_features(sample)).filter(~base_failed()), rules)) if len(rules) > 1 else rules
    out = with_features(docs).withColumn("base_failed", base_failed())
    return out.withColumn("rejected_by", F.when(~F.col("base_failed"), verdict(ordered))).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("_lines")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op4_quality_rules": op4_quality_rules}

ORACLE_SQL = {
    "op4_quality_rules": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, i AS p FROM rep UNION ALL SELECT doc_id, i + 1 FROM rep UNION ALL SELECT doc_id, i + 2 FROM rep) GROUP BY doc_id),
f AS (
  SELECT t.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
    length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    length(regexp_replace(x, '[^\p{Lu}]', '', 'g')) AS n_upper,
    len(list_filter(ls, lambda v: regexp_matches(v, '^[\x20\x09-\x0D]*[-*\x{2022}\x{25CF}]'))) AS n_bullets,
    len(list_filter(ls, lambda v: regexp_matches(v, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) AS n_dots,
    len(list_filter(w, lambda v: NOT regexp_matches(v, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_bare
  FROM t LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 5 * word_chars) AND NOT (100 * n_upper > 40 * word_chars)
    AND NOT (100 * n_dup_lines > 40 * n_lines) AND NOT (word_chars > 15 * n_words)
    AND NOT (100 * n_bullets > 90 * n_lines) AND NOT (100 * n_dots > 30 * n_lines) AND NOT (100 * n_bare > 50 * n_words) AS kept
FROM b
""",
}
