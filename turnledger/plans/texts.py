"""Queries over texts: redaction, keywords, similarity and relays, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import similarity as S
from .core import rounded

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.concat(F.lit("d"), "doc_id").alias("session_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("doc_id").cast("int"))).alias("ts"), "text", "source")


def prompts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'user'")
    return c.select(F.concat(F.lit("c"), "conv_id").alias("item"), "text")


def add(name: str, query, oracle: str | None, table=documents) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(table(spark, sf_dir)))
    if oracle:
        ORACLE_SQL[name] = oracle


def _redact(x: str) -> str:
    r"""The same replacements for RE2: the patterns use nothing that it lacks."""
    for pattern in X.REDACTIONS:
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    return x


TOKENS = f"""tk AS (
  SELECT id, regexp_replace(raw, '^[.+#]+|[.+#]+$', '', 'g') AS term FROM (SELECT id, unnest(regexp_split_to_array(lower({_redact('text')}), '[^a-z0-9+#.]+')) AS raw FROM src)),
ok AS (
  SELECT id, term FROM tk WHERE length(term) BETWEEN 3 AND 30 AND term NOT IN ({', '.join(f"'{w}'" for w in X.STOP_WORDS)}) AND NOT regexp_full_match(term, '[0-9]+')
    AND NOT (length(term) >= 12 AND regexp_matches(term, '[a-z]') AND regexp_matches(term, '[0-9]')) AND NOT (length(term) >= 8 AND regexp_full_match(term, '[0-9a-f]+') AND regexp_matches(term, '[0-9]'))),
cnt AS (SELECT id, term, count(*) AS n FROM ok GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS r FROM cnt),
fp AS (SELECT id, list(term ORDER BY r) AS terms FROM rk WHERE r <= 8 GROUP BY 1)
"""
DOCS = "WITH src AS (SELECT doc_id AS id, text FROM documents), " + TOKENS
PROMPTS = "WITH src AS (SELECT 'c' || conv_id AS id, text FROM conversations WHERE role = 'user'), " + TOKENS

add("redact_text", lambda d: d.select("doc_id", F.md5(X.redact_text(F.col("text"))).alias("redacted_md5")), f"SELECT doc_id, md5({_redact('text')}) AS redacted_md5 FROM documents")
add(
    "tokenize_text",
    # Texts go to their document's task, so that words needn't; the number keeps small texts from being put together.
    lambda d: d.select("doc_id", "text").repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").select("doc_id", F.explode(X.tokenize_text(F.col("text"))).alias("term")).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.countDistinct("term").alias("distinct_tokens")),
    DOCS + "SELECT id AS doc_id, count(*) AS tokens, count(DISTINCT term) AS distinct_tokens FROM ok GROUP BY 1",
)
add(
    "fingerprint_terms",
    lambda p: X.fingerprint_terms(p, "item", "text").select("item", F.array_join("terms", " ").alias("terms"), X.label_of(F.col("terms")).alias("label")),
    PROMPTS + "SELECT id AS item, array_to_string(terms, ' ') AS terms, array_to_string(terms[1:3], ' ') AS label FROM fp",
    prompts,
)
add(
    "fnv1a_hex",
    lambda d: d.select(X.fnv1a_hex(F.col("source")).alias("h"), "source").distinct(),
    """WITH RECURSIVE src AS (SELECT DISTINCT source FROM documents),
    f AS (SELECT source, 0 AS i, 2166136261::HUGEINT AS h FROM src UNION ALL SELECT source, i + 1, xor(h, ascii(source[i + 1])::HUGEINT) * 16777619 % 4294967296 FROM f WHERE i < length(source))
    SELECT lpad(lower(to_hex(h::BIGINT)), 8, '0') AS h, source FROM f WHERE i = length(source) OR (source IS NULL AND i = 0)""",
)
add(
    "word_list",
    lambda d: d.select("doc_id", F.size(X.word_list(F.col("text"))).cast("long").alias("words")),
    r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS words FROM documents",
)
RAW = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 7], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)
"""
W = RAW.replace("lower(text)", f"lower({_redact('text')})")
add("shingles", lambda d: d.select("doc_id", F.size(X.shingles(X.word_list(F.col("text")))).cast("long").alias("n")).filter("n > 0"), f"WITH {RAW} SELECT * FROM n")
add(
    "output_shingles",
    lambda d: S.output_shingles(d).groupBy("session_id").agg(F.count("*").alias("n"), F.max("last_ts").alias("last_ts")),
    f"WITH {W} SELECT 'd' || doc_id AS session_id, n, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS last_ts FROM n",
)
RELAYS = f"""{W}, h AS (
  SELECT x.doc_id AS m, y.doc_id AS f, count(*) AS hit FROM s x JOIN s y ON x.sh = y.sh AND y.doc_id < x.doc_id AND x.doc_id - y.doc_id <= {14 * 1440} JOIN n ON n.doc_id = x.doc_id AND n.n >= 24 GROUP BY 1, 2),
b AS (SELECT m, f, hit / n.n::DOUBLE AS overlap, row_number() OVER (PARTITION BY m ORDER BY hit / n.n::DOUBLE DESC, f) AS r FROM h JOIN n ON n.doc_id = m WHERE hit / n.n::DOUBLE >= 0.35),
rel AS (SELECT m, f, overlap, len(ws) AS words FROM b JOIN w ON w.doc_id = m WHERE r = 1)
"""


def relays(d):
    return S.detect_relays(d.withColumnRenamed("doc_id", "message_id"), d)


add(
    "detect_relays",
    relays,
    f"WITH {RELAYS} SELECT m AS message_id, 'd' || m AS to_session, 'd' || f AS from_session, round(overlap, 6) AS overlap, words::INTEGER AS words, round((m - f) / 1440.0)::BIGINT AS gap_days FROM rel",
)
add(
    "relay_summary",
    lambda d: S.relay_summary(relays(d), d),
    f"WITH {RELAYS} SELECT count(*) AS pairs, sum(words)::BIGINT AS words, count(DISTINCT m) AS sessions, (SELECT sum(len(ws))::BIGINT FROM w) AS prompt_words, round(sum(words) / (SELECT sum(len(ws)) FROM w)::DOUBLE, 6) AS share FROM rel",
)


def document_turns(d):
    """One turn per document: its length as input, the model by its number."""
    zero = F.lit(0).cast("long")
    model = F.when(F.col("doc_id") % 2 == 0, "claude-opus-4-7").otherwise("claude-haiku-4-5")
    return d.select(
        "source", F.col("doc_id").cast("string").alias("event_key"), "session_id", F.lit("p").alias("project"), "ts", model.alias("model"), (F.length("text").cast("long") % 2000).alias("input_tokens"), zero.alias("output_tokens"), zero.alias("cache_read_tokens"),
        zero.alias("cache_creation_tokens"), zero.alias("cache_creation_1h_tokens"), zero.alias("thinking_tokens"), F.array().cast("array<string>").alias("tools"), F.lit(None).cast("map<string,bigint>").alias("tool_result_chars"), F.lit(False).alias("is_error"),
        F.lit(False).alias("is_sidechain"), F.lit(None).cast("string").alias("parent_session_id"), F.lit("coding").alias("activity"),
    )


add(
    "relay_cost",
    lambda d: S.relay_cost(relays(d), document_turns(d)).select("to_session", "relay_usd"),
    f"""WITH {RELAYS}, i AS (SELECT doc_id, length(text) % 2000 AS input, CASE WHEN doc_id % 2 = 0 THEN 5.0 ELSE 1.0 END::DOUBLE AS price FROM documents)
    SELECT 'd' || m AS to_session, round(least(input, words * 1.3::DOUBLE) * (input * price / 1e6) / input, 8) AS relay_usd FROM rel JOIN i ON i.doc_id = m WHERE input > 0""",
)
add(
    "prompt_messages",
    lambda d: S.prompt_messages(d.union(d)).select("doc_id", F.length("text").cast("long").alias("n_chars")),
    f"SELECT doc_id, length({_redact('text')}) AS n_chars FROM documents WHERE trim(text) <> ''",
)


def prints(p):
    return X.fingerprint_terms(p, "item", "text")


IDF = """, ex AS (SELECT id, unnest(terms) AS term FROM fp), idf AS (SELECT term, count(DISTINCT id) AS df, ln(((SELECT count(*) FROM fp) + 1) / (count(DISTINCT id) + 1.0::DOUBLE)) + 1 AS idf FROM ex GROUP BY 1)
"""
add("term_idf", lambda p: S.term_idf(prints(p)), PROMPTS + IDF + "SELECT term, df, round(idf, 6) AS idf FROM idf", prompts)
add(
    "similar_sessions",
    lambda p: S.similar_sessions(prints(p)),
    PROMPTS + IDF + """, nv AS (SELECT id, sqrt(sum(idf * idf)) AS norm FROM ex JOIN idf USING (term) GROUP BY 1),
    reps AS (SELECT min(id) AS id FROM (SELECT id, list_sort(terms) AS k FROM fp) GROUP BY k),
    v AS (SELECT id, term, idf / norm AS w FROM ex JOIN idf USING (term) JOIN nv USING (id) JOIN reps USING (id))
    SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 6) AS similarity FROM v x JOIN v y ON x.term = y.term AND x.id < y.id GROUP BY 1, 2 HAVING round(sum(x.w * y.w), 12) >= 0.4""",
    prompts,
)
