"""Redaction, keywords and shingles of texts as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What redaction removes, in this order; structured spans before generic runs. ASCII classes throughout.
REDACTIONS = [
    r"-----BEGIN[\s\S]*?-----END[^-]*-----",
    r"(?i)\b[a-z][a-z0-9+.-]*://\S+",
    r"(?i)\bwww\.\S+",
    r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    r"(?i)\b(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret|credential|auth|bearer)s?\s*[:=]\s*\S+",
    r"\beyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    r"(?i)\b(?:sk|pk|rk|ghp|gho|ghs|github_pat|xox[baprs]|AKIA|ASIA|AIza|ya29|Bearer)[-_A-Za-z0-9]{6,}\b",
    r"\b[A-Za-z0-9+/]{20,}={0,2}\b",
    r"(?:[A-Za-z]:)?(?:[\\/][\w.+-]+){2,}[\\/]?",
    r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    r"(?i)\b(?:[0-9a-f]{0,4}:){2,}[0-9a-f]{0,4}\b",
    r"(?i)\b[0-9a-f]{16,}\b",
    r"\b\d{7,}\b",
]
#: Java's word boundary follows Unicode; this one is between ASCII word characters and all others.
ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
# Words that are no keywords.
STOP_WORDS = (
    "the a an and or but if then else for to of in on at by with from into as is are was were be been being do does did done can could should would will shall may might "
    "must i we you it this that these those my our your its me us please want wants need needs make makes use using used add adds added adding get gets got set help let lets "
    "also so not no yes have has had here there what which when where how why all any some more most very just like about up down out over than too one two now via per etc eg ie "
    "currently currentl able"
).split()
FINGERPRINT_TERMS = 8
SHINGLE_WORDS = 8


#: For each pattern something that any match holds; texts without it are passed on as they are.
_NEEDS = ["-----BEGIN", "://", r"(?i)www\.", "@", r"[:=]", "eyJ", r"(?i)(?<!\w)[sprgxayb](?:[kh]|ox|it|[ks]ia|iza|a29|earer)[-_A-Za-z0-9]{6}", "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20}", r"[\\/]", r"(?i)[0-9a-f]{8}-", r"\d\.\d", ":[0-9a-fA-F]{0,4}:", "(?i)[0-9a-f]{16}", r"\d{7}"]


def _java(pattern: str) -> str:
    """The pattern with ASCII boundaries; before a word character a look behind is enough, after one a look ahead."""
    if re.match(r"(\(\?i\))?\\b(\(\?:)?(\[a-z\]|\[0-9a-f\]\{8|\[0-9a-f\]\{16|\\d|www|eyJ|pass|sk)", pattern):
        pattern = pattern.replace(r"\b", r"(?<!\w)", 1)
    if pattern.endswith((r"{12}\b", r"{3}\b", r"{16,}\b", r"{7,}\b")):
        pattern = pattern[:-2] + r"(?!\w)"
    return pattern.replace(r"\b", ASCII_BOUNDARY)


def _step(need: str, pattern: str):
    return lambda x: F.when(x.rlike(need), F.regexp_replace(x, pattern, " ")).otherwise(x)


def redact_text(text: Column) -> Column:
    for need, pattern in zip(_NEEDS, REDACTIONS):
        # Bound once, so that a step does not repeat all steps before it.
        text = F.get(F.transform(F.array(text), _step(need, _java(pattern))), F.lit(0))
    return text


def tokenize_text(text: Column) -> Column:
    """Lower-case keywords in order: no stop words, short or long words, numbers or key-like runs."""
    # Marks at a word's ends go with what parts words; spaces put the text's own ends on the same footing.
    raw = F.split(F.concat(F.lit(" "), F.lower(redact_text(text)), F.lit(" ")), r"(?<![.+#])[.+#]*+[^a-z0-9+#.][^a-z0-9]*+")

    def keep(x: Column) -> Column:
        key_like = ((F.length(x) >= 12) & x.rlike("[a-z]") & x.rlike("[0-9]")) | ((F.length(x) >= 8) & x.rlike("^[0-9a-f]+$") & x.rlike("[0-9]"))
        # The pattern of numbers is only tried on what begins with a digit.
        return F.length(x).between(3, 30) & ~x.isin(STOP_WORDS) & ~((x < ":") & x.rlike("^[0-9]+$")) & ~key_like

    return F.filter(raw, keep)


def fingerprint_terms(items: DataFrame, id_column: str, text_column: str, k: int = FINGERPRINT_TERMS) -> DataFrame:
    """(id, terms): the k most frequent keywords of each item, ties by the alphabet."""
    t = items.select(id_column, F.explode(tokenize_text(F.col(text_column))).alias("term")).groupBy(id_column, "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy(id_column).orderBy(F.desc("n"), "term")
    top = t.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("r", "term")))
    return top.groupBy(id_column).agg(F.transform(ordered, lambda x: x["term"]).alias("terms"))


def label_of(terms: Column) -> Column:
    """The first three terms, or misc."""
    return F.coalesce(F.nullif(F.array_join(F.slice(terms, 1, 3), " "), F.lit("")), F.lit("misc"))


def fnv1a_hex(text: Column) -> Column:
    """32-bit FNV-1a of the characters' codes as eight hex digits."""
    h = F.aggregate(F.split(text, ""), F.lit(2166136261).cast("long"), lambda a, c: (a.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.lpad(F.hex(F.when(F.length(text) > 0, h).otherwise(F.lit(2166136261).cast("long"))), 8, "0"))


def word_list(text: Column) -> Column:
    """Lower-case words of a-z and 0-9."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def shingles(words: Column, n: int = SHINGLE_WORDS) -> Column:
    """Distinct windows of n words, as 64-bit hashes of their words' hashes."""

    def windows(w: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(F.size(w) >= n, F.array_distinct(all_)).otherwise(F.array().cast("array<bigint>"))

    # Bound once: inside a lambda the words would be split anew for every window.
    return F.get(F.transform(F.array(F.transform(words, lambda x: F.xxhash64(x))), windows), F.lit(0))
