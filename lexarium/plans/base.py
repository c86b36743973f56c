"""What the registered queries share: transliterated documents on one side, the same as SQL on the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.config import Normalizer
from lexarium.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOW = Normalizer()


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its counterpart."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the transliterated text."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", T.transliterate(F.col("text")).alias("text"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def named(df: DataFrame, columns: dict[str, Column], *keep: str) -> DataFrame:
    return rounded(df.select(*keep, *[c.alias(k) for k, c in columns.items()]))


TEXT = f"translate(lower(text), '{T.LATIN}', '{T.CYRILLIC}')"
DOCS = f"d AS (SELECT doc_id, lang, source, {TEXT} AS t FROM documents)"
WORDS = r"w AS (SELECT doc_id, lang, source, t, regexp_extract_all(regexp_replace(regexp_replace(t, '([а-яё]+)\[([а-яё]+)\]([а-яё]*)', '\1\2\3', 'g'), '([а-яё]+)<([а-яё]+)>([а-яё]*)', '\1\2\3', 'g'), '[а-яё]+') AS w FROM d)"
TOKENS = "k AS (SELECT doc_id, lang, source, t, w, list_filter(w, lambda x: x[1] NOT IN ('ъ', 'ь')) AS k, translate(array_to_string(w, ''), 'ёйъь', 'еи') AS letters FROM w)"
BASE = f"{DOCS}, {WORDS}, {TOKENS}"
LETTER_COUNTS = "c AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(string_split(letters, '')) AS x FROM k WHERE letters <> '') GROUP BY doc_id, x)"
ROWS = "rows AS (SELECT doc_id, n, p - 1 AS pos, k[p] AS token FROM (SELECT doc_id, k, len(k) AS n, unnest(range(1, len(k) + 1)) AS p FROM k))"
ITEMS = "i AS (SELECT doc_id, token, count(*) AS n, min(pos) AS first_pos, any_value(n) AS n_tokens FROM rows GROUP BY doc_id, token)"
GAPS = "g AS (SELECT * FROM (SELECT doc_id, token, pos, pos - lag(pos) OVER (PARTITION BY doc_id, token ORDER BY pos) AS gap, count(*) OVER (PARTITION BY doc_id, token) AS n, min(pos) OVER (PARTITION BY doc_id, token) AS first_pos FROM rows) WHERE gap IS NOT NULL)"
#: Entropy in bits of the counts n of a group.
H = "(log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n))"
