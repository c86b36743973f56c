"""Benchmark decontamination with DataFrame functions only.

Test items become windows of 8 normalised words (an item of fewer is one window).  Any 2s-1 consecutive
words hold a block of s words that begins at a multiple of s, so a text is first probed with one
hashed block every s words against a broadcast set of the blocks of all test windows.  Only texts with
such a seed are cut into all their windows, which are joined with the test windows by their
very words; hits are therefore verified, not hashed guesses.  A window set beyond ``BROADCAST_ROWS`` is shuffled instead of broadcast.

Nulls have no words.  Items without words or with a null id are never found.  Repeated documents get equal rows; a row is
known by its id and its text, so ids may repeat or be null.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CASED_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: At about 100 bytes a row the broadcast stays under 200 MB; beyond it both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _windows(w: Column, size: int) -> Column:
    """The words of each window of ``size`` words, joined by a space."""
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.array_join(F.slice(w, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def _block(w: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(w, at + k) for k in range(size)])


def _blocks(w: Column, size: int) -> Column:
    """The block of ``size`` words at each multiple of ``size``."""
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size, F.lit(size)), lambda i: _block(w, i, size)))


def _numbered(w: Column, size: int) -> Column:
    return F.transform(_windows(w, size), lambda x, i: F.struct(F.lit(size).alias("size"), i.alias("at"), x.alias("gram")))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document with hits: id, text_hash, hit (word positions in order) and items (ids as sorted strings)."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w")).where(F.size("w") > 0)
    tests = (
        items.select("item", F.least(F.size("w"), F.lit(WINDOW)).alias("size"), "w")
        .select("item", "size", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("size")), lambda i: F.slice(F.col("w"), i + 1, F.col("size")))).alias("t"))
        .groupBy("size", F.array_join("t", " ").alias("gram"))
        .agg(F.collect_set("item").alias("found"), F.first("t").alias("t"))
    )
    per_size = {r["size"]: r["n"] for r in tests.groupBy("size").agg(F.count("*").alias("n")).collect()}
    small = sum(per_size.values()) <= BROADCAST_ROWS
    send = F.broadcast if small else lambda x: x
    key = [F.col(id_col).alias("k"), F.xxhash64(text_col).alias("h")]
    seeded = None
    for s in sorted({(n + 1) // 2 for n in per_size}):
        of_size = tests.where((F.floor((F.col("size") + 1) / 2)) == s)
        seeds = of_size.select(F.explode(F.array(*[_block(F.col("t"), F.lit(d), s) for d in range(s)])).alias("seed"), "size").where(F.col("seed").isNotNull()).select("seed").distinct()
        w = F.col("w")
        blocks = _blocks(w, s)
        probed = docs.select(*key, words(F.col(text_col)).alias("w")).select("k", "h", F.explode(blocks).alias("seed")).join(send(seeds), "seed", "left_semi").select("k", "h")
        seeded = probed if seeded is None else seeded.unionAll(probed)
    own = docs.select(*key, F.col(text_col).alias("t")).dropDuplicates(["k", "h"]) if seeded is None else None
    if seeded is None:
        found = own.where(F.lit(False)).select("k", "h", F.lit(0).alias("at"), F.lit(0).alias("size"), F.array(F.lit("")).alias("found"))
    else:
        seeded = seeded.distinct().select(F.col("k").alias("sk"), F.col("h").alias("sh"))
        texts = docs.select(*key, F.col(text_col).alias("t"))
        texts = texts.join(seeded, F.col("k").eqNullSafe(F.col("sk")) & (F.col("h") == F.col("sh")), "left_semi").select("k", "h", words(F.col("t")).alias("w"))
        cut = F.flatten(F.array(*[_numbered(F.col("w"), n) for n in sorted(per_size)]))
        found = texts.select("k", "h", F.explode(cut).alias("x")).select("k", "h", "x.*").join(send(tests.select("size", "gram", "found")), ["size", "gram"])
    return (
        found.groupBy("k", "h")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1))))).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("items"),
        )
        .select(F.col("k").alias(id_col), F.col("h").alias("text_hash"), "hit", "items")
    )


def _with_hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, columns: list[Column], **names: str) -> DataFrame:
    """The given columns of every row, and its hits (null without any)."""
    h = hits(docs, benchmark, id_col, text_col, **names).select(F.col(id_col).alias("found_k"), F.col("text_hash").alias("found_h"), F.col("hit").alias("found_hit"), F.col("items").alias("found_items"))
    left = docs.select(*columns, F.col(id_col).alias("own_k"), F.xxhash64(text_col).alias("own_h"))
    return left.join(h, F.col("own_k").eqNullSafe(F.col("found_k")) & (F.col("own_h") == F.col("found_h")), "left")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_items: int = 2, **names: str) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(CASED_WORDS)), F.lit(0)).cast("long")
    out = _with_hits(docs, benchmark, id_col, text_col, [F.col(id_col).alias(id_col), n_words.alias("n_words")], **names)
    n_items = F.when(F.col("found_items").isNull(), F.lit(0)).otherwise(F.size("found_items")).cast("long")
    return out.select(
        id_col,
        "n_words",
        F.when(F.col("found_hit").isNull(), F.lit(0)).otherwise(F.size("found_hit")).cast("long").alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.coalesce(F.array_join("found_items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_items >= min_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", min_items: int = 2, **names: str) -> DataFrame:
    """``docs`` without the documents that hold windows of at least ``min_items`` items, or (``remove="spans"``) with the hit words taken out of them.

    A text that loses words becomes its other words joined by one space; all others stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is {remove!r}; it must be documents or spans")
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    out = _with_hits(docs, benchmark, id_col, text_col, inner, **names)
    bad = F.coalesce(F.size("found_items") >= min_items, F.lit(False)) & F.col("found_items").isNotNull()
    if remove == "documents":
        return out.where(~bad).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
    t = docs.columns.index(text_col)
    kept = F.filter(F.array_remove(F.split(F.col(f"c{t}"), CASED_SEPARATORS), ""), lambda x, i: ~F.array_contains(F.col("found_hit"), i))
    return out.select(*[(F.when(bad, F.array_join(kept, " ")).otherwise(F.col(f"c{i}")) if i == t else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, least(len(w), 8) AS size, w, unnest(range(len(w) - least(len(w), 8) + 1)) AS pos FROM b WHERE len(w) > 0),
t AS (SELECT DISTINCT size, array_to_string(w[pos + 1:pos + size], ' ') AS gram, CAST(item_id AS VARCHAR) AS item FROM bi),
s AS (SELECT DISTINCT size FROM t),
di AS (SELECT doc_id, size, w, unnest(range(len(w) - size + 1)) AS pos FROM d, s WHERE len(w) >= size),
g AS (SELECT doc_id, size, pos, array_to_string(w[pos + 1:pos + size], ' ') AS gram FROM di),
x AS (SELECT doc_id, g.size, pos, item FROM g JOIN t ON g.size = t.size AND g.gram = t.gram),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM x) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""
