"""Texts from files, directories, delimited files and JSON; tables and datasets to files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium import runtime
from lexarium.config import Normalizer
from lexarium.functions import text as T

SEGMENTS = "name string, label string, text string"


def _files(spark: SparkSession, path: str, pattern: str, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "content")


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt", recursive: bool = True, fallback: bool = True) -> DataFrame:
    """(name, path, text) of files in UTF-8; others are read as cp1251, or left out without ``fallback``."""
    raw = _files(spark, path, pattern, recursive)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    if not fallback:
        return raw.where(valid).select(name.alias("name"), "path", F.col("content").cast("string").alias("text"))
    runtime.prepare(spark)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for c in f["content"]:
                try:
                    texts.append(bytes(c).decode("utf-8"))
                except UnicodeDecodeError:
                    texts.append(bytes(c).decode("cp1251", "replace"))
            yield pd.DataFrame({"name": f["name"], "path": f["path"], "text": texts})

    return raw.select(name.alias("name"), "path", "content").mapInPandas(decode, "name string, path string, text string")


def from_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, name, text) of (name, text) pairs; anything else is an error."""
    for r in rows:
        if not (isinstance(r, tuple) and len(r) == 2 and all(isinstance(x, str) for x in r)):
            raise TypeError("each row must be a pair of name and text")
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "doc_id bigint, name string, text string")


def read_json_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).option("multiLine", "true").json(path)


def split_segments(df: DataFrame, delimiter: str = "***", least_words: int = 10, how: Normalizer | None = None, text_col: str = "text", auto_name: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stripped pieces between literal delimiters with at least ``least_words`` words, numbered anew within each text."""
    how = how or Normalizer()
    pieces = F.filter(F.transform(F.split(F.col(text_col), r"\Q" + delimiter + r"\E"), T.strip), lambda x: x != "")
    good = F.filter(pieces, lambda x: F.size(T.tokens(T.words(x, how), how)) >= least_words)
    out = df.select(*keep, F.posexplode(good).alias("pos", "text"))
    return out.select(*keep, (F.col("pos") + 1).alias("segment"), F.concat(F.lit("Segment " if auto_name else "Text "), (F.col("pos") + 1).cast("string")).alias("name"), "text")


def labelled_files(spark: SparkSession, path: str, delimiter: str = "======", least_chars: int = 30, pattern: str = "*.txt") -> DataFrame:
    """One file is one class: (label, name, text) of its pieces of more than ``least_chars`` characters."""
    files = read_texts(spark, path, pattern).withColumn("label", F.regexp_replace("name", r"\.[^.]*$", ""))
    parts = files.select("label", F.posexplode(F.filter(F.transform(F.split("text", r"\Q" + delimiter + r"\E"), T.strip), lambda x: F.length(x) > least_chars)).alias("pos", "text"))
    return parts.select("label", F.concat_ws("_", "label", F.col("pos").cast("string")).alias("name"), "text")


def make_dataset(segments: DataFrame, least_words: int, per_author: int, label_col: str = "label", order: str = "name") -> DataFrame:
    """Up to ``per_author`` segments of each author with enough space-separated words, in order, with a number for each author."""
    from pyspark.sql import Window

    enough = segments.where(F.size(F.filter(F.split(T.strip(T.join_brackets(F.col("text"))), T.SPACES + "+"), lambda x: x != "")) >= least_words)
    ranked = enough.withColumn("own_rank", F.row_number().over(Window.partitionBy(label_col).orderBy(order))).where(F.col("own_rank") <= per_author).drop("own_rank")
    authors = ranked.groupBy(label_col).agg(F.min(order).alias("own_first"))
    authors = authors.select(F.col(label_col).alias("own_label"), (F.row_number().over(Window.orderBy("own_first", label_col)) - 1).alias("author_id"))
    return ranked.join(F.broadcast(authors), F.col(label_col) == F.col("own_label")).drop("own_label")


def balance(dataset: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: texts, authors, smallest and largest class and their ratio; ``balanced`` from 0.8 on."""
    per = dataset.groupBy(label_col).agg(F.count("*").alias("n"))
    ratio = F.min("n") / F.max("n")
    return per.agg(F.sum("n").alias("texts"), F.count("*").alias("authors"), F.min("n").alias("least"), F.max("n").alias("most"), ratio.alias("ratio"), (ratio >= 0.8).alias("balanced"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_rows(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report table of a small result."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns)
    show = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    return f"# {title}\n\n{head}\n" + "".join("| " + " | ".join(show(v) for v in r) + " |\n" for r in rows)
