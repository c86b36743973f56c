"""Cleaning of digitised books: OCR repairs as column expressions, line rules as windows over numbered lines.

Lines are a table (file, line, text); a file's lines are ordered within the file only, so files are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.functions import text as T

# Beginnings of editors' notes.
NOTE_STARTS = ["Печатается по", "Датируется", "Впервые опубликовано", "Автограф", "Имеется", "В литературе", "Под заглавием", r"Стихи \d+", r"В \d+ году", "Строка.*исправляется", "Копия", "Черновой", "Некоторые стихи", "В этом стихотворении", "По словам", "Рядом с текстом", "Оно действительно", "Это показание", r"Стих \d+", r"Строки \d+", "В «Стихотворениях»", "В автографе", "Какая.*имеется в виду", r"листок\)\.", "оставляем первоначальное", "Следующие.*стихотворений", "В рукописи", r"В стихе \d+", "чтение стиха"]
SEPARATOR = "======"
LETTER = "а-яёА-ЯЁa-zA-Z"


def number_lines(files: DataFrame, file_col: str = "name", text_col: str = "text") -> DataFrame:
    return files.select(F.col(file_col).alias("file"), F.posexplode(F.split(F.col(text_col), T.LINE_BREAKS)).alias("line", "text"))


def fix_ocr(text: Column) -> Column:
    """Low quotes, bracketed parts of words, dashes and dots in angle brackets, missing spaces after quotes, short words in angle brackets; in this order."""
    out = F.replace(text, F.lit("„"), F.lit('"'))
    rules = [
        (rf"(?U)(\w)<([{LETTER}]+)>([\s\W]|$)", "$1$2$3"),
        (rf"(?U)(\w)<([{LETTER}]+)>(\w)", "$1$2$3"),
        ("<– >", "–"),
        (r"<\.{2,}>", "[...]"),
        (r'(?U)"([^"]*)"([^"\s])', '"$1" $2'),
        (rf'"([^"]+)"([{LETTER}])', '"$1" $2'),
        ("< – >", "–"),
        (r"<\s*([а-яёa-zA-Z][а-яёА-ЯЁa-zA-Z]{0,2})\s*>", "$1"),
    ]
    for pattern, replacement in rules:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement))
    return out


def normalize_title(title: Column) -> Column:
    return F.lower(T.strip(F.regexp_replace(F.regexp_replace(title, F.lit("<[^>]*>"), F.lit("")), F.lit(f"{T.SPACES}+"), F.lit(" "))))


def titles(toc: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Distinct normalised titles of a table of contents; a page number at the end of a line is dropped."""
    line = T.strip(F.col("text"))
    kept = toc.where(line != "")
    for pattern in skip:
        kept = kept.where(~line.rlike(pattern))
    return kept.select(normalize_title(F.regexp_replace(line, F.lit(r"^(.+?)\s+\d+$"), F.lit("$1"))).alias("title")).distinct()


def is_page_number(lines: DataFrame, header: str) -> DataFrame:
    """``lines`` with ``is_page``: a line of digits whose next line is the page header."""
    nxt = F.lead(T.strip(F.col("text"))).over(Window.partitionBy("file").orderBy("line"))
    return lines.withColumn("is_page", T.strip(F.col("text")).rlike(r"^\d+$") & F.coalesce(nxt == header, F.lit(False)))


def split_poems(lines: DataFrame, known: DataFrame, header: str) -> DataFrame:
    """(file, poem, text): a poem begins where a known title, other than the current one, follows a page header.

    Headers, page numbers and what comes before the first poem go; blank lines at the edges are trimmed.
    """
    w = Window.partitionBy("file").orderBy("line")
    t = is_page_number(lines, header).withColumn("t", T.strip(F.col("text")))
    t = t.where(~F.col("is_page")).withColumn("after_header", F.coalesce(F.lag("t").over(w) == header, F.lit(False)))
    t = t.where(F.col("t") != header).withColumn("title", normalize_title(F.col("t")))
    t = t.join(F.broadcast(known.select(F.col("title").alias("known_title"))), F.col("title") == F.col("known_title"), "left")
    t = t.withColumn("mark", F.when(F.col("known_title").isNotNull() & F.col("after_header"), F.col("title")))
    last = F.last("mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("start", (F.col("mark").isNotNull() & ~F.coalesce(F.col("mark") == last, F.lit(False))).cast("int"))
    t = t.withColumn("poem", F.sum("start").over(w)).where("poem > 0")
    rows = t.groupBy("file", "poem").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("x"))
    return rows.select("file", "poem", T.strip(F.array_join(F.col("x.text"), "\n")).alias("text"))


def is_editor_note(line: Column) -> Column:
    """A line that begins like an editor's note, or names an archive and holds its reference numbers."""
    s = T.strip(line)
    starts = s.rlike("(?iu)^(?:" + "|".join(NOTE_STARTS) + ")")
    archive = s.rlike(r"(?iu)(?:ГПБ|ИРЛИ|ЦГАЛИ|ГИМ|ЛБ)") & s.rlike(r"(?iu)(?:оп\.|№|л\.)\s*\d+")
    return F.coalesce((s != "") & (starts | archive), F.lit(False))


def remove_editor_notes(lines: DataFrame) -> DataFrame:
    """``lines`` without notes: a note lasts from its first line to the next blank line or separator."""
    w = Window.partitionBy("file").orderBy("line")
    s = T.strip(F.col("text"))
    t = lines.withColumn("stop", (s == "") | (s == SEPARATOR)).withColumn("note", is_editor_note(F.col("text")))
    t = t.withColumn("block", F.sum(F.col("stop").cast("int")).over(w))
    inside = F.max(F.col("note").cast("int")).over(Window.partitionBy("file", "block").orderBy("line")) == 1
    return t.withColumn("inside", inside & ~F.col("stop")).where(~F.col("inside")).select(*lines.columns)


def remove_footnotes(lines: DataFrame) -> DataFrame:
    """``lines`` without lines that are only a bracketed note or a footnote number (with the note after it); trailing language marks, words, references and numbers in brackets go."""
    w = Window.partitionBy("file").orderBy("line")
    s = T.strip(F.col("text"))
    alone, number = s.rlike(r"^\([^)]+\)$"), s.rlike(r"^\d+$")
    note = alone | s.rlike(r"^[А-ЯЁ][^а-яё]*\([а-яё]+\.\)$")
    t = lines.withColumn("gone", alone | number | (note & F.coalesce(F.lag(number).over(w), F.lit(False))))
    clean = F.col("text")
    for pattern in (r"\([а-яё]+\.\)\s*$", r"\([а-яё]+\)\s*$", r"\((?:см|прим)\.[^)]*\)?\s*$", r"\(\d+\)\s*$"):
        clean = F.regexp_replace(clean, F.lit(pattern), F.lit(""))
    return t.where(~F.col("gone")).withColumn("text", F.regexp_replace(clean, F.lit(r"\s+$"), F.lit(""))).select(*lines.columns)


def notes_pages(toc: DataFrame) -> DataFrame:
    """Page numbers of the notes sections that a table of contents lists."""
    return toc.select(F.regexp_extract(T.strip(F.col("text")), r"(?iu)^примечания.*?(\d+)$", 1).alias("page")).where("page <> ''").select(F.col("page").cast("int").alias("page"))


def join_lines(lines: DataFrame) -> DataFrame:
    """(file, text) with a file's lines in order."""
    rows = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("x"))
    return rows.select("file", F.array_join(F.col("x.text"), "\n").alias("text"))
