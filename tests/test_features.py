"""Feature labels of texts whose measures are known by hand."""

import pytest

from lexarium.functions import features as X

VERSE = "Мама мыла раму\nБоря брал барабан\nпапа пил пиво\r\n\n ау!  дом том"


def label(spark, texts, *names):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = X.measured(df, list(names)).select("doc_id", *[c.alias(n) for n, c in X.labels(list(names)).items()]).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_long_lines(spark):
    """Squares of lengths over 46340 don't fit into 32 bits."""
    long_ = "а" * 50_000
    got = label(spark, [long_, long_ + "\nб", "а " * 50_000 + "\n" + "б"], "line_length_std", "avg_line_len", "meter_regularity")
    assert got == [("low_line_std", "very_long_line", "too_short"), ("very_high_line_std", "very_long_line", "very_irregular"), ("very_high_line_std", "very_long_line", "very_irregular")]


def test_measures():
    x = X._Text(VERSE)
    assert x.lines == ["Мама мыла раму", "Боря брал барабан", "папа пил пиво", "ау!", "дом том"]
    want = {
        "line_count": 5,
        "token_count": 12,
        "avg_line_len": (14 + 17 + 13 + 3 + 7) / 5,
        "consonant_repetition": (2 + 3 + 3 + 1) / 4,
        "meter_pattern": (6 + 6 + 5 + 2 + 2) / 5,
        "syllables_per_line": (6 + 6 + 5 + 2 + 2) / 5,
        "sentence_length": (10 + 2) / 2,
        "rhyme_repetition": 1 / 5,
        "rhyme_quality": 1.0,
        "upper_ratio": 2 / 46,
        "unique_ratio": 1.0,
        "enjambment_rate": 3 / 4,
        "exclamation_ratio": 1.0,
        "question_ratio": 0.0,
    }
    for name, value in want.items():
        assert X.MEASURES[name](x) == pytest.approx(value), name
    assert X.MEASURES["consonant_repetition"](X._Text("ау оо\nёж у")) == 1 and X.MEASURES["consonant_repetition"](X._Text("а" * 200_000 + " ёё")) is None
    assert X.rhyme_scheme(X._Text("дом\nкот\nтом\nрот")) == "cross_rhyme" and X.rhyme_scheme(X._Text("дом\nтом\nкот\nрот")) == "paired_rhyme" and X.rhyme_scheme(X._Text("а")) == "too_short"


def test_without_measures(spark):
    names = ["meter_pattern", "consonant_repetition", "rhyme_quality", "voiced_consonant_ratio", "question_ratio", "end_punct", "token_count"]
    assert label(spark, ["", "...", "аа", None], *names) == [
        ("empty", "empty", "too_short", "empty", "empty", "empty", "empty"),
        ("no_meter", "no_alliteration", "too_short", "empty", "very_low_quest", "dot_end", "empty"),
        ("very_short_meter", "no_alliteration", "too_short", "no_consonants", "no_punct", "other_end", "tiny"),
        ("no_meter", "no_alliteration", "no_rhyme", "no_consonants", "empty", "empty", "empty"),
    ]
