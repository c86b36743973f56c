"""Hand-computed cases of normalisation, letters and words."""

import math

import pytest
from pyspark.sql import functions as F

from lexarium.config import Normalizer
from lexarium.functions import text as T
from lexarium.operators import entropy, lexical


def rows(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def test_alphabets():
    assert Normalizer().size == 29 and Normalizer("rus33").size == 33
    assert not set("ёйъь") & set(Normalizer("rus28").alphabet_letters)
    assert Normalizer("custom", letters="абба").alphabet_letters == "аб"
    with pytest.raises(ValueError):
        Normalizer("latin")


def test_tokens_and_first_letters(spark):
    how = Normalizer()
    df = rows(spark, "Мой дядя самых честных правил", "Ёлка ежик", "ъа ььь а", "", None)
    out = df.select(T.tokens(T.words(F.col("text"), how), how).alias("t"), T.first_letters(T.words(F.col("text"), how), how).alias("f")).collect()
    assert out[0]["t"][0] == "мой" and out[0]["f"] == list("мдсчп")
    assert out[1]["f"] == ["е", "е"] and out[1]["t"] == ["ёлка", "ежик"]
    assert out[2]["t"] == ["а"] and out[3]["t"] == [] and out[4]["t"] is None
    kept = df.select(T.first_letters(T.words(F.col("text"), Normalizer("rus33", keep_yo=True)), Normalizer("rus33")).alias("f")).collect()
    assert kept[1]["f"] == ["ё", "е"]


def test_brackets(spark):
    out = [r[0] for r in rows(spark, "пти[чек] от [плодов]", "М<артынов> пришел", "[Скоро странствию] конец", "т[е][к]ст").select(T.join_brackets(F.col("text"))).collect()]
    assert out == ["птичек от [плодов]", "Мартынов пришел", "[Скоро странствию] конец", "текст"]


def test_letter_entropy(spark):
    f = entropy.letter_frame(rows(spark, "мама мыла раму", "", "123"))
    m = entropy.letter_metrics(29)
    got = f.select("n_words", *[m[k].alias(k) for k in ("n_letters", "entropy", "evenness", "simpson", "renyi_0", "renyi_inf")]).collect()
    assert got[0]["n_words"] == 3 and got[0]["n_letters"] == 12
    assert got[0]["entropy"] == pytest.approx(math.log2(12) - 16 / 12)
    assert got[0]["renyi_0"] == pytest.approx(math.log2(6)) and got[0]["renyi_inf"] == pytest.approx(math.log2(3))
    assert got[1]["entropy"] == 0 and got[1]["evenness"] == 1 and got[1]["simpson"] == 1 and got[2]["n_words"] == 0


def _tokens(spark, *words):
    return lexical.token_rows(rows(spark, " ".join(words)))


def test_mattr_and_gries(spark):
    assert lexical.mattr(_tokens(spark, *"а б а в а б".split()), 3).first()["mattr"] == pytest.approx(5 / 6)
    assert lexical.mattr(_tokens(spark, "а", "б"), 5).first()["mattr"] == pytest.approx(1.0)
    even = {r["token"]: r for r in lexical.gries(_tokens(spark, *"а б а б".split()), 2).collect()}
    assert even["а"]["dp"] == pytest.approx(0) and even["а"]["dp_norm"] == pytest.approx(1)
    odd = {r["token"]: r for r in lexical.gries(_tokens(spark, *"а а б б".split()), 2).collect()}
    assert odd["а"]["dp"] == pytest.approx(0.5) and odd["а"]["dp_norm"] == pytest.approx(0)


def test_sentences(spark):
    out = [r[0] for r in rows(spark, "Он жил в г. Москве. А.С. писал! Да?", "   ", "без точки", "и т.д. и т.п.").select(T.sentences(F.col("text"))).collect()]
    assert out == [3, 0, 1, 1]
