"""The Arrow passes over texts against counts made one text at a time, and that they need no shuffle."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium import runtime
from lexarium.config import Normalizer
from lexarium.functions import batch as B
from lexarium.functions import numeric as N
from lexarium.functions import text as T
from lexarium.operators import attribution, classify, entropy, lexical, sequential
from lexarium.plans import catalog

HOW = Normalizer()
TEXTS = ["мама мыла раму мама мыла пол", "", None, "ъа ьь ёж, йод! ёж", "пти[чек] т[е][к]ст <я> м<артынов>", "а", "123 ...", " ".join(["ма", "мы", "ра", "ку", "ёл"][i * i % 5] + "лл" * (i % 3) for i in range(130)), "мама мыла раму мама мыла пол"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)


def words(text):
    return re.findall("[а-яё]+", {TEXTS[4]: "птичек текст <я> мартынов"}.get(text, text or ""))


def tokens(text):
    return [w for w in words(text) if w[0] not in "ъь"]


def letters(text):
    return [c for c in "".join(words(text)).replace("ё", "е").replace("й", "и") if c not in "ъь"]


def h(counts):
    n = sum(counts)
    return math.log2(n) - sum(c * math.log2(c) for c in counts) / n if n else 0.0


def collected(df):
    assert all(s not in df._jdf.queryExecution().optimizedPlan().toString() for s in ("Aggregate", "Window", "Generate"))
    return df.collect()


def test_letter_counts(spark):
    got = {r["doc_id"]: r for r in collected(entropy.letter_frame(frame(spark)))}
    for i, t in enumerate(TEXTS):
        if t is None:
            assert got[i]["n_words"] is None and got[i]["counts"] == [None] * 29
        else:
            assert got[i]["n_words"] == len(tokens(t)) and got[i]["counts"] == [letters(t).count(c) for c in HOW.alphabet_letters]


@pytest.mark.parametrize("unit, n", [("word", 2), ("word", 3), ("letter", 2), ("letter", 3)])
def test_ngram_distribution(spark, unit, n):
    got = {r["doc_id"]: r for r in collected(lexical.ngram_distribution(frame(spark), n, unit))}
    for i, t in enumerate(TEXTS):
        items = tokens(t) if unit == "word" else letters(t)
        grams = [tuple(items[k : k + n]) for k in range(len(items) - n + 1)]
        if not grams:
            assert i not in got
            continue
        c, heads = Counter(grams), Counter(g[:-1] for g in grams)
        most = [x for _, x in c.most_common()]
        want = [len(grams), len(c), h(c.values()), most.count(1), most.count(1) / len(c), sum(most[:10]) / len(grams), sum(most[:50]) / len(grams), max(0, h(c.values()) - h(heads.values()))]
        assert list(got[i])[1:] == pytest.approx(want, abs=1e-12)


def test_top_ngrams(spark):
    got = collected(lexical.top_ngrams(frame(spark), 2, 3))
    for i, t in enumerate(TEXTS):
        grams = [" ".join(g) for g in zip(tokens(t), tokens(t)[1:], strict=False)]
        c = Counter(grams)
        top = sorted(c, key=lambda g: (-c[g], grams.index(g)))[:3]
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["rank"])
        assert [(r["ngram"], r["count"], r["rank"]) for r in mine] == [(g, c[g], k) for k, g in enumerate(top, 1)]
        assert [r["cumulative"] for r in mine] == pytest.approx([sum(c[g] for g in top[: k + 1]) / len(grams) for k in range(len(top))])


def test_gries_is_that_over_rows(spark):
    df = frame(spark)
    rows = {(r["doc_id"], r["token"]): list(r)[2:] for r in lexical.gries(lexical.token_rows(df), 10, 2).collect()}
    got = {(r["doc_id"], r["token"]): list(r)[2:] for r in collected(lexical.gries_words(df, 10, 2))}
    assert got == rows and got
    mean = {r["doc_id"]: r["gries"] for r in collected(lexical.gries_mean(df, 10, 2))}
    assert mean == {i: pytest.approx(np.mean([v[2] for (j, _), v in rows.items() if j == i])) for i in {j for j, _ in rows}}


def test_syllable_entropy(spark):
    got = {r["doc_id"]: list(r)[1:] for r in collected(lexical.syllable_entropy(frame(spark)))}
    assert set(got) == {i for i, t in enumerate(TEXTS) if len(tokens(t)) >= 10}
    for i, g in got.items():
        pat = ["".join(c for c in w if c in "аеёиоуыэюя") for w in tokens(TEXTS[i])]
        syl = [max(1, len(p)) for p in pat]
        kinds = Counter(p for p in pat if p)
        want = [h(Counter(syl).values()), max(0, h(Counter(zip(syl, syl[1:], strict=False)).values()) - h(Counter(syl[:-1]).values())), h(kinds.values()), len(kinds)]
        assert g == pytest.approx(want, abs=1e-12)


def test_rolling_entropy(spark):
    got = collected(lexical.rolling_entropy(frame(spark), 4, 2))
    for i, t in enumerate(TEXTS):
        first = [w[0].replace("ё", "е").replace("й", "и") for w in tokens(t)]
        want = {p: h(Counter(first[p : p + 4]).values()) for p in range(0, len(first) - 3, 2)}
        assert {r["position"]: r["entropy"] for r in got if r["doc_id"] == i} == pytest.approx(want)


def test_slices_and_ranks_change_nothing(monkeypatch):
    parts = [B.distribution(TEXTS[a:b], HOW, 3) for a, b in runtime.slices(TEXTS, 20)]
    assert len(parts) > 2
    whole = B.distribution(TEXTS, HOW, 3)
    for k in range(8):
        assert np.concatenate([p[1][k] for p in parts]) == pytest.approx(whole[1][k], abs=1e-12)
    monkeypatch.setattr(B, "MOST", 1000)
    ranked = B.distribution(TEXTS, HOW, 3)
    assert ranked[0].tolist() == whole[0].tolist() and all(np.allclose(a, b) for a, b in zip(ranked[1], whole[1], strict=True))


def test_own_words(spark):
    how = Normalizer("custom", letters="abc", word_class="[a-z]+", min_token_len=2)
    got = entropy.letter_frame(spark.createDataFrame([(0, "ab c cab xa b")], "doc_id bigint, text string"), how).first()
    assert got["n_words"] == 2 and got["counts"] == [3, 2, 1]


def test_sentences(spark):
    rnd = random.Random(9)
    bits = ["А", "ж", "г", "Г", "в", "с", "т", ".", ".", ".", "!", "?", " ", " ", "\n", "\x85", "·", "_", "½", "5", "́", "ᲀ", "т.е.", "Т.Д.", "и т.п.", "и др.", "гг.", "обл.", "дом", "ⓐ", "\0"]
    texts = ["", " ", ".", "г.", "А.", "и т.д. и т.п."] + ["".join(rnd.choice(bits) for _ in range(rnd.choice([2, 5, 12, 60]))) for _ in range(3000)]
    want = [r[0] for r in frame(spark, texts).coalesce(1).orderBy("doc_id").select(T.sentences(F.col("text"))).collect()]
    assert B.sentences(texts).tolist() == want
    parts = [B.sentences(texts[a:b]) for a, b in runtime.slices(texts, 500)]
    assert np.concatenate(parts).tolist() == want


def test_attribution_parts(spark):
    """The parts alone are those of the whole set of figures, and take no shuffle."""
    df = frame(spark, [*TEXTS, "а б. в, а! Г. Д. б а а? " * 30])
    whole = {r["doc_id"]: r.asDict() for r in attribution.all_metrics(df, ordered=("mtld", "compression")).select("doc_id", *[c.alias(k) for k, c in attribution.scaled().items()]).collect()}
    made = attribution.parts(df)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: r.asDict() for r in made.select("doc_id", *[c.alias(k) for k, c in attribution.scaled().items()]).collect()}
    assert set(got) == set(whole)
    for i, r in whole.items():
        assert got[i] == pytest.approx(r, abs=1e-9), i


def test_forest_reads_texts_once(spark, tmp_path):
    """The figures that the forest reads many times come from one pass over the texts."""
    texts = [(i, ("а" if i % 2 else "о") * (i % 7 + 3) + " мама мыла" * (i % 5), "ab"[i % 2], "s") for i in range(60)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.queries()["ml02_metric_forest"](spark, str(tmp_path))
    assert "InMemoryRelation" in df._jdf.queryExecution().withCachedData().toString()
    assert df.count() > 0


def test_character_grams(spark, monkeypatch):
    """The tf-idf vectors are counts of the most frequent n-grams, without a row for each n-gram."""
    texts = [*TEXTS, "Ab\0c😀 ab", "\0\0"]
    grams = [[t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)] if t else [] for t in texts]
    total = Counter(g for gs in grams for g in gs)
    want = sorted(total, key=lambda g: (-total[g], g))
    df = frame(spark, texts)
    assert classify.gram_vocabulary(df, 50) == want[:50]
    for table in (B.TABLE, 10):
        monkeypatch.setattr(B, "TABLE", table)
        lower = [t and t.lower() for t in texts]
        _, (g, n) = B.gram_counts(lower)
        assert dict(zip(g, n.tolist(), strict=True)) == dict(total)
        _, (v,) = B.gram_vectors(lower, want[:50])
        for i, own in enumerate(grams):
            assert dict(zip(v[i]["indices"].as_py(), v[i]["values"].as_py(), strict=True)) == {k: own.count(x) for k, x in enumerate(want[:50]) if x in own}
    made = classify.gram_vectors(df, want[:50])
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: dict(zip(r["tf"].indices.tolist(), r["tf"].values.tolist(), strict=True)) for r in made.collect()} == {i: {k: own.count(x) for k, x in enumerate(want[:50]) if x in own} for i, own in enumerate(grams)}


def test_ordered_metrics(spark):
    """One row for each text, also for equal ones, with the figures of its own tokens."""
    df = frame(spark, TEXTS)
    got = {r["doc_id"]: r for r in collected(sequential.ordered_metrics(df))}
    assert sorted(got) == list(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        counts = np.array(list(Counter(tokens(t)).values()), np.int64)
        assert got[i]["mtld"] == N.mtld(tokens(t)) and got[i]["phrases"] == N.phrases(t or "") and got[i]["raw_size"] == len((t or "").encode())
        assert tuple(got[i][k] for k in ("zm_alpha", "zm_beta", "zm_c", "zm_r2", "zm_gain")) == N.zipf_mandelbrot(counts)
        assert got[i]["boot_mean"] == N.bootstrap_entropy(np.array([letters(t).count(c) if i != 3 else "".join(tokens(t)).replace("ё", "е").replace("й", "и").count(c) for c in HOW.alphabet_letters]))[0]
