"""Queries over groups of documents: distances, summaries, tests, features and the recogniser."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from lexarium.functions import features as X
from lexarium.functions import text as T
from lexarium.operators import classify, cleaning, compare, entropy, recognize, sequential, stats
from lexarium.sources import files

from .base import BASE, DOCS, HOW, LETTER_COUNTS, ROWS, TEXT, corpus, query, r, read, rounded
from .text_metrics import _ALL, _ALPHABET

# --- distances ---------------------------------------------------------------------------------------------------------------------------------


def _lang_letters(spark, sf):
    return compare.group_letters(entropy.letter_frame(corpus(spark, sf), HOW, keep=("lang",)), "lang", HOW.size)


_PAIRS = f"""WITH {BASE}, {LETTER_COUNTS}, {_ALPHABET}, lg AS (SELECT lang, x, sum(n) AS n FROM c JOIN k USING (doc_id) GROUP BY 1, 2), ls AS (SELECT lang, sum(n)::DOUBLE AS s FROM lg GROUP BY 1),
f AS (SELECT ls.lang, rank, coalesce(lg.n, 0) / s AS p FROM ls CROSS JOIN al LEFT JOIN lg ON lg.lang = ls.lang AND lg.x = letter),
j AS (SELECT a.lang AS a, b.lang AS b, a.rank, a.p AS p, b.p AS q, (b.p + 1e-10) / (1 + 29e-10) AS qs, (a.p + 1e-10) / (1 + 29e-10) AS ps FROM f a JOIN f b ON a.lang < b.lang AND a.rank = b.rank),
cum AS (SELECT *, sum(p - q) OVER (PARTITION BY a, b ORDER BY rank) AS d FROM j)"""
_DIST_SQL = {
    "kl_ab": "sum(CASE WHEN p > 0 THEN p * log2(p / qs) ELSE 0 END)",
    "kl_ba": "sum(CASE WHEN q > 0 THEN q * log2(q / ps) ELSE 0 END)",
    "js": "greatest(0.5 * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END), 0)",
    "cosine": "sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)))",
    "wasserstein": "sum(abs(d))",
    "hellinger": "sqrt(greatest(1 - sum(sqrt(p * q)), 0))",
    "bhattacharyya": "-ln(sum(sqrt(p * q)))",
    "total_variation": "0.5 * sum(abs(p - q))",
}


def _distance(name: str, *columns: str) -> None:
    def run(spark, sf):
        d = compare.distances(F.col("p"), F.col("q"))
        return rounded(compare.pairs(_lang_letters(spark, sf), "lang").select("a", "b", *[d[c].alias(c) for c in columns]))

    query(name, f"{_PAIRS} SELECT a, b, {', '.join(r(_DIST_SQL[c]) + ' AS ' + c for c in columns)} FROM cum GROUP BY a, b")(run)


_distance("cmp01_kl_divergence", "kl_ab", "kl_ba")
_distance("cmp02_js_by_lang", "js")
_distance("cmp03_cosine", "cosine")
_distance("cmp04_information_distances", "wasserstein", "hellinger", "bhattacharyya", "total_variation")
_distance("cmp05_compare", "kl_ab", "kl_ba", "js", "cosine", "wasserstein", "hellinger", "total_variation")


def _group_words(spark, sf):
    docs = corpus(spark, sf)
    t = docs.select("lang", F.explode(T.tokens(T.words(F.col("text"), HOW), HOW)).alias("item"))
    return t.groupBy("lang", "item").agg(F.count("*").alias("n"))


_MFW = f"""WITH {BASE}, {ROWS}, gw AS (SELECT lang, token AS item, count(*) AS n FROM rows JOIN k USING (doc_id) GROUP BY 1, 2), al AS (SELECT item, sum(n) AS n FROM gw GROUP BY 1 ORDER BY n DESC, item LIMIT 100),
rk AS (SELECT item, row_number() OVER (ORDER BY n DESC, item) AS rank FROM al), sz AS (SELECT lang, sum(n)::DOUBLE AS s FROM gw GROUP BY 1),
fr AS (SELECT sz.lang, rk.item, rank, coalesce(gw.n, 0) / s AS f FROM rk CROSS JOIN sz LEFT JOIN gw ON gw.lang = sz.lang AND gw.item = rk.item),
z AS (SELECT lang, item, rank, f, (f - avg(f) OVER w) / CASE WHEN stddev_samp(f) OVER w > 0 THEN stddev_samp(f) OVER w ELSE 1 END AS z FROM fr WINDOW w AS (PARTITION BY item))"""


@query("jn07_mfw_frequencies", f"{_MFW} SELECT lang, item, rank::INT AS rank, {r('f', 9)} AS f FROM z")
def _(spark, sf):
    return rounded(compare.mfw_frequencies(_group_words(spark, sf), "lang"), 9)


@query("dlt01_z_scores", f"{_MFW} SELECT lang, item, {r('z')} AS z FROM z")
def _(spark, sf):
    return rounded(compare.z_scores(compare.mfw_frequencies(_group_words(spark, sf), "lang")).select("lang", "item", "z"))


_DELTA = f"{_MFW}, j AS (SELECT a.lang AS a, b.lang AS b, a.z AS za, b.z AS zb, a.rank, count(*) OVER (PARTITION BY a.lang, b.lang) AS n FROM z a JOIN z b ON a.item = b.item AND a.lang < b.lang)"
for _name, _column, _sql in (
    ("dlt02_burrows_delta", "burrows", "sum(abs(za - zb)) / count(*)"),
    ("dlt03_eder_delta", "eder", "sum(abs(za - zb) * (1 - rank / (n + 1)))"),
    ("dlt04_cosine_delta", "cosine_delta", "1 - sum(za * zb) / (sqrt(sum(za * za)) * sqrt(sum(zb * zb)))"),
):
    query(_name, f"{_DELTA} SELECT a, b, {r(_sql)} AS {_column} FROM j GROUP BY a, b")(lambda spark, sf, c=_column: rounded(compare.deltas(compare.z_scores(compare.mfw_frequencies(_group_words(spark, sf), "lang")), "lang").select("a", "b", c)))


def _group_bigrams(spark, sf):
    docs = corpus(spark, sf)
    t = docs.select("lang", F.explode(T.ngrams(T.tokens(T.words(F.col("text"), HOW), HOW), 2, " ")).alias("item"))
    return t.groupBy("lang", "item").agg(F.count("*").alias("n"))


_BI = f"WITH {BASE}, {ROWS}, b AS (SELECT doc_id, token || ' ' || lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS item FROM rows), gb AS (SELECT lang, item, count(*) AS n FROM b JOIN k USING (doc_id) WHERE item IS NOT NULL GROUP BY 1, 2)"
_TWO = f"{_BI}, x AS (SELECT item, n / (SELECT sum(n)::DOUBLE FROM gb WHERE lang = 'en') AS p, n AS c FROM gb WHERE lang = 'en'), y AS (SELECT item, n / (SELECT sum(n)::DOUBLE FROM gb WHERE lang = 'de') AS q FROM gb WHERE lang = 'de'), xy AS (SELECT coalesce(x.item, y.item) AS item, coalesce(p, 0) AS p, coalesce(q, 0) AS q, c FROM x FULL JOIN y ON x.item = y.item)"


@query("ng03_compare_ngrams", f"{_TWO} SELECT sum((p > 0 AND q > 0)::INT)::BIGINT AS shared, sum((q = 0)::INT)::BIGINT AS only_a, sum((p = 0)::INT)::BIGINT AS only_b, {r('sum((p > 0 AND q > 0)::INT)::DOUBLE / count(*)')} AS jaccard, {r('0.5 * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)')} AS js, {r('sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)))')} AS cosine FROM xy")
def _(spark, sf):
    return rounded(compare.compare_ngrams(_group_bigrams(spark, sf), "lang", "en", "de"))


@query("srt02_differing_ngrams", f"{_TWO} SELECT item, c::BIGINT AS n, {r('p')} AS f1, {r('q')} AS f2, {r('(p - q) / greatest(q, 1e-4)', 5)} AS score FROM xy WHERE c >= 3 ORDER BY round((p - q) / greatest(q, 1e-4), 9) DESC, item LIMIT 10")
def _(spark, sf):
    d = compare.differing_ngrams(_group_bigrams(spark, sf), "lang", "en", "de")
    return d.select("item", "n", F.round("f1", 6).alias("f1"), F.round("f2", 6).alias("f2"), F.round("score", 5).alias("score"))


@query("set01_ngram_sets", f"{_BI} SELECT (SELECT count(*) FROM (SELECT item FROM gb WHERE lang = 'en' INTERSECT SELECT item FROM gb WHERE lang = 'de'))::BIGINT AS common, (SELECT count(*) FROM (SELECT item FROM gb WHERE lang = 'en' EXCEPT SELECT item FROM gb WHERE lang = 'de'))::BIGINT AS left_only, (SELECT count(DISTINCT item) FROM gb WHERE lang IN ('en', 'de'))::BIGINT AS either")
def _(spark, sf):
    g = _group_bigrams(spark, sf).where(F.col("lang").isin("en", "de")).groupBy("item").agg(F.max((F.col("lang") == "en").cast("int")).alias("a"), F.max((F.col("lang") == "de").cast("int")).alias("b"))
    return g.agg(F.sum(F.col("a") * F.col("b")).cast("long").alias("common"), F.sum(F.col("a") * (1 - F.col("b"))).cast("long").alias("left_only"), F.count("*").alias("either"))


# --- summaries and tests -----------------------------------------------------------------------------------------------------------------------


def _entropies(spark, sf):
    f = entropy.letter_frame(corpus(spark, sf), HOW, keep=("lang",))
    m = entropy.letter_metrics(HOW.size)
    return f.select("doc_id", "lang", "n_words", m["n_letters"].alias("n_letters"), F.round(m["entropy"], 9).alias("h")).where("n_letters > 0").drop("n_letters")


def _kept_entropies(spark, sf):
    """_entropies() for queries that read it several times: a few numbers a document, kept in memory, else on the executors' disks."""
    return _entropies(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)


_HS = f"{_ALL}, hs AS (SELECT doc_id, lang, n_words, round(h, 9) AS h FROM a JOIN k USING (doc_id) WHERE n > 0)"
_EXT = "count({v})::BIGINT AS n, " + ", ".join(f"{r(e, d)} AS {a}" for a, e, d in (("mean", "avg({v})", 6), ("median", "median({v})", 6), ("std", "stddev_samp({v})", 6), ("variance", "var_samp({v})", 6), ("q1", "quantile_cont({v}, 0.25)", 6), ("q3", "quantile_cont({v}, 0.75)", 6), ("iqr", "quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)", 6), ("cv_percent", "100 * stddev_samp({v}) / abs(avg({v}))", 6), ("skewness", "skewness({v})", 4), ("kurtosis", "kurtosis({v})", 4), ("min", "min({v})", 6), ("max", "max({v})", 6)))


def _stats(df):
    return df.select(*[(F.round(c, 4 if c in ("skewness", "kurtosis") else 6) + 0.0).alias(c) if c not in ("n", "lang") else F.col(c) for c in df.columns])


@query("agg07_extended_stats", f"{_HS} SELECT {_EXT.format(v='h')} FROM hs")
def _(spark, sf):
    return _stats(_entropies(spark, sf).agg(*stats.extended_stats("h")))


@query("agg10_batch_summary", f"{_HS} SELECT lang, {_EXT.format(v='h')} FROM hs GROUP BY lang")
def _(spark, sf):
    return _stats(_entropies(spark, sf).groupBy("lang").agg(*stats.extended_stats("h")))


@query("agg08_mad", f"{_HS} SELECT {r('mad(h)')} AS mad FROM hs")
def _(spark, sf):
    return rounded(stats.mad(_entropies(spark, sf), "h"))


@query("agg09_correlation", f"{_HS} SELECT {r('corr(h, n_words)', 5)} AS r, {r('regr_slope(h, n_words)', 8)} AS slope, {r('regr_intercept(h, n_words)', 5)} AS intercept, {r('corr(h, n_words) * corr(h, n_words)', 5)} AS r_squared FROM hs")
def _(spark, sf):
    c = _entropies(spark, sf).agg(*stats.correlation("n_words", "h"))
    return c.select(*[(F.round(x, 8 if x == "slope" else 5) + 0.0).alias(x) for x in c.columns])


@query("agg14_class_sizes", "SELECT lang, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def _(spark, sf):
    return read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("agg11_author_averages", f"{_HS} SELECT lang, {r('avg(h)')} AS entropy, {r('avg(n_words)')} AS n_words FROM hs GROUP BY lang")
def _(spark, sf):
    return rounded(_entropies(spark, sf).groupBy("lang").agg(F.avg("h").alias("entropy"), F.avg("n_words").alias("n_words")))


_OUT = {
    "iqr": f"{_HS}, q AS (SELECT quantile_cont(h, 0.25) AS q1, quantile_cont(h, 0.75) AS q3 FROM hs) SELECT doc_id, {r('CASE WHEN h < q1 - 1.5 * (q3 - q1) THEN (q1 - 1.5 * (q3 - q1) - h) / (q3 - q1) WHEN h > q3 + 1.5 * (q3 - q1) THEN (h - q3 - 1.5 * (q3 - q1)) / (q3 - q1) ELSE 0 END')} AS score, h < q1 - 1.5 * (q3 - q1) OR h > q3 + 1.5 * (q3 - q1) AS is_outlier FROM hs, q",
    "zscore": f"{_HS}, q AS (SELECT avg(h) AS m, stddev_samp(h) AS s FROM hs) SELECT doc_id, {r('abs(h - m) / s')} AS score, abs(h - m) / s > 3 AS is_outlier FROM hs, q",
    "modified_zscore": f"{_HS}, q AS (SELECT median(h) AS m, mad(h) AS s FROM hs) SELECT doc_id, {r('0.6745 * abs(h - m) / s')} AS score, 0.6745 * abs(h - m) / s > 3.5 AS is_outlier FROM hs, q",
}
for _n, _m in (("tst01_outliers_iqr", "iqr"), ("tst02_outliers_zscore", "zscore"), ("tst03_outliers_modified", "modified_zscore")):
    query(_n, _OUT[_m])(lambda spark, sf, m=_m: rounded(stats.outliers(_kept_entropies(spark, sf), "h", m).select("doc_id", "score", "is_outlier")))


@query("tst05_cohens_d", f"{_HS}, q AS (SELECT count(*) FILTER (lang = 'en') AS na, count(*) FILTER (lang = 'de') AS nb, avg(h) FILTER (lang = 'en') AS ma, avg(h) FILTER (lang = 'de') AS mb, var_samp(h) FILTER (lang = 'en') AS va, var_samp(h) FILTER (lang = 'de') AS vb FROM hs) SELECT na::BIGINT AS n_a, nb::BIGINT AS n_b, {r('ma')} AS m_a, {r('mb')} AS m_b, {r('(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))')} AS cohens_d FROM q")
def _(spark, sf):
    return rounded(stats.cohens_d(_entropies(spark, sf), "lang", "h", "en", "de").drop("effect"))


@query("tst08_rank_sum", f"{_HS}, q AS (SELECT h, lang, rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2 AS rk FROM hs WHERE lang IN ('en', 'de')) SELECT {r('sum(rk) FILTER (lang = $$en$$) - count(*) FILTER (lang = $$en$$) * (count(*) FILTER (lang = $$en$$) + 1) / 2')} AS u, (count(*) FILTER (lang = 'en'))::BIGINT AS n1, (count(*) FILTER (lang = 'de'))::BIGINT AS n2 FROM q")
def _(spark, sf):
    return rounded(stats.rank_sum(_entropies(spark, sf).where(F.col("lang").isin("en", "de")), "lang", "h", "en").select(F.col("u").cast("double").alias("u"), F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2")))


_P = "p AS (SELECT n_nationkey AS id, ((n_nationkey * 37) % 50 + 1) / 1000.0::DOUBLE AS p FROM nation)"
for _n, _m in (("tst07_bonferroni", "bonferroni"), ("tst07_bh_correction", "fdr_bh"), ("tst07_by_correction", "fdr_by")):
    _scale = "1" if _m != "fdr_by" else "(SELECT sum(1.0::DOUBLE / i) FROM (SELECT unnest(range(1, (SELECT count(*) FROM p) + 1)) AS i))"
    _sql = f"WITH {_P} SELECT id, {r('least(1, p * (SELECT count(*) FROM p))')} AS adjusted, least(1, p * (SELECT count(*) FROM p)) < 0.05 AS significant FROM p" if _m == "bonferroni" else f"WITH {_P}, k AS (SELECT id, p * (SELECT count(*) FROM p) * {_scale} / row_number() OVER (ORDER BY p, id) AS raw, row_number() OVER (ORDER BY p, id) AS rk FROM p), m AS (SELECT id, least(1, min(raw) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adjusted FROM k) SELECT id, {r('adjusted')} AS adjusted, adjusted < 0.05 AS significant FROM m"
    query(_n, _sql)(lambda spark, sf, m=_m: rounded(stats.correct_p_values(read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), (((F.col("n_nationkey") * 37) % 50 + 1) / F.lit(1000.0)).alias("p")), "p", m).select("id", "adjusted", "significant")))


@query("tst09_group_tests")
def _(spark, sf):
    h = _entropies(spark, sf)
    rows = h.select("doc_id", "lang", F.explode(F.array(F.struct(F.lit("entropy").alias("metric"), F.col("h").alias("value")), F.struct(F.lit("n_words").alias("metric"), F.col("n_words").cast("double").alias("value")))).alias("x")).select("doc_id", "lang", "x.*")
    return rounded(sequential.group_tests(rows, "metric", "lang", "doc_id", "en", "de"))


@query("ser01_ordered_metrics")
def _(spark, sf):
    return rounded(sequential.ordered_metrics(corpus(spark, sf), how=HOW))


# --- sources and cleaning ----------------------------------------------------------------------------------------------------------------------


@query("src04_split_segments", f"WITH {DOCS}, s AS (SELECT doc_id, list_filter(list_transform(string_split(t, '.'), lambda x: regexp_replace(x, '^[\\s]+|[\\s]+$', '', 'g')), lambda x: len(list_filter(regexp_extract_all(x, '[а-яё]+'), lambda y: y[1] NOT IN ('ъ', 'ь'))) >= 10) AS p FROM d) SELECT doc_id, i::INT AS segment, md5(p[i]) AS digest FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM s)")
def _(spark, sf):
    return files.split_segments(corpus(spark, sf), ".", 10, HOW, keep=("doc_id",)).select("doc_id", "segment", F.md5("text").alias("digest"))


@query("etl06_fix_ocr")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(cleaning.fix_ocr(F.col("text"))).alias("digest"))


@query("etl07_editor_notes")
def _(spark, sf):
    lines = cleaning.number_lines(read(spark, sf, "documents"), "doc_id")
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.sum(cleaning.is_editor_note(F.col("text")).cast("int")).alias("notes"))


@query("etl09_footnotes")
def _(spark, sf):
    return cleaning.remove_footnotes(cleaning.number_lines(read(spark, sf, "documents"), "doc_id")).groupBy("file").agg(F.count("*").alias("lines"))


# --- features and recogniser -------------------------------------------------------------------------------------------------------------------

_WS = T.SPACES
_FEATURE = f"""WITH x AS (SELECT doc_id, coalesce({TEXT}, '') AS t FROM documents),
f AS (SELECT doc_id, t, regexp_extract_all(lower(t), '{T.ANY_WORD}') AS w, lower(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS a, list_filter(list_transform(string_split_regex(t, '{T.LINE_BREAKS}'), lambda y: regexp_replace(y, '^{_WS}+|{_WS}+$', '', 'g')), lambda y: y <> '') AS l FROM x)"""
_count = lambda s, chars: f"(length({s}) - length(translate({s}, '{chars}', '')))::DOUBLE"
_share = lambda cond: f"CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda y: {cond}))::DOUBLE / len(w) END"
_over = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} END"
_in = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_MEASURES = {
    "avg_word_len": _over("length(array_to_string(w, ''))::DOUBLE", "len(w)"),
    "avg_line_len": "list_avg(list_transform(l, lambda y: length(y)))",
    "punct_ratio": _over(_count("t", X.PUNCTUATION.replace("'", "''")), "length(t)"),
    "unique_ratio": _over("len(list_distinct(w))::DOUBLE", "len(w)"),
    "vowel_ratio": _over(_count("a", "аеёиоуыэюяaeiou"), "length(a)"),
    "line_count": "CASE WHEN len(l) > 0 THEN len(l) END",
    "token_count": "CASE WHEN len(w) > 0 THEN len(w) END",
    "long_word_share": _share("length(y) >= 8"),
    "stopword_ratio": _share(f"y IN {_in(X.STOP_WORDS)}"),
    "upper_ratio": _over("length(regexp_replace(t, '[^\\p{Lu}]', '', 'g'))::DOUBLE", "length(a)"),
    "sentence_length": f"list_avg(list_transform(list_filter(string_split_regex(t, '[.!?]'), lambda y: regexp_replace(y, '^{_WS}+|{_WS}+$', '', 'g') <> ''), lambda y: len(regexp_extract_all(lower(y), '{T.ANY_WORD}'))))",
    "rare_letter_ratio": _over(_count("a", X.RARE_LETTERS), "length(a)"),
    "enjambment_rate": f"CASE WHEN len(l) >= 2 THEN len(list_filter(l[1:len(l) - 1], lambda y: NOT contains('{X.LINE_END_PUNCTUATION.replace(chr(39), chr(39) * 2)}', right(y, 1))))::DOUBLE / (len(l) - 1) END",
    "adjective_density": _share(f"length(y) > 3 AND right(y, 2) IN {_in(X.ADJECTIVE_ENDINGS)}"),
    "voiced_consonant_ratio": _over(_count("a", X.VOICED), _count("a", X.CONSONANTS)),
    "exclamation_ratio": _over(_count("t", "!"), _count("t", ".!?;")),
    "question_ratio": _over(_count("t", "?"), _count("t", ".!?;")),
}
_IDS = ["avg_word_len", "avg_line_len", "punct_ratio", "unique_ratio", "vowel_ratio", "line_count", "token_count", "long_word_share", "stopword_ratio", "upper_ratio", "sentence_length", "rare_letter_ratio", "end_punct", "syllables_per_line", "line_length_std", "rhyme_repetition", "meter_pattern", "meter_regularity", "rhyme_scheme", "rhyme_quality", "enjambment_rate", "adjective_density", "consonant_repetition", "voiced_consonant_ratio", "exclamation_ratio", "question_ratio"]


def _case(name: str) -> str:
    b, sign = X.BINS[name], "<=" if X.BINS[name].closed else "<"
    missing = f"CASE WHEN {'a' if name == 'voiced_consonant_ratio' else 't'} = '' THEN 'empty' ELSE '{X.MISSING.get(name, 'empty')}' END"
    return f"CASE WHEN m IS NULL THEN {missing} " + " ".join(f"WHEN m {sign} {x} THEN '{y}'" for x, y in zip(b.limits, b.labels, strict=False)) + f" ELSE '{b.labels[-1]}' END"


for _k, _f in enumerate(_IDS, 1):
    if _f in _MEASURES:
        _sql = f"{_FEATURE}, m AS (SELECT *, round({_MEASURES[_f]}, 12) AS m FROM f) SELECT doc_id, {_case(_f)} AS bin FROM m"
    elif _f == "end_punct":
        _sql = f"{_FEATURE}, m AS (SELECT doc_id, right(regexp_replace(t, '^{_WS}+|{_WS}+$', '', 'g'), 1) AS m FROM f) SELECT doc_id, CASE m WHEN '' THEN 'empty' " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.END_PUNCTUATION.items()) + " ELSE 'other_end' END AS bin FROM m"
    else:
        _sql = None
    query(f"f{_k:02d}_{_f}", _sql)(lambda spark, sf, f=_f: X.measured(corpus(spark, sf).select("doc_id", "text"), [f]).select("doc_id", X.labels([f])[f].alias("bin")))


_TABLES = "pr(class, prior) AS (VALUES ('A1', 0.3::DOUBLE), ('A2', 0.5), ('A3', 0.2)), cd(feature, idx, class, value, p) AS (VALUES " + ", ".join(f"('{f}', {i}, 'A{k + 1}', '{v}', {p}::DOUBLE)" for i, (f, t) in enumerate((("f1", [[0.7, 0.3], [0.4, 0.6], [0.5, 0.5]]), ("f2", [[0.2, 0.5, 0.3], [0.3, 0.4, 0.3], [0.1, 0.6, 0.3]]))) for k, line in enumerate(t) for v, p in enumerate(line)) + ")"


@query("rec02_feature_error", f"WITH {_TABLES}, j AS (SELECT feature, value, p * prior AS j FROM cd JOIN pr USING (class)), v AS (SELECT feature, value, sum(j) AS px, max(j) AS b FROM j GROUP BY 1, 2) SELECT feature, {r('sum(px - b)')} AS error FROM v GROUP BY feature")
def _(spark, sf):
    return rounded(recognize.feature_scores(*recognize.sample_tables(spark)).select("feature", "error"))


@query("rec03_informativeness", f"WITH {_TABLES}, j AS (SELECT feature, value, p * prior AS j FROM cd JOIN pr USING (class)), v AS (SELECT feature, value, j, sum(j) OVER (PARTITION BY feature, value) AS px FROM j) SELECT feature, {r('(SELECT -sum(prior * log2(prior)) FROM pr) + sum(j * log2(j / px))')} AS informativeness FROM v GROUP BY feature")
def _(spark, sf):
    return rounded(recognize.feature_scores(*recognize.sample_tables(spark)).select("feature", "informativeness"))


@query("rec04_pair_error", f"WITH {_TABLES}, j AS (SELECT a.feature AS first, b.feature AS second, a.value AS x, b.value AS y, a.p * b.p * prior AS j FROM cd a JOIN cd b ON a.class = b.class AND a.idx < b.idx JOIN pr ON pr.class = a.class), v AS (SELECT first, second, x, y, sum(j) - max(j) AS e FROM j GROUP BY 1, 2, 3, 4) SELECT first, second, {r('sum(e)')} AS error FROM v GROUP BY 1, 2")
def _(spark, sf):
    return rounded(recognize.pair_scores(*recognize.sample_tables(spark)).select("first", "second", "error"))


@query("rec05_noisy_run")
def _(spark, sf):
    return rounded(recognize.run(*recognize.sample_tables(spark), noise=0.05, seed=123))


def _segments(spark, sf):
    return corpus(spark, sf).withColumnRenamed("lang", "label")


@query("rec09_train_tables")
def _(spark, sf):
    priors, cond = recognize.train(recognize.kept(recognize.discretise(_segments(spark, sf), X.profile("baseline"))))
    return rounded(cond.join(priors, "class"))


@query("rec10_predictions")
def _(spark, sf):
    return rounded(recognize.train_and_predict(_segments(spark, sf), "compact")[1])


@query("rec11_batch_summary")
def _(spark, sf):
    return rounded(recognize.train_and_predict(_segments(spark, sf), "compact")[0])


@query("agg12_confusion")
def _(spark, sf):
    return rounded(recognize.confusion(recognize.train_and_predict(_segments(spark, sf), "baseline")[1]))


@query("rec12_author_lexicons")
def _(spark, sf):
    return rounded(classify.author_lexicons(_group_words(spark, sf), "lang"))
