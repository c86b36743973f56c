"""Per-document queries: letters, words, n-grams, dispersion, burstiness, readability."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexarium.functions import text as T
from lexarium.operators import entropy, lexical

from .base import BASE, GAPS, HOW, ITEMS, LETTER_COUNTS, ROWS, H, corpus, named, query, r, read, rounded

# --- normalisation -----------------------------------------------------------------------------------------------------------------------------


@query("nrm01_bracket_fix", rf"SELECT doc_id, md5(regexp_replace(regexp_replace(t, '([а-яё]+)\[([а-яё]+)\]([а-яё]*)', '\1\2\3', 'g'), '([а-яё]+)<([а-яё]+)>([а-яё]*)', '\1\2\3', 'g')) AS digest FROM (WITH {BASE} SELECT * FROM d)")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", F.md5(T.join_brackets(F.col("text"))).alias("digest"))


@query("nrm04_first_letters", f"WITH {BASE} SELECT doc_id, array_to_string(list_transform(k, lambda x: translate(x[1], 'ёй', 'еи')), '') AS first_letters FROM k")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", F.array_join(T.first_letters(T.words(F.col("text"), HOW), HOW), "").alias("first_letters"))


@query("nrm05_all_letters", f"WITH {BASE} SELECT doc_id, md5(letters) AS digest, len(letters)::BIGINT AS n FROM k")
def _(spark, sf):
    s = T.letter_string(T.words(F.col("text"), HOW), HOW)
    return corpus(spark, sf).select("doc_id", F.md5(s).alias("digest"), F.length(s).cast("long").alias("n"))


@query("nrm06_tokens", f"WITH {BASE} SELECT doc_id, len(k)::BIGINT AS n, md5(array_to_string(k, ' ')) AS digest FROM k")
def _(spark, sf):
    t = T.tokens(T.words(F.col("text"), HOW), HOW)
    return corpus(spark, sf).select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("flt01_min_token_length", f"WITH {BASE} SELECT doc_id, len(list_filter(k, lambda x: len(x) >= 5))::BIGINT AS n FROM k")
def _(spark, sf):
    from lexarium.config import Normalizer

    how = Normalizer(min_token_len=5)
    return corpus(spark, sf).select("doc_id", F.size(T.tokens(T.words(F.col("text"), how), how)).cast("long").alias("n"))


# --- letters -----------------------------------------------------------------------------------------------------------------------------------

_SUMS = "s AS (SELECT doc_id, sum(n)::DOUBLE AS n, count(*)::DOUBLE AS kinds, {h} AS h, sum(n * n)::DOUBLE AS sq, sum(n * (n - 1))::DOUBLE AS nn, max(n)::DOUBLE AS top, sum(n * position(x IN 'абвгдежзиклмнопрстуфхцчшщыэюя'))::DOUBLE AS r1, sum(n * position(x IN 'абвгдежзиклмнопрстуфхцчшщыэюя') * position(x IN 'абвгдежзиклмнопрстуфхцчшщыэюя'))::DOUBLE AS r2 FROM c GROUP BY doc_id)".format(h=H)
_ALL = f"WITH {BASE}, {LETTER_COUNTS}, {_SUMS}, a AS (SELECT k.doc_id, len(k.k)::BIGINT AS n_words, coalesce(n, 0) AS n, coalesce(kinds, 0) AS kinds, coalesce(h, 0) AS h, coalesce(sq, 0) AS sq, coalesce(nn, 0) AS nn, coalesce(top, 0) AS top, coalesce(r1, 0) AS r1, coalesce(r2, 0) AS r2 FROM k LEFT JOIN s USING (doc_id))"
_SQL = {
    "n_letters": "n::BIGINT",
    "n_kinds": "kinds::BIGINT",
    "entropy": "h",
    "entropy_miller_madow": "CASE WHEN n > 0 THEN h + (kinds - 1) / (2 * n) ELSE h END",
    "entropy_normalized": "h / log2(29.0)",
    "entropy_per_word": "CASE WHEN n > 0 THEN h / n ELSE 0 END",
    "perplexity": "pow(2.0, h)",
    "utilization": "kinds / 29.0::DOUBLE",
    "herfindahl": "CASE WHEN n > 0 THEN sq / (n * n) ELSE 0 END",
    "uniqueness": "CASE WHEN n_words > 0 THEN kinds / n_words ELSE 0 END",
    "redundancy": "1 - h / log2(29.0)",
    "evenness": "CASE WHEN kinds > 1 THEN h / log2(kinds) ELSE 1 END",
    "renyi_0": "CASE WHEN n > 0 THEN log2(kinds) ELSE 0 END",
    "renyi_2": "CASE WHEN n > 0 THEN -log2(sq / (n * n)) ELSE 0 END",
    "renyi_inf": "CASE WHEN n > 0 THEN -log2(top / n) ELSE 0 END",
    "mean_rank": "CASE WHEN n > 0 THEN r1 / n ELSE 0 END",
    "std_rank": "CASE WHEN n > 0 THEN sqrt(greatest(r2 / n - (r1 / n) * (r1 / n), 0)) ELSE 0 END",
    "simpson": "CASE WHEN n > 1 THEN nn / (n * (n - 1)) ELSE 1 END",
    "gini_simpson": "1 - CASE WHEN n > 1 THEN nn / (n * (n - 1)) ELSE 1 END",
}


def _letters(name: str, *columns: str) -> None:
    def run(spark, sf, columns=columns):
        frame = entropy.letter_frame(corpus(spark, sf), HOW)
        m = entropy.letter_metrics(HOW.size)
        return named(frame, {c: m[c] for c in columns}, "doc_id")

    whole = ("n_letters", "n_kinds")
    query(name, f"{_ALL} SELECT doc_id, {', '.join((_SQL[c] if c in whole else r(_SQL[c])) + ' AS ' + c for c in columns)} FROM a")(run)


_letters("ent00_letter_block", "n_letters", "n_kinds", "entropy", "perplexity", "evenness", "redundancy", "simpson")
_letters("ent01_shannon_letters", "n_letters", "entropy")
_letters("ent04_miller_madow", "entropy_miller_madow")
_letters("ent05_normalized_entropy", "entropy_normalized", "entropy_per_word")
_letters("ent06_perplexity", "perplexity")
_letters("ent07_alphabet_utilization", "utilization")
_letters("ent08_herfindahl", "herfindahl")
_letters("ent10_uniqueness", "uniqueness")
_letters("ent11_redundancy", "redundancy")
_letters("ent12_evenness", "evenness")
_letters("ent13_renyi", "renyi_0", "renyi_2", "renyi_inf")
_letters("ent14_enhanced_metrics", "perplexity", "utilization", "herfindahl", "uniqueness", "redundancy", "evenness", "renyi_0", "renyi_2", "renyi_inf")
_letters("ent15_letter_ranks", "mean_rank", "std_rank")
_letters("ent17_simpson", "simpson")
_letters("ent18_gini_simpson", "gini_simpson")

_ALPHABET = "al AS (SELECT u AS rank, 'абвгдежзиклмнопрстуфхцчшщыэюя'[u] AS letter FROM (SELECT unnest(range(1, 30)) AS u))"
_STATS = f"WITH {BASE}, {LETTER_COUNTS}, {_ALPHABET}, tot AS (SELECT doc_id, sum(n)::DOUBLE AS total FROM c GROUP BY doc_id), f AS (SELECT k.doc_id, rank::INT AS rank, letter, coalesce(n, 0)::BIGINT AS count, coalesce(n / total, 0) AS p FROM k CROSS JOIN al LEFT JOIN c ON c.doc_id = k.doc_id AND c.x = letter LEFT JOIN tot ON tot.doc_id = k.doc_id)"


@query("ent16_letter_stats", f"{_STATS} SELECT doc_id, rank, letter, count, {r('p')} AS probability, {r('CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END')} AS p_log2 FROM f")
def _(spark, sf):
    return rounded(entropy.letter_stats(entropy.letter_frame(corpus(spark, sf), HOW), HOW))


@query("ent02_entropy_from_probabilities", f"{_STATS} SELECT doc_id, {r('-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END)')} AS entropy FROM f GROUP BY doc_id")
def _(spark, sf):
    s = entropy.letter_stats(entropy.letter_frame(corpus(spark, sf), HOW), HOW)
    return rounded(s.groupBy("doc_id").agg((-F.sum("p_log2")).alias("entropy")))


@query("ent09_uniformity_distance", f"{_STATS} SELECT doc_id, {r('CASE WHEN max(p) > 0 THEN sqrt(sum((p - 1/29.0::DOUBLE) * (p - 1/29.0::DOUBLE))) ELSE 0 END')} AS uniform_euclidean, {r('CASE WHEN max(p) > 0 THEN sum(abs(p - 1/29.0::DOUBLE)) ELSE 0 END')} AS uniform_manhattan, {r('CASE WHEN max(p) > 0 THEN max(abs(p - 1/29.0::DOUBLE)) ELSE 0 END')} AS uniform_chebyshev FROM f GROUP BY doc_id")
def _(spark, sf):
    m = entropy.letter_metrics(HOW.size)
    return named(entropy.letter_frame(corpus(spark, sf), HOW), {c: m[c] for c in ("uniform_euclidean", "uniform_manhattan", "uniform_chebyshev")}, "doc_id")


@query("agg01_first_letter_counts", f"WITH {BASE} SELECT doc_id, x AS letter, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(list_transform(k, lambda x: translate(x[1], 'ёй', 'еи'))) AS x FROM k) GROUP BY doc_id, x")
def _(spark, sf):
    first = corpus(spark, sf).select("doc_id", F.explode(T.first_letters(T.words(F.col("text"), HOW), HOW)).alias("letter"))
    return first.groupBy("doc_id", "letter").agg(F.count("*").alias("n"))


@query("agg02_letter_counts", f"WITH {BASE}, {LETTER_COUNTS} SELECT doc_id, x AS letter, n::BIGINT AS n FROM c")
def _(spark, sf):
    return entropy.letter_stats(entropy.letter_frame(corpus(spark, sf), HOW), HOW).where("count > 0").select("doc_id", "letter", F.col("count").alias("n"))


_JOINT = "WITH n AS (SELECT {x} AS x, {y} AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), hx AS (SELECT {h} AS h FROM (SELECT x, sum(n) AS n FROM n GROUP BY x)), hy AS (SELECT {h} AS h FROM (SELECT y, sum(n) AS n FROM n GROUP BY y)), hxy AS (SELECT {h} AS h FROM n)".format(x="l_returnflag", y="l_linestatus", h=H)


@query("ent19_mutual_information", f"{_JOINT} SELECT {r('hx.h')} AS h_x, {r('hy.h')} AS h_y, {r('hxy.h')} AS h_xy, {r('greatest(hx.h + hy.h - hxy.h, 0)')} AS mutual_information FROM hx, hy, hxy")
def _(spark, sf):
    return rounded(entropy.joint_entropy(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").drop("conditional_entropy"))


@query("ent20_conditional_entropy", f"{_JOINT} SELECT {r('greatest(hxy.h - hx.h, 0)')} AS conditional_entropy FROM hx, hxy")
def _(spark, sf):
    return rounded(entropy.joint_entropy(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select("conditional_entropy"))


_RANKED = "z AS (SELECT doc_id, ln(n::DOUBLE) AS y, ln(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, {item})::DOUBLE) AS x FROM {t}), zz AS (SELECT doc_id, CASE WHEN count(*) >= 3 THEN -regr_slope(y, x) ELSE 0 END AS alpha, CASE WHEN count(*) >= 3 THEN CASE WHEN regr_syy(y, x) = 0 THEN 1 ELSE regr_r2(y, x) END ELSE 0 END AS r2 FROM z GROUP BY doc_id)"


@query("ent21_zipf_words", f"WITH {BASE}, {ROWS}, {ITEMS}, {_RANKED.format(item='token', t='i')} SELECT doc_id, {r('alpha')} AS zipf_alpha, {r('r2', 5)} AS zipf_r2 FROM zz")
def _(spark, sf):
    z = entropy.zipf(lexical.item_counts(lexical.token_rows(corpus(spark, sf), HOW)))
    return z.select("doc_id", (F.round("zipf_alpha", 6) + 0.0).alias("zipf_alpha"), (F.round("zipf_r2", 5) + 0.0).alias("zipf_r2"))


# --- words -------------------------------------------------------------------------------------------------------------------------------------


def _rows(spark, sf):
    return lexical.token_rows(corpus(spark, sf), HOW)


@query("agg03_word_frequency", f"WITH {BASE}, {ROWS}, {ITEMS} SELECT doc_id, token AS item, n::BIGINT AS n, first_pos::INT AS first_pos FROM i")
def _(spark, sf):
    return lexical.item_counts(_rows(spark, sf))


@query("agg06_distinct_counts", f"WITH {BASE}, {ROWS} SELECT doc_id, count(DISTINCT token)::BIGINT AS types, count(DISTINCT token[1])::BIGINT AS initials FROM rows GROUP BY doc_id")
def _(spark, sf):
    return _rows(spark, sf).groupBy("doc_id").agg(F.count_distinct("token").alias("types"), F.count_distinct(F.substring("token", 1, 1)).alias("initials"))


_RICH = f"WITH {BASE}, {ROWS}, {ITEMS}, x AS (SELECT doc_id, n, n_tokens, CASE WHEN n_tokens >= 42 THEN (1 - list_aggregate(list_transform(range(0, 42), lambda j: greatest(0, n_tokens - n - j)::DOUBLE / (n_tokens - j)), 'product')) / 42 ELSE 0 END AS hit FROM i)"


@query("lex01_yules_k", f"{_RICH} SELECT doc_id, {r('10000 * (sum(n * n) - sum(n))::DOUBLE / (sum(n) * sum(n))')} AS yules_k FROM x GROUP BY doc_id")
def _(spark, sf):
    return rounded(lexical.richness(_rows(spark, sf)).select("doc_id", "yules_k"))


@query("lex04_richness", f"{_RICH} SELECT doc_id, sum(n)::BIGINT AS n_tokens, count(*)::BIGINT AS n_types, {r('avg((n = 1)::INT)')} AS hapax_ratio, {r('sum(hit)')} AS hdd FROM x GROUP BY doc_id")
def _(spark, sf):
    return rounded(lexical.richness(_rows(spark, sf)).select("doc_id", "n_tokens", "n_types", "hapax_ratio", "hdd"))


@query("lex05_ttr", f"{_RICH} SELECT doc_id, {r('count(*)::DOUBLE / sum(n)')} AS ttr FROM x GROUP BY doc_id")
def _(spark, sf):
    return rounded(lexical.richness(_rows(spark, sf)).select("doc_id", "ttr"))


@query("win03_mattr", f"WITH {BASE}, {ROWS}, p AS (SELECT doc_id, n, least(100, n) AS w, pos, coalesce(lag(pos) OVER (PARTITION BY doc_id, token ORDER BY pos), -1) AS prev FROM rows) SELECT doc_id, {r('sum(greatest(0, least(pos, n - w) - greatest(prev + 1, pos - w + 1, 0) + 1))::DOUBLE / (any_value(w) * (any_value(n) - any_value(w) + 1))')} AS mattr FROM p GROUP BY doc_id")
def _(spark, sf):
    return rounded(lexical.mattr(_rows(spark, sf), 100))


@query("win04_gaps", f"WITH {BASE}, {ROWS}, {GAPS} SELECT doc_id, count(*)::BIGINT AS n_gaps, sum(gap)::BIGINT AS total, max(gap)::INT AS longest FROM g GROUP BY doc_id")
def _(spark, sf):
    return lexical.gaps(_rows(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n_gaps"), F.sum("gap").alias("total"), F.max("gap").alias("longest"))


@query("bur01_burstiness", f"WITH {BASE}, {ROWS}, {GAPS}, x AS (SELECT doc_id, token, stddev_samp(gap) AS s, avg(gap) AS m FROM g WHERE n >= 5 GROUP BY doc_id, token HAVING count(*) >= 2) SELECT doc_id, {r('avg((s - m) / (s + m))')} AS burstiness FROM x GROUP BY doc_id")
def _(spark, sf):
    return rounded(lexical.burstiness_index(lexical.gaps(_rows(spark, sf))))


_BURST = f"WITH {BASE}, {ROWS}, {GAPS}, x AS (SELECT doc_id, gap::DOUBLE AS gap, lead(gap::DOUBLE) OVER (PARTITION BY doc_id ORDER BY first_pos, pos) AS nxt, quantile_cont(gap::DOUBLE, 0.5) OVER (PARTITION BY doc_id) AS mid FROM g WHERE n >= 5)"


@query("bur03_short_gaps", f"{_BURST} SELECT doc_id, count(*)::BIGINT AS n_gaps, sum((gap < mid / 2)::INT)::BIGINT AS burst_count, {r('avg((gap < mid / 2)::INT)')} AS burst_ratio FROM x GROUP BY doc_id")
def _(spark, sf):
    return rounded(lexical.burst_parameters(lexical.gaps(_rows(spark, sf))).select("doc_id", "n_gaps", "burst_count", "burst_ratio"))


@query("bur04_burst_parameter", f"{_BURST} SELECT doc_id, {r('CASE WHEN count(*) >= 3 THEN (stddev_samp(gap) - avg(gap)) / (stddev_samp(gap) + avg(gap)) END')} AS burst_parameter FROM x GROUP BY doc_id")
def _(spark, sf):
    return rounded(lexical.burst_parameters(lexical.gaps(_rows(spark, sf))).select("doc_id", "burst_parameter"))


@query("bur05_memory", f"{_BURST} SELECT doc_id, {r('CASE WHEN count(*) >= 3 THEN covar_pop(gap, nxt) / nullif(stddev_pop(CASE WHEN nxt IS NOT NULL THEN gap END) * stddev_pop(nxt), 0) END', 5)} AS memory FROM x GROUP BY doc_id")
def _(spark, sf):
    return rounded(lexical.burst_parameters(lexical.gaps(_rows(spark, sf))).select("doc_id", "memory"), 5)


_GRIES = f"""WITH {BASE}, {ROWS}, q AS (SELECT doc_id, token, pos, n, least(10, n) AS s FROM rows),
e AS (SELECT doc_id, token, n, s, n // s AS short, n % s AS extra, CASE WHEN pos < (n % s) * (n // s + 1) THEN pos // (n // s + 1) ELSE n % s + (pos - (n % s) * (n // s + 1)) // greatest(n // s, 1) END AS seg FROM q),
v AS (SELECT doc_id, token, seg, count(*) AS v, any_value(n) AS n, any_value(CASE WHEN seg < extra THEN short + 1 ELSE short END) AS part, any_value(short::DOUBLE / n) AS low FROM e GROUP BY doc_id, token, seg),
f AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, token) AS f FROM v),
dp AS (SELECT doc_id, token, any_value(f) AS f, any_value(low) AS low, (sum(abs(v * n - f * part)) + any_value(f) * (any_value(n) - sum(part)))::DOUBLE / (2 * any_value(f) * any_value(n)) AS dp FROM f GROUP BY doc_id, token),
dn AS (SELECT *, CASE WHEN low < 1 THEN least(1, greatest(0, 1 - dp / (1 - low))) ELSE 1 END AS dp_norm FROM dp)"""


@query("dsp01_gries_dp", f"{_GRIES} SELECT doc_id, token, f::BIGINT AS n, {r('dp', 12)} AS dp, {r('dp_norm', 12)} AS dp_norm FROM dn WHERE f >= 5")
def _(spark, sf):
    return rounded(lexical.gries_words(corpus(spark, sf), 10, 5, HOW), 12)


@query("dsp02_gries_average", f"{_GRIES} SELECT doc_id, {r('avg(dp_norm)', 10)} AS gries FROM dn WHERE f >= 3 GROUP BY doc_id")
def _(spark, sf):
    return rounded(lexical.gries_mean(corpus(spark, sf), 10, 3, HOW), 10)


@query("syl01_syllables", f"WITH {BASE}, {ROWS} SELECT doc_id, sum(greatest(1, len(token) - len(translate(token, 'аеёиоуыэюя', ''))))::BIGINT AS syllables FROM rows GROUP BY doc_id")
def _(spark, sf):
    return _rows(spark, sf).groupBy("doc_id").agg(F.sum(T.syllables(F.col("token"))).alias("syllables"))


@query("syl02_syllable_entropy", f"""WITH {BASE}, {ROWS}, y AS (SELECT doc_id, pos, greatest(1, len(token) - len(translate(token, 'аеёиоуыэюя', ''))) AS s, regexp_replace(token, '[^аеёиоуыэюя]', '', 'g') AS pat FROM rows WHERE n >= 10),
b AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM y),
h1 AS (SELECT doc_id, {H} AS h FROM (SELECT doc_id, s, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1),
h2 AS (SELECT doc_id, {H} AS h FROM (SELECT doc_id, s, nxt, count(*) AS n FROM b WHERE nxt IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1),
h3 AS (SELECT doc_id, {H} AS h FROM (SELECT doc_id, s, count(*) AS n FROM b WHERE nxt IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
h4 AS (SELECT doc_id, {H} AS h, count(*) AS kinds FROM (SELECT doc_id, pat, count(*) AS n FROM b WHERE pat <> '' GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, {r('h1.h')} AS syllable_entropy, {r('greatest(h2.h - h3.h, 0)')} AS conditional_entropy, {r('coalesce(h4.h, 0)')} AS pattern_entropy, coalesce(kinds, 0)::BIGINT AS unique_patterns FROM h1 LEFT JOIN h2 USING (doc_id) LEFT JOIN h3 USING (doc_id) LEFT JOIN h4 USING (doc_id)""")
def _(spark, sf):
    return rounded(lexical.syllable_entropy(corpus(spark, sf), HOW))


_sent = "t"
for _a in T.ABBREVIATIONS:
    _sent = f"regexp_replace({_sent}, '(^|[^\\p{{L}}\\p{{N}}_])({_a.replace('.', chr(92) + '.')})', '\\1{_a.replace('.', '·')}', 'g')"
# The driver tables are lower-cased and transliterated, so no initials occur in them.
_SENT = f"len(list_filter(regexp_split_to_array({_sent}, '[.!?]+(\\s|$)'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> ''))"


@query("rdb01_sentences", f"WITH {BASE} SELECT doc_id, CASE WHEN trim(t, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) = '' THEN 0 ELSE greatest(1, {_SENT}) END::BIGINT AS n_sentences FROM d")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", T.sentences(F.col("text")).cast("long").alias("n_sentences"))


@query("rdb02_readability", f"""WITH {BASE}, m AS (SELECT doc_id, len(k)::DOUBLE AS n, greatest(1, {_SENT}) AS s, list_transform(k, lambda x: greatest(1, len(x) - len(translate(x, 'аеёиоуыэюя', '')))) AS y FROM k)
SELECT doc_id, {r('CASE WHEN n > 0 THEN n / s ELSE 0 END')} AS avg_sentence_length, {r('CASE WHEN n > 0 THEN list_sum(y) / n ELSE 0 END')} AS avg_syllables,
{r('CASE WHEN n > 0 THEN 206.835 - 1.3 * n / s - 60.1 * list_sum(y) / n ELSE 0 END')} AS flesch, {r('CASE WHEN n > 0 THEN 0.4 * (n / s + 100 * len(list_filter(y, lambda x: x >= 3)) / n) ELSE 0 END')} AS fog FROM m""")
def _(spark, sf):
    return rounded(lexical.readability(corpus(spark, sf), HOW).drop("n_sentences"))


# --- n-grams -----------------------------------------------------------------------------------------------------------------------------------


def _gram_sql(n: int, source: str, sep: str) -> str:
    leads = [f"lead(token, {j}) OVER (PARTITION BY doc_id ORDER BY pos)" if j else "token" for j in range(n)]
    return f"gr AS (SELECT * FROM (SELECT doc_id, pos, {', '.join(f'{x} AS g{j}' for j, x in enumerate(leads))} FROM {source}) WHERE g{n - 1} IS NOT NULL), gg AS (SELECT doc_id, pos, concat_ws('{sep}', {', '.join(f'g{j}' for j in range(n))}) AS ngram, concat_ws('{sep}', {', '.join(f'g{j}' for j in range(n - 1))}) AS prefix FROM gr)"


_LETTER_ROWS = "lr AS (SELECT doc_id, p - 1 AS pos, letters[p] AS token FROM (SELECT doc_id, letters, unnest(range(1, len(letters) + 1)) AS p FROM k))"
_DIST = """gc AS (SELECT doc_id, prefix, ngram, count(*) AS n FROM gg GROUP BY 1, 2, 3), gk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ngram) AS rk FROM gc),
gp AS (SELECT doc_id, {h} AS h FROM (SELECT doc_id, prefix, sum(n) AS n FROM gc GROUP BY 1, 2) GROUP BY 1),
gm AS (SELECT doc_id, sum(n)::BIGINT AS total, count(*)::BIGINT AS uniq, {h} AS h, sum((n = 1)::INT)::BIGINT AS hapax_count, avg((n = 1)::INT) AS hapax_ratio, sum(CASE WHEN rk <= 10 THEN n ELSE 0 END)::DOUBLE / sum(n) AS c10, sum(CASE WHEN rk <= 50 THEN n ELSE 0 END)::DOUBLE / sum(n) AS c50 FROM gk GROUP BY 1)""".format(h=H)
_DIST_OUT = f"SELECT doc_id, total, uniq AS \"unique\", {r('gm.h')} AS entropy, hapax_count, {r('hapax_ratio')} AS hapax_ratio, {r('c10')} AS coverage_10, {r('c50')} AS coverage_50, {r('greatest(gm.h - gp.h, 0)')} AS conditional_entropy FROM gm JOIN gp USING (doc_id)"


def _ngram_queries(name: str, unit: str, cte: str, n: int, sep: str) -> None:
    query(f"{name}_entropy", f"WITH {BASE}, {cte}, {_gram_sql(n, cte.split()[0], sep)}, {_DIST} SELECT doc_id, {r('greatest(gm.h - gp.h, 0)')} AS conditional_entropy FROM gm JOIN gp USING (doc_id)")(
        lambda spark, sf: rounded(lexical.ngram_distribution(corpus(spark, sf), n, unit, HOW).select("doc_id", "conditional_entropy"))
    )
    query(f"{name}_distribution", f"WITH {BASE}, {cte}, {_gram_sql(n, cte.split()[0], sep)}, {_DIST} {_DIST_OUT}")(
        lambda spark, sf: rounded(lexical.ngram_distribution(corpus(spark, sf), n, unit, HOW))
    )


_ngram_queries("ng01_word_bigram", "word", ROWS, 2, " ")
_ngram_queries("ng01_word_trigram", "word", ROWS, 3, " ")
_ngram_queries("ng02_letter_bigram", "letter", _LETTER_ROWS, 2, "")
_ngram_queries("ng02_letter_trigram", "letter", _LETTER_ROWS, 3, "")


@query("srt01_top_ngrams", f"""WITH {BASE}, {ROWS}, {_gram_sql(2, 'rows', ' ')}, x AS (SELECT doc_id, ngram, count(*) AS n, min(pos) AS p FROM gg GROUP BY 1, 2), y AS (SELECT *, row_number() OVER o AS rk, sum(n) OVER (PARTITION BY doc_id) AS total, sum(n) OVER (PARTITION BY doc_id ORDER BY n DESC, p ROWS UNBOUNDED PRECEDING) AS cum FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY n DESC, p))
SELECT doc_id, ngram, n::BIGINT AS count, {r('n / total')} AS frequency, rk::INT AS rank, {r('cum / total')} AS cumulative FROM y WHERE rk <= 30""")
def _(spark, sf):
    return rounded(lexical.top_ngrams(corpus(spark, sf), 2, 30, HOW))


# --- rolling -----------------------------------------------------------------------------------------------------------------------------------


@query("win02_rolling_entropy", f"""WITH {BASE}, x AS (SELECT doc_id, list_transform(k, lambda x: translate(x[1], 'ёй', 'еи')) AS f FROM k), s AS (SELECT doc_id, p AS position, unnest(f[p + 1:p + 50]) AS c FROM (SELECT doc_id, f, unnest(range(0, len(f) - 49, 10)) AS p FROM x WHERE len(f) >= 50)),
c AS (SELECT doc_id, position, c, count(*) AS n FROM s GROUP BY 1, 2, 3) SELECT doc_id, position::INT AS position, {r(H)} AS entropy FROM c GROUP BY doc_id, position""")
def _(spark, sf):
    return rounded(lexical.rolling_entropy(corpus(spark, sf), 50, 10, HOW))
