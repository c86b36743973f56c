"""Figures that need a document's tokens in order or iterative numerics: one Arrow pass over rows, no grouping and no shuffle."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium import runtime
from lexarium.config import Normalizer
from lexarium.functions import batch
from lexarium.functions import numeric as N

FIELDS = {
    "mtld": "mtld double",
    "compression": "raw_size bigint, compressed_size bigint, compression_ratio double",
    "phrases": "phrases bigint",
    "hurst": "hurst double, hurst_r2 double, hurst_kind string",
    "zipf_mandelbrot": "zm_alpha double, zm_beta double, zm_c double, zm_r2 double, zm_gain double",
    "bootstrap": "boot_mean double, boot_std double, boot_low double, boot_high double",
    "weibull": "weibull_beta double",
    "kleinberg": "kleinberg_bursts bigint, kleinberg_ratio double",
    "zipf_chi2": "zipf_chi2 double, zipf_p double",
}


def zipf_chi2(counts: np.ndarray) -> tuple[float, float]:
    """Fit of the fitted rank law to the counts: chi square with bins of an expected count under 5 pooled, and its p; (inf, 0) for fewer than 3 kinds."""
    y = np.sort(counts[counts > 0].astype(float))[::-1]
    if len(y) < 3:
        return float("inf"), 0.0
    rank = np.arange(1, len(y) + 1)
    slope, at = np.polyfit(np.log(rank), np.log(y), 1)
    e = np.exp(at + slope * np.log(rank))
    e *= y.sum() / e.sum()
    small = e < 5
    if small.any() and (~small).sum() >= 1:
        y, e = np.append(y[~small], y[small].sum()), np.append(e[~small], e[small].sum())
    x = float(((y - e) ** 2 / e).sum())
    return x, N.chi2_p(x, max(1, len(y) - 3))


def _values(kinds, tokens: list[str], text: str, how: Normalizer, iterations: int, seed: int | None, fitted: tuple = ()) -> list:
    """The fields of the kinds; ``fitted`` are those of zipf_mandelbrot, which texts are given together."""
    out: list = []
    words = Counter(tokens)
    counts = np.array(list(words.values()), np.int64)
    for kind in kinds:
        if kind == "mtld":
            out.append(N.mtld(tokens))
        elif kind == "compression":
            out += N.compression(text)
        elif kind == "phrases":
            out.append(N.phrases(text))
        elif kind == "hurst":
            out += N.dfa(np.array([len(t) for t in tokens], float))
        elif kind == "zipf_mandelbrot":
            out += fitted
        elif kind == "zipf_chi2":
            out += zipf_chi2(counts)
        elif kind == "bootstrap":
            table = str.maketrans(dict.fromkeys(how.folding[0])) if how.folding[0] else {}
            for a, b in zip(how.folding[0], how.folding[1], strict=False):
                table[ord(a)] = b
            letters = Counter("".join(tokens).translate(table))
            out += N.bootstrap_entropy(np.array([letters.get(c, 0) for c in how.alphabet_letters]), iterations, seed=seed)
        elif kind == "weibull":
            least = max(5, len(tokens) // 100)
            top = [w for w, n in words.most_common(30) if n >= least]
            at: dict[str, list[int]] = {w: [] for w in top}
            for i, t in enumerate(tokens):
                if t in at:
                    at[t].append(i)
            shapes = [b for w in top if len(at[w]) >= 4 and np.isfinite(b := N.weibull_shape(np.diff(at[w]))[0])]
            out.append(float(np.mean(shapes)) if shapes else None)
        elif kind == "kleinberg":
            if not tokens:
                out += [0, 0.0]
                continue
            first: dict[str, int] = {}
            for i, t in enumerate(tokens):
                first.setdefault(t, i)
            word = min(words, key=lambda w: (-words[w], first[w]))
            out += N.kleinberg(np.array([i for i, t in enumerate(tokens) if t == word]))
    return out


def ordered_metrics(docs: DataFrame, kinds: tuple[str, ...] = tuple(FIELDS), how: Normalizer | None = None, id_col: str = "doc_id", text_col: str = "text", iterations: int = 1000, seed: int | None = 42) -> DataFrame:
    """One row per document with the fields of the chosen kinds."""
    unknown = set(kinds) - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown figures {sorted(unknown)}")
    how = how or Normalizer()
    source = docs.select(id_col, batch.source(F.col(text_col), how).alias("own_words"), F.col(text_col).alias("own_text"))

    def work(texts: list[str | None], raw: list[str | None]) -> tuple[None, list]:
        w = batch.Words(texts, how)
        words, ends = w.strings(), np.cumsum(w.n).tolist()
        raw = [t or "" for t in raw]
        once = {t: i for i, t in enumerate(raw)}  # equal texts have equal figures, whatever the seed
        if seed is None:
            once = {i: i for i in range(len(raw))}
        tokens = {i: words[ends[i] - w.n[i] : ends[i]] for i in once.values()}
        fitted = dict.fromkeys(tokens, ())
        if "zipf_mandelbrot" in kinds:
            fitted = dict(zip(tokens, N.zipf_mandelbrots([np.array(list(Counter(t).values()), np.int64) for t in tokens.values()]), strict=True))
        values = {i: _values(kinds, t, raw[i], how, iterations, seed, fitted[i]) for i, t in tokens.items()}
        rows = [values[once[i if seed is None else t]] for i, t in enumerate(raw)]
        return None, [pa.array(c, from_pandas=True) for c in zip(*rows, strict=True)]

    return runtime.map_texts(source, "own_words", ", ".join(FIELDS[k] for k in kinds), work, also="own_text")


def group_tests(samples: DataFrame, metric: str, group: str, order: str, a, b, values: str = "value", rounds: int = 5000, boots: int = 3000, seed: int = 42) -> DataFrame:
    """Per metric: permutation and bootstrap of the difference of means, Cohen's d, Student's t and Mann-Whitney between groups a and b.

    Resampling depends on the order of the values, so they are sorted by ``order``.  A metric's values of two groups are one bounded sample.
    """
    runtime.prepare(samples.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order, kind="stable")
        x, y = (f.loc[f[group] == g, values].dropna().to_numpy(float) for g in (a, b))
        if len(x) < 2 or len(y) < 2:
            return pd.DataFrame([[f[metric].iloc[0]] + [None] * 10], columns=names)
        diff, p = N.permutation_p(x, y, rounds, seed=seed)
        low, high, sig = N.bootstrap_difference(x, y, boots, seed=seed)
        free = len(x) + len(y) - 2
        sd = np.sqrt(((len(x) - 1) * x.var(ddof=1) + (len(y) - 1) * y.var(ddof=1)) / free)
        t = diff / (sd * np.sqrt(1 / len(x) + 1 / len(y))) if sd > 0 else 0.0
        u, mw = N.mann_whitney(x, y)
        return pd.DataFrame([[f[metric].iloc[0], diff, p, low, high, sig, diff / sd if sd > 0 else 0.0, t, N.t_p(t, free), u, mw]], columns=names)

    schema = f"{metric} string, difference double, permutation_p double, ci_low double, ci_high double, ci_significant boolean, cohens_d double, t double, t_p double, u double, mw_p double"
    names = [x.split()[0] for x in schema.split(", ")]
    return samples.where(F.col(group).isin(a, b)).groupBy(metric).applyInPandas(run, schema)
