"""Numpy kernels for figures that need ordered state, resampling or iteration.  Each takes plain arrays or strings."""

from __future__ import annotations

import gzip
import math

import numpy as np


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 500):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= (step := d * c)
        if abs(step - 1) < 1e-16:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= (step := c * d)
        if abs(1 - step) < 1e-15:
            break
    return front * (f - 1)


def chi2_p(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def correlation_p(r: float, n: int) -> float:
    if n <= 2 or abs(r) >= 1:
        return 0.0 if n > 2 else 1.0
    return t_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def mann_whitney(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """U of a and its two-sided p: exact for small samples without ties (at most 8 on a side), else normal with continuity and tie correction."""
    both = np.concatenate((a, b))
    _, at, count = np.unique(both, return_inverse=True, return_counts=True)
    ends = np.cumsum(count)
    rank = (ends - (count - 1) / 2)[at]
    n1, n2, n = len(a), len(b), len(both)
    u = float(rank[:n1].sum() - n1 * (n1 + 1) / 2)
    if min(n1, n2) <= 8 and len(count) == n:
        ways = np.zeros(n1 * n2 + 1)
        table = {0: {0: 1.0}}
        for k in range(1, n + 1):  # number of subsets of ranks by size and sum
            for size in range(min(k, n1), 0, -1):
                for s, w in list(table.get(size - 1, {}).items()):
                    table.setdefault(size, {}).setdefault(s + k, 0.0)
                    table[size][s + k] += w
        for s, w in table[n1].items():
            ways[s - n1 * (n1 + 1) // 2] += w
        tail = ways[int(max(u, n1 * n2 - u)) :].sum() / ways.sum()
        return u, float(min(1.0, 2 * tail))
    var = n1 * n2 / 12 * ((n + 1) - (count**3 - count).sum() / (n * (n - 1)))
    if var <= 0:
        return u, 1.0
    z = (abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var)
    return u, float(min(1.0, math.erfc(z / math.sqrt(2))))


def mtld(tokens: list[str], threshold: float = 0.72) -> float:
    """Mean length of stretches that keep the type-token ratio, over both directions."""
    def one(seq) -> float:
        factors, seen, n = 0.0, set(), 0
        for w in seq:
            seen.add(w)
            n += 1
            if len(seen) / n < threshold:
                factors, seen, n = factors + 1, set(), 0
        if n:
            factors += min(1.0, max(0.0, (1 - len(seen) / n) / (1 - threshold)))
        return len(tokens) / factors if factors else float(len(tokens))

    return (one(tokens) + one(tokens[::-1])) / 2 if tokens else 0.0


def phrases(text: str) -> int:
    """Number of phrases of a greedy parse into shortest new ones; at least 1 for a text."""
    seen, at = set(), 0
    for k in range(1, len(text) + 1):
        if (part := text[at:k]) not in seen:
            seen.add(part)
            at = k
    return max(1, len(seen)) if text else 0


def compression(text: str) -> tuple[int, int, float]:
    raw = text.encode()
    packed = len(gzip.compress(raw, 9, mtime=0)) if raw else 0
    return len(raw), packed, packed / len(raw) if raw else 0.0


def bootstrap_entropy(counts: np.ndarray, iterations: int = 1000, confidence: float = 0.95, seed: int | None = 42) -> tuple[float, float, float, float]:
    """Mean, deviation and percentile interval of the entropy of multinomial resamples; zeros without counts."""
    if iterations < 100:
        raise ValueError("at least 100 iterations")
    n = int(counts.sum())
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    p = np.random.default_rng(seed).multinomial(n, counts / n, size=iterations) / n
    h = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    low, high = np.percentile(h, [50 * (1 - confidence), 50 * (1 + confidence)])
    return float(h.mean()), float(h.std(ddof=1)), float(low), float(high)


def permutation_p(a: np.ndarray, b: np.ndarray, rounds: int = 10_000, alternative: str = "two-sided", seed: int = 42) -> tuple[float, float]:
    """Difference of means, and the share of reshuffles of the pooled values that reach it."""
    rng, pool, n = np.random.default_rng(seed), np.concatenate((a, b)).astype(float), len(a)
    seen = float(a.mean() - b.mean())
    hits = 0
    for _ in range(rounds):
        rng.shuffle(pool)
        d = pool[:n].mean() - pool[n:].mean()
        hits += abs(d) >= abs(seen) if alternative == "two-sided" else d >= seen if alternative == "greater" else d <= seen
    return seen, hits / rounds


def bootstrap_difference(a: np.ndarray, b: np.ndarray, rounds: int = 5000, confidence: float = 0.95, seed: int = 42) -> tuple[float, float, bool]:
    rng = np.random.default_rng(seed)
    d = np.array([rng.choice(a, len(a)).mean() - rng.choice(b, len(b)).mean() for _ in range(rounds)])
    low, high = np.percentile(d, [50 * (1 - confidence), 50 * (1 + confidence)])
    return float(low), float(high), not low <= 0 <= high


def dfa(series: np.ndarray, least: int = 4) -> tuple[float, float, str]:
    """Hurst exponent by detrended fluctuations over up to 25 scales, the fit's r squared, and what it means."""
    n = len(series)
    most = n // 4
    if n < 8:
        return 0.5, 0.0, "insufficient_data"
    profile = np.cumsum(series - series.mean())
    scales, s = [], least
    while s <= most and len(scales) < 25:
        scales.append(s)
        s = max(s + 1, int(s * 1.2))
    if len(scales) < 4:
        scales = list(range(least, most + 1, max(1, (most - least) // 25)))[:25]
    points = []
    for s in scales:
        k = n // s
        if k < 2:
            continue
        y = profile[: k * s].reshape(k, s)
        t = np.arange(s) - (s - 1) / 2
        slope = y @ t / (t @ t)
        left = y - y.mean(axis=1, keepdims=True) - slope[:, None] * t
        f = float(np.sqrt((left**2).mean(axis=1)).mean())
        if f > 0:
            points.append((math.log(s), math.log(f)))
    if len(points) < 3:
        return 0.5, 0.0, "insufficient_data"
    x, y = np.array(points).T
    slope, at = np.polyfit(x, y, 1)
    rest = ((y - slope * x - at) ** 2).sum()
    r2 = 1 - rest / ((y - y.mean()) ** 2).sum() if np.ptp(y) > 0 else 0.0
    return float(slope), float(r2), "persistent" if slope > 0.6 else "random" if slope > 0.4 else "anti-persistent"


#: The grid of beta that zipf_mandelbrot() searches first.
_BETAS = np.concatenate(([0.0], np.geomspace(0.01, 100, 80)))


def zipf_mandelbrot(counts: np.ndarray) -> tuple[float, float, float, float, float]:
    """alpha, beta, C, weighted r squared of ln C - alpha ln(rank + beta) and its gain over the unweighted fit without beta.

    The fit's deviations are the weights' reciprocals, so residuals count by the weights' squares; r squared counts them by the weights.
    For a given beta the fit is linear, so beta is searched.
    """
    return zipf_mandelbrots([counts])[0]


def zipf_mandelbrots(many: list[np.ndarray], together: int = 16) -> list[tuple[float, float, float, float, float]]:
    """zipf_mandelbrot() of each; those of one number of kinds are fitted together, each by the same steps as alone."""
    out = [(0.0, 0.0, 0.0, 0.0, 0.0)] * len(many)
    own, groups = [np.sort(c[c > 0].astype(float))[::-1] for c in many], {}
    for i, y in enumerate(own):
        if len(y) >= 5:
            groups.setdefault(len(y), []).append(i)
    for rows in groups.values():
        for at in range(0, len(rows), together):
            part = rows[at : at + together]
            for i, v in zip(part, _zipf_mandelbrot(np.array([own[i] for i in part])), strict=True):
                out[i] = v
    return out


def _zipf_mandelbrot(y: np.ndarray) -> list[tuple[float, float, float, float, float]]:
    n = y.shape[1]
    rank = np.arange(1, n + 1, dtype=float)
    if n > 300:
        keep = np.unique(np.concatenate((np.arange(50), np.geomspace(50, n - 1, 250).astype(int), [n - 1])))
        rank, y = rank[keep], np.ascontiguousarray(y[:, keep])
    w = np.ones(len(rank))
    w[:20] = 2.0
    w[-10:] = 1.5
    ly, lr, ww = np.log(y), np.log(rank), w * w
    sw = ww.sum()
    my = (ly * ww).sum(axis=1)[:, None] / sw
    dy = (ly - my)[:, None]

    def fit(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Residual, alpha and ln C of each row for each of its betas."""
        x = np.log(rank + beta[:, :, None])
        mx = (x * ww).sum(axis=2) / sw
        d = x - mx[:, :, None]
        a = np.clip(-(ww * d * dy).sum(axis=2) / np.maximum((ww * d**2).sum(axis=2), 1e-300), 0.1, 5)
        c = my + a * mx
        return (ww * (ly[:, None] - c[:, :, None] + a[:, :, None] * x) ** 2).sum(axis=2), a, c

    k = fit(np.broadcast_to(_BETAS, (len(y), len(_BETAS))))[0].argmin(axis=1)
    low, high = _BETAS[np.maximum(0, k - 1)], _BETAS[np.minimum(len(_BETAS) - 1, k + 1)]
    for _ in range(60):
        m1, m2 = low + 0.382 * (high - low), low + 0.618 * (high - low)
        left = np.less(*fit(np.stack((m1, m2), axis=1))[0].T)
        low, high = np.where(left, low, m1), np.where(left, m2, high)
    beta = (low + high) / 2
    _, a, c = (v[:, 0] for v in fit(beta[:, None]))
    out = []
    for i in range(len(y)):
        plain = np.corrcoef(lr, ly[i])[0, 1] ** 2 if np.ptp(ly[i]) > 0 else 0.0
        rest, spread = (w * (ly[i] - c[i] + a[i] * np.log(rank + beta[i])) ** 2).sum(), (w * (ly[i] - np.average(ly[i], weights=w)) ** 2).sum()
        r2 = float(1 - rest / spread) if spread > 0 else 0.0
        out.append((float(a[i]), float(beta[i]), float(np.exp(c[i])), r2, max(0.0, r2 - float(plain))))
    return out


def weibull_shape(gaps: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood shape of gaps (origin 0), and r squared against the empirical distribution."""
    x = np.sort(gaps[gaps > 0].astype(float))
    if len(x) < 3:
        return 0.0, 0.0
    if np.ptp(x) == 0:
        return float("inf"), 0.0
    lx = np.log(x / x.max())
    mean, k = lx.mean(), 1.0
    for _ in range(100):
        p = np.exp(k * lx)
        q = p * lx
        s0, s1, s2 = p.sum(), q.sum(), (q * lx).sum()
        f = s1 / s0 - 1 / k - mean
        step = f / ((s2 * s0 - s1 * s1) / (s0 * s0) + 1 / (k * k))
        k = max(k - step, k / 4)
        if abs(step) < 1e-12 * k:
            break
    scale = x.max() * (np.exp(k * lx).mean()) ** (1 / k)
    seen = np.arange(1, len(x) + 1) / len(x)
    model = 1 - np.exp(-((x / scale) ** k))
    return float(k), float(1 - ((seen - model) ** 2).sum() / ((seen - seen.mean()) ** 2).sum())


def kleinberg(positions: np.ndarray, s: float = 2.0, gamma: float = 0.5) -> tuple[int, float]:
    """Bursts of a two-state automaton over gaps, and the share of gaps in the burst state."""
    g = np.diff(np.sort(positions)).astype(float)
    if len(g) < 2:
        return 0, 0.0
    rates = (len(g) / g.sum(), s * len(g) / g.sum())
    up = gamma * math.log(len(g))
    cost, back = [0.0, math.inf], []
    for x in g:
        emit = [-math.log(r) + r * x for r in rates]
        from0, from1 = cost[0] <= cost[1], cost[0] + up < cost[1]
        back.append((0 if from0 else 1, 0 if from1 else 1))
        cost = [min(cost) + emit[0], min(cost[0] + up, cost[1]) + emit[1]]
    state = int(cost[1] < cost[0])
    path = [state]
    for b in reversed(back[1:]):
        state = b[state]
        path.append(state)
    path = np.array(path[::-1])
    return int(((np.diff(path, prepend=0)) == 1).sum()), float(path.mean())


def gaussian_kde(values: np.ndarray, grid: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The density of values that occur ``counts`` times each, once where None."""
    counts = np.ones(len(values)) if counts is None else counts.astype(float)
    n = counts.sum()
    width = math.sqrt((counts * (values - (counts * values).sum() / n) ** 2).sum() / (n - 1)) * n**-0.2
    return np.exp(-0.5 * ((grid[:, None] - values) / width) ** 2) @ counts / (n * width * math.sqrt(2 * math.pi))
