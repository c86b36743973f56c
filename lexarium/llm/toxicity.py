"""Toxic spans by a linear-chain conditional random field, trained and applied in numpy.

Tokens carry the states clean and toxic.  A token's emission score is a sum of weights of its hashed
features (the word, its first 3 to 6 and last 3 bytes, its neighbours); a 2x2 table scores
neighbouring states.  Document labels become token labels where a feature's documents are toxic beyond
chance.  Forward-backward marginals of whole documents give the toxic tokens with their byte offsets; their
sum and maximum give the document's score through a logistic curve fitted to the document labels.

Null and empty texts have no tokens and get the curve's value at zero.  Without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import _BASE, _BYTE, _INV, LOWER, Words, _power, mix, slices, split_words, string_buffers
from ._spark import prepare

#: Tokens are runs of ASCII letters and digits and of all bytes of non-ASCII characters.
SEPARATOR = np.ones(256, bool)
SEPARATOR[48:58] = SEPARATOR[97:123] = SEPARATOR[65:91] = SEPARATOR[128:] = False

BITS = 18
CUTS = (3, 4, 5, 6)
#: A feature marks toxic tokens if chance gives its documents' labels at most this probability.
CHANCE = 1e-5
#: Parts of a long text that a field learns from.
STRETCHES = 8


def features(words: Words) -> np.ndarray:
    """Hashed features of each word: the whole, prefixes of CUTS bytes, a suffix of 3.  Column 0 is the word's full hash."""
    n = len(words.buf)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[words.buf] * _power("up", _BASE, n), out=total[1:])
    down = _power("down", _INV, n + 1)
    size = words.end - words.start
    span = lambda a, b, seed: mix((total[b] - total[a]) * down[a] + np.uint64(seed))
    out = [span(words.start, words.end, 0)]
    out += [np.where(size >= k, span(words.start, np.minimum(words.start + k, words.end), k), np.uint64(0)) for k in CUTS]
    out.append(np.where(size >= 3, span(np.maximum(words.end - 3, words.start), words.end, 77), np.uint64(0)))
    return np.stack(out, axis=1)


def chain_marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, begin: np.ndarray, lanes: int = 512) -> np.ndarray:
    """Probability of state 1 at each token of consecutive documents, by forward and backward passes.

    The tokens are cut into lanes that advance side by side: a first pass finds each lane's 2x2 transfer
    matrix, the matrices are chained, and a second pass fills in the messages.  A document's first token resets the chain.
    """
    n = len(emission)
    if not n:
        return np.zeros(0)
    length = -(-n // lanes)
    pad = length * lanes
    e = np.ones((pad, 2))
    e[:n, 1] = np.exp(np.clip(emission, -30, 30))
    fresh = np.zeros(pad + 1, bool)
    fresh[first[:-1][np.diff(first) > 0]] = True
    fresh[n:] = True
    T, B = np.exp(trans), np.exp(begin)
    e, head = e.reshape(lanes, length, 2), fresh[:pad].reshape(lanes, length)
    tail = fresh[1:].reshape(lanes, length)

    def advance(state, t):  # state: lanes x ... x 2, messages over states
        out = state @ T
        if head[:, t].any():
            out[head[:, t]] = state[head[:, t]].sum(axis=-1, keepdims=True) * B
        out = out * (e[:, t] if out.ndim == 2 else e[:, t, None, :])
        return out / out.sum(axis=tuple(range(1, out.ndim)), keepdims=True)

    def retreat(state, t):
        out = state * (e[:, t] if state.ndim == 2 else e[:, t, None, :])
        new = out @ T.T
        if head[:, t].any():
            new[head[:, t]] = (out[head[:, t]] @ B)[..., None] * np.ones(2)
        return new / new.sum(axis=tuple(range(1, new.ndim)), keepdims=True)

    eye = np.broadcast_to(np.eye(2), (lanes, 2, 2)).copy()
    moved = eye
    for t in range(length):
        moved = advance(moved, t)
    entry, state = np.empty((lanes, 2)), np.ones(2)
    for k in range(lanes):
        entry[k] = state
        state = state @ moved[k]
        state /= state.sum()
    forward, state = np.empty((lanes, length, 2)), entry
    for t in range(length):
        state = advance(state, t)
        forward[:, t] = state
    moved = eye
    for t in range(length - 1, -1, -1):
        moved = retreat(moved, t)
    entry, state = np.empty((lanes, 2)), np.ones(2)
    for k in range(lanes - 1, -1, -1):
        entry[k] = state
        state = state @ moved[k]
        state /= state.sum()
    both, state = np.empty((lanes, length)), entry
    for t in range(length - 1, -1, -1):
        m = forward[:, t] * np.where(tail[:, t, None], 1.0, state)
        both[:, t] = m[:, 1] / m.sum(axis=1)
        state = retreat(state, t)
    return both.reshape(-1)[:n]


class ToxicCRF:
    def __init__(self):
        self.weight = np.zeros(1 << BITS, np.float32)
        self.bias, self.trans, self.begin = -4.0, np.zeros((2, 2)), np.zeros(2)
        self.curve = np.zeros(3)

    @staticmethod
    def slots(f: np.ndarray) -> np.ndarray:
        out = (f % np.uint64((1 << BITS) - 1)).astype(np.int64) + 1
        out[f == 0] = 0
        return out

    def emission(self, f: np.ndarray, which: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of state 1 over state 0 of each token: ``f`` has the features of distinct words, ``which`` each token's word."""
        own = self.weight[self.slots(f)].sum(axis=1)
        word = f[:, 0]
        left = self.weight[self.slots(mix(word + np.uint64(1001)))]
        right = self.weight[self.slots(mix(word + np.uint64(1002)))]
        out = own[which] + self.bias
        inner = np.ones(len(which), bool)
        inner[first[:-1][first[:-1] < len(which)]] = False
        out[1:] += np.where(inner[1:], left[which[:-1]], 0)
        out[:-1] += np.where(inner[1:], right[which[1:]], 0)
        return out.astype(np.float64)

    def marginals(self, words: Words) -> np.ndarray:
        _, where, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        few = Words(words.buf, words.start[where], words.end[where], np.array([0, len(where)]))
        return chain_marginals(self.emission(features(few), which, words.first), words.first, self.trans, self.begin)

    @staticmethod
    def summary(m: np.ndarray, first: np.ndarray) -> np.ndarray:
        """1, log(1 + expected toxic tokens) and the largest marginal of each document; marginals under a half count as none."""
        high = np.where(m >= 0.5, m, 0)
        run = np.concatenate(([0], np.cumsum(high)))
        top = np.zeros(len(first) - 1)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            top[full] = np.maximum.reduceat(m, first[full])
        return np.stack((np.ones(len(top)), np.log1p(run[first[1:]] - run[first[:-1]]), top), axis=1)

    def scores(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.curve, -30, 30)))

    def fit(self, f: np.ndarray, which: np.ndarray, first: np.ndarray, toxic: np.ndarray, epochs: int = 6, seed: int = 3) -> None:
        """Token labels from document labels, then the chain's likelihood by Adagrad, then the document curve.

        ``f`` has the features of distinct words, ``which`` each token's word, ``first`` the first token of each document.
        """
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        bad, good = int(toxic.sum()), int(len(toxic) - toxic.sum())
        if not bad or not good:
            self.curve[:] = (-30.0, 0, 0)
            return
        label = np.zeros(len(which), bool)
        for c in range(f.shape[1] - 1):
            _, once = np.unique(mix(f[:, c])[which] + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
            value, at = np.unique(f[which[once], c], return_inverse=True)
            a = np.bincount(at, weights=toxic[doc[once]], minlength=len(value))
            b = np.bincount(at, minlength=len(value)) - a
            rate = bad / (bad + good)
            chance = a * np.log(rate) + b * np.log1p(-rate) + np.where(b > 0, b * np.log((a + b) / np.maximum(b, 1)) + a * np.log((a + b) / np.maximum(a, 1)), 0)
            marked = value[(chance < np.log(CHANCE)) & (a * good > 50 * b * bad) & (value > 0)]
            label |= np.isin(f[:, c], marked)[which]
        label &= toxic[doc]
        slots = self.slots(f)
        around = np.stack((self.slots(mix(f[:, 0] + np.uint64(1001))), self.slots(mix(f[:, 0] + np.uint64(1002)))), axis=1)
        # Stretches of 24 tokens of one document: all that have a toxic token, and four times as many others.
        size = 24
        begins = np.concatenate([np.arange(a, b, size) for a, b in zip(first[:-1], first[1:], strict=True) if b > a] or [np.zeros(0, int)])
        ends = np.minimum(begins + size, first[doc[begins] + 1])
        run = np.concatenate(([0], np.cumsum(label)))
        hot = run[ends] > run[begins]
        rng = np.random.default_rng(seed)
        cold = rng.permutation(np.flatnonzero(~hot))[: 4 * hot.sum() + 2000]
        rows = np.concatenate((np.flatnonzero(hot), cold))
        store = {k: np.full(v, 1e-3) for k, v in (("w", 1 << BITS), ("t", (2, 2)), ("s", 2), ("b", 1))}
        for _ in range(epochs):
            rng.shuffle(rows)
            for k in range(0, len(rows), 256):
                pick = rows[k : k + 256]
                at = begins[pick][:, None] + np.arange(size)
                ok = at < ends[pick][:, None]
                at[~ok] = 0
                word = which[at]
                before, after = np.roll(word, 1, axis=1), np.roll(word, -1, axis=1)
                s = self.weight[slots[word]].sum(axis=2) + self.bias
                s[:, 1:] += self.weight[around[before, 0]][:, 1:]
                s[:, :-1] += np.where(ok[:, 1:], self.weight[around[after, 1]][:, :-1], 0)
                m, pair = self._expect(s, ok)
                y = np.where(ok, label[at], 0).astype(float)
                g = np.where(ok, m - y, 0)
                gt = pair - np.einsum("bti,btj->ij", np.stack((1 - y, y), 2)[:, :-1] * ok[:, 1:, None], np.stack((1 - y, y), 2)[:, 1:])
                gs = np.array([(1 - m[:, 0]).sum() - (1 - y[:, 0]).sum(), m[:, 0].sum() - y[:, 0].sum()])
                gw = np.bincount(slots[word].ravel(), np.repeat(g.ravel(), slots.shape[1]), 1 << BITS)
                gw += np.bincount(around[before, 0][:, 1:].ravel(), g[:, 1:].ravel(), 1 << BITS)
                gw += np.bincount(around[after, 1][:, :-1].ravel(), np.where(ok[:, 1:], g[:, :-1], 0).ravel(), 1 << BITS)
                gw[0] = 0
                for name, grad in (("w", gw), ("t", gt), ("s", gs), ("b", np.array([g.sum()]))):
                    store[name] += grad * grad
                    step = 0.15 * grad / np.sqrt(store[name])
                    if name == "w":
                        self.weight -= step.astype(np.float32)
                    elif name == "t":
                        self.trans -= step
                    elif name == "s":
                        self.begin -= step
                    else:
                        self.bias -= float(step[0])
        x = self.summary(chain_marginals(self.emission(f, which, first), first, self.trans, self.begin), first)
        theta = np.zeros(3)
        for _ in range(40):  # Newton with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            grad = x.T @ (p - toxic) + 0.05 * theta
            theta -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(3), grad)
        self.curve = theta

    def _expect(self, s: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of state 1, and summed marginals of neighbouring states, for padded stretches."""
        e = np.stack((np.ones_like(s), np.exp(np.clip(s, -30, 30))), axis=2).astype(float)
        e[~ok] = 1.0
        T, n = np.exp(self.trans), s.shape[1]
        alpha = np.empty_like(e)
        a = np.exp(self.begin) * e[:, 0]
        alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, n):
            a = (alpha[:, t - 1] @ T) * e[:, t]
            a /= a.sum(axis=1, keepdims=True)
            alpha[:, t] = np.where(ok[:, t, None], a, alpha[:, t - 1])
        beta = np.ones_like(e)
        pair = np.zeros((2, 2))
        for t in range(n - 2, -1, -1):
            out = e[:, t + 1] * beta[:, t + 1]
            joint = alpha[:, t, :, None] * T * out[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pair += joint[ok[:, t + 1]].sum(axis=0)
            b = out @ T.T
            beta[:, t] = np.where(ok[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
        m = alpha * beta
        return m[:, :, 1] / m.sum(axis=2), pair


def stretches(text: Column, most: int) -> Column:
    """``text``, or STRETCHES evenly spread parts of it, of ``most`` characters in all, where it is longer; each part is a line of its own."""
    size = most // STRETCHES
    room = F.length(text) - size
    parts = [F.substring(text, F.floor(k * room / (STRETCHES - 1)).cast("int") + 1, F.lit(size)) for k in range(STRETCHES)]
    return F.when(F.length(text) <= most, text).otherwise(F.concat_ws("\n", *parts))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 1200, max_chars: int = 8_000) -> ToxicCRF:
    """A field fitted in one task on a bounded sample of the labelled rows; the driver gets its weights only.

    About ``per_label`` toxic and three times as many clean ids are drawn from ``labels`` by a hash of the id, so that every run draws the same; that list
    is broadcast, so only the texts of the sample are shuffled.  Of a text of more than ``max_chars`` characters, STRETCHES stretches of ``max_chars`` in all are learnt from, spread
    evenly from its first character to its last.
    """
    prepare(docs.sparkSession)
    rows = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and k is not null")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    crf = ToxicCRF()
    crf.curve[:] = (-30.0, 0, 0)
    if len(sizes) < 2:
        return crf
    draw = F.pmod(F.xxhash64("k", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("y") == 1, per_label / sizes[1]).otherwise(3 * per_label / sizes[0])
    drawn = rows.where(draw < share)
    texts = docs.select(F.col(id_col).alias("own_k"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    learnt = texts.join(F.broadcast(drawn), F.col("own_k") == F.col("k")).select("k", stretches(F.col("t"), max_chars).alias("t"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fitted(pa.Table.from_batches(held).to_pandas()))], pa.binary())], names=["field"])

    found = learnt.repartition(1).mapInArrow(run, "field binary").collect()
    return pickle.loads(found[0]["field"]) if found else crf


def _fitted(picked: pd.DataFrame) -> ToxicCRF:
    """The field of a sample of (k: id, t: text, y: label), the same in whatever order its rows come."""
    crf = ToxicCRF()
    picked = picked.sort_values(["k", "y", "t"], kind="stable")
    if picked["y"].nunique() < 2:
        crf.curve[:] = (-30.0, 0, 0)
        return crf
    texts = [t.encode() for t in picked["t"]]
    body, offsets = LOWER[np.frombuffer(b"".join(texts), np.uint8)], np.cumsum([0] + [len(t) for t in texts])
    toxic = picked["y"].to_numpy() == 1
    del texts, picked
    # Features of distinct words only, and each token's hash.
    known, hashes, counts = [np.zeros((0, len(CUTS) + 2), np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in slices(offsets):
        words = split_words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SEPARATOR)
        hashes.append(words.hashes())
        counts.append(words.counts)
        _, where = np.unique(hashes[-1], return_index=True)
        known.append(features(Words(words.buf, words.start[where], words.end[where], np.array([0, len(where)]))))
    known, hashes = np.concatenate(known), np.concatenate(hashes)
    known = known[np.unique(known[:, 0], return_index=True)[1]]
    crf.fit(known, np.searchsorted(known[:, 0], hashes).astype(np.int32), np.cumsum(np.concatenate(counts)), toxic)
    return crf


def score(docs: DataFrame, crf: ToxicCRF, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, **extra: Column) -> DataFrame:
    """Rows of (id, extra columns, score), one for each row of ``docs``; with ``spans`` also an array of (begin, end, probability) in bytes of the UTF-8 text.

    Runs of toxic tokens (marginal at least a half) are spans.  Only the text is looked at; nothing is shuffled.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias(id_col), *[c.alias(k) for k, c in extra.items()], F.col(text_col).alias("own_text"))
    kept = source.schema.fields[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double" + (", spans array<struct<begin:int,end:int,probability:double>>" if spans else "")
    names = [f.name for f in kept] + ["score"] + ["spans"] * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = string_buffers(batch.column(len(kept)))
            for i, j in slices(offsets):
                own = offsets[i : j + 1] - offsets[i]
                words = split_words(LOWER[body[offsets[i] : offsets[j]]], own, SEPARATOR)
                m = crf.marginals(words)
                out = [*(batch.column(k)[i:j] for k in range(len(kept))), pa.array(crf.scores(crf.summary(m, words.first)))]
                if spans:
                    found = [[] for _ in range(j - i)]
                    doc, last = words.doc(), -2
                    for t in np.flatnonzero(m >= 0.5).tolist():
                        d = doc[t]
                        if t == last + 1 and found[d]:
                            found[d][-1] |= {"end": int(words.end[t] - own[d]), "probability": max(found[d][-1]["probability"], float(m[t]))}
                        else:
                            found[d].append({"begin": int(words.start[t] - own[d]), "end": int(words.end[t] - own[d]), "probability": float(m[t])})
                        last = t
                    out.append(pa.array(found, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return source.mapInArrow(run, schema)
