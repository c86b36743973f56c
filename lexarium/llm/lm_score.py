"""Document scores of a log-bilinear neural language model, beside an add-one unigram base.

Counts cover every token of every training document: words are counted in the tasks, summed by word and kept as a
table.  The model's outcomes are the most frequent words, the end, and classes of all other words (by
their last two bytes); a word of a class follows its smoothed count within the class, so the whole is one
distribution over words.  A context is two embedded outcomes, each weighted element by element; the model is trained in
numpy by noise-contrastive estimation, with noise from the outcomes' counts, on every token of every training document:
outcomes are dealt by a hash of their document, each task goes on from the common weights over its share, and the weights
are averaged by tokens.  Up to ``CHUNK`` tokens one task makes several passes, above that there is one pass in rounds of growing
shares.  Scoring multiplies the distinct contexts of a batch with all outcomes at once to get exact normalisers.

The ``HEAVY`` most frequent words (a fixed number) go to the tasks; the other words of each document
are joined with the count table by a shuffle, so no limit on the vocabulary is assumed.

Null and empty texts consist of the end alone.  Repeated rows and ids are scored one by one.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, Words, slices, split_words, string_buffers
from ._spark import Cuts, prepare

#: Words with an outcome of their own, besides the end.
FREQUENT = 511
CLASSES = 64
HEAVY = 1 << 17
SLICE = 4 << 20
#: Tokens that a task shuffles and learns from at once, and about what it gets in a round.
CHUNK = 1 << 21
#: Sixteenths of the training documents that have been learnt from after each round.
ROUNDS = (1, 2, 4, 8, 16)
#: Groups of tasks whose weights are averaged before the driver gets them.
GROUPS = 16


def word_class(words: Words) -> np.ndarray:
    last = words.buf[words.end - 1].astype(np.int64)
    size = words.end - words.start
    before = np.where(size > 1, words.buf[np.maximum(words.end - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before * 7) % CLASSES


def _strings(words: Words, which: np.ndarray) -> pa.Array:
    start, size = words.start[which], words.end[which] - words.start[which]
    ends = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    return pa.StringArray.from_buffers(len(which), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(words.buf[index].tobytes()))


def hash_words(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    size = np.array([len(t) for t in raw], np.int64)
    end = np.cumsum(size)
    return Words(np.frombuffer(b"".join(raw), np.uint8), end - size, end, np.array([0, len(raw)])).hashes()


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of (word, class, n): counts of all words, and of ends under the empty word.  Summed in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = string_buffers(batch.column(0))
            for i, j in slices(offsets, SLICE):
                w = split_words(LOWER[body[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
                _, where, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                few = Words(w.buf, w.start[where], w.end[where], w.first)
                words = pa.concat_arrays([_strings(w, where), pa.array([""])])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(word_class(few), -1).astype(np.int32)), pa.array(np.append(n, j - i).astype(np.int64))], names=["word", "class", "n"])

    return docs.select(text_col).mapInArrow(run, "word string, class int, n bigint").groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


class LogBilinear:
    """Outcomes: 0 the end, 1 to f the frequent words, then the classes; as contexts also one more, the beginning."""

    def __init__(self, weights: np.ndarray, dim: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        v = len(weights)
        self.v, self.begin = v, v
        self.noise = (weights + 1.0) / (weights + 1.0).sum()
        self.E = rng.normal(0, 0.1, (v + 1, dim)).astype(np.float32)
        self.C = np.stack((np.ones(dim), 0.5 * np.ones(dim))).astype(np.float32)
        self.R = rng.normal(0, 0.1, (v, dim)).astype(np.float32)
        self.b = np.log(self.noise).astype(np.float32)
        self.store = {k: np.full_like(getattr(self, k), 1e-4) for k in ("E", "C", "R", "b")}

    def state(self) -> np.ndarray:
        """All weights and Adagrad's sums in one array."""
        return np.concatenate([x.ravel() for k in self.store for x in (getattr(self, k), self.store[k])])

    def restore(self, state: np.ndarray) -> None:
        at = 0
        for k in self.store:
            for x in (getattr(self, k), self.store[k]):
                x[...] = state[at : at + x.size].reshape(x.shape)
                at += x.size

    def query(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.E[one] * self.C[0] + self.E[two] * self.C[1]

    def fit(self, out: np.ndarray, one: np.ndarray, two: np.ndarray, passes: int = 1, batch: int = 2048, noise: int = 256, rate: float = 0.15, seed: int = 9) -> None:
        """Noise-contrastive estimation over all examples, with the noise words of a step shared by its examples; Adagrad."""
        rng = np.random.default_rng(seed)
        store = self.store
        log_kp = np.log(noise * self.noise).astype(np.float32)

        def descend(name: str, grad: np.ndarray) -> None:
            store[name] += grad * grad
            p = getattr(self, name)
            p -= rate * grad / np.sqrt(store[name])

        def spread(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
            order = np.argsort(rows, kind="stable")
            r = rows[order]
            cut = np.flatnonzero(np.diff(r, prepend=-1))
            g = np.zeros((n, values.shape[1]), np.float32)
            g[r[cut]] = np.add.reduceat(values[order], cut, axis=0)
            return g

        def steps() -> Iterator[np.ndarray]:
            for _ in range(passes):
                order = rng.permutation(np.arange(len(out), dtype=np.uint32))
                yield from (order[k : k + batch] for k in range(0, len(order), batch))

        for at in steps():
            w, c1, c2 = out[at], one[at], two[at]
            z = rng.choice(self.v, noise, p=self.noise)
            e1, e2 = self.E[c1], self.E[c2]
            q = e1 * self.C[0] + e2 * self.C[1]
            true = (q * self.R[w]).sum(axis=1) + self.b[w] - log_kp[w]
            fake = q @ self.R[z].T + self.b[z] - log_kp[z]
            gt = (-1 / (1 + np.exp(np.clip(true, -30, 30))) / len(at)).astype(np.float32)
            gf = (1 / (1 + np.exp(-np.clip(fake, -30, 30))) / len(at)).astype(np.float32)
            gq = gt[:, None] * self.R[w] + gf @ self.R[z]
            gr = spread(np.concatenate((w, z)), np.concatenate((gt[:, None] * q, gf.T @ q)), self.v)
            gb = np.bincount(np.concatenate((w, z)), np.concatenate((gt, gf.sum(axis=0))), self.v).astype(np.float32)
            ge = spread(np.concatenate((c1, c2)), np.concatenate((gq * self.C[0], gq * self.C[1])), self.v + 1)
            descend("C", np.stack(((gq * e1).sum(axis=0), (gq * e2).sum(axis=0))))
            descend("E", ge)
            descend("R", gr)
            descend("b", gb)

    def log_probability(self, out: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural logarithms; each distinct context is normalised over all outcomes once."""
        key, which = np.unique(one.astype(np.int64) * (self.v + 1) + two, return_inverse=True)
        q = self.query(key // (self.v + 1), key % (self.v + 1))
        log_z = np.empty(len(key), np.float32)
        for k in range(0, len(key), 1024):
            s = q[k : k + 1024] @ self.R.T
            s += self.b
            top = s.max(axis=1)
            s -= top[:, None]
            np.exp(s, out=s)
            log_z[k : k + 1024] = top + np.log(s.sum(axis=1))
        got = np.empty(len(out))
        for k in range(0, len(out), 1 << 16):
            part = slice(k, k + (1 << 16))
            got[part] = np.einsum("ij,ij->i", q[which[part]], self.R[out[part]]) + self.b[out[part]] - log_z[which[part]]
        return got


def stream(which_id: np.ndarray, first: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Outcomes with an end after each document, their two contexts, and the first token of each document."""
    n = np.diff(first) + 1
    at = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(at[-1], np.int64)
    inner = np.ones(at[-1], bool)
    inner[at[1:] - 1] = False
    out[inner] = which_id
    return out, *contexts(out, at, begin), at


def contexts(out: np.ndarray, at: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The outcomes one and two places before each, in documents that begin at ``at[:-1]``."""
    one = np.concatenate((np.array([begin], out.dtype), out[:-1]))
    one[at[:-1]] = begin
    two = np.concatenate((np.array([begin], out.dtype), one[:-1]))
    two[at[:-1]] = begin
    return one, two


def look_up(w: Words, heavy: tuple, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a batch: index of each token's word, outcome, count or -1 where only the table has it, and where each word is."""
    h, where, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    outcome = 1 + f + word_class(Words(w.buf, w.start[where], w.end[where], w.first))
    n = np.full(len(h), -1)
    if len(heavy[0]):
        at = np.minimum(np.searchsorted(heavy[0], h), len(heavy[0]) - 1)
        known = heavy[0][at] == h
        n[known] = heavy[1][at[known]]
        own = known & (heavy[2][at] > 0)
        outcome[own] = heavy[2][at[own]]
    return which, outcome, n, where


def encode(docs: DataFrame, heavy: tuple, f: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of (draw, outcomes): the outcomes of each document with its end, two bytes each, and a hash of id and outcomes."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = string_buffers(batch.column(1))
            for i, j in slices(offsets, SLICE):
                w = split_words(LOWER[body[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
                which, outcome, _, _ = look_up(w, sent.value, f)
                out, _, _, at = stream(outcome[which], w.first, 0)
                data = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(out.astype(np.uint16))])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], data], names=["id", "outcomes"])

    rows = docs.select(F.xxhash64(id_col).alias("id"), text_col).mapInArrow(run, "id bigint, outcomes binary")
    return rows.select(F.xxhash64("id", "outcomes").alias("draw"), "outcomes")


def learn(model: LogBilinear, encoded: DataFrame, workers: int, passes: int = 1) -> int:
    """Go on from the model's weights over all of ``encoded`` in about ``workers`` tasks, and average what they learnt by tokens; returns the tokens."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = copy.deepcopy(sent.value)
        parts, held, seen, first = [], 0, 0, None

        def fit() -> None:
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            own.fit(*columns, passes=passes, seed=9 + seen // CHUNK)

        for batch in batches:
            body, offsets = string_buffers(batch.column(1))
            for i, j in slices(offsets, CHUNK):
                first = batch.column(0)[i].as_py() if first is None else first
                out, at = np.frombuffer(body[offsets[i] : offsets[j]].tobytes(), np.uint16), (offsets[i : j + 1] - offsets[i]) // 2
                parts.append((out, *contexts(out, at, own.begin)))
                held += len(out)
                if held >= CHUNK and passes == 1:
                    fit()
                    parts, held, seen = [], 0, seen + held
        if held:
            fit()
            seen += held
        if seen:
            yield pa.RecordBatch.from_pydict({"worker": pa.array([first], pa.int64()), "tokens": pa.array([seen], pa.int64()), "state": pa.array([own.state().astype(np.float64).tobytes()], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["worker"])
        total = sum(r["tokens"] for r in rows)
        mean = sum(np.frombuffer(r["state"]) * (r["tokens"] / total) for r in rows)
        return pa.table({"worker": pa.array([rows[0]["worker"]], pa.int64()), "tokens": pa.array([total], pa.int64()), "state": pa.array([mean.tobytes()], pa.binary())})

    schema = "worker bigint, tokens bigint, state binary"
    # Sorted by the hash, so that neither the files' layout nor the order of arrival decides what is learnt.
    states = encoded.repartition(workers, "draw").sortWithinPartitions("draw").mapInArrow(run, schema)
    table = states.groupBy(F.pmod("worker", F.lit(GROUPS))).applyInArrow(merge, schema).toArrow()
    if not table.num_rows:
        return 0
    whole = merge(table).to_pylist()[0]
    model.restore(np.frombuffer(whole["state"]))
    return whole["tokens"]


def train(model: LogBilinear, encoded: DataFrame, tokens: int) -> int:
    """Learn from every outcome of ``encoded``, ``tokens`` in all; returns how many were learnt from."""
    if tokens <= CHUNK:
        return learn(model, encoded, 1, passes=max(1, round(min(300, 10 + 400_000 / tokens, 5_000_000 / tokens))))
    part, done, before = F.pmod("draw", F.lit(ROUNDS[-1])), 0, 0
    for upto in ROUNDS:
        share = tokens * (upto - before) // ROUNDS[-1]
        done += learn(model, encoded.where((part >= before) & (part < upto)), 1 + share // CHUNK)
        before = upto
    return done


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", **extra: Column) -> DataFrame:
    """One row per row of ``docs``: id, extra columns, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` says which rows are learnt from: counts and neural weights cover every token of them.
    """
    spark = prepare(docs.sparkSession)
    cuts = Cuts(spark, "lm")
    chosen = docs.where(training)
    counts = cuts.cut(count_words(chosen, text_col), "counts")
    stats = {r["class"]: (r["n"], r["v"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    N, V = sum(n for n, _ in stats.values()), sum(v for _, v in stats.values())
    # The least count (of 16 steps to a doubling) that at most HEAVY words reach.
    level = F.floor(F.log2("n") * 16).cast("int")
    seen, cut = 0, None
    for r in counts.where("word <> ''").groupBy(level.alias("level")).agg(F.count("*").alias("v")).orderBy(F.desc("level")).collect():
        seen += r["v"]
        if seen > HEAVY:
            break
        cut = r["level"]
    top = counts.where("word <> ''").where(level >= (1 << 30 if cut is None else cut)).select("word", "class", "n").toPandas().sort_values(["n", "word"], ascending=[False, True], kind="stable")
    top_hash = hash_words(list(top["word"]))
    top_n, top_class = top["n"].to_numpy(), top["class"].to_numpy()
    ends = stats.get(-1, (0, 0))[0]
    f = min(FREQUENT, len(top))
    class_n = np.array([stats.get(k, (0, 0))[0] for k in range(CLASSES)], float) - np.bincount(top_class[:f], top_n[:f], CLASSES)
    class_v = np.array([stats.get(k, (0, 0))[1] for k in range(CLASSES)], float) - np.bincount(top_class[:f], minlength=CLASSES)
    model = LogBilinear(np.concatenate(([ends], top_n[:f], class_n)))
    order = np.argsort(top_hash)
    heavy = (top_hash[order], top_n[order], np.where(order < f, order + 1, 0))

    if N:
        train(model, cuts.cut(encode(chosen, heavy, f, id_col, text_col), "outcomes"), int(N))
        cuts.drop("outcomes")
    model.store = {}
    log_within = np.log10(class_n + class_v + 1)
    sent = spark.sparkContext.broadcast((model, heavy, log_within))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias(id_col), *[c.alias(k) for k, c in extra.items()], F.col(text_col).alias("own_text"))
    kept = source.schema.fields[1:-1]
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in kept)
    schema = f"row bigint, {fields}, n_tokens bigint, known bigint, model double, logs double, word string, tf bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, heavy, log_within = sent.value
        names = [x.split()[0].strip("`") for x in schema.split(", ")]
        for batch in batches:
            body, offsets = string_buffers(batch.column(len(kept) + 1))
            for i, j in slices(offsets, SLICE):
                w = split_words(LOWER[body[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
                which, outcome, n, where = look_up(w, heavy, f)
                out, one, two, at = stream(outcome[which], w.first, model.begin)
                log_p = model.log_probability(out, one, two) / np.log(10)
                within = np.where(outcome > f, -log_within[np.maximum(outcome - 1 - f, 0)], 0.0)
                run_p = np.concatenate(([0], np.cumsum(log_p)))
                per_doc = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[w.first[1:]] - c[w.first[:-1]]
                log_n = np.where(n >= 0, np.log10(np.maximum(n, 0) + 1.0), 0.0)
                frequent = (outcome <= f)[which]
                model_sum = run_p[at[1:]] - run_p[at[:-1]] + per_doc(within[which] + np.where(frequent, 0.0, log_n[which]))
                base_logs = per_doc(log_n[which]) + np.log10(ends + 1.0)
                rows = batch.column(0)[i:j]
                head = [rows, *(batch.column(1 + k)[i:j] for k in range(len(kept)))]
                own_key = pa.array([f"\t{r}" for r in rows.to_pylist()])
                known = per_doc(n[which] > 0) + (1 if ends else 0)
                zero = np.zeros(j - i, np.int64)
                yield pa.RecordBatch.from_arrays([*head, pa.array(w.counts + 1), pa.array(known.astype(np.int64)), pa.array(model_sum), pa.array(base_logs), own_key, pa.array(zero)], names=names)
                rest = np.flatnonzero((n < 0)[which])
                if len(rest):
                    doc = w.doc()[rest]
                    pair, tf = np.unique(doc * len(n) + which[rest], return_counts=True)
                    doc, word = pair // len(n), pair % len(n)
                    m = len(pair)
                    fill = [rows.take(pa.array(doc)), *(pa.nulls(m, c.type) for c in head[1:])]
                    zeros = [pa.array(np.zeros(m, np.int64))] * 2 + [pa.array(np.zeros(m))] * 2
                    yield pa.RecordBatch.from_arrays([*fill, *zeros, _strings(w, where[word]), pa.array(tf.astype(np.int64))], names=names)

    scored = source.mapInArrow(run, schema)
    table = counts.select(F.col("word").alias("table_word"), F.col("n").alias("table_n"))
    n = F.coalesce(F.col("table_n"), F.lit(0))
    rare = F.col("tf") * F.log10(n + 1)
    joined = scored.join(table, F.col("word") == F.col("table_word"), "left")
    own = F.col("tf") == 0
    total = joined.groupBy("row").agg(
        *[F.max(F.when(own, F.col(f"`{x.name}`"))).alias(x.name) for x in kept],
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(n > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum("model").alias("model"),
        F.sum("logs").alias("logs"),
        F.sum(rare).alias("rare"),
    )
    base = F.col("logs") + F.col("rare") - F.col("n_tokens") * float(np.log10(N + V + 1.0))
    value = F.col("model") + F.col("rare") if N else base
    return total.select(*[F.col(f"`{x.name}`") for x in kept], "n_tokens", "n_known", F.lit(N).cast("long").alias("train_tokens"), base.alias("base_score"), value.alias("score"))
