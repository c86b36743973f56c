"""Language identification by a byte convolutional network, trained and applied in numpy.

A window of fixed length is a row of byte classes.  Filters of several widths slide over the embedded
classes, each filter's maximum over the window (max pooling, then ReLU) goes to a softmax over the
languages.  As an embedded byte has few values, a filter's response is a sum of table entries for pairs of
neighbouring classes, which is how windows are scored.  A document's distribution is the mean over all its windows, weighted by their letters.

Null texts and texts without a letter get ``und`` and score 0; so does everything if no labelled row can be learnt from.  Long texts
are read whole, window by window; repeated rows get equal results; of equal probabilities the label that sorts first wins; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import slices, string_buffers
from ._spark import prepare

WINDOW = 256
CLASSES = 140
WIDTHS = (2, 3, 4)

#: Byte classes: 0 other ASCII, 1-26 letters, 27 digits, 28 apostrophes, 29-92 the continuation bytes, 93-122 lead bytes of two-byte characters, 123-138 of three-byte, 139 of four-byte ones.
BYTE_CLASS = np.zeros(256, np.uint8)
BYTE_CLASS[97:123] = np.arange(1, 27)
BYTE_CLASS[65:91] = np.arange(1, 27)
BYTE_CLASS[48:58] = 27
BYTE_CLASS[39] = 28
BYTE_CLASS[0x80:0xC0] = np.arange(29, 93)
BYTE_CLASS[0xC2:0xE0] = np.arange(93, 123)
BYTE_CLASS[0xE0:0xF0] = np.arange(123, 139)
BYTE_CLASS[0xF0:] = 139


def windows(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of each text, as rows of byte classes padded with 0, and the first window of each text."""
    n = -(-np.diff(offsets) // WINDOW)
    first = np.concatenate(([0], np.cumsum(n)))
    doc = np.repeat(np.arange(len(n)), n)
    begin = offsets[doc] + (np.arange(first[-1]) - first[doc]) * WINDOW
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < offsets[doc + 1][:, None]
    at[~inside] = 0
    out = BYTE_CLASS[body[at]] if len(body) else np.zeros((0, WINDOW), np.uint8)
    out[~inside] = 0
    return out, first


class ByteConvNet:
    def __init__(self, languages: list[str], embed: int = 8, filters: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p: dict[str, np.ndarray] = {"embed": rng.normal(0, 0.5, (CLASSES, embed))}
        for w in WIDTHS:
            self.p[f"conv{w}"] = rng.normal(0, (w * embed) ** -0.5, (w, embed, filters))
            self.p[f"bias{w}"] = np.zeros(filters)
        self.p["out"] = rng.normal(0, 0.1, (filters * len(WIDTHS), len(languages)))
        self.p["out_bias"] = np.zeros(len(languages))
        self.tables()

    def tables(self) -> None:
        """Responses of each filter to pairs of classes; an odd last byte counts as a pair with nothing."""
        e = self.p["embed"]
        self.pair = {}
        for w in WIDTHS:
            parts = []
            for k in range(0, w, 2):
                one = e @ self.p[f"conv{w}"][k]
                two = e @ self.p[f"conv{w}"][k + 1] if k + 1 < w else np.zeros_like(one)
                parts.append((one[:, None, :] + two[None, :, :]).reshape(CLASSES * CLASSES, -1).astype(np.float32))
            self.pair[w] = parts

    def pooled(self, x: np.ndarray, where: bool = False):
        """The pooled activations of windows, and on request where each maximum was."""
        key = x[:, :-1].astype(np.int32) * CLASSES + x[:, 1:]
        key = np.concatenate((key, x[:, -1:].astype(np.int32) * CLASSES), axis=1)
        out, at = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            r = self.pair[w][0][key[:, :n]]
            for k, part in enumerate(self.pair[w][1:], 1):
                r += part[key[:, 2 * k : 2 * k + n]]
            if where:
                at.append(r.argmax(axis=1))
            out.append(np.maximum(r.max(axis=1) + self.p[f"bias{w}"].astype(np.float32), 0))
        return (np.concatenate(out, axis=1), at) if where else np.concatenate(out, axis=1)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 11) -> None:
        """Adam on the cross entropy; the gradient of a pooled filter goes to the bytes at its maximum."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for b in range(0, len(order), batch):
                rows = order[b : b + batch]
                xb = x[rows]
                pooled, at = self.pooled(xb, where=True)
                d = self.probabilities(pooled)
                d[np.arange(len(rows)), y[rows]] -= 1
                d /= len(rows)
                g = {"out": pooled.T @ d, "out_bias": d.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
                dp = (d @ self.p["out"].T) * (pooled > 0)
                filters = dp.shape[1] // len(WIDTHS)
                for k, w in enumerate(WIDTHS):
                    dw = dp[:, k * filters : (k + 1) * filters]
                    g[f"bias{w}"] = dw.sum(axis=0)
                    conv = self.p[f"conv{w}"]
                    gc = np.zeros_like(conv)
                    for j in range(w):
                        c = xb[np.arange(len(rows))[:, None], at[k] + j]
                        onto = np.zeros((CLASSES, filters))
                        np.add.at(onto, (c, np.arange(filters)[None, :]), dw)
                        gc[j] = self.p["embed"].T @ onto
                        g["embed"] += onto @ conv[j].T
                    g[f"conv{w}"] = gc
                t += 1
                for name, grad in g.items():
                    first[name] += 0.1 * (grad - first[name])
                    second[name] += 0.001 * (grad * grad - second[name])
                    self.p[name] -= rate * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)
                self.tables()

    def predict(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language index and its probability for each text."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        for i, j in slices(offsets, 1 << 20):
            x, first = windows(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(x):
                continue
            p = np.concatenate([self.probabilities(self.pooled(x[k : k + 64])) for k in range(0, len(x), 64)])
            p *= ((x > 0) & (x != 27)).sum(axis=1)[:, None] + 1e-6
            run = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)))
            total[i:j] = run[first[1:]] - run[first[:-1]]
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
        best = total.argmax(axis=1)
        return best, np.clip(total[np.arange(len(best)), best], 0, 1)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 2000, max_rows: int = 40_000) -> ByteConvNet | None:
    """A network for the languages of ``labelled``, fitted on the driver on a bounded sample.

    One window of each of about ``per_language`` texts a language, chosen by a hash of the id; with many languages fewer of
    each, about ``max_rows`` in all.  Every label is learnt.  Rows with a null label or text are not used.  None without rows.
    """
    rows = labelled.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("y")).where("t is not null and y is not null and t rlike '\\\\p{L}'")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    most = min(per_language, max(1, max_rows // len(sizes)))
    share = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(1.0, most / n))])
    draw = F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1_000_000)) / 1_000_000
    begin = F.pmod(F.xxhash64("k", F.lit(29)), F.greatest(F.length("t") - WINDOW, F.lit(1)))
    picked = rows.where(draw < F.element_at(share, F.col("y"))).select("k", "y", F.expr("t").substr((begin + 1).cast("int"), F.lit(WINDOW)).alias("t")).toPandas()
    picked = picked.sort_values(["k", "y", "t"], kind="stable")
    languages = sorted(set(picked["y"]))
    net = ByteConvNet(languages)
    texts = [t.encode() for t in picked["t"]]
    cut = [t[:WINDOW] for t in texts]
    x, _ = windows(np.frombuffer(b"".join(cut), np.uint8), np.cumsum([0] + [len(t) for t in cut]))
    y = picked["y"].map({v: i for i, v in enumerate(languages)}).to_numpy()[[len(t) > 0 for t in cut]]
    if len(languages) > 1:
        net.fit(x, y, epochs=max(4, min(40, 60_000 // max(1, len(x)))))
    return net


def identify(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text", **extra: Column) -> DataFrame:
    """Rows of (id, extra columns, lang_pred, score), one for each row of ``docs``.  Only the text is looked at; nothing is shuffled."""
    prepare(docs.sparkSession)
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    source = docs.select(F.col(id_col).alias(id_col), *[c.alias(k) for k, c in extra.items()], has_letter.alias("has_letter"), F.col(text_col).alias("own_text"))
    kept = [f for f in source.schema.fields if f.name not in ("has_letter", "own_text")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"
    names = [f.name for f in kept] + ["lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = [batch.column(i) for i in range(len(kept))]
            letter = np.asarray(batch.column(len(kept)))
            if net is None:
                best, score = np.zeros(len(letter), int), np.zeros(len(letter))
                letter = np.zeros(len(letter), bool)
            else:
                best, score = net.predict(*string_buffers(batch.column(len(kept) + 1)))
            label = np.where(letter, np.array([*(net.languages if net else ["und"])], object)[best], "und")
            yield pa.RecordBatch.from_arrays([*head, pa.array(label, pa.string()), pa.array(np.where(letter, score, 0.0))], names=names)

    return source.mapInArrow(run, schema)
