"""Embedding near-deduplication with hierarchical navigable small-world graphs.

Exact copies become one vector with a multiplicity.  The distinct vectors of a label are dealt into shards of bounded size; each shard
gets a graph of its own, built in batches.  Every vector queries every shard of its label with a beam search that
runs side by side for many queries.  A query whose beam is half full of hits gets a beam four times as wide, and a shard's beams are widened for all
until an audit of queries against brute force loses nothing; if the widest beam still does, brute force answers.  Hits are verified by cosine in double precision, counted, and
reduced to forests, from which components are united over all shards.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing.
Vectors of different lengths never link.  Rows with equal vec_id and different vectors are one vertex: each is counted as a link of others, they
share their links and one component.  Repeated rows are counted one by one.  An empty table gives none; ties can't arise, as ids alone choose.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Cuts, prepare
from .graph import components, smallest_labels

THRESHOLD = 0.98
SHARD = 16_384
#: Queries that meet one copy of a graph, and those of every AUDITED that are checked against brute force.
CHUNK = 32_768
LINKS = 16
BUILD_BEAM = 64
BEAM = 64
AUDITS = 48
AUDITED = 4_096


def _search(near: np.ndarray, unit: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``beam`` nodes for each query, best first, by expanding a sixteenth of the beam (4 at least) of every query at once; -1 where there are fewer."""
    b, n = len(q), len(unit)
    ids = np.full((b, beam), -1)
    sims = np.full((b, beam), -np.inf, np.float32)
    open_ = np.zeros((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)
    row = np.arange(b)
    ids[:, 0], sims[:, 0], open_[:, 0] = entry, (unit[entry] * q).sum(axis=1), True
    seen[row, entry] = True
    seen[:, n] = True
    live = row
    while len(live):
        score = np.where(open_[live], sims[live], -np.inf)
        w = min(max(4, beam // 16), beam)
        pick = np.argpartition(-score, w - 1, axis=1)[:, :w] if w < beam else np.tile(np.arange(beam), (len(live), 1))
        good = np.take_along_axis(score, pick, 1) > -np.inf
        some = good.any(axis=1)
        live, pick, good = live[some], pick[some], good[some]
        if not len(live):
            break
        nodes = np.where(good, ids[live[:, None], pick], n)
        open_[live[:, None], pick] = False
        new = np.where(nodes[:, :, None] < n, near[np.minimum(nodes, n - 1)], -1).reshape(len(live), -1)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[new < 0] = n
        fresh = ~seen[live[:, None], new]
        seen[live[:, None], new] = True
        got = np.full(new.shape, -np.inf, np.float32)
        r, c = np.nonzero(fresh)
        got[r, c] = np.einsum("ij,ij->i", unit[new[r, c]], q[live[r]])
        all_ids = np.concatenate((ids[live], np.where(fresh, new, -1)), axis=1)
        all_sims = np.concatenate((sims[live], got), axis=1)
        all_open = np.concatenate((open_[live], fresh), axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live], sims[live], open_[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_open))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(unit: np.ndarray, cand: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none), ``keep`` links: those nearer to the node than to a link already taken, then the nearest others."""
    out = np.full((len(cand), keep), -1)
    for k in range(0, len(cand), 512):
        c, s = cand[k : k + 512], sims[k : k + 512]
        v = unit[np.maximum(c, 0)]
        between = v @ v.transpose(0, 2, 1)
        taken = np.zeros(c.shape, bool)
        count = np.zeros(len(c), int)
        closest = np.full(c.shape, -np.inf, np.float32)
        for j in range(c.shape[1]):
            ok = (c[:, j] >= 0) & (s[:, j] > closest[:, j]) & (count < keep)
            taken[:, j] = ok
            count += ok
            closest = np.where(ok[:, None], np.maximum(closest, between[:, j]), closest)
        order = np.argsort(np.where(c < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :keep]
        got = np.take_along_axis(c, order, 1)
        out[k : k + 512, : got.shape[1]] = got
    return out


class Graph:
    """A layered graph over unit vectors; layer l holds the nodes of level l or more."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, seed: int = 1):
        self.vectors = vectors
        x = vectors.astype(np.float64)
        self.unit = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(links)).astype(int), 5)
        self.level[0] = top = int(self.level.max()) if n else 0
        self.near = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(top + 1)]
        self.degree = [np.zeros(n, int) for _ in self.near]
        done = 1
        while done < n:
            size = min(256, done, n - done) if done > 256 else min(n - done, 128)
            self._insert(np.arange(done, done + size), done, links)
            done += size

    def _insert(self, new: np.ndarray, done: int, links: int) -> None:
        q = self.unit[new]
        entry = np.zeros(len(new), int)
        inner = q @ q.T
        np.fill_diagonal(inner, -np.inf)
        for layer in range(len(self.near) - 1, -1, -1):
            own = self.level[new] >= layer
            if (~own).any():
                ids, _ = _search(self.near[layer], self.unit, q[~own], entry[~own], 4)
                entry[~own] = ids[:, 0]
            if not own.any():
                continue
            ids, sims = _search(self.near[layer], self.unit, q[own], entry[own], min(BUILD_BEAM, max(8, done)))
            entry[own] = ids[:, 0]
            mates = np.where(own[None, :], inner[own], -np.inf)
            m = min(links, mates.shape[1])
            best = np.argsort(-mates, axis=1)[:, :m]
            mate_sims = np.take_along_axis(mates, best, 1)
            cand = np.concatenate((ids, np.where(mate_sims > -np.inf, new[best], -1)), axis=1)
            sims = np.concatenate((sims, mate_sims.astype(np.float32)), axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")
            cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
            chosen = _diverse(self.unit, cand, sims, links)
            self._link(layer, np.repeat(new[own], chosen.shape[1]), chosen.ravel())

    def _link(self, layer: int, a: np.ndarray, b: np.ndarray) -> None:
        """Links a-b both ways; a full node keeps the more diverse of its old and new links."""
        ok = b >= 0
        src, dst = np.concatenate((a[ok], b[ok])), np.concatenate((b[ok], a[ok]))
        pair = np.unique(src.astype(np.int64) * len(self.unit) + dst)
        src, dst = pair // len(self.unit), pair % len(self.unit)
        near, width = self.near[layer], self.near[layer].shape[1]
        node, first, count = np.unique(src, return_index=True, return_counts=True)
        most = int(count.max()) if len(count) else 0
        for k in range(0, len(node), 1024):
            own, f, c = node[k : k + 1024], first[k : k + 1024], count[k : k + 1024]
            add = np.full((len(own), most), -1)
            at = np.arange(most)[None, :] < c[:, None]
            add[at] = dst[(f[:, None] + np.arange(most))[at]]
            cand = np.concatenate((near[own], add), axis=1)
            cand = np.sort(cand, axis=1)[:, ::-1]
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            sims = np.where(cand >= 0, np.einsum("ijk,ik->ij", self.unit[np.maximum(cand, 0)], self.unit[own]), -np.inf).astype(np.float32)
            order = np.argsort(-sims, axis=1, kind="stable")
            cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
            full = (cand >= 0).sum(axis=1) > width
            near[own[~full]] = cand[~full, :width]
            if full.any():
                limit = min(cand.shape[1], width + 48)
                near[own[full]] = _diverse(self.unit, cand[full, :limit], sims[full, :limit], width)

    def within(self, vectors: np.ndarray, threshold: float, beam: int) -> list[np.ndarray]:
        """Nodes with cosine of at least ``threshold`` (in double precision) for each query."""
        x = vectors.astype(np.float64)
        norm = np.sqrt((x * x).sum(axis=1))
        q = (x / norm[:, None]).astype(np.float32)
        out: list[np.ndarray] = [np.zeros(0, int)] * len(q)
        todo = np.arange(len(q))
        n = len(self.unit)
        while len(todo):
            beam = min(beam, n)
            wider = []
            step = max(8, min(256, (1 << 21) // max(1, beam)))
            for k in range(0, len(todo), step):
                part = todo[k : k + step]
                entry = np.zeros(len(part), int)
                for layer in range(len(self.near) - 1, 0, -1):
                    entry = _search(self.near[layer], self.unit, q[part], entry, min(4, n))[0][:, 0]
                ids, sims = _search(self.near[0], self.unit, q[part], entry, beam)
                close = (sims >= threshold - 1e-4) & (ids >= 0)
                for r, i in enumerate(part.tolist()):
                    hit = ids[r, close[r]]
                    if 2 * len(hit) > beam and beam < n:
                        wider.append(i)
                        continue
                    v = self.vectors[hit].astype(np.float64)
                    cos = (v @ x[i]) / (np.sqrt((v * v).sum(axis=1)) * norm[i])
                    out[i] = hit[cos >= threshold]
            todo, beam = np.array(wider, int), 4 * beam
        return out

    def brute(self, vectors: np.ndarray, threshold: float) -> list[np.ndarray]:
        x, v = vectors.astype(np.float64), self.vectors.astype(np.float64)
        cos = (x @ v.T) / (np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None, :])
        return [np.flatnonzero(c >= threshold) for c in cos]

    def audited(self, vectors: np.ndarray, threshold: float, beam: int = BEAM, audits: int = AUDITS) -> list[np.ndarray]:
        """within(), with beams widened until the audited queries (evenly spread over the batch) lose nothing; where the widest beam still loses some, brute force in blocks."""
        sample = np.unique(np.linspace(0, len(vectors) - 1, min(audits * -(-len(vectors) // AUDITED), len(vectors))).astype(int))
        truth = self.brute(vectors[sample], threshold)
        while True:
            found = self.within(vectors[sample], threshold, beam)
            if all(len(np.setdiff1d(t, f)) == 0 for t, f in zip(truth, found, strict=True)):
                return self.within(vectors, threshold, beam)
            if beam >= len(self.unit):
                return [hit for k in range(0, len(vectors), 256) for hit in self.brute(vectors[k : k + 256], threshold)]
            beam *= 2


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept."""
    cuts = Cuts(prepare(vectors.sparkSession), "vectors")
    e = F.col(vector_col).cast("array<double>")
    valid = F.coalesce(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("v"),
        F.when(valid, F.xxhash64(F.col(label_col), e)).alias("h1"),
        F.when(valid, F.xxhash64(F.lit(1), e, F.col(label_col))).alias("h2"),
        F.when(valid, F.col(label_col).cast("string")).alias("label"),
        F.when(valid, e).alias("e"),
    )
    group = (
        rows.where("h1 is not null")
        .groupBy("h1", "h2")
        .agg(F.min("v").alias("rep"), F.count("*").alias("copies"), F.min(F.struct("v", "label", "e")).alias("own"))
        .select("h1", "h2", "rep", "copies", F.concat_ws(":", F.col("own.label"), F.size("own.e")).alias("label"), F.col("own.e").alias("e"))
    )
    group = cuts.cut(group, "distinct")
    sizes = group.groupBy("label").agg(F.count("*").alias("n")).select(F.col("label").alias("size_label"), F.ceil(F.col("n") / SHARD).cast("int").alias("shards"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    placed = group.join(sizes, F.col("label") == F.col("size_label")).select("label", "rep", "copies", "e", "shards", "chunks", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int").alias("shard"))

    def build(key, t):
        order = np.argsort(np.asarray(t["rep"]), kind="stable")
        t = t.take(pa.array(order))
        index = (Graph(_matrix(t["e"])), np.asarray(t["rep"]), np.asarray(t["copies"]))
        return pa.table({"label": pa.array([key[0].as_py()]), "shard": pa.array([key[1].as_py()], pa.int32()), "chunks": pa.array([t["chunks"][0].as_py()], pa.int32()), "graph": pa.array([pickle.dumps(index)], pa.binary())})

    graphs = cuts.cut(placed.groupBy("label", "shard").applyInArrow(build, "label string, shard int, chunks int, graph binary"), "graphs")
    queries = placed.select("label", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("rep", F.lit(3)), F.col("chunks")).cast("int").alias("chunk"), "rep", "e")
    served = graphs.select("label", "shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "graph")

    def search(asked, served):
        out = {"kind": [], "u": [], "v": []}
        if asked.num_rows and served.num_rows:
            graph, reps, copies = pickle.loads(served["graph"][0].as_py())
            own, x = np.asarray(asked["rep"]), _matrix(asked["e"])
            order = np.argsort(own, kind="stable")
            own, x = own[order], x[order]
            hits = graph.audited(x, threshold)
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for r, at in zip(own.tolist(), hits, strict=True):
                at = at[reps[at] != r]
                out["kind"].append(0), out["u"].append(r), out["v"].append(int(copies[at].sum()))
                a, b = np.concatenate((a, np.full(len(at), r))), np.concatenate((b, reps[at]))
                if len(a) > 200_000:
                    b, a = smallest_labels(a, b)
            if len(a):
                vertex, label = smallest_labels(a, b)
                linked = vertex != label
                out["kind"] += [1] * int(linked.sum())
                out["u"] += vertex[linked].tolist()
                out["v"] += label[linked].tolist()
        return pa.table({"kind": pa.array(out["kind"], pa.int32()), "u": pa.array(out["u"], pa.int64()), "v": pa.array(out["v"], pa.int64())})

    keys = ("label", "shard", "chunk")
    found = cuts.cut(queries.groupBy(*keys).cogroup(served.groupBy(*keys)).applyInArrow(search, "kind int, u bigint, v bigint"), "found")
    cuts.drop("graphs")
    counts = found.where("kind = 0").groupBy(F.col("u").alias("count_rep")).agg(F.sum("v").alias("others"))
    united = components(found.where("kind = 1").select("u", "v"), cuts)
    by_group = (
        group.select("h1", "h2", "rep", "copies")
        .join(counts, F.col("rep") == F.col("count_rep"), "left")
        .join(united, F.col("rep") == F.col("vertex"), "left")
        .select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = rows.select("v", "h1", "h2").join(by_group, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.coalesce("component_id", "v")
    return out.select(F.col("v").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("v")).alias("kept"))


ORACLE = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
ok AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e WHERE v IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.norm > 0 AND b.norm > 0 WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
c AS (WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b) SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, component_id = e.vec_id AS kept
FROM e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
