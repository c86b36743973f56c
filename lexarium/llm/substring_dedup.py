"""Substring deduplication by seeds and extension: documents meet on winnowed anchors, matches are extended both ways word by word, and words under repeats of 13 words or more go.

Of every 13 consecutive words, the smallest hash among their 9 groups of 5 words is an anchor, so equal windows of 13 words have the same anchor at
the same place.  Anchors in two documents or more are the seeds.

1. Each seed has a leader, its first occurrence in the smallest document that has it.  A document's seeds with the same leading document come together, as
   stretches of text as far as their windows reach, and are joined with the stretches of that document.  From each seed the match is extended to the left
   and to the right as far as the words agree.  Windows inside the match are repeats of the smallest document that can have them.
2. Windows that a match doesn't cover may be repeated elsewhere in the seed's group, but not in its leader.  They are seeds of full length, with nothing
   left to extend: equal ones are compared with the smallest document among them, by their words where the group is in one task, else by digests (128 bits).
3. Windows that follow each other make up maximal repeats, of 13 words or more, and the words under them go.

No pairs of documents are made: every occurrence meets one leader.  The occurrences of a frequent seed are dealt over several tasks, each with a copy of its leader.

Nulls have no words.  Documents of fewer than 13 words lose nothing.  Rows with a null id keep all words and take none
from others; rows with equal ids count as one document and each row is cut by itself.  Ids may be numbers or strings; between equal windows the smaller id keeps its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import Words, batches_of_words, grams, inside, joined, mix, signed
from ._spark import Cuts, prepare

WINDOW = 13
ANCHOR = 5
#: Occurrences of a seed that meet one copy of its leader.
DEALT = 256
#: Seeds in one stretch of a document.
CHAIN = 64
#: Rows in one batch of output, so that those of a very long text take little memory at once.
ROWS_OUT = 1024
#: Windows that a task holds for one leading document; from there on those of its smallest documents are compared over all tasks.
HELD = 100_000


def anchors_of(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in order: first word, document, hash, and how many words before the anchor and after it its windows reach."""
    h = words.hashes()
    g = grams(h, anchor)
    start = np.flatnonzero(inside(words.first, len(h), window))
    best, at, wide, choices = g, np.arange(len(g)), 1, window - anchor + 1
    while wide < choices:  # the first smallest hash of ``wide`` groups, from each on; wide doubles
        step = min(wide, choices - wide)
        n = max(0, len(best) - step)
        better = best[step:] < best[:n]
        best, at, wide = np.where(better, best[step:], best[:n]), np.where(better, at[step:], at[:n]), wide + step
    at = at[start]
    first = np.flatnonzero(np.diff(at, prepend=-1))  # it never goes back
    p, count = at[first], np.diff(first, append=len(at))
    doc = np.searchsorted(words.first, p, "right") - 1
    return p, doc, g[p], p - start[first], start[first + count - 1] + window - anchor - p


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, v, t): v tells apart the texts of rows with equal ids."""
    return docs.select(F.col(id_col).alias("d"), F.xxhash64(F.col(text_col)).alias("v"), F.col(text_col).alias("t"))


def _anchor_rows(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, d, n), once a document, which has it n times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in batches_of_words(batch.column(1)):
                _, doc, g, _, _ = anchors_of(words, window, anchor)
                order = np.argsort(mix(g + doc.astype(np.uint64)))  # brings equal ones together; a row more for a collision does no harm
                g, doc = g[order], doc[order]
                new = np.concatenate(([True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]))) if len(g) else np.zeros(0, bool)
                n = np.diff(np.append(np.flatnonzero(new), len(g)))
                yield pa.RecordBatch.from_arrays([signed(g[new]), batch.column(0)[i:j].take(pa.array(doc[new])), pa.array(n)], names=["anchor", "d", "n"])

    return texts.where("d is not null").select("d", "t").mapInArrow(run, f"anchor bigint, d {texts.schema['d'].dataType.simpleString()}, n bigint")


def _chains(marked: DataFrame, window: int, anchor: int) -> DataFrame:
    """(low, deals, deal, other, d, v, first, anchors, places, words): stretches of a document with the seeds of one leading document, as far as their windows reach.

    ``first`` is the stretch's first word, ``anchors`` its seeds (64 bits each) and ``places`` where each has its anchor, its first and its last window (32 bits
    each, from ``first`` on).  Those that lead (not ``other``) come once for each deal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in batches_of_words(batch.column(2)):
                p, doc, g, left, right = anchors_of(words, window, anchor)
                marks = batch.column(3)[i:j]
                flat, sizes = marks.flatten(), np.diff(np.asarray(marks.offsets))
                owner, mark = np.repeat(np.arange(j - i), sizes), flat.field(0).to_numpy().view(np.uint64)
                order = np.lexsort((mark, owner))
                begin = np.concatenate(([0], np.cumsum(sizes)))
                at = np.zeros(len(p), np.int64)
                first = np.searchsorted(doc, np.arange(j - i + 1))
                for d in np.flatnonzero(sizes):
                    own, a, b = mark[order[begin[d] : begin[d + 1]]], first[d], first[d + 1]
                    k = np.minimum(np.searchsorted(own, g[a:b]), len(own) - 1)
                    at[a:b] = np.where(own[k] == g[a:b], order[begin[d] + k] + 1, 0)
                sel = np.flatnonzero(at)
                if not len(sel):
                    continue
                p, doc, g, left, right, at = p[sel], doc[sel], g[sel], left[sel], right[sel], at[sel] - 1
                lead, low, deals = flat.field(1).to_numpy(zero_copy_only=False)[at], flat.field(2).dictionary_encode().indices.to_numpy()[at], flat.field(3).to_numpy()[at]
                again = np.ones(len(p), bool)
                again[np.unique(at, return_index=True)[1]] = False
                other = ~lead | again
                order = np.lexsort((p, other, deals, low, doc))
                p, doc, g, left, right, at, low, deals, other = (x[order] for x in (p, doc, g, left, right, at, low, deals, other))
                new = np.ones(len(p), bool)
                new[1:] = (p[1:] - left[1:] > (p + anchor + right)[:-1]) | np.logical_or.reduce([x[1:] != x[:-1] for x in (doc, low, deals, other)])
                nth = np.arange(len(p)) - np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
                head = np.flatnonzero(nth % CHAIN == 0)
                n = np.diff(np.append(head, len(p)))
                start, stop = (p - left)[head], (p + anchor + right)[head + n - 1]
                place = np.stack((p, p - left, p + anchor + right - window), 1) - np.repeat(start, n)[:, None]
                body, _ = joined(words, np.ones(len(words), bool))
                edge = np.concatenate(([0], np.cumsum(words.end - words.start + 1)))
                copies = np.where(other[head], 1, deals[head])
                all_rows = np.repeat(np.arange(len(head)), copies)
                nth = np.arange(len(all_rows)) - np.repeat(np.cumsum(copies) - copies, copies)
                values = batch.column(1)[i:j].to_numpy()
                seeds, place = g.view(np.uint8), place.astype(np.int32).view(np.uint8).ravel()
                for k in range(0, len(all_rows), ROWS_OUT):
                    row = all_rows[k : k + ROWS_OUT]
                    h, own, a = head[row], pa.array(doc[head[row]]), edge[start[row]]
                    deal = np.where(other[h], ((values[doc[h]] & 0x7FFFFFFF) + 7919 * p[h]) % deals[h], nth[k : k + ROWS_OUT])
                    yield pa.RecordBatch.from_arrays(
                        [flat.field(2).take(pa.array(at[h])), pa.array(deals[h]), pa.array(deal.astype(np.int64)), pa.array(other[h])]
                        + [batch.column(0)[i:j].take(own), batch.column(1)[i:j].take(own)]
                        + [pa.array((start[row] - words.first[doc[h]]).astype(np.int32))]
                        + [_cells(seeds, h * 8, n[row] * 8), _cells(place, h * 12, n[row] * 12), _cells(body, a, edge[stop[row]] - 1 - a)],
                        names=["low", "deals", "deal", "other", "d", "v", "first", "anchors", "places", "words"],
                    )

    kind = marked.schema["d"].dataType.simpleString()
    schema = f"low {kind}, deals bigint, deal bigint, other boolean, d {kind}, v bigint, first int, anchors binary, places binary, words binary"
    return marked.select("d", "v", "t", "marks").mapInArrow(run, schema)


def _cells(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary column of ``size`` bytes of ``data`` from each ``start``."""
    ends = np.concatenate(([0], np.cumsum(size)))
    cells = data[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(cells.tobytes())])


def extended(words: list[bytes], at: int, lead: list[bytes], lead_at: int, anchor: int) -> tuple[int, int]:
    """First word and end of the longest match around two anchors, in ``words``; an empty one if the anchors themselves differ."""
    if words[at : at + anchor] != lead[lead_at : lead_at + anchor]:
        return at, at
    shift, begin, end = lead_at - at, at, at + anchor
    least, most = max(0, -shift), min(len(words), len(lead) - shift)
    while begin > least and words[begin - 1] == lead[begin - 1 + shift]:
        begin -= 1
    while end < most and words[end] == lead[end + shift]:
        end += 1
    return begin, end


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (start, count) in order, those that meet or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, count in sorted(runs):
        if out and start <= sum(out[-1]):
            out[-1] = (out[-1][0], max(out[-1][1], start + count - out[-1][0]))
        else:
            out.append((start, count))
    return out


def _extend(chains: DataFrame, window: int, anchor: int) -> DataFrame:
    """(d, v, runs, win): the runs (start, count) of a text's windows that a smaller document has, together for each leading document of a task; and with ``win``
    the places of one window that is still to be compared over several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leader, texts, apart, here, held = None, {}, set(), {}, True, 0
        runs: dict[tuple, list] = {}
        kept, out = 0, []

        def settle() -> None:
            """Windows of a document that isn't the smallest one here are repeats; those of the smallest may be repeats of another task's."""
            for own, same in apart.items():
                least = min(same)[0]
                places: dict[int, list] = {}
                for d, v, s in same:
                    if d > least:
                        runs.setdefault((d, v), []).append((s, 1))
                    elif not here:
                        places.setdefault(v, []).append((s, 1))
                if places:
                    win = hashlib.blake2b(own, digest_size=16).digest()
                    out.extend((least, v, merged(at), win) for v, at in places.items())
            apart.clear()
            finish()

        def finish() -> None:
            out.extend((d, v, merged(own), None) for (d, v), own in runs.items())
            runs.clear()

        def rows(fields) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(out), ROWS_OUT):
                d, v, own, win = zip(*out[k : k + ROWS_OUT], strict=True)
                flat = np.array([x for one in own for x in one], np.int32)
                ends = np.concatenate(([0], np.cumsum([len(one) for one in own]))).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "count"])
                columns = [pa.array(d, fields.field("d").type), pa.array(v, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), each), pa.array(win, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["d", "v", "runs", "win"])
            out.clear()

        schema = None
        for batch in batches:
            schema = batch.schema
            for low, deals, deal, other, d, v, first, anchors, places, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (low, deals, deal) != key:
                    settle()
                    key, leader, texts, here, held = (low, deals, deal), {}, set(), deals == 1, 0
                if kept > HELD:
                    finish()
                if kept > HELD or len(out) >= ROWS_OUT:
                    yield from rows(schema)
                    kept = 0
                place = memoryview(places).cast("i").tolist()
                if other and text in texts:
                    if d > low:
                        runs.setdefault((d, v), []).append((first + place[1], place[-1] - place[1] + 1))
                        kept += 1
                    continue
                words, seeds = text.split(b" "), memoryview(anchors).cast("q").tolist()
                if not other:
                    texts.add(text)
                    have = len(leader)
                    for g, at in zip(seeds, place[::3], strict=True):
                        leader.setdefault(g, (words, at))
                    if len(leader) == have + len(seeds):
                        continue  # else another row with this id led with one of these seeds: its other windows are compared
                source, shift, begin, end, run_start, run_end = None, 0, 0, 0, 0, 0
                for g, at, a, b in zip(seeds, place[::3], place[1::3], place[2::3], strict=True):
                    lead, lead_at = leader[g]
                    if lead is not source or lead_at - at != shift or at < begin or at + anchor > end:
                        source, shift = lead, lead_at - at
                        begin, end = extended(words, at, lead, lead_at, anchor)
                    x, y = max(a, begin), min(b, end - window)
                    if x <= y:
                        if x != run_end:
                            if run_start < run_end and d > low:
                                runs.setdefault((d, v), []).append((first + run_start, run_end - run_start))
                                kept += 1
                            run_start = x
                        run_end = y + 1
                    for s in range(a, b + 1) if x > y else [*range(a, x), *range(y + 1, b + 1)]:
                        own = b" ".join(words[s : s + window])
                        apart.setdefault(own, []).append((d, v, first + s))
                        held, kept = held + 1, kept + 1
                if run_start < run_end and d > low:
                    runs.setdefault((d, v), []).append((first + run_start, run_end - run_start))
                    kept += 1
                if held > HELD:
                    here, held = False, 0
                    settle()
        settle()
        if schema is not None:
            yield from rows(schema)

    kind = chains.schema["d"].dataType.simpleString()
    key = ["low", "deals", "deal"]
    return chains.repartition(*key).sortWithinPartitions(*key, "other").mapInArrow(run, f"d {kind}, v bigint, runs array<struct<start:int,count:int>>, win binary")


def repeated_windows(docs: DataFrame, cuts: Cuts, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(d, v, runs): for each text the runs (start, count) of its windows that occur in a smaller document."""
    texts = _ids(docs, id_col, text_col)
    rows = _anchor_rows(texts, window, anchor)
    deals = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.sum("n") / DEALT)))).cast("long").alias("deals")
    seeds = cuts.cut(rows.groupBy("anchor").agg(F.min("d").alias("low"), F.max("d").alias("high"), deals).where("low < high").select("anchor", "low", "deals"), "seeds")
    mark = F.struct("anchor", (F.col("d") == F.col("low")).alias("lead"), "low", "deals")
    marks = cuts.cut(rows.join(seeds.hint("shuffle_hash"), "anchor").groupBy("d").agg(F.collect_list(mark).alias("marks")), "marks")
    cuts.drop("seeds")
    found = cuts.cut(_extend(_chains(texts.join(marks, "d"), window, anchor), window, anchor), "found")
    cuts.drop("marks")
    rest = found.where("win is not null")
    first = cuts.cut(rest.groupBy("win").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low < high").select("win", "low"), "first")
    hits = rest.join(first, "win").where("d > low").unionByName(found.where("win is null"), allowMissingColumns=True)
    later = cuts.cut(hits.groupBy("d", "v").agg(F.flatten(F.collect_list("runs")).alias("runs")), "later")
    cuts.drop("found", "first")
    return later


def covered(n: int, start: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie under the runs of windows."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + count - 1 + window, -1)
    return np.cumsum(change[:-1]) > 0


def _cut_rows(docs: DataFrame, later: DataFrame, id_col: str, text_col: str, window: int, schema: str, make) -> DataFrame:
    """Join each row with its runs and let ``make`` build the output from (other columns, text, words, removed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.num_columns - 2
            for i, j, words in batches_of_words(batch.column(rest)):
                runs = batch.column(rest + 1)[i:j].fill_null([])
                flat, sizes = runs.flatten(), np.diff(np.asarray(runs.offsets))
                start = flat.field(0).to_numpy().astype(np.int64) + np.repeat(words.first[:-1], sizes)
                removed = covered(len(words), start, flat.field(1).to_numpy().astype(np.int64), window)
                yield make([batch.column(k)[i:j] for k in range(rest)], batch.column(rest)[i:j], words, removed)

    names = [f"c{k}" for k in range(len(docs.columns))]
    own = docs.toDF(*names)
    text = F.col(names[docs.columns.index(text_col)])
    keyed = own.select(*names, F.col(names[docs.columns.index(id_col)]).alias("own_d"), F.xxhash64(text).alias("own_v"), text.alias("own_t"))
    both = keyed.join(later, (F.col("own_d") == F.col("d")) & (F.col("own_v") == F.col("v")), "left")
    return both.select(*names, "own_t", "runs").mapInArrow(run, schema)


def _per_doc(x: np.ndarray, words: Words) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(x)))
    return run[words.first[1:]] - run[words.first[:-1]]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, start, n_words): the maximal repeats of every text, as ranges of its words whose every window occurs in a smaller document."""
    cuts = Cuts(prepare(docs.sparkSession), "substring")
    runs = repeated_windows(docs, cuts, id_col, text_col, window, anchor).select("d", "v", F.inline("runs"))
    starts = runs.select("d", "v", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("s")).groupBy("d", "v").agg(F.array_sort(F.collect_set("s")).alias("s"))
    first = F.filter("s", lambda x: ~F.array_contains("s", x - 1))
    last = F.filter("s", lambda x: ~F.array_contains("s", x + 1))
    each = starts.select("d", F.explode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("z"))
    return each.select(F.col("d").alias(id_col), F.col("z.a").cast("long").alias("start"), (F.col("z.b") - F.col("z.a") + window).cast("long").alias("n_words"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256 of the kept words joined by one space."""
    cuts = Cuts(prepare(docs.sparkSession), "substring")
    few = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col))
    later = repeated_windows(few, cuts, id_col, text_col, window, anchor)

    def make(columns, _, words, removed):
        body, at = joined(words, ~removed)
        sha = [hashlib.sha256(body[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([columns[0], pa.array(words.counts), pa.array(_per_doc(removed, words)), pa.array(sha)], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    schema = f"`{id_col}` {few.schema[0].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string"
    return _cut_rows(few, later, id_col, text_col, window, schema, make)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` without the repeated words.  A text that loses words becomes its other words joined by one space; documents that lose all are left out."""
    cuts = Cuts(prepare(docs.sparkSession), "substring")
    later = repeated_windows(docs, cuts, id_col, text_col, window, anchor)
    t = docs.columns.index(text_col)

    def make(columns, text, words, removed):
        lost, counts = _per_doc(removed, words), words.counts
        body, at = joined(words, ~removed)
        raw = text.to_pylist()
        for d in np.flatnonzero(lost).tolist():
            raw[d] = body[at[d] : max(at[d], at[d + 1] - 1)].tobytes().decode()
        columns[t] = pa.array(raw, columns[t].type)
        keep = pa.array((lost < counts) | (counts == 0))
        return pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=[f"c{k}" for k in range(len(columns))])

    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    return _cut_rows(docs, later, id_col, text_col, window, schema, make).toDF(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(len(w) - 12)) AS pos FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + 13], ' ') AS gram FROM s),
m AS (SELECT gram, min(doc_id) AS low FROM g GROUP BY gram),
b AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS p FROM g JOIN m USING (gram) WHERE doc_id > low),
r AS (SELECT doc_id, list(p) AS gone FROM b GROUP BY doc_id),
u AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d),
k AS (SELECT u.doc_id, string_agg(w[u.p + 1], ' ' ORDER BY u.p) AS kept FROM u LEFT JOIN b ON b.doc_id = u.doc_id AND b.p = u.p WHERE b.p IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
