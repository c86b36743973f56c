"""N-gram Jaccard join: prefix-tree join of documents' shingle sets.

A set is an array of 58-bit shingle hashes.  Sets of similarity t share a token in the first n - ceil(t n) + 1 tokens of each, in any
order that all sets agree on, and k tokens in their first n - ceil(t n) + k.

1. Equal sets become one (equal in 128 bits).
2. First look, in the order of the hashes: a set stays if it shares k tokens of its longer prefix with other sets, k in proportion to its size.
   Tasks sum up what they share within a chunk; only one entry for each token of a chunk is shuffled, packed by ranges of hashes, so no token gathers rows.
3. The sets that stay are put into the order that matters, rare before common, with counts over all of them.  Tokens that no other set has come first and
   are then left out, since they never count for an overlap; a set with fewer than ceil(t n) others can't link.
4. In the group of a prefix token all members are paired with one leader, not with each other: the member with the fewest rarer tokens before it.
   Pairs are verified by leader, in chunks of bounded size: a chunk's ordered sets form a compressed trie, the leader walks
   it once with shared partial overlaps, and subtrees whose remaining length can't reach the needed overlap are cut.
5. Links unite sets.  Groups of three or more that are still in several components keep the members whose sizes and positions allow a link, and are dealt
   into blocks of bounded size; each two blocks meet in one task, where one block's tokens from the group's token on form a trie that all
   sets of the other walk together.  So every link is either found or inside a component: components are exact.  Only links leave these tasks.

Null texts and texts without words have an empty set and link with nothing.  Rows with a null id link with nothing and get a null component.
Rows with equal ids count as one document, whatever their texts.  Ties of leaders go to the smaller set, then to the smaller digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import Words, batches_of_words, grams, inside, mix, signed
from ._spark import Cuts, broadcast_if_small, free_name, prepare
from .graph import components, smallest_labels

SHINGLE = 5
#: Similarity in percent.
PERCENT = 80
#: Tokens that the first look asks for, in percent of a set's size.
EXTRA = 20
#: Bits of a token, and entries in a range of tokens.
TOKEN_BITS = 58
RANGE_ENTRIES = 400_000
#: Tokens found this many times in a chunk are counted first; the HOT_LIMIT most frequent of them go to the tasks, a bound that only affects speed.
HOT_COUNT = 3
HOT_LIMIT = 1 << 16
#: Tokens of the sets that a leader, and a block of a group, meet in one task; cells of the membership table at a time; queries at a time.
CHUNK_TOKENS = 150_000
BLOCK_TOKENS = 300_000
CELLS = 1 << 25
QUERIES = 256


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, as 58-bit hashes in order, and where each document's begin."""
    h, counts = words.hashes(), words.counts
    start = np.flatnonzero(inside(words.first, len(h), k))
    value, doc = grams(h, k)[start], np.searchsorted(words.first, start, "right") - 1
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            value = np.concatenate((value, grams(h, n, seed=50 + n)[words.first[short]]))
            doc = np.concatenate((doc, short))
    value = value >> np.uint64(6)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if len(value):
        once = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])))
        value, doc = value[once], doc[once]
    return value, np.searchsorted(doc, np.arange(len(counts) + 1))


def needed(n, percent: int = PERCENT):
    """Least overlap of a set of n with any similar set: ceil(t n)."""
    return (n * percent + 99) // 100


def overlap_needed(a, b, percent: int = PERCENT):
    """Least overlap of sets of a and b tokens of this similarity: ceil(t (a + b) / (1 + t))."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def digests_of(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each document's set."""

    def digest(constant: int) -> np.ndarray:
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(constant)))))
        return mix(run[first[1:]] - run[first[:-1]] + np.diff(first).astype(np.uint64))

    return digest(0x51ED2701), digest(0x2545F4914F6CDD1D)


class Names:
    """64-bit names of sets: the first digest, and for the few whose first digest stands for several sets both digests as one."""

    def __init__(self, bits: int = 64, shared: list[int] | None = None):
        self.mask, self.shared = np.uint64((1 << bits) - 1), np.array(shared or [], np.int64).view(np.uint64)

    def __call__(self, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        name, check = digests_of(value, first)
        return self.told(name & self.mask, check)

    def told(self, name: np.ndarray, check: np.ndarray) -> np.ndarray:
        return np.where(np.isin(name, self.shared), name ^ check, name) if len(self.shared) else name


def _prefix(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first ``size`` tokens of each document, and their documents."""
    ends = np.concatenate(([0], np.cumsum(size)))
    doc = np.repeat(np.arange(len(size)), size)
    return first[:-1][doc] + np.arange(ends[-1]) - ends[doc], doc


class Trie:
    """Ordered sets as a path-compressed trie in arrays: a node is a run of tokens that its sets share.

    ``sizes``: of the whole sets, where ``sets`` holds only their tokens from some token on.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int] | None = None):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets] if sizes is None else sizes, np.int64)
        rows = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.root = self._node([sets[i] for i in rows], rows, 0)

    def _node(self, sets: list[np.ndarray], rows: list[int], depth: int):
        """(segment, depth after it, least whole size, largest length, rows that end here, children)."""
        a, b = sets[0], sets[-1]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:n] != b[depth:n])
        stop = depth + int(differ[0]) if len(differ) else n
        here = [r for r, s in zip(rows, sets, strict=True) if len(s) == stop]
        rest = [(s, r) for s, r in zip(sets, rows, strict=True) if len(s) > stop]
        children, k = [], 0
        while k < len(rest):
            j = k
            while j < len(rest) and rest[j][0][stop] == rest[k][0][stop]:
                j += 1
            part = rest[k:j]
            children.append(([s for s, _ in part], [r for _, r in part]))
            k = j
        return (a[depth:stop], stop, int(self.sizes[rows].min()), max(map(len, sets)), here, [self._node(s, r, stop) for s, r in children])

    def search(self, query: np.ndarray, percent: int = PERCENT) -> list[int]:
        """Rows whose similarity with ``query`` reaches ``percent``."""
        return [int(r) for _, r in zip(*self.search_all([query], [len(query)], percent), strict=True)]

    def search_all(self, queries: list[np.ndarray], sizes: list[int], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) whose similarity reaches ``percent``; the queries walk the trie together, each as far as its bounds let it."""
        found = ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
        words = np.unique(np.concatenate(queries))
        shared = words[np.isin(words, np.concatenate(self.sets))]
        step = max(1, CELLS // max(1, len(shared)))
        for k in range(0, len(queries), step):
            for q, r in self._walk(queries[k : k + step], np.array(sizes[k : k + step], np.int64), words, shared, percent):
                found[0].append(q + k)
                found[1].append(r)
        return np.concatenate(found[0]), np.concatenate(found[1])

    def _walk(self, queries, sizes: np.ndarray, words: np.ndarray, shared: np.ndarray, percent: int):
        length = np.array([len(q) for q in queries])
        begin = np.concatenate(([0], np.cumsum(length)))
        flat, owner = np.concatenate(queries), np.repeat(np.arange(len(queries)), length)
        ranked = owner * len(words) + np.searchsorted(words, flat)  # sorted: by query, then by token
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        member = np.zeros((len(shared), len(queries)), bool)
        if len(shared):
            hit = shared[at] == flat
            member[at[hit], owner[hit]] = True
        stack = [(self.root, np.arange(len(queries)), np.zeros(len(queries), np.int64))]
        while stack:
            (segment, depth, low, high, here, children), who, overlap = stack.pop()
            if len(segment):
                if len(shared):
                    place = np.minimum(np.searchsorted(shared, segment), len(shared) - 1)
                    place = place[shared[place] == segment]
                    overlap = overlap + member[np.ix_(place, who)].sum(0)
                passed = np.searchsorted(ranked, who * len(words) + np.searchsorted(words, segment[-1], "right") - 1, "right") - begin[who]
                left = np.minimum(high - depth, length[who] - passed)
            else:
                left = np.minimum(high - depth, length[who])
            go = overlap + left >= overlap_needed(sizes[who], low, percent)
            who, overlap = who[go], overlap[go]
            if not len(who):
                continue
            for r in here:
                ok = 100 * overlap >= percent * (sizes[who] + self.sizes[r] - overlap)
                if ok.any():
                    yield who[ok], np.full(int(ok.sum()), r, np.int64)
            stack += [(child, who, overlap) for child in children]


def _scan(docs: DataFrame, schema: str, make) -> DataFrame:
    """Rows that ``make(ids, shingle values, document starts)`` gives for a table of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in batches_of_words(batch.column(1), lower=True):
                yield from make(batch.column(0)[i:j], *shingles(words))

    return docs.mapInArrow(run, schema)


def set_digests(texts: DataFrame, bits: int = 64) -> DataFrame:
    """(d, n, sid, check): size and digests of every row's set."""
    mask = np.uint64((1 << bits) - 1)

    def make(ids, value, first):
        name, check = digests_of(value, first)
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first)), signed(name & mask), signed(check)], names=["d", "n", "sid", "check"])

    return _scan(texts, f"d {texts.schema['d'].dataType.simpleString()}, n bigint, sid bigint, check bigint", make)


def _once(sid: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a document is the first of its set in the chunk, and not empty."""
    out = np.zeros(len(sid), bool)
    out[np.unique(sid, return_index=True)[1]] = True
    return out & (n > 0)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _range_bits(entries: int) -> int:
    """Bits that number the ranges of tokens so that each gets about RANGE_ENTRIES entries, 64 ranges at least."""
    return min(30, max(6, int(np.ceil(np.log2(max(1, entries) / RANGE_ENTRIES)))))


def _by_range(token: np.ndarray, who: np.ndarray, sid: np.ndarray, bits: int, note: np.ndarray) -> pa.RecordBatch:
    """One row for each range of the sorted tokens: its tokens, the sets they belong to as numbers into ``sids``, and a note on each entry."""
    at = (token >> np.uint64(TOKEN_BITS - bits)).astype(np.int64)
    used, begin, size = np.unique(at, return_index=True, return_counts=True)
    pairs, number = np.unique(at * len(sid) + who, return_inverse=True)
    first = np.searchsorted(pairs, used * len(sid))
    owners = np.diff(np.append(first, len(pairs)))
    number = number - np.repeat(first, size)
    return pa.RecordBatch.from_arrays(
        [pa.array(used), _lists(signed(token), size), _lists((number * 2 + note).astype(np.int32), size), _lists(signed(sid[pairs % max(1, len(sid))]), owners), pa.array(np.zeros(len(used), bool))],
        names=["range", "tokens", "who", "sids", "own"],
    )


def _own_row(sid: np.ndarray, number: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, bits: int) -> pa.RecordBatch:
    """A row that takes what a chunk knows of its sets along to one of the ranges: a number for each set, and tokens."""
    where = int(sid[0] >> np.uint64(64 - bits)) if len(sid) else 0
    flat = np.concatenate((sizes.astype(np.uint64), tokens))
    return pa.RecordBatch.from_arrays(
        [pa.array([where]), _lists(signed(flat), np.array([len(flat)])), _lists(number.astype(np.int32), np.array([len(number)])), _lists(signed(sid), np.array([len(sid)])), pa.array([True])],
        names=["range", "tokens", "who", "sids", "own"],
    )


RANGES = "range bigint, tokens array<bigint>, who array<int>, sids array<bigint>, own boolean"


def _entries(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, names of their sets and notes of a range, in the order of tokens and names."""
    t = t.filter(pc.invert(t["own"])).combine_chunks()
    flat = lambda name: t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    token, who, sids = flat("tokens").view(np.uint64), flat("who"), flat("sids")
    first = np.concatenate(([0], np.cumsum(pc.list_value_length(t["sids"]).to_numpy(zero_copy_only=False)))).astype(np.int64)
    row = np.repeat(np.arange(t.num_rows), pc.list_value_length(t["tokens"]).to_numpy(zero_copy_only=False))
    sid = sids[first[row] + (who >> 1)] if len(who) else sids[:0]
    order = np.lexsort((sid, token))
    return token[order], sid[order], (who & 1)[order]


def _extra(n, extra: int):
    return np.maximum(1, n * extra // 100)


def survivors(texts: DataFrame, tokens: int, names: Names, percent: int, extra: int = EXTRA) -> DataFrame:
    """(sid): sets that share enough tokens of their longer prefix with other sets.  ``tokens``: of all sets, for the number of ranges."""
    bits = _range_bits(tokens * (100 - percent + extra) // 100)

    def make(_, value, first):
        n, sid = np.diff(first), names(value, first)
        once = _once(sid, n)
        size = np.where(once, np.minimum(n, n - needed(n, percent) + _extra(n, extra)), 0)
        at, doc = _prefix(first, size)
        number = np.cumsum(once) - 1
        order = np.argsort(value[at], kind="stable")
        token, who = value[at][order], number[doc][order]
        new = np.concatenate(([True], token[1:] != token[:-1])) if len(token) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        several = np.diff(np.append(begin, len(token))) > 1
        here = np.bincount(who[np.repeat(several, np.diff(np.append(begin, len(token))))], minlength=int(once.sum()))
        if once.any():
            yield _own_row(sid[once], here, np.zeros(0, np.uint64), n[once], bits)
            yield _by_range(token[begin], who[begin], sid[once], bits, several.astype(np.int64))

    def resolve(t: pa.Table) -> pa.Table:
        token, sid, several = _entries(t)
        begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(token)))
        shared = np.zeros(len(begin), bool)
        if len(begin):
            other = np.concatenate(([False], (sid[1:] != sid[:-1]) & (token[1:] == token[:-1])))
            shared = np.maximum.reduceat(np.maximum(several, other), begin) > 0
        name, hits = np.unique(sid[np.repeat(shared, size) & (several == 0)], return_counts=True)
        out = [pa.table({"sid": pa.array(name), "hits": pa.array(hits), "seen": pa.array(np.zeros(len(name), np.int64)), "n": pa.array(np.zeros(len(name), np.int64))})]
        for row in t.filter(t["own"]).to_batches():
            for k in range(row.num_rows):
                own = [row.column(c)[k].values for c in ("sids", "who", "tokens")]
                out.append(pa.table({"sid": own[0], "hits": own[1].cast(pa.int64()), "seen": pa.array(np.ones(len(own[0]), np.int64)), "n": own[2]}))
        return pa.concat_tables(out)

    rows = _scan(texts, RANGES, make).groupBy("range").applyInArrow(resolve, "sid bigint, hits bigint, seen bigint, n bigint")
    least = F.greatest(F.lit(1), F.floor(F.floor((F.col("n") * percent + 99) / 100) * extra / 100))
    return rows.groupBy("sid").agg(F.sum("hits").alias("hits"), F.sum("seen").alias("seen"), F.max("n").alias("n")).where(F.col("hits") >= F.col("seen") * least).select("sid")


def _hot(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles (in hash order) and their levels.  A token in HOT_COUNT sets of a chunk on average is in at least one chunk's count, so none of those is missed."""

    def make(_, value, first):
        token, n = np.unique(value, return_counts=True)
        often = n >= HOT_COUNT
        yield pa.RecordBatch.from_arrays([signed(token[often]), pa.array(n[often].astype(np.int64))], names=["token", "n"])

    rows = _scan(texts, "token bigint, n bigint", make).groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(HOT_LIMIT).toPandas()
    token = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], _level(rows["n"].to_numpy(np.int64))[order]


def _level(n: np.ndarray) -> np.ndarray:
    """How common a token is, from 1 to 31: five bits above its hash put rare tokens first."""
    return np.clip(np.floor(np.log2(np.maximum(n, 1))), 1, 31).astype(np.uint64)


def ordered_sets(texts: DataFrame, tokens: int, names: Names, percent: int) -> DataFrame:
    """(sid, n, tokens): sizes of the sets and their shared tokens, rare before common, where there are enough of them for any link."""
    bits, hot = _range_bits(tokens), _hot(texts)

    def make(_, value, first):
        n, sid = np.diff(first), names(value, first)
        once = _once(sid, n)
        if not once.any():
            return
        at, doc = _prefix(first, np.where(once, n, 0))
        token, who = value[at], (np.cumsum(once) - 1)[doc]
        place = np.minimum(np.searchsorted(hot[0], token), len(hot[0]) - 1)
        common = hot[0][place] == token if len(hot[0]) else np.zeros(len(token), bool)
        known = token[common] | (hot[1][place[common]] << np.uint64(TOKEN_BITS)) if len(hot[0]) else token[:0]
        yield _own_row(sid[once], np.bincount(who[common], minlength=int(once.sum())), known, n[once], bits)
        token, who = token[~common], who[~common]
        order = np.argsort(token, kind="stable")
        yield _by_range(token[order], who[order], sid[once], bits, np.zeros(len(order), np.int64))

    def resolve(t: pa.Table) -> pa.Table:
        token, sid, _ = _entries(t)
        again = np.concatenate(([False], (token[1:] == token[:-1]) & (sid[1:] == sid[:-1]))) if len(token) else np.zeros(0, bool)
        token, sid = token[~again], sid[~again]
        begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(token)))
        count = np.repeat(size, size)
        token, sid = (token | (_level(count) << np.uint64(TOKEN_BITS)))[count > 1], sid[count > 1]
        order = np.argsort(sid, kind="stable")
        name, sizes = np.unique(sid, return_counts=True)
        out = [pa.table({"sid": pa.array(name), "n": pa.array(np.zeros(len(name), np.int64)), "tokens": _lists(signed(token[order]), sizes)})]
        for row in t.filter(t["own"]).to_batches():
            for k in range(row.num_rows):
                sids, sizes, flat = (row.column(c)[k].values for c in ("sids", "who", "tokens"))
                out.append(pa.table({"sid": sids, "n": flat[: len(sids)], "tokens": _lists(flat[len(sids) :], np.asarray(sizes))}))
        return pa.concat_tables(out)

    rows = _scan(texts, RANGES, make).groupBy("range").applyInArrow(resolve, "sid bigint, n bigint, tokens array<bigint>")
    sets = rows.groupBy("sid").agg(F.max("n").cast("int").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"))
    return sets.where(F.size("tokens") >= F.floor((F.col("n") * percent + 99) / 100))


def _passing(pairs: DataFrame, percent: int) -> DataFrame:
    """Of candidate rows (a, b, a_size, b_size, a_pos, b_pos), the pairs whose sizes and positions allow the similarity."""
    bound = F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos"))
    fits = (F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * percent) & (bound * (100 + percent) >= (F.col("a_size") + F.col("b_size")) * percent)
    return pairs.where(fits).groupBy("a", "b").agg(F.max("a_size").alias("a_size"), F.max("b_size").alias("b_size"))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, cuts: Cuts) -> DataFrame:
    """Links (u, v) among the pairs (a: leader, b: member)."""
    totals = cuts.cut(pairs.groupBy(F.col("a").alias("lead_a")).agg(F.greatest(F.ceil(F.sum("b_size") / CHUNK_TOKENS), F.lit(1)).alias("chunks")), "totals")
    members = pairs.join(totals, F.col("a") == F.col("lead_a")).select("a", F.pmod(F.xxhash64("b"), "chunks").alias("chunk"), F.col("b").alias("sid"))
    leads = totals.select(F.col("lead_a").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("lead_a").alias("sid"))
    members = cuts.cut(members.unionAll(leads), "members")
    rows = sets.join(broadcast_if_small(members), "sid").select("a", "chunk", "sid", "n", "tokens")

    def links(key, t):
        lead, sid, n = key[0].as_py(), t["sid"].to_numpy(), t["n"].to_numpy()
        own = [np.asarray(x.values).view(np.uint64) for x in t["tokens"]]
        first, rest = np.flatnonzero(sid == lead)[:1], np.flatnonzero(sid != lead)
        found = np.zeros(0, np.int64)
        if len(first) and len(rest):
            _, found = Trie([own[r] for r in rest], n[rest]).search_all([own[first[0]]], n[first], percent)
        return pa.table({"u": pa.array(np.full(len(found), lead, np.int64)), "v": pa.array(sid[rest[found]])})

    return rows.groupBy("a", "chunk").applyInArrow(links, "u bigint, v bigint")


def _possible(members: DataFrame, percent: int, cuts: Cuts) -> DataFrame:
    """Members (token, level, sid, size, pos, small) of groups by token and size that can link at their token.

    The smaller set of a pair has its first shared token within its first n - ceil(2 t n / (1 + t)) + 1 tokens (``small``), and sizes
    of a pair are in the same level or in two that follow each other: the larger set also comes to the group below its own.
    """
    reach = (F.col("size") - F.col("pos")) * (100 + percent)
    level = F.floor(F.log("size") / F.log(F.lit(101.0 / percent)))
    own = members.withColumn("level", level).withColumn("small", reach >= F.col("size") * 2 * percent)
    both = own.unionAll(own.withColumn("level", F.col("level") - 1).withColumn("small", F.lit(False)))
    least = cuts.cut(both.where("small").groupBy("token", "level").agg(F.min("size").alias("least")), "least")
    other = F.greatest(F.col("least"), F.ceil(F.col("size") * percent / 100))
    fit = cuts.cut(both.join(least, ["token", "level"]).where((F.col("least") <= F.col("size")) & (reach >= (F.col("size") + other) * percent)), "fit")
    open_ = cuts.cut(fit.groupBy("token", "level").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").drop("x", "y"), "open")
    return fit.join(open_, ["token", "level"]).select("token", "level", "sid", "size", "pos", "small")


def _search_groups(rows: DataFrame, sets: DataFrame, percent: int, cuts: Cuts) -> DataFrame:
    """Links (u, v), reduced to forests, among the members that ``_possible`` gives of groups.

    Members are dealt into blocks by their digests and each two blocks of a group meet in one task; sets come with their tokens from the group's token on.
    A group of k blocks ships each set k times, and its members are those that the bounds on sizes and positions leave open.
    """
    blocks = cuts.cut(rows.groupBy("token", "level").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("size") - F.col("pos")) / BLOCK_TOKENS)).alias("k")), "blocks")
    dealt = rows.join(blocks, ["token", "level"]).withColumn("x", F.pmod(F.xxhash64("sid"), "k")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    keys = dealt.select("sid", "token", "level", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "size", "small")
    keys = cuts.cut(keys, "keys")
    meet = sets.join(broadcast_if_small(keys), "sid").select("token", "level", "i", "j", "x", "sid", "size", "small", F.filter("tokens", lambda t: t >= F.col("token")).alias("tokens"))

    def links(t: pa.Table) -> pa.Table:
        sid, size, small, block = (t[c].to_numpy(zero_copy_only=False) for c in ("sid", "size", "small", "x"))
        sets = [np.asarray(x.values).view(np.uint64) for x in t["tokens"]]
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        u = v = np.empty(0, np.int64)
        for x, y in {(i, j), (j, i)}:
            below, queries = np.flatnonzero(small & (block == x)), np.flatnonzero(block == y)
            if not len(below) or not len(queries):
                continue
            trie = Trie([sets[r] for r in below], size[below])
            for k in range(0, len(queries), QUERIES):
                part = queries[k : k + QUERIES]
                q, r = trie.search_all([sets[n] for n in part], size[part], percent)
                a, b = sid[part[q]], sid[below[r]]
                vertex, label = smallest_labels(np.concatenate((u, a)), np.concatenate((v, b)))
                u, v = vertex[vertex != label], label[vertex != label]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return meet.groupBy("token", "level", "i", "j").applyInArrow(links, "u bigint, v bigint")


def _links(sets: DataFrame, percent: int, cuts: Cuts) -> DataFrame:
    """Links (u, v) of the ordered sets whose components are those of all links."""
    least = F.floor((F.col("n") * percent + 99) / 100)
    shared = F.slice("tokens", 1, (F.size("tokens") - least + 1).cast("int"))
    rows = sets.select("sid", F.col("n").alias("size"), F.size("tokens").alias("m"), F.posexplode(shared).alias("k", "token"))
    tokens = cuts.cut(rows.select("token", "sid", "size", (F.col("size") - F.col("m") + F.col("k")).alias("pos")), "tokens")
    lead = F.min(F.struct(F.col("pos").alias("a_pos"), F.col("size").alias("a_size"), F.col("sid").alias("a"))).alias("lead")
    leads = cuts.cut(tokens.groupBy("token").agg(lead, F.count("*").alias("members")).where("members > 1"), "leads")
    member = tokens.select("token", F.col("sid").alias("b"), F.col("size").alias("b_size"), F.col("pos").alias("b_pos"))
    star = cuts.cut(_passing(member.join(leads, "token").select("lead.*", "b", "b_size", "b_pos").where("a <> b"), percent), "pairs")
    found = cuts.cut(_verify(star, sets, percent, cuts), "links1")
    united = components(found, cuts, "round").select(F.col("vertex").alias("sid"), "component")
    left = tokens.join(leads.where("members > 2").select("token"), "token", "left_semi").join(united, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    left = cuts.cut(left, "left")
    mixed = cuts.cut(left.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token"), "mixed")
    open_ = cuts.cut(_possible(left.join(mixed, "token", "left_semi"), percent, cuts), "possible")
    cuts.drop("tokens", "leads", "pairs", "left", "mixed", "least", "fit", "open")
    return found.unionAll(cuts.cut(_search_groups(open_, sets, percent, cuts), "links2"))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, digest_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links).  ``digest_bits`` is smaller only in tests."""
    cuts = Cuts(prepare(docs.sparkSession), "jaccard")
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    digests = cuts.cut(set_digests(texts, digest_bits), "digests")
    full = digests.where("n > 0 and d is not null")
    several = [r["sid"] for r in full.groupBy("sid").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x < y").select("sid").collect()]
    names = Names(digest_bits, several)
    if several:
        digests = digests.withColumn("sid", F.when(F.col("sid").isin(several), F.col("sid").bitwiseXOR(F.col("check"))).otherwise(F.col("sid")))
        full = digests.where("n > 0 and d is not null")
    place = cuts.cut(full.groupBy("sid").agg(F.min("d").alias("low"), F.max("n").alias("n")), "place")
    texts = texts.where("d is not null")
    tokens = place.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stay = cuts.cut(survivors(texts, tokens, names, percent).join(place, "sid"), "stay")
    tokens = stay.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = cuts.cut(texts.join(broadcast_if_small(stay.select(F.col("low").alias("d"))), "d", "left_semi"), "texts")
    sets = cuts.cut(ordered_sets(own, tokens, names, percent), "sets")
    cuts.drop("texts", "stay")
    found = _links(sets, percent, cuts)
    same = full.groupBy("d").agg(F.min("sid").alias("u"), F.max("sid").alias("v")).where("u < v")
    same = full.select("d", F.col("sid").alias("v")).join(same.select("d", "u"), "d").where("u <> v").select("u", "v")
    final = components(found.unionAll(same), cuts, "final").select(F.col("vertex").alias("sid"), "component")
    labels = place.join(final, "sid", "left").select("sid", F.coalesce("component", "sid").alias("label"), "low")
    least = labels.groupBy("label").agg(F.min("low").alias("component_id"))
    by_set = cuts.cut(labels.join(least, "label").select(F.col("sid").alias("set_sid"), "component_id"), "labels")
    cuts.drop("sets", "place", "links1", "links2")
    out = digests.join(by_set, (F.col("sid") == F.col("set_sid")) & (F.col("n") > 0) & F.col("d").isNotNull(), "left")
    return out.select(F.col("d").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("d")).alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each group of linked documents, the one with the smallest id (all rows that have it); documents that link with nothing, empty ones and those with a null id stay."""
    found = join_components(docs, id_col, text_col, percent)
    name = free_name(docs, "gone_id")
    gone = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; null for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS pos FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[pos + 1:pos + 5], ' ') AS shingle FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.doc_id = w.doc_id
"""
