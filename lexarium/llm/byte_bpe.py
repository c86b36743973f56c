"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All pre-tokens of a batch that are not in the cache lie in one doubly linked list of byte tokens.
Pairs that the vocabulary can merge wait in one bucket per merge rank; a three-level bitmap over the
ranks gives the lowest non-empty one by find-first-set.  A bucket holds list positions; a position
whose pair has changed since it was queued is stale and is skipped.  The cost of a pre-token is
n log(ranks) whatever its length, so runs of megabytes are no special case.

Nulls count as empty texts; an empty text has no ids and decodes to nothing.  Invalid ids are an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from ._bytes import Words, slices, string_buffers
from ._spark import prepare


#: The pattern that split_code_points() does by classes of code points; any other goes through the regex library.
STANDARD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text encoded at once; larger slices share more pre-tokens.
SLICE_BYTES = 2 << 20


class RankBitmap:
    """A set of ranks with find-first-set; three levels of 64-bit words."""

    def __init__(self, size: int):
        self.levels = [[0] * (size // 64 + 1)]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * ((len(self.levels[-1]) - 1) // 64 + 1))

    def add(self, rank: int) -> None:
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            if level[word] & bit:
                return
            level[word] |= bit
            rank = word

    def pop(self) -> int:
        """Remove and return the lowest rank; -1 if there is none."""
        if not self.levels[-1][0]:
            return -1
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = (at << 6) | ((word & -word).bit_length() - 1)
        rank = at
        for level in self.levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        return rank


@lru_cache(1)
def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other for each code point, by the tokenizer library's Unicode tables (only its pattern matcher is used)."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, 3, np.uint8)
    for value, name in ((0, r"\s"), (1, r"\p{L}"), (2, r"\p{N}")):
        single = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(single.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
    return out


def split_code_points(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the matches of STANDARD in consecutive texts (``bounds``: their offsets in code points); each code point is in one match."""
    n = len(code)
    kind = _classes()[code]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    first = first[:n]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    blank = kind == 0
    last = np.concatenate((first[1:] if n else first[:0], np.ones(min(n, 1), bool)))  # of its text
    ends_run = blank & ~last & ~np.concatenate((blank[1:], np.ones(min(n, 1), bool)))  # a white space before another class
    start |= ends_run
    glued = ends_run & (code == 32)
    after = np.flatnonzero(glued) + 1
    start[after] = False
    tick = np.flatnonzero((code == 39) & start & ~last)
    if len(tick):
        pad = np.concatenate((code, np.zeros(2, code.dtype)))
        one, two = pad[tick + 1], pad[tick + 2]
        text_end = bounds[np.searchsorted(bounds, tick, "right")]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8).astype(code.dtype))
        long = (tick + 2 < text_end) & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        for at, size in ((tick[short], 2), (tick[long], 3)):
            start[at + 1] = False
            rest = at + size
            rest = rest[rest < n]
            start[rest] |= (kind[rest] == 1) | first[rest]
    return np.flatnonzero(start)


def _unique(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


class ByteBPE:
    """A vocabulary in tiktoken's format: ranks by byte string."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_size: int = 400_000):
        self.pattern = regex.compile(pattern)
        self.standard = pattern == STANDARD
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        keys, values = [], []
        lowest = np.full(self.size, self.size)
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
                    lowest[left] = min(lowest[left], rank)
                    lowest[right] = min(lowest[right], rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_key = np.array(keys, np.int64)[order]
        self.pair_rank = np.array(values, np.int64)[order]
        #: Ranks whose token is part of no merge of a lower rank: nothing can come between the merges of such a bucket, so they are done together.
        self.safe = lowest > np.arange(self.size)
        sizes = np.array([len(t or b"") for t in self.bytes_of])
        self.body = np.frombuffer(b"".join(t or b"" for t in self.bytes_of), np.uint8)
        self.body_at = np.concatenate(([0], np.cumsum(sizes)))
        self.cache_size = cache_size
        self.forget()

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, or -1."""
        key = left * self.size + right
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each byte string, as 32-bit integers; nothing merges across strings."""
        if not pieces:
            return []
        body = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        n = len(body)
        token = np.concatenate((self.byte_id[body], [-1]))
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        after[n] = n
        full = sizes > 0
        after[ends[full] - 1] = n  # the sentinel ends each piece
        before[(ends - sizes)[full]] = n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        piece = np.repeat(np.arange(len(pieces)), sizes)
        queue, buckets = RankBitmap(self.size), {}

        def push(at: np.ndarray) -> None:
            at = at[after[at] != n]
            rank = self.rank_of(token[at], token[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank, prepend=-1))
            edges = [*cut.tolist(), len(at)]
            for k, r in enumerate(rank[cut].tolist()):
                group = at[edges[k] : edges[k + 1]]
                if r in buckets:
                    buckets[r].append(group)
                else:
                    buckets[r] = [group]
                    queue.add(r)

        push(np.arange(n))
        while (rank := queue.pop()) >= 0:
            groups = buckets.pop(rank)
            at = _unique(np.concatenate(groups) if len(groups) > 1 else groups[0])
            at = at[alive[at] & (after[at] != n)]
            at = at[self.rank_of(token[at], token[after[at]]) == rank]  # the rest are stale
            if not len(at):
                continue
            if len(at) > 1 and not self.safe[rank]:
                # A new pair may have a lower rank and must then come first; where one can, only the leftmost position of the piece is merged now.
                follow = token[after[after[at]]]
                lead = token[before[at]]
                own = np.full(len(at), rank)
                low = np.zeros(len(at), bool)
                for a, b in ((lead, own), (own, follow), (own, own)):
                    made = self.rank_of(a, b)
                    low |= (made >= 0) & (made < rank) & (a >= 0) & (b >= 0)
                wait = np.isin(piece[at], piece[at[low]]) & np.concatenate(([False], np.diff(piece[at]) == 0))
                if wait.any():
                    buckets.setdefault(rank, []).append(at[wait])
                    queue.add(rank)
                    at = at[~wait]
            if len(at) > 1 and (after[at[:-1]] == at[1:]).any():  # overlaps as in aaa: every other one, from the left
                follows = np.concatenate(([False], after[at[:-1]] == at[1:]))
                index = np.arange(len(at))
                head = np.maximum.accumulate(np.where(follows, 0, index))
                at = at[(index - head) % 2 == 0]
            right = after[at]
            token[at] = rank
            after[at] = after[right]
            before[after[at]] = at
            alive[right] = False
            left = before[at]
            left = left[(left != n) & (left >= 0)]
            push(_unique(np.concatenate((left, at))))
        last = np.flatnonzero(alive[:n])
        ids = token[last].astype(np.uint32)
        cut = [0, *(4 * np.searchsorted(last, ends)).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def forget(self) -> None:
        """Empty the cache: hashes of pre-tokens in order, and where the ids of each are in ``known_ids``."""
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros(0, np.int64)
        self.known_size = np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.uint32)

    def _starts(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pre-tokens begin, in bytes."""
        lead = np.flatnonzero((body & 0xC0) != 0x80)
        text = body.tobytes().decode()
        if self.standard:
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            return lead[split_code_points(code, np.searchsorted(lead, offsets))]
        at, out = np.searchsorted(lead, offsets).tolist(), []
        for i, j in zip(at, at[1:], strict=False):
            found = [i + m.start() for m in self.pattern.finditer(text[i:j]) if m[0]]
            out += found
        return lead[np.array(out, np.int64)]

    def encode_bytes(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive UTF-8 texts, and the offsets of each text's ids."""
        begin = self._starts(body, offsets)
        words = Words(body, begin, np.append(begin[1:], len(body)) if len(begin) else begin, np.searchsorted(begin, offsets))
        h, where, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        new = self.known[at] != h if len(self.known) else np.ones(len(h), bool)
        if new.any():
            if len(self.known) + new.sum() > self.cache_size:
                self.forget()
                new[:] = True
            made = self.encode_pieces([words.text(i) for i in where[new].tolist()])
            sizes = np.array([len(x) // 4 for x in made])
            begins = len(self.known_ids) + np.cumsum(sizes) - sizes
            self.known_ids = np.concatenate((self.known_ids, np.frombuffer(b"".join(made), np.uint32)))
            order = np.argsort(both := np.concatenate((self.known, h[new])), kind="stable")
            self.known = both[order]
            self.known_at = np.concatenate((self.known_at, begins))[order]
            self.known_size = np.concatenate((self.known_size, sizes))[order]
            at = np.searchsorted(self.known, h)
        at = at[which]
        sizes = self.known_size[at]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.known_ids[np.arange(ends[-1]) + np.repeat(self.known_at[at] - ends[:-1], sizes)]
        return ids, ends[words.first]

    def encode(self, text: str) -> np.ndarray:
        body = np.frombuffer(text.encode(), np.uint8)
        return self.encode_bytes(body, np.array([0, len(body)]))[0]

    def decode_ids(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and the offset of each id's bytes."""
        ids = ids.astype(np.int64)
        sizes = self.body_at[ids + 1] - self.body_at[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.body[np.arange(ends[-1]) + np.repeat(self.body_at[ids] - ends[:-1], sizes)], ends

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_ids(np.asarray(ids))[0].tobytes()


@lru_cache(2)
def load(path: str, pattern: str) -> ByteBPE:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ByteBPE(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids and the decoded bytes.

    ``path`` is a tiktoken rank file that every executor can read (it comes with an installed package).
    Null and empty texts give 0 tokens.  Nothing is shuffled; memory is bounded by one Arrow batch and the cache.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            body, offsets = string_buffers(column)
            for i, j in slices(offsets, SLICE_BYTES):
                own = body[offsets[i] : offsets[j]]
                ids, cut = bpe.encode_bytes(own, offsets[i : j + 1] - offsets[i])
                plain, at = bpe.decode_ids(ids)
                if not np.array_equal(plain, own):
                    raise ValueError("decoding did not give the text back")
                packed, at = ids.astype("<u4"), at[cut]
                parts = range(j - i)
                out = [
                    keys[i:j],
                    pa.array(np.diff(cut), pa.int64()),
                    pa.array([hashlib.sha256(packed[cut[k] : cut[k + 1]]).hexdigest() for k in parts]),
                    pa.array([hashlib.sha256(plain[at[k] : at[k + 1]]).hexdigest() for k in parts]),
                ]
                if with_ids:
                    out += [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.view(np.int32))), pa.array([plain[at[k] : at[k + 1]].tobytes() for k in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows of (id, decoded binary) for a column of id arrays; null arrays give empty bytes."""
    prepare(encoded.sparkSession)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            out = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {id_type}, decoded binary")
