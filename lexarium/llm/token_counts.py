"""Token counts: greedy longest-match piece counts by a linear automaton, without building pieces.

The vocabulary is a trie over bytes.  A node's failure link leads to where matching goes on after the
pieces that are then certain are popped, and its precomputed count says how many those are, so each
byte of a word is read once.  A word is a space and its bytes: vocabulary entries that begin with a space are
the word-initial pieces, the others continue a word.  Every single byte is in the vocabulary, so each word has pieces.

Null and empty texts have 0 words and 0 tokens.  Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._bytes import Words, slices, split_words, string_buffers
from ._spark import prepare


class PieceCounter:
    def __init__(self, vocabulary: list[bytes]):
        known = set(vocabulary)
        if missing := [b for b in range(256) if bytes([b]) not in known]:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:8]}; words with them have no pieces")
        children: list[dict[int, int]] = [{}]
        final = [False]
        for token in vocabulary:
            node = 0
            for byte in token:
                step = children[node].get(byte)
                if step is None:
                    step = children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = step
            final[node] = True
        fail, popped = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent].items():
                queue.append(node)
                if final[node]:
                    fail[node], popped[node] = 0, 1
                    continue
                back, count = fail[parent], popped[parent]
                while back >= 0 and byte not in children[back]:
                    count += popped[back]
                    back = fail[back]
                if back >= 0:
                    fail[node], popped[node] = children[back][byte], count
        edges = sorted((node << 8 | byte, step) for node, own in enumerate(children) for byte, step in own.items())
        self.edge = np.array([e[0] for e in edges], np.int64)
        self.step = np.array([e[1] for e in edges], np.int64)
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)

    def _child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node << 8 | byte
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.step[at], -1)

    def counts(self, words: Words, which: np.ndarray) -> np.ndarray:
        """Pieces of the given words; all run through the automaton side by side, a byte at a time."""
        start, size = words.start[which], words.end[which] - words.start[which]
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        n = len(order)
        node, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        active = n
        for p in range(-1, int(size[0]) if n else 0):
            active = int(np.searchsorted(-size[:active], -p, "left")) if p >= 0 else n
            byte = words.buf[start[:active] + p].astype(np.int64) if p >= 0 else np.full(n, 32)
            to = self._child(node[:active], byte)
            while len(stuck := np.flatnonzero(to < 0)):
                at = node[stuck]
                count[stuck] += self.popped[at]
                node[stuck] = self.fail[at]
                to[stuck] = self._child(node[stuck], byte[stuck])
            node[:active] = to
        while len(left := np.flatnonzero(node > 0)):
            count[left] += self.popped[node[left]]
            node[left] = self.fail[node[left]]
        out = np.empty(n, np.int64)
        out[order] = count
        return out


@lru_cache(2)
def load(path: str) -> PieceCounter:
    with open(path, "rb") as f:
        return PieceCounter([base64.b64decode(line.split()[0]) for line in f if line.strip()])


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (id, n_words, n_tokens), one for each row of ``docs``; other columns are left out.  Nothing is shuffled."""
    prepare(docs.sparkSession)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            body, offsets = string_buffers(batch.column(1))
            for i, j in slices(offsets, 4 << 20):
                words = split_words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                _, where, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
                total = np.concatenate(([0], np.cumsum(counter.counts(words, where)[which])))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(words.counts), pa.array(np.diff(total[words.first]))], names=[id_col, "n_words", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
