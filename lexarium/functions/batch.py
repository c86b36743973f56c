"""Letters, words and n-grams of a slice of texts at once, as numpy arrays.  Counts are kept apart by text, so a slice's size changes no figure."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexarium.config import WORD_CLASS, Normalizer
from lexarium.functions import numeric as N
from lexarium.functions import text as T

END = "\0"
#: Keys above this are replaced by their ranks before they grow further.
MOST = 1 << 62
_BRACKET = re.compile(r"[а-яё][\[<][а-яё]", re.I)
_JOINS = [re.compile(rf"([а-яё]+){a}([а-яё]+){b}([а-яё]*)", re.I) for a, b in ((r"\[", r"\]"), ("<", ">"))]


def joined(how: Normalizer) -> bool:
    """Whether words are found by Spark (own word class or least length) and not here."""
    return how.word_class != WORD_CLASS or how.min_token_len > 1


def source(text: Column, how: Normalizer) -> Column:
    """What Words takes: the lower-cased text, or its words with END between them."""
    return F.array_join(T.words(text, how), END) if joined(how) else F.lower(text)


@lru_cache(maxsize=8)
def tables(how: Normalizer) -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it belongs to a word, and its place in the alphabet after folding (from 1; 0 for none)."""
    word = np.zeros(0x110000, bool)
    if joined(how):
        word[1:] = True
    else:
        word[[ord(c) for c in re.findall("[а-яё]", "".join(map(chr, range(0xD800))), re.I)]] = True
    letter = np.zeros(0x110000, np.uint16)
    gone, became = how.folding
    for i, c in enumerate(how.alphabet_letters, 1):
        if c not in gone:
            letter[ord(c)] = i
    for a, b in zip(gone, became, strict=False):
        letter[ord(a)] = letter[ord(b)]
    return word, letter


def join_brackets(text: str) -> str:
    """As functions.text.join_brackets(), of a lower-cased text."""
    if not _BRACKET.search(text):
        return text
    for _ in range(11):
        was = text
        for p in _JOINS:
            text = p.sub(r"\1\2\3", text)
        if text == was:
            break
    return text


class Words:
    """The words of a slice: ``doc`` (place of the text), ``pos`` and ``start`` of each word that begins with a letter of the alphabet, in order, and ``n`` such words of each text."""

    def __init__(self, texts: list[str | None], how: Normalizer):
        self.how, self.docs = how, len(texts)
        own = [t or "" for t in texts]
        if not joined(how):
            own = [join_brackets(t) if "[" in t or "<" in t else t for t in own]
            own = [t.replace(END, " ") if END in t else t for t in own]
        size = np.fromiter(map(len, own), np.int64, len(own)) + 1
        self.cp = np.frombuffer((END.join(own) + END).encode("utf-32-le", "surrogatepass"), np.uint32)
        word, letter = tables(how)
        self.is_word = word[self.cp]
        self.letter = letter[self.cp]
        self.letter[~self.is_word] = 0
        self.doc_of = np.repeat(np.arange(self.docs, dtype=np.int32), size)
        before = np.zeros(len(self.cp), bool)
        before[1:] = self.is_word[:-1]
        self.after = before & ~self.is_word
        starts = np.flatnonzero(self.is_word & ~before)
        self.named = self.letter[starts] > 0
        self.start = starts[self.named]
        self.doc = self.doc_of[self.start]
        self.n = np.bincount(self.doc, minlength=self.docs)
        self.pos = np.arange(len(self.doc)) - (np.cumsum(self.n) - self.n)[self.doc]

    def strings(self) -> list[str]:
        """The words themselves."""
        keep = self.is_word | self.after
        text = np.where(self.is_word, self.cp, 0)[keep].tobytes().decode("utf-32-le", "surrogatepass")
        out = text.split(END)[:-1]
        return out if self.named.all() else [w for w, ok in zip(out, self.named, strict=True) if ok]

    def ids(self) -> tuple[np.ndarray, list[str]]:
        """The number of each word, and the words by number."""
        known: dict[str, int] = _Numbers()
        words = self.strings()
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words)), list(known)

    def letter_counts(self) -> np.ndarray:
        """Counts of the alphabet's letters by text."""
        size, at = self.how.size, np.flatnonzero(self.letter)
        return np.bincount(self.doc_of[at] * size + (self.letter[at] - 1), minlength=self.docs * size).reshape(self.docs, size)

    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """(doc, letter from 0) of all letters of all words, in order."""
        at = np.flatnonzero(self.letter)
        return self.doc_of[at], self.letter[at].astype(np.int64) - 1


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Counts:
    """Distinct keys (text, a, b, ...) with their counts, in their order.  ``parts`` are columns of whole numbers below their ``sizes``."""

    def __init__(self, doc: np.ndarray, parts: list[np.ndarray], sizes: list[int], docs: int, first: bool = False):
        self.docs = docs
        key, top, ranked = doc.astype(np.int64), max(docs, 1), False
        for p, size in zip(parts, sizes, strict=True):
            size = max(size, 1)
            if top * size >= MOST:
                ranks, key = np.unique(key, return_inverse=True)
                top, ranked = len(ranks), True
            key, top = key * size + p, top * size
        self.last = max(sizes[-1], 1)
        if ranked or first:
            self.key, self.first, self.n = np.unique(key, return_index=True, return_counts=True)
            self.doc = doc[self.first]
        else:
            key.sort()
            at = np.flatnonzero(np.diff(key, prepend=-1))
            self.key, self.n = key[at], np.diff(at, append=len(key))
            self.doc = self.key
            for size in reversed(sizes):
                self.doc = self.doc // max(size, 1)

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """(doc, count) of the keys without their last part."""
        if not len(self.key):
            return self.doc, self.n
        at = np.flatnonzero(np.diff(self.key // self.last, prepend=-1))
        return self.doc[at], np.add.reduceat(self.n, at)

    def entropy(self) -> np.ndarray:
        return entropy(self.doc, self.n, self.docs)


def entropy(doc: np.ndarray, n: np.ndarray, docs: int) -> np.ndarray:
    """Entropy in bits of the counts of each text; 0 without counts."""
    total = np.bincount(doc, weights=n, minlength=docs)
    some = np.maximum(total, 1)
    return np.log2(some) - np.bincount(doc, weights=n * np.log2(n), minlength=docs) / some


def grams(doc: np.ndarray, items: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(doc, columns) of n neighbouring items of one text."""
    if len(doc) < n:
        return doc[:0], [items[:0]] * n
    whole = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    return doc[whole], [items[whole + k] for k in range(n)]


def top_share(doc: np.ndarray, n: np.ndarray, docs: int, ks: tuple[int, ...]) -> list[np.ndarray]:
    """For each k the sum of each text's k largest counts."""
    most = int(n.max(initial=0)) + 1
    key = np.sort(doc * most + (most - 1 - n))
    doc, n = key // most, most - 1 - key % most
    kinds = np.bincount(doc, minlength=docs)
    rank = np.arange(len(doc)) - (np.cumsum(kinds) - kinds)[doc]
    return [np.bincount(doc[rank < k], weights=n[rank < k], minlength=docs) for k in ks]


def lists(values: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists; of nulls where ``missing``."""
    flat = pa.array(values.ravel(), mask=np.repeat(missing, values.shape[1]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)


def letter_figures(texts: list[str | None], how: Normalizer) -> tuple[None, list]:
    """n_words and counts of the alphabet's letters; nulls for null."""
    w = Words(texts, how)
    missing = np.fromiter((t is None for t in texts), bool, len(texts))
    return None, [pa.array(w.n, mask=missing), lists(w.letter_counts().astype(np.int32), missing)]


def distribution(texts: list[str | None], how: Normalizer, n: int, unit: str = "word") -> tuple[np.ndarray, list]:
    """Totals, entropies, hapax figures and coverage of the n-grams of words or letters; no row for texts without any."""
    w = Words(texts, how)
    if unit == "word":
        items, known = w.ids()
        doc, size = w.doc, len(known)
    else:
        (doc, items), size = w.letters(), how.size
    doc, parts = grams(doc, items, n)
    c = Counts(doc, parts, [size] * n, w.docs)
    total, kinds = np.bincount(c.doc, weights=c.n, minlength=w.docs), np.bincount(c.doc, minlength=w.docs)
    once = np.bincount(c.doc[c.n == 1], minlength=w.docs)
    c10, c50 = top_share(c.doc, c.n, w.docs, (10, 50))
    h = c.entropy()
    given = np.maximum(h - entropy(*c.heads(), w.docs), 0)
    rows = np.flatnonzero(total)
    t, k = total[rows], kinds[rows]
    return rows, [t.astype(np.int64), k, h[rows], once[rows], once[rows] / k, c10[rows] / t, c50[rows] / t, given[rows]]


def top_grams(texts: list[str | None], how: Normalizer, n: int, k: int) -> tuple[np.ndarray, list]:
    """The k most frequent n-grams of words of each text (ties: the earlier): ngram, count, frequency, rank, cumulative share."""
    w = Words(texts, how)
    items, known = w.ids()
    doc, parts = grams(w.doc, items, n)
    c = Counts(doc, parts, [len(known)] * n, w.docs, first=True)
    order = np.lexsort((c.first, -c.n, c.doc))
    doc, count, first = c.doc[order], c.n[order], c.first[order]
    kinds = np.bincount(doc, minlength=w.docs)
    begin = (np.cumsum(kinds) - kinds)[doc]
    rank = np.arange(len(doc)) - begin
    run = np.cumsum(count)
    total = np.bincount(doc, weights=count, minlength=w.docs)[doc]
    cumulative = (run - (run - count)[begin]) / total
    at = np.flatnonzero(rank < k)
    text = [" ".join([known[p[i]] for p in parts]) for i in first[at].tolist()]
    return doc[at], [text, count[at], count[at] / total[at], rank[at] + 1, cumulative[at]]


def gries(texts: list[str | None], how: Normalizer, segments: int, least: int, mean: bool = False) -> tuple[np.ndarray, list]:
    """Deviation of proportions of the words of ``least`` occurrences (token, n, dp, dp_norm), or the mean of dp_norm of each text that has such words."""
    w = Words(texts, how)
    items, known = w.ids()
    k = np.minimum(segments, np.maximum(w.n, 1))
    short, longer = w.n // k, w.n % k
    edge = longer * (short + 1)
    s, e = short[w.doc], edge[w.doc]
    seg = np.where(w.pos < e, w.pos // (s + 1), longer[w.doc] + (w.pos - e) // np.maximum(s, 1))
    c = Counts(w.doc, [items, seg], [len(known), segments], w.docs, first=True)
    if not len(c.key):
        return np.zeros(0, np.int64), [[]] * (1 if mean else 4)
    at = np.flatnonzero(np.diff(c.key // segments, prepend=-1))
    part = np.where(c.key % segments < longer[c.doc], short[c.doc] + 1, short[c.doc])
    f = np.add.reduceat(c.n, at)
    n = w.n[c.doc]
    seen = np.add.reduceat(np.abs(c.n * n - np.repeat(f, np.diff(at, append=len(c.n))) * part), at)
    share = np.add.reduceat(part, at)
    n, low = n[at], (short / np.maximum(w.n, 1))[c.doc[at]]
    # Whole numbers up to one division; segments without the word add their share.
    dp = (seen + f * (n - share)) / (2 * f * n)
    norm = np.where(low < 1, np.clip(1 - dp / np.where(low < 1, 1 - low, 1), 0, 1), 1.0)
    often = np.flatnonzero(f >= least)
    doc = c.doc[at][often]
    if mean:
        number = np.bincount(doc, minlength=w.docs)
        rows = np.flatnonzero(number)
        return rows, [np.bincount(doc, weights=norm[often], minlength=w.docs)[rows] / number[rows]]
    return doc, [[known[i] for i in items[c.first[at][often]].tolist()], f[often], dp[often], norm[often]]


_NO_VOWELS = str.maketrans(dict.fromkeys("".join(chr(c) for c in range(0x430, 0x460) if chr(c) not in T.VOWELS)))
_OTHER = re.compile(f"[^{T.VOWELS}]+")


def syllable_parts(known: list[str]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Syllables of each word, the number of its pattern of vowels (0: none), and how many of either there are."""
    pattern = [_OTHER.sub("", p) if not p.isascii() else "" for p in (x.translate(_NO_VOWELS) for x in known)]
    numbers = _Numbers()
    numbers[""] = 0
    kinds = np.fromiter(map(numbers.__getitem__, pattern), np.int64, len(known))
    n = np.fromiter(map(len, pattern), np.int64, len(known))
    spoken = np.fromiter((any(map(str.isalpha, x)) for x in known), bool, len(known))
    n = np.where(spoken, np.maximum(n, 1), 0)
    return n, kinds, int(n.max(initial=0)) + 1, len(numbers)


def syllable_entropy(texts: list[str | None], how: Normalizer) -> tuple[np.ndarray, list]:
    """Entropies of syllable counts, of the next count given one, and of vowel patterns, and the number of these; texts of 10 words or more."""
    w = Words(texts, how)
    items, known = w.ids()
    syl, pat, most, kinds = syllable_parts(known)
    doc, s, p = w.doc, syl[items], pat[items]
    one = Counts(doc, [s], [most], w.docs).entropy()
    pairs = Counts(*grams(doc, s, 2), [most, most], w.docs)
    given = np.maximum(pairs.entropy() - entropy(*pairs.heads(), w.docs), 0)
    c = Counts(doc[p > 0], [p[p > 0]], [kinds], w.docs)
    rows = np.flatnonzero(w.n >= 10)
    return rows, [one[rows], given[rows], c.entropy()[rows], np.bincount(c.doc, minlength=w.docs)[rows]]


def rolling(texts: list[str | None], how: Normalizer, window: int, step: int) -> tuple[np.ndarray, list]:
    """(position, entropy) of the first letters of each ``window`` words, ``step`` apart; none for shorter texts."""
    w = Words(texts, how)
    first = w.letter[w.start].astype(np.int64) - 1
    windows = np.where(w.n >= window, (w.n - window) // step + 1, 0)
    doc = np.repeat(np.arange(w.docs), windows)
    position = (np.arange(len(doc)) - (np.cumsum(windows) - windows)[doc]) * step
    begin = (np.cumsum(w.n) - w.n)[doc] + position
    nlogn = np.zeros(window + 1)
    nlogn[1:] = np.arange(1, window + 1) * np.log2(np.arange(1, window + 1))
    total = np.zeros(len(doc))
    for x in range(how.size):
        seen = np.concatenate(([0], np.cumsum(first == x)))
        total += nlogn[seen[begin + window] - seen[begin]]
    return doc, [position, np.log2(window) - total / window]


def _doc_sums(doc: np.ndarray, values: np.ndarray, docs: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=docs)


def _hdd(doc: np.ndarray, n: np.ndarray, size: np.ndarray, docs: int, draw: int = 42) -> np.ndarray:
    """HD-D from the counts of each text's words; 0 under ``draw`` tokens.  Words of one count are worked out together."""
    c = Counts(doc, [n], [int(n.max(initial=0)) + 1], docs)
    n = c.key % c.last
    total = size[c.doc].astype(float)
    miss = np.ones(len(n))
    for i in range(draw):
        miss *= np.maximum(0.0, total - n - i) / np.maximum(total - i, 1.0)
    return _doc_sums(c.doc, np.where(total >= draw, (1 - miss) / draw, 0.0) * c.n, docs)


def _bursts(doc: np.ndarray, gap: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Burstiness parameter and memory coefficient of each text's gaps, in their order; 0 where there are fewer than 3 or they don't vary."""
    n = np.bincount(doc, minlength=docs)
    some = np.maximum(n, 1)
    mean = _doc_sums(doc, gap, docs) / some
    sd = np.sqrt(_doc_sums(doc, (gap - mean[doc]) ** 2, docs) / np.maximum(n - 1, 1))
    parameter = np.where(n >= 3, (sd - mean) / np.where(n > 0, sd + mean, 1), 0.0)
    d, (x, y) = grams(doc, gap, 2)
    k = np.maximum(np.bincount(d, minlength=docs), 1)
    dx, dy = x - (_doc_sums(d, x, docs) / k)[d], y - (_doc_sums(d, y, docs) / k)[d]
    vary = np.ones(docs, bool)
    for z in (x, y):
        low, high = np.full(docs, np.inf), np.full(docs, -np.inf)
        np.minimum.at(low, d, z)
        np.maximum.at(high, d, z)
        vary &= high > low
    norm = np.sqrt(_doc_sums(d, dx * dx, docs) * _doc_sums(d, dy * dy, docs))
    memory = np.where((n >= 3) & vary, _doc_sums(d, dx * dy, docs) / np.where(vary & (norm > 0), norm, 1), 0.0)
    return parameter, memory


@lru_cache(maxsize=1)
def _marks() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: spaces, Java's word characters (letters, marks, decimal digits, connectors, joiners), what it is without case for abbreviations, capitals of initials."""
    every = range(0x110000)
    space = np.fromiter((chr(c).isspace() for c in every), bool, 0x110000)
    word = np.fromiter((unicodedata.category(chr(c)) in _WORD_KINDS for c in every), bool, 0x110000)
    for low, high in ((0x200C, 0x200D), (0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189)):
        word[low : high + 1] = True
    same = np.arange(0x110000, dtype=np.uint32)
    for c in sorted(set("".join(T.ABBREVIATIONS)) - set(" .")):
        same[[ord(x) for x in re.findall(c, _BMP, re.I)]] = ord(c)
    capital = np.zeros(0x110000, bool)
    capital[[ord(c) for c in re.findall("[А-ЯЁA-Z]", _BMP)]] = True
    return space, word, same, capital


_BMP = "".join(map(chr, range(0xD800)))
_WORD_KINDS = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Me", "Nd", "Pc"}


def sentences(texts: list[str | None]) -> np.ndarray:
    """As functions.text.sentences(): at least 1 for each text, 0 for a blank one.

    Abbreviations and initials share no dot that the others need, so a dot ends no sentence if it is in any of them.
    """
    space, word, same, capital = _marks()
    own = [t.replace(END, "-") if t and END in t else t or "" for t in texts]
    docs, size = len(own), np.fromiter(map(len, own), np.int64, len(own)) + 1
    cp = np.frombuffer((END.join(own) + END).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc_of = np.repeat(np.arange(docs, dtype=np.int32), size)
    first = np.cumsum(size) - size
    edge, content = cp == 0, ~space[cp]
    content[edge] = False
    mark = (cp == ord(".")) | (cp == ord("!")) | (cp == ord("?"))
    dots = np.flatnonzero(cp == ord("."))
    begin = first[doc_of[dots]]
    outside = lambda at: (at < begin) | ~word[cp[np.maximum(at, 0)]]
    mark[dots[(dots - 1 >= begin) & capital[cp[np.maximum(dots - 1, 0)]] & outside(dots - 2)]] = False
    for a in T.ABBREVIATIONS:
        start = dots - (len(a) - 1)
        found = (start >= begin) & outside(start - 1)
        for k, c in enumerate(a):
            found &= same[cp[np.maximum(start + k, 0)]] == ord(c)
        for k in (k for k, c in enumerate(a) if c == "."):
            mark[start[found] + k] = False
    # Runs of marks before a space or the end of the text part sentences.
    at = np.flatnonzero(mark)
    last = at[~mark[at + 1]]
    stops = last[space[cp[last + 1]] | edge[last + 1]]
    runs = at[~mark[at - 1] | (at == 0)]
    heads = runs[np.searchsorted(runs, stops, "right") - 1] if len(stops) else stops
    inside = np.zeros(len(cp) + 1, np.int32)
    inside[heads] += 1
    inside[stops + 1] -= 1
    content &= np.cumsum(inside[:-1]) == 0
    part = np.zeros(len(cp), np.int64)
    part[heads] = 1
    part[edge] = 1
    part = np.cumsum(part)
    full = np.flatnonzero(content)
    full = full[np.diff(part[full], prepend=-1) != 0]
    blank = np.fromiter((not t or t.isspace() for t in own), bool, docs)
    return np.where(blank, 0, np.maximum(1, np.bincount(doc_of[full], minlength=docs)))


def readability(texts: list[str | None], raw: list[str | None], how: Normalizer) -> tuple[None, list]:
    """Sentences, words, syllables and words of three syllables or more."""
    w = Words(texts, how)
    items, known = w.ids()
    syl = syllable_parts(known)[0][items]
    null = np.fromiter((t is None for t in raw), bool, w.docs)
    return None, [pa.array(sentences(raw), mask=null), w.n, _doc_sums(w.doc, syl, w.docs), _doc_sums(w.doc, syl >= 3, w.docs)]


#: Columns of attribution(): the parts of the attribution vector before they are scaled.
ATTRIBUTION = "avg_sentence_length double, mtld double, yules_k double, burst_parameter double, memory double, mattr double, hdd double, letter_bigram_conditional double, pattern_entropy double, avg_syllables double, compression_ratio double"


def attribution(texts: list[str | None], raw: list[str | None], how: Normalizer, window: int = 100, least: int = 5) -> tuple[None, list]:
    """ATTRIBUTION of each text; ``raw`` are the texts as they are.  Null where a figure has too little text."""
    w = Words(texts, how)
    docs, doc, n = w.docs, w.doc, w.n
    items, known = w.ids()
    bounds = np.cumsum(n)
    tokens = items.tolist()
    mtld = [N.mtld(tokens[b - k : b]) for b, k in zip(bounds.tolist(), n.tolist(), strict=True)]

    size = max(len(known), 1)
    key = doc * np.int64(size) + items
    order = np.argsort(key, kind="stable")
    pos = w.pos[order]
    new = np.diff(key[order], prepend=-1) != 0
    at = np.flatnonzero(new)
    group, occurrences = np.cumsum(new) - 1, np.diff(at, append=len(key))
    by = doc[order]
    squares = _doc_sums(by[at], occurrences * occurrences, docs)
    yules = 10000 * (squares - n) / np.maximum(n * n, 1)
    hdd = _hdd(by[at], occurrences, n, docs)

    prev = np.where(new, -1, np.concatenate(([-1], pos[:-1])) if len(pos) else pos)
    wide = np.minimum(window, n)[by]
    low = np.maximum(np.maximum(prev + 1, pos - wide + 1), 0)
    high = np.minimum(pos, n[by] - wide)
    short = np.minimum(window, n)
    mattr = _doc_sums(by, np.maximum(0, high - low + 1), docs) / np.maximum(short * (n - short + 1), 1)

    # The gaps of frequent words, words in the order of their first places.
    use = np.flatnonzero(~new & (occurrences[group] >= least)) if len(pos) else np.zeros(0, np.int64)
    use = use[np.lexsort((pos[use], pos[at][group[use]], by[use]))]
    parameter, memory = _bursts(by[use], (pos[use] - prev[use]).astype(float), docs)

    ldoc, letters = w.letters()
    pairs = Counts(*grams(ldoc, letters, 2), [how.size] * 2, docs)
    given = np.maximum(pairs.entropy() - entropy(*pairs.heads(), docs), 0)

    syl, pat, _, kinds = syllable_parts(known)
    p = pat[items]
    pattern = Counts(doc[p > 0], [p[p > 0]], [kinds], docs).entropy()
    spoken = _doc_sums(doc, syl[items], docs) / np.maximum(n, 1)
    null = n == 0
    return None, [
        n / np.maximum(sentences(raw), 1),
        mtld,
        pa.array(yules, mask=null),
        parameter,
        memory,
        pa.array(mattr, mask=null),
        pa.array(hdd, mask=null),
        given,
        np.where(n >= 10, pattern, 0.0),
        spoken,
        [N.compression(t or "")[2] for t in raw],
    ]


class _Characters:
    """All n-grams of 1 to 3 characters of a slice as keys over its own characters, or over those of a vocabulary.  A digit 0 stands for others and parts the texts."""

    def __init__(self, texts: list[str | None], chars: np.ndarray | None = None):
        own = [t or "" for t in texts]
        self.docs, size = len(own), np.fromiter(map(len, own), np.int64, len(own)) + 1
        cp = np.frombuffer((END.join(own) + END).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.doc = np.repeat(np.arange(self.docs), size)
        part = np.cumsum(size) - 1
        if chars is None:
            seen = np.bincount(cp, minlength=1)
            seen[0] -= len(part)
            chars = np.flatnonzero(seen)
        self.chars, self.base = chars, len(chars) + 1
        code = np.zeros(0x110000, np.int32 if self.base**3 <= TABLE else np.int64)
        code[chars] = np.arange(1, self.base)
        self.code = code[cp]
        self.code[part] = 0

    def keys(self, most: int):
        """(n, keys) for each n; a key's place is that of the n-gram's first character."""
        key = self.code
        for n in range(1, most + 1):
            if n > 1:
                key = key[:-1] * self.base + self.code[n - 1 :]
            yield n, key

    def whole(self, key: np.ndarray, n: int) -> np.ndarray:
        """Which keys have no digit 0."""
        ok = np.ones(len(key), bool)
        for _ in range(n):
            ok &= key % self.base > 0
            key = key // self.base
        return ok

    def gram(self, key: int) -> str:
        out = ""
        while key:
            key, c = divmod(key, self.base)
            out = chr(self.chars[c - 1]) + out
        return out


#: Tables of at most this many entries are indexed by key.
TABLE = 1 << 24


def gram_counts(texts: list[str | None], most: int = 3) -> tuple[np.ndarray, list]:
    """(gram, n) of the n-grams of 1 to ``most`` characters of a slice, all texts together."""
    x = _Characters(texts)
    grams_, counts = [], []
    for n, key in x.keys(most):
        if x.base**n <= TABLE:
            c = np.bincount(key)
            kinds = np.flatnonzero(c)
            c = c[kinds]
        else:
            kinds, c = np.unique(key, return_counts=True)
        ok = x.whole(kinds, n)
        grams_ += map(x.gram, kinds[ok].tolist())
        counts.append(c[ok])
    return np.zeros(len(grams_), np.int64), [grams_, np.concatenate(counts)]


def gram_vectors(texts: list[str | None], vocabulary: list[str], most: int = 3) -> tuple[None, list]:
    """Counts of the grams of a vocabulary in each text, as Spark ML's sparse vectors."""
    x = _Characters(texts, np.array(sorted({ord(c) for g in vocabulary for c in g}), np.int64))
    code, size = {chr(c): i for i, c in enumerate(x.chars.tolist(), 1)}, max(len(vocabulary), 1)
    counts = np.zeros(x.docs * size, np.int64)
    for n, key in x.keys(most):
        own = sorted((_key([code[c] for c in g], x.base), i) for i, g in enumerate(vocabulary) if len(g) == n)
        if not own or not len(key):
            continue
        known, place = np.array(own).T
        if x.base**n <= TABLE:
            table = np.full(x.base**n, -1, np.int32)
            table[known] = place
            at = table[key]
        else:
            near = np.minimum(np.searchsorted(known, key), len(known) - 1)
            at = np.where(known[near] == key, place[near], -1)
        hit = np.flatnonzero(at >= 0)
        counts += np.bincount(x.doc[hit] * size + at[hit], minlength=len(counts))
    full = np.flatnonzero(counts)
    ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(full // size, minlength=x.docs)))), pa.int32())
    indices = pa.ListArray.from_arrays(ends, pa.array(full % size, pa.int32()))
    values = pa.ListArray.from_arrays(ends, pa.array(counts[full], pa.float64()))
    return None, [pa.StructArray.from_arrays([pa.array(np.zeros(x.docs), pa.int8()), pa.array(np.full(x.docs, len(vocabulary)), pa.int32()), indices, values], names=["type", "size", "indices", "values"])]


def _key(codes: list[int], base: int) -> int:
    out = 0
    for c in codes:
        out = out * base + c
    return out
