"""Discrete text features: a measure and the bins it falls in.  Measures are made in an Arrow pass over the texts, bins are column expressions over them."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium import runtime
from lexarium.functions import text as T

# Character lists, word lists and bins.
PUNCTUATION = ".,;:!?—-–()[]{}\"'«»"
LINE_END_PUNCTUATION = ".,;:!?—-–)]}\"'«»…"
STOP_WORDS = ["и", "в", "во", "не", "что", "он", "она", "как", "я", "с", "со", "а", "то", "все", "всё", "к", "на", "ты", "мы", "они", "бы", "для", "же", "ли", "или", "но", "о", "от", "по", "из", "у", "над", "под", "при", "про", "это", "этот", "эта", "эти"]
ADJECTIVE_ENDINGS = ["ый", "ий", "ой", "ая", "яя", "ое", "ее", "ые", "ие", "ья", "ье", "го", "ей"]
RARE_LETTERS = "щчфъёй"
VOICED, CONSONANTS, INITIAL_CONSONANTS = "бвгджз", "бвгджзклмнпрстфхцчшщ", "бвгджзйклмнпрстфхцчшщ"


@dataclass(frozen=True)
class Bins:
    """Labels in order; a value is under the first label whose limit it is below (or, ``closed``, does not exceed)."""

    limits: tuple[float, ...]
    labels: tuple[str, ...]
    closed: bool = False

    def of(self, value: Column) -> Column:
        out = F.when(value <= self.limits[0] if self.closed else value < self.limits[0], self.labels[0])
        for limit, label in zip(self.limits[1:], self.labels[1:], strict=False):
            out = out.when(value <= limit if self.closed else value < limit, label)
        return out.otherwise(self.labels[-1])


def _five(suffix: str) -> tuple[str, ...]:
    return tuple(f"{x}_{suffix}" for x in ("very_low", "low", "mid", "high", "very_high"))


def _four(suffix: str) -> tuple[str, ...]:
    return tuple(f"{x}_{suffix}" for x in ("low", "mid", "high", "very_high"))


BINS = {
    "avg_word_len": Bins((4, 7, 12), ("short", "medium", "long", "very_long"), True),
    "avg_line_len": Bins((30, 60, 90), ("short_line", "medium_line", "long_line", "very_long_line"), True),
    "punct_ratio": Bins((0.05, 0.1, 0.2), _four("punct")),
    "unique_ratio": Bins((0.3, 0.5, 0.7), ("low", "mid", "high", "very_high")),
    "vowel_ratio": Bins((0.35, 0.5, 0.65), _four("vowel")),
    "line_count": Bins((1, 4, 8), ("one_line", "few", "several", "many"), True),
    "token_count": Bins((30, 80, 150), ("tiny", "short_text", "medium_text", "long_text"), True),
    "long_word_share": Bins((0.1, 0.25, 0.4), _four("longword")),
    "stopword_ratio": Bins((0.15, 0.3, 0.45), _four("stop")),
    "upper_ratio": Bins((0.02, 0.08, 0.15), _four("upper")),
    "sentence_length": Bins((6, 12, 20), ("very_short_sent", "short_sent", "medium_sent", "long_sent"), True),
    "rare_letter_ratio": Bins((0.01, 0.025, 0.05, 0.08), _five("rare")),
    "syllables_per_line": Bins((8, 12, 16), _four("syll_per_line")),
    "line_length_std": Bins((5, 12, 20), _four("line_std")),
    "rhyme_repetition": Bins((0.15, 0.3, 0.5, 0.7), _five("rhyme_rep")),
    "meter_pattern": Bins((6, 9, 12, 15), ("very_short_meter", "short_meter", "mid_meter", "long_meter", "very_long_meter"), True),
    "meter_regularity": Bins((1.0, 1.5, 2.5, 3.5), ("very_regular", "regular", "mid_regular", "irregular", "very_irregular")),
    "rhyme_quality": Bins((0.3, 0.5, 0.7, 0.85), ("very_repetitive_rhyme", "repetitive_rhyme", "mid_rhyme", "diverse_rhyme", "very_diverse_rhyme")),
    "enjambment_rate": Bins((0.1, 0.25, 0.4, 0.6), _five("enjamb")),
    "adjective_density": Bins((0.05, 0.1, 0.15, 0.2), _five("adj")),
    "consonant_repetition": Bins((1.5, 2.0, 2.5), _four("alliter")),
    "voiced_consonant_ratio": Bins((0.25, 0.35, 0.45, 0.55), _five("voiced")),
    "exclamation_ratio": Bins((0.05, 0.15, 0.3, 0.5), _five("exclam")),
    "question_ratio": Bins((0.05, 0.15, 0.3, 0.5), _five("quest")),
}
LEXICON_BINS = Bins((0.005, 0.015, 0.03, 0.05), ("very_low", "low", "mid", "high", "very_high"))
END_PUNCTUATION = {"?": "question_end", "!": "exclam_end", ";": "semicolon_end", ",": "comma_end", ".": "dot_end"}
#: Labels for inputs without a measure, besides ``empty``.
MISSING = {"meter_pattern": "no_meter", "meter_regularity": "too_short", "rhyme_quality": "too_short", "consonant_repetition": "no_alliteration", "voiced_consonant_ratio": "no_consonants", "exclamation_ratio": "no_punct", "question_ratio": "no_punct"}

BASELINE = ["avg_word_len", "avg_line_len", "punct_ratio", "token_count", "long_word_share", "stopword_ratio"]
PROFILES = {
    "baseline": BASELINE,
    "compact": [*BASELINE, "end_punct", "line_count", "unique_ratio"],
    "poetry_essential": ["adjective_density", "enjambment_rate", "exclamation_ratio", "meter_pattern", "rhyme_scheme", "syllables_per_line", "avg_line_len"],
    "poetry_full": ["meter_pattern", "meter_regularity", "rhyme_scheme", "rhyme_quality", "enjambment_rate", "adjective_density", "consonant_repetition", "voiced_consonant_ratio", "exclamation_ratio", "question_ratio", "avg_line_len", "syllables_per_line", "line_length_std", "rhyme_repetition", "avg_word_len", "punct_ratio", "stopword_ratio"],
    "full": [*BINS, "end_punct", "rhyme_scheme"],
}


def profile(name: str) -> list[str]:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}")
    return list(PROFILES[name])


_WORD = re.compile(r"\w+")
_LETTERS = re.compile(r"[^\W\d_]+")
_FIRST_CONSONANT = re.compile(rf"\b[^\W{INITIAL_CONSONANTS}]*([{INITIAL_CONSONANTS}])\w*")


def _count(text: str, chars: str) -> int:
    return sum(map(text.count, set(chars)))


def _mean(values: list[int]) -> float | None:
    return sum(values) / len(values) if values else None


def _std(values: list[int]) -> float | None:
    if not values:
        return None
    m = sum(values) / len(values)
    return math.sqrt(max(sum(x * x for x in values) / len(values) - m * m, 0.0))


def _ratio(a: float, b: float) -> float | None:
    return a / b if b > 0 else None


class _Text:
    """What the measures of one text share; each part is worked out when a measure asks for it."""

    def __init__(self, text: str):
        self.t = text

    @cached_property
    def lower(self) -> str:
        return self.t.lower()

    @cached_property
    def lines(self) -> list[str]:
        """Stripped lines that are not blank, as functions.text.lines()."""
        return [x for x in map(str.strip, self.t.splitlines()) if x]

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.lower)

    @cached_property
    def alpha(self) -> str:
        """The letters, lower-cased."""
        out = "".join(_LETTERS.findall(self.t))
        return (out if out.isalpha() else "".join(filter(str.isalpha, out))).lower()

    def line_words(self, most: int | None = None) -> list[list[str]]:
        return [_WORD.findall(x.lower()) for x in self.lines[:most]]

    @cached_property
    def spoken(self) -> list[list[str]]:
        """The words of each line that has any."""
        return [w for w in self.line_words() if w]

    @cached_property
    def syllables(self) -> list[int]:
        return [_count("".join(w), T.VOWELS) for w in self.spoken]

    @cached_property
    def ends(self) -> list[str]:
        return [w[-1][-3:] for w in self.spoken]


def _sentence_length(x: _Text) -> float | None:
    return _mean([len(_WORD.findall(s)) for s in re.split("[.!?]", x.lower) if s.strip()])


def _consonant_repetition(x: _Text) -> float | None:
    lines = [_FIRST_CONSONANT.findall(y) for y in map(str.lower, x.lines[:12]) if len(_WORD.findall(y)) >= 2]
    return _mean([max(Counter(f).values()) for f in lines if f])


def _enjambment_rate(x: _Text) -> float | None:
    n = len(x.lines)
    return sum(y[-1] not in LINE_END_PUNCTUATION for y in x.lines[: n - 1]) / (n - 1) if n >= 2 else None


def _upper(text: str) -> int:
    return sum(unicodedata.category(c) == "Lu" for c in filter(str.isupper, text)) if text != text.lower() else 0


#: The number behind each feature; None where there is none.
MEASURES: dict[str, Callable[[_Text], float | None]] = {
    "avg_word_len": lambda x: _ratio(sum(map(len, x.words)), len(x.words)),
    "avg_line_len": lambda x: _mean([len(y) for y in x.lines]),
    "punct_ratio": lambda x: _ratio(_count(x.t, PUNCTUATION), len(x.t)),
    "unique_ratio": lambda x: _ratio(len(set(x.words)), len(x.words)),
    "vowel_ratio": lambda x: _ratio(_count(x.alpha, "аеёиоуыэюяaeiou"), len(x.alpha)),
    "line_count": lambda x: len(x.lines) or None,
    "token_count": lambda x: len(x.words) or None,
    "long_word_share": lambda x: _ratio(sum(len(w) >= 8 for w in x.words), len(x.words)),
    "stopword_ratio": lambda x: _ratio(sum(map(_STOP.__contains__, x.words)), len(x.words)),
    "upper_ratio": lambda x: _ratio(_upper(x.t), len(x.alpha)),
    "sentence_length": _sentence_length,
    "rare_letter_ratio": lambda x: _ratio(_count(x.alpha, RARE_LETTERS), len(x.alpha)),
    "syllables_per_line": lambda x: _mean(x.syllables),
    "line_length_std": lambda x: _std([len(y) for y in x.lines]),
    "rhyme_repetition": lambda x: max(Counter(x.ends).values()) / len(x.lines) if x.ends else None,
    "meter_pattern": lambda x: _mean([_count("".join(w), T.VOWELS) for w in x.line_words(10) if w]),
    "meter_regularity": lambda x: _std(x.syllables) if len(x.syllables) >= 2 else None,
    "rhyme_quality": lambda x: len(set(x.ends)) / len(x.ends) if len(x.lines) >= 4 and x.ends else None,
    "enjambment_rate": _enjambment_rate,
    "adjective_density": lambda x: _ratio(sum(w[-2:] in _ADJECTIVE and len(w) > 3 for w in x.words), len(x.words)),
    "consonant_repetition": _consonant_repetition,
    "voiced_consonant_ratio": lambda x: _ratio(_count(x.alpha, VOICED), _count(x.alpha, CONSONANTS)),
    "exclamation_ratio": lambda x: _ratio(x.t.count("!"), _count(x.t, ".!?;")),
    "question_ratio": lambda x: _ratio(x.t.count("?"), _count(x.t, ".!?;")),
}
_STOP, _ADJECTIVE = frozenset(STOP_WORDS), frozenset(ADJECTIVE_ENDINGS)
#: Features whose label for a text without a measure depends on its lines.
_LINES_ONLY = ("meter_pattern", "meter_regularity", "consonant_repetition")


def rhyme_scheme(x: _Text) -> str:
    """Scheme of the first quatrains by their 2-letter line ends: cross before paired before enclosed."""
    e = [w[-1][-2:] for w in x.line_words(16) if w]
    if len(x.lines) < 4 or len(e) < 4:
        return "too_short"
    fours = [e[i : i + 4] for i in range(0, len(e) - 3, 4)]
    cross, paired, ring = (sum(q[a] == q[b] and q[c] == q[d] for q in fours) for a, b, c, d in ((0, 2, 1, 3), (0, 1, 2, 3), (0, 3, 1, 2)))
    if cross + paired + ring == 0:
        return "free_rhyme"
    return "cross_rhyme" if cross >= paired and cross >= ring else "paired_rhyme" if paired >= ring else "enclosed_rhyme"


def _measure(texts: list[str | None], names: list[str], lines: bool, alpha: bool) -> tuple[None, list]:
    out: list[list] = [[] for _ in range(len(names) + 3)]
    for t in texts:
        x = _Text(t or "")
        out[0].append(not t)
        out[1].append(len(x.lines) if lines and t is not None else None)
        out[2].append(len(x.alpha) if alpha and t is not None else None)
        for values, name in zip(out[3:], names, strict=True):
            if name == "rhyme_scheme":
                values.append("free_rhyme" if t is None else rhyme_scheme(x))
            elif name == "end_punct":
                values.append(x.t.strip()[-1:])
            else:
                m = MEASURES[name](x)
                values.append(None if m is None else float(m))
    return None, out


def measured(df: DataFrame, names: list[str], text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` with what labels() needs: the measures of the features (own_m_...), made in one Arrow pass."""
    fields = ", ".join(["own_blank boolean, own_lines int, own_alpha int", *[f"own_m_{n} {'string' if n in ('rhyme_scheme', 'end_punct') else 'double'}" for n in names]])
    lines, alpha = any(n in (*_LINES_ONLY, "rhyme_quality") for n in names), "voiced_consonant_ratio" in names
    return runtime.map_texts(df, text_col, fields, lambda texts: _measure(texts, names, lines, alpha), keep_text)


def labels(names: list[str]) -> dict[str, Column]:
    """The bin of each feature, over the columns of measured()."""
    out = {}
    for name in names:
        m = F.col(f"own_m_{name}")
        if name == "rhyme_scheme":
            out[name] = m
        elif name == "end_punct":
            case = F.when(m == "", "empty")
            for mark, label in END_PUNCTUATION.items():
                case = case.when(m == mark, label)
            out[name] = case.otherwise("other_end")
        else:
            blank = F.col("own_lines") == 0 if name in _LINES_ONLY else F.col("own_alpha") == 0 if name == "voiced_consonant_ratio" else F.col("own_blank")
            if name == "rhyme_quality":
                missing = F.when(F.col("own_lines") < 4, "too_short").otherwise("no_rhyme")
            else:
                missing = F.when(blank, "empty").otherwise(MISSING.get(name, "empty"))
            out[name] = F.when(m.isNull(), missing).otherwise(BINS[name].of(m))
    return out


def lexicon_density(words: list[str]) -> Column:
    """Bin of the share of words that are in an author's lexicon; over ``own_words``, the words of the text."""
    if not words:
        return F.when(F.size("own_words") == 0, "empty").otherwise("unknown_lexicon")
    n = F.size("own_words")
    return F.when(n == 0, "empty").otherwise(LEXICON_BINS.of(F.size(F.filter("own_words", lambda x: x.isin(words))) / n))
