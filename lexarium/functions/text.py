"""Text helpers as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexarium.config import Normalizer

# Fixed values.
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абцдефгхийклмнопщрстувшыёз"
SPACES = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
ANY_WORD = r"[\p{L}\p{N}_]+"
VOWELS = "аеёиоуыэюя"
#: Abbreviations whose dots end no sentence, in the order in which they are rewritten.
ABBREVIATIONS = ["т.е.", "т.д.", "т.п.", "т.к.", "и т.д.", "и т.п.", "и др.", "и пр.", "г.", "гг.", "в.", "вв.", "стр.", "с.", "см.", "ср.", "пр.", "др.", "обл."]
INITIAL = r"(?U)\b([А-ЯЁA-Z])\."


def transliterate(text: Column) -> Column:
    """Lower-cased text with Cyrillic letters for Latin ones, for inputs without Cyrillic."""
    return F.translate(F.lower(text), LATIN, CYRILLIC)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(f"^{SPACES}+|{SPACES}+$"), F.lit(""))


def lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text, LINE_BREAKS), strip), lambda x: x != "")


def any_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({ANY_WORD})"), F.lit(1))


def join_brackets(text: Column) -> Column:
    """Letters in brackets inside a word become part of it, also several in a row (11 passes)."""
    letters = r"[а-яё]"
    out = text
    for _ in range(11):
        for a, b in ((r"\[", r"\]"), ("<", ">")):
            out = F.regexp_replace(out, F.lit(f"(?iu)({letters}+){a}({letters}+){b}({letters}*)"), F.lit("$1$2$3"))
    return F.when(text.rlike(r"(?iu)[а-яё][\[<][а-яё]"), out).otherwise(text)


def words(text: Column, how: Normalizer) -> Column:
    """All words of the word class, lower-cased, of the least length."""
    out = F.regexp_extract_all(F.lower(join_brackets(text)), F.lit(f"(?iu)({how.word_class})"), F.lit(1))
    return F.filter(out, lambda w: F.length(w) >= how.min_token_len) if how.min_token_len > 1 else out


def fold(text: Column, how: Normalizer) -> Column:
    """Letters in the alphabet's form, all others left out."""
    a, b = how.folding
    out = F.translate(text, a, b) if a else text
    return F.regexp_replace(out, F.lit(f"[^{how.alphabet_letters}]"), F.lit(""))


def tokens(words_: Column, how: Normalizer) -> Column:
    """Words whose first letter is in the alphabet; letters inside stay as they are."""
    return F.filter(words_, lambda w: fold(F.substring(w, 1, 1), how) != "")


def first_letters(words_: Column, how: Normalizer) -> Column:
    return F.filter(F.transform(words_, lambda w: fold(F.substring(w, 1, 1), how)), lambda x: x != "")


def letter_string(words_: Column, how: Normalizer) -> Column:
    """All letters of all words, in the alphabet's form."""
    return fold(F.array_join(words_, ""), how)


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def counts(text: Column, alphabet: str) -> Column:
    """How often each letter of the alphabet occurs: one array, no explode and no shuffle."""
    return F.array(*[F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in alphabet])


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def syllables(word: Column, least: int = 1) -> Column:
    """Vowels; at least ``least`` where there is a letter."""
    n = count_of(F.lower(word), VOWELS)
    return F.when(word.rlike(r"\p{L}"), F.greatest(F.lit(least), n)).otherwise(n if least == 0 else F.lit(0))


def sentences(text: Column) -> Column:
    """Number of sentences, at least 1; 0 for a blank text.  Abbreviations are rewritten only in texts that have one."""
    quoted = [a.replace(".", r"\.") for a in ABBREVIATIONS]
    out = text
    for a, q in zip(ABBREVIATIONS, quoted, strict=True):
        out = F.regexp_replace(out, F.lit(r"(?iuU)\b" + q), F.lit(a.replace(".", "·")))
    out = F.when(text.rlike(r"(?iuU)\b(?:" + "|".join(quoted) + ")"), out).otherwise(text)
    out = F.regexp_replace(out, F.lit(INITIAL), F.lit("$1·"))
    parts = F.filter(F.split(out, rf"[.!?]+(?:{SPACES}|$)"), lambda s: strip(s) != "")
    return F.when(strip(text) == "", 0).otherwise(F.greatest(F.lit(1), F.size(parts)))


def ngrams(items: Column, n: int, sep: str) -> Column:
    """n-grams of an array as joined strings; none if it is shorter.  ``items`` is worked out once for each row, not once for each n-gram."""

    def joined(own: Column) -> Column:
        size = F.size(own)
        return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), lambda i: F.array_join(F.slice(own, i + 1, n), sep))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(items), joined), F.lit(0))
