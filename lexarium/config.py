"""How text becomes letters and words."""

from __future__ import annotations

from dataclasses import dataclass

# The two standard alphabets and the class of word characters.
RUS29 = "абвгдежзиклмнопрстуфхцчшщыэюя"
RUS33 = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
WORD_CLASS = "[а-яё]+"


@dataclass(frozen=True)
class Normalizer:
    """``rus29`` (also known as rus28) folds ё into е and й into и unless told to keep them, and leaves out ъ and ь; kept letters
    that the alphabet lacks are dropped.  ``custom`` takes ``letters`` without repeats."""

    alphabet: str = "rus29"
    letters: str = ""
    keep_yo: bool = False
    keep_j: bool = False
    min_token_len: int = 1
    word_class: str = WORD_CLASS

    def __post_init__(self):
        if self.alphabet not in ("rus28", "rus29", "rus33", "custom"):
            raise ValueError(f"unknown alphabet {self.alphabet!r}")
        if self.alphabet == "custom" and not self.letters:
            raise ValueError("a custom alphabet needs letters")

    @property
    def folds(self) -> bool:
        return self.alphabet in ("rus28", "rus29")

    @property
    def alphabet_letters(self) -> str:
        if self.alphabet == "custom":
            return "".join(dict.fromkeys(self.letters.lower()))
        return RUS29 if self.folds else RUS33

    @property
    def size(self) -> int:
        return len(self.alphabet_letters)

    def rank(self, letter: str) -> int | None:
        """1-based place of a letter in the alphabet."""
        at = self.alphabet_letters.find(letter)
        return at + 1 if at >= 0 and letter else None

    @property
    def folding(self) -> tuple[str, str]:
        """Letters to translate and what they become; those without a counterpart go."""
        if not self.folds:
            return "", ""
        pairs = [("ё", "е")] * (not self.keep_yo) + [("й", "и")] * (not self.keep_j)
        return "".join(a for a, _ in pairs) + "ъь", "".join(b for _, b in pairs)
