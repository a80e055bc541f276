"""Word rule and per-document statistics shared by the operators of this subpackage."""

from __future__ import annotations

import functools

import numpy as np

#: A word is a run of characters other than the six ASCII white-space characters; ``bytes.split`` has the same rule.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

_PLAIN, _SPACE, _SYMBOL, _UPPER, _DIGIT, _PUNCT = range(6)


class Numbering(dict):
    """word -> dense number in order of first sight."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


@functools.cache
def _classes() -> np.ndarray:
    """One class per code point; the exact white space and symbols win over the rest."""
    kind = np.zeros(0x110000, dtype=np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isupper():
            kind[code] = _UPPER
        elif c.isdigit():
            kind[code] = _DIGIT
    for c in "!?.,;:'\"()[]{}-_/\\":
        kind[ord(c)] = _PUNCT
    for c in SYMBOLS:
        kind[ord(c)] = _SYMBOL
    for c in " \t\n\x0b\x0c\r":
        kind[ord(c)] = _SPACE
    return kind


def _window_keys(ids: np.ndarray, distinct: int) -> np.ndarray:
    """One exact integer per 3-word window."""
    pair = ids[:-1] * distinct + ids[1:]
    if distinct > 2_000_000:  # three numbers no longer fit in 63 bits: renumber the pairs first
        pair = np.unique(pair, return_inverse=True)[1]
    return pair[:-1] * distinct + ids[2:]


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside any 3-word window that occurs at least twice in the text."""
    if len(ids) < 4:
        return 0
    keys = _window_keys(ids, distinct)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift:shift + len(twice)] |= twice
    return int(covered.sum())


STAT_NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct",
)


def doc_stats(text: str | None) -> tuple[int, ...]:
    """Counts of one whole text, in the order of STAT_NAMES; a null text counts as empty."""
    if not text:
        return (0,) * len(STAT_NAMES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0,) * len(STAT_NAMES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.bincount(_classes()[codes], minlength=6)
    number = Numbering()
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words), int(len(codes) - kinds[_SPACE]), int(kinds[_SYMBOL]), len(lines) - len(set(lines)),
        repeated_words(ids, len(number)), len(lines), int(kinds[_UPPER]), int(kinds[_DIGIT]), int(kinds[_PUNCT]),
        len(number),
    )
