"""Counts over one whole text, in numpy; used inside tasks."""

from __future__ import annotations

import unicodedata

import numpy as np

#: Classes of characters.
SPACE, LOWER, UPPER, DIGIT, PROSE, SYMBOL, WIDE_LOWER, WIDE_UPPER, OTHER = range(9)
N_CLASSES = 9
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _class_of(code: int) -> int:
    c = chr(code)
    kind = unicodedata.category(c)
    if c.isspace():
        return SPACE
    if kind[0] == "L":
        return {(True, True): UPPER, (True, False): LOWER, (False, True): WIDE_UPPER, (False, False): WIDE_LOWER}[(code < 128, kind in ("Lu", "Lt"))]
    if kind[0] == "N":
        return DIGIT
    if c in ".,;:'\"!?-()" or kind in ("Pd", "Pi", "Pf"):
        return PROSE
    return SYMBOL if kind[0] in "PS" else OTHER


def class_table() -> np.ndarray:
    """Class of every code point of the basic plane; the last entry stands for all others."""
    return np.array([_class_of(c) if not 0xD800 <= c < 0xE000 else OTHER for c in range(65_536)] + [OTHER], np.uint8)


def class_counts(text: str, table: np.ndarray) -> np.ndarray:
    counts = np.zeros(N_CLASSES, np.int64)
    for at in range(0, len(text), 1 << 20):
        codes = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le"), "<u4")
        counts += np.bincount(table[np.minimum(codes, 65_536)], minlength=N_CLASSES)
    return counts


def repeated_words(words: list) -> tuple[int, np.ndarray]:
    """Words that lie in a three-word window found at least twice, and how often each distinct word occurs."""
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    counts = np.bincount(a, minlength=len(ids))
    if len(words) < 4:
        return 0, counts
    n = len(ids)
    if n < 2_000_000:
        key = (a[:-2] * n + a[1:-1]) * n + a[2:]
    else:  # the product would not fit
        _, pair = np.unique(a[:-2] * n + a[1:-1], return_inverse=True)
        key = pair * n + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = np.zeros(len(words), bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum()), counts


def basic_counts(text: str) -> dict:
    """The counts of the rules: words, their characters, symbols, repeated lines and words."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    repeat, counts = repeated_words(words)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(text.count(c) for c in BLANK),
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat,
        "n_lines": len(lines),
        "words": words,
        "word_counts": counts,
    }
