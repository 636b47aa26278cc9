"""What a text's lines and words look like: the evidence of the line labeller and of the quality classifier."""

from __future__ import annotations

from operator import eq

import numpy as np

from .common import words_of

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
TERMINAL = (".", "!", "?", "。", "…", ":", ";", '"', "”", ")")

#: One bit each, in this order, of a line's feature mask.
FEATURES = (
    "some symbols", "many symbols", "pipes", "mostly upper case", "bangs", "words run on", "few distinct words", "very few distinct words",
    "repeats an earlier line", "one to three words", "four to fourteen words", "fifteen words or more", "ends a sentence", "digits", "address",
    "first line", "last line", "long words", "short words",
)


def line_masks(text: str | None) -> tuple[list[int], list[int]]:
    """Feature mask and word count of each line that has a word."""
    masks, counts = [], []
    if not text:
        return masks, counts
    seen: set[str] = set()
    for line in text.split("\n"):
        raw = line.encode()
        words = raw.split()
        n = len(words)
        if not n:
            continue
        size = len(raw)
        symbols = size - len(raw.translate(None, SYMBOLS))
        upper = size - len(raw.translate(None, UPPER))
        lower = size - len(raw.translate(None, LOWER))
        distinct = len(set(words))
        letters = size / n
        mask = (
            (symbols > 0)
            | (symbols * 50 > size) << 1
            | (raw.count(b"|") * 20 > n) << 2
            | (upper > lower and upper > 2) << 3
            | (raw.count(b"!!") * 5 > n) << 4
            | (n > 3 and sum(map(eq, words, words[1:])) * 4 > n) << 5
            | (n > 7 and distinct * 2 < n) << 6
            | (n > 7 and distinct * 5 < n) << 7
            | (line in seen) << 8
            | (n < 4) << 9
            | (3 < n < 15) << 10
            | (n > 14) << 11
            | line.rstrip().endswith(TERMINAL) << 12
            | (raw.translate(None, b"0123456789") != raw) << 13
            | (b"://" in raw or b"@" in raw) << 14
            | (not counts) << 15
            | (letters > 12) << 17
            | (letters < 3) << 18
        )
        seen.add(line)
        masks.append(int(mask))
        counts.append(n)
    masks[-1:] = [m | 1 << 16 for m in masks[-1:]]
    return masks, counts


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        _, pairs = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)
        keys = (pairs[:-1].astype(np.int64) << 32) | ids[2:]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = words_of(text)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    raw = text.encode()
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.encode().split())
        else:
            seen.add(line)
    return len(words), chars, symbols, dup, repeat_words(words)


def bits(masks) -> np.ndarray:
    """Feature masks as a 0/1 matrix."""
    masks = np.asarray(masks, np.int64)
    return ((masks[:, None] >> np.arange(len(FEATURES))) & 1).astype(np.float64)
