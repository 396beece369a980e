"""Pre-tokens of byte-level BPE, found for a whole batch of texts at once.

The pattern of the public vocabulary is

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Each byte gets the class of its character; class changes give the token starts, and two
corrections follow: a space before a token joins it, and contractions end early.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

SPACE, WHITE, LETTER, NUMBER, OTHER = range(5)

#: The characters of Unicode's White_Space property.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Suffixes that the pattern splits off after an apostrophe.
SUFFIXES = [b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"]

_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of every code point."""
    global _classes
    if _classes is None:
        c = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        kinds = {"L": LETTER, "N": NUMBER}
        for i in range(sys.maxunicode + 1):
            k = kinds.get(unicodedata.category(chr(i))[0])
            if k is not None:
                c[i] = k
        c[WHITE_SPACE] = WHITE
        c[0x20] = SPACE
        _classes = c
    return _classes


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each UTF-8 byte belongs to."""
    table = char_classes()
    c = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.int64)
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        point = b & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
        for k in (1, 2, 3):
            more = size > k
            at = lead[more] + k
            point[more] = point[more] << 6 | (data[at] & 0x3F)
        kind = table[point]
        c[lead] = kind
        for k in (1, 2, 3):
            more = size > k
            c[lead[more] + k] = kind[more]
    return c


def pretoken_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all pre-tokens (each ends where the next begins) and per row the index of its first."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    c = byte_classes(data)
    first = np.zeros(n + 1, bool)  # of a row
    first[offsets] = True
    white = c <= WHITE
    group = np.maximum(c, WHITE)
    run = first[:n].copy()
    run[1:] |= group[1:] != group[:-1]
    begin = run.copy()
    # a token after a single space begins at the space
    at = np.flatnonzero(run & ~white & ~first[:n])
    at = at[c[at - 1] == SPACE]
    begin[at] = False
    begin[at - 1] = True
    # white space before a token, when its last character is no space: that character stands alone
    at = np.flatnonzero(run & ~white & ~first[:n])
    at = at[c[at - 1] == WHITE] - 1
    while len(at):
        tail = (data[at] & 0xC0) == 0x80
        begin[at[~tail]] = True
        at = at[tail] - 1
    # contractions
    at = np.flatnonzero(begin & (data == 0x27))
    if len(at):
        row_end = offsets[np.searchsorted(offsets, at, "right")]
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        kinds = np.concatenate([c, np.full(3, OTHER, np.uint8)])
        done = np.zeros(len(at), bool)
        for suffix in SUFFIXES:
            k = len(suffix)
            hit = ~done & (at + 1 + k <= row_end)
            for j, x in enumerate(suffix):
                hit &= padded[at + 1 + j] == x
            begin[at[hit] + 1] = False
            after = at[hit] + 1 + k
            inside = (after < row_end[hit]) & (kinds[after] == LETTER)
            begin[after[inside]] = True
            done |= hit
    s = np.flatnonzero(begin)
    return s, np.searchsorted(s, offsets)
