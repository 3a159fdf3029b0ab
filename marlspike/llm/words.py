"""Word tokens as 64-bit numbers, for the operators that compare word sequences.

A word is a maximal run of letters and digits of the lower-cased text. The code
of a word is a polynomial of its UTF-8 bytes modulo 2**64, taken for all words of
a batch at once from one prefix sum, so no word becomes a Python object.
"""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _bytes(text: str) -> bytes:
    text = text.lower()
    if not text.isascii():
        for c in set(text):
            if c > "\x7f" and not c.isalnum():
                text = text.replace(c, " ")
    return text.encode("utf-8", "replace")


def code_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words of the lower-cased texts, end to end, and each text's number of words."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = [_bytes(t) for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    word = _IS_WORD[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _up_to(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    codes = mix((total[ends] - total[starts]) * inverse[starts])
    bounds = np.cumsum([len(r) + 1 for r in raw])
    return codes, np.diff(np.searchsorted(starts, bounds), prepend=0).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(codes: np.ndarray, k: int) -> np.ndarray:
    """The code of the k words that begin at each position (the last k-1 positions give none)."""
    n = len(codes) - k + 1
    if n <= 0:
        return codes[:0]
    out = codes[:n].copy()
    for j in range(1, k):
        out *= MIX
        out += codes[j : j + n]
    return mix(out)
