"""Word and shingle hashes of many texts at once, as numpy arrays.

Words are runs of ASCII letters and digits and of characters beyond ASCII, in
lower case; everything else separates. A shingle is five words in a row; a text
of one to four words has one shingle, of all its words; a text without words has
none.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

WIDTH = 5
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
_U = np.uint64
_P, _Q, _R = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
_PINV, _powers = _U(pow(int(_P), -1, 2**64)), {}
_IS_WORD = np.zeros(256, bool)
for _r in ((48, 58), (97, 123), (128, 256)):
    _IS_WORD[_r[0] : _r[1]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([np.ones(1, _U), np.full(max(n, 1 << 16), base, _U)]))
        if len(have) <= 1 << 21:  # 16 MB, for each of four bases
            _powers[int(base)] = have
    return have[:n]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


_SPACED = bytes(b if _IS_WORD[b] else 32 for b in range(256))


def word_digests(texts: list[str | None]) -> list[bytes]:
    """SHA-256 of the words of each text, joined by spaces."""
    return [hashlib.sha256(b" ".join((t or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split())).digest() for t in texts]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words begin (one more entry than texts)."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    at = np.cumsum([0] + [len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8)
    inside = _IS_WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.cumsum(np.concatenate([np.zeros(1, _U), (data.astype(_U) + _U(1)) * _power(_P, len(data))]))
    h = mix((sums[ends] - sums[starts]) * _power(_PINV, len(data) + 1)[starts] + (ends - starts).astype(_U))
    return h, np.searchsorted(starts, at)


def run_hashes(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `width` words that lies in one text, and its text."""
    h, at = word_hashes(texts)
    m = max(0, len(h) - width + 1)
    owner = np.searchsorted(at, np.arange(m), "right") - 1
    inside = np.arange(m) + width <= at[owner + 1] if m else np.zeros(0, bool)
    s = np.zeros(m, _U)
    for j, q in enumerate(_power(_Q, width)):
        s += h[j : j + m] * q
    return mix(s)[inside], owner[inside]


def shingle_hashes(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, their bounds by text, and by text a hash of all its words, and its number of words."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    total = np.zeros(len(h) + 1, _U)
    q = _power(_Q, len(h))
    np.cumsum(h * q, out=total[1:])
    whole = mix((total[at[1:]] - total[at[:-1]]) * _power(_U(pow(int(_Q), -1, 2**64)), len(h) + 1)[at[:-1]] + n.astype(_U) * _R)
    m = max(0, len(h) - width + 1)
    s = np.zeros(m, _U)
    for j in range(width):
        s += h[j : j + m] * q[j] if len(q) > j else _U(0)
    s = mix(s)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    which = np.repeat(np.arange(len(n)), count)
    place = at[which] + np.arange(bounds[-1]) - bounds[which]
    short = n[which] < width
    out = np.empty(bounds[-1], _U)
    out[~short] = s[place[~short]]
    out[short] = whole[which[short]]
    return out, bounds, whole, n


def cells(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct hash for each occurrence of a shingle in its text: the i-th copy becomes cell i."""
    which = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((shingles, which))
    s, w = shingles[order], which[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (w[1:] != w[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    nth = np.empty(len(s), _U)
    nth[order] = (np.arange(len(s)) - first).astype(_U)
    return mix(shingles + nth * _R)
