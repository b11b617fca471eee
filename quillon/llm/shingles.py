"""Sets of word shingles as sorted 64-bit hashes, for many texts at once.

Words are maximal runs of bytes other than ASCII white space, with A-Z lowered.
A word's hash is a polynomial over its bytes, a shingle's hash mixes five word
hashes in order; all steps run over a whole slice of texts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
SIZE = 5
#: Bytes of text that are hashed in one go.
SLICE = 1 << 20
_BASE = U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.cumprod(np.full(1 << 16, _BASE, dtype=U))
#: The same for every 65,536th byte of longer words; an Arrow value has under 2 ** 31 bytes.
_FAR_POWERS = np.cumprod(np.concatenate(([U(1)], np.full((1 << 15) - 1, _POWERS[-1], dtype=U))))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, document, start, end, buffer) of all words of some texts, in order; start and end are places in the buffer."""
    buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]  # the buffer ends in white space
    if not len(start):
        return np.zeros(0, U), np.zeros(0, np.int64), start, end, buf
    lengths = end - start
    offsets = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
    terms = buf[inside].astype(U)
    terms += U(1)
    terms *= _POWERS[at & 0xFFFF]
    if lengths.max() > len(_POWERS):
        terms *= _FAR_POWERS[at >> 16]
    hashes = mixed(np.add.reduceat(terms, offsets) + lengths.astype(U))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(ends, start, side="right"), start, end, buf


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document) of all words of some texts, in order."""
    return word_spans(texts)[:2]


def _chain(words: np.ndarray, size: int) -> np.ndarray:
    out = np.full(len(words) - size + 1, U(size), dtype=U)
    for j in range(size):
        out = mixed(out * _BASE + words[j : j + len(out)])
    return out


def slices(texts: list[bytes], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have about ``size`` bytes together."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than five words make one shingle, none make none."""
    words, owner = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    whole = _chain(words, SIZE) if len(words) >= SIZE else np.zeros(0, U)
    out = []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = last - first
        if n >= SIZE:
            out.append(np.unique(whole[first : last - SIZE + 1]))
        else:
            out.append(_chain(words[first:last], n) if n else np.zeros(0, U))
    return out
