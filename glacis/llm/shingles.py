"""Word shingles of whole Arrow batches as 64-bit hashes, with numpy over one byte buffer."""

from __future__ import annotations

import numpy as np

_FIRST = np.random.default_rng(20240601)
#: Random value of each byte, and an odd base whose powers tell places apart.
BYTE = _FIRST.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 3
ROUND = _FIRST.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bytes() -> np.ndarray:
    """A-Z lower-cased; the white space of the word pattern (space and U+0009 to U+000D) becomes a space."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[9:14] = 32
    return out


BYTES = _bytes()
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            row = np.full(n, np.uint64(base % (1 << 64)))
            row[0] = 1
            _POWERS[k] = np.multiply.accumulate(row)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray, round_: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ROUND[round_]
    x = (x ^ (x >> np.uint64(29))) * ROUND[round_ + 1]
    return x ^ (x >> np.uint64(32))


def sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of ``size`` words of each text, ascending.

    A text with fewer words has its whole word sequence as one; one without words none.
    """
    buf = BYTES[np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 2, out=begin[1:])
    space = buf == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # the buffer begins and ends with a space
    start, end = edge[0::2], edge[1::2]
    power, inverse = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[buf] * power, out=total[1:])
    word = mix((total[end] - total[start]) * inverse[start])
    first = np.searchsorted(start, begin)  # of each text's words
    count = np.diff(first)
    whole = np.zeros(max(len(word) - size + 1, 0), np.uint64)
    for k in range(size):
        whole += word[k:k + len(whole)] * ROUND[10 + k]
    whole = mix(whole + np.uint64(size), 2)
    out, offsets = [], np.zeros(len(texts) + 1, np.int64)
    for i, (a, n) in enumerate(zip(first.tolist(), count.tolist())):
        if n >= size:
            own = whole[a:a + n - size + 1]
            own = np.sort(own)
            if len(own) > 1:
                own = own[np.append(True, own[1:] != own[:-1])]
        elif n:
            with np.errstate(over="ignore"):
                own = mix((word[a:a + n] * ROUND[10:10 + n]).sum(keepdims=True) + np.uint64(n), 4)
        else:
            own = whole[:0]
        out.append(own)
        offsets[i + 1] = offsets[i] + len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), offsets


def identity(hashes: np.ndarray, offsets: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each set, equal for equal sets: a name, of which ``bits`` are used, and a check."""
    total = np.zeros((2, len(hashes) + 1), np.uint64)
    np.cumsum(mix(hashes, 6), out=total[0, 1:])
    np.cumsum(mix(hashes, 8), out=total[1, 1:])
    a, b = (t[offsets[1:]] - t[offsets[:-1]] for t in total)
    n = np.diff(offsets).astype(np.uint64)
    return mix(a + mix(b, 20) + n * ROUND[30], 22) >> np.uint64(64 - bits), mix(b + mix(a, 24) + n * ROUND[31], 26)
