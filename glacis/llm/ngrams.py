"""Character n-grams of whole Arrow batches, hashed with numpy over one byte buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 32
#: Multiplier of the hash (an odd 64-bit constant).
MIX = np.uint64(0x9E3779B97F4A7C15)


def _map() -> np.ndarray:
    """ASCII other than letters and digits becomes a space; the rest stays."""
    out = np.arange(256, dtype=np.uint8)
    for b in range(128):
        if not chr(b).isalnum():
            out[b] = SPACE
    return out


LETTERS = _map()


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): the lower-cased texts with a space before and after each."""
    parts = pc.utf8_lower(texts.cast(pa.large_string())).cast(pa.large_binary()).to_pylist()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    whole = b"  ".join(parts)
    buf = LETTERS[np.frombuffer(b" " + whole + b" ", np.uint8)]
    starts = np.zeros(len(parts), np.int64)
    np.cumsum(sizes[:-1] + 2, out=starts[1:])
    return buf, starts


def grams(buf: np.ndarray, sizes: range, bits: int):
    """For each size: (size, bucket of the n-gram that starts at each byte, whether it is one).

    An n-gram lies in one word, whose border counts as a letter at either end.
    Sizes go up to 8.
    """
    n = len(buf)
    code = buf.astype(np.uint64)
    space = buf == SPACE
    # how far the word goes on: the first space at or after each place
    at = np.arange(n)
    ends = np.where(space, at, n)
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    after = np.append(ends[1:], n)  # first space after the place itself
    packed = code.copy()
    for size in range(2, sizes.stop):
        m = n - size + 1
        if m <= 0:
            return
        packed = packed[:m] | (code[size - 1:] << np.uint64(8 * (size - 1)))
        if size >= sizes.start:
            # no space inside, and not a lone border
            fine = after[:m] >= at[:m] + size - 1
            if size == 2:
                fine &= ~(space[:m] & space[1:])
            yield size, ((packed * MIX) >> np.uint64(64 - bits)).astype(np.int32), fine


def scores(texts: pa.Array, table: np.ndarray, sizes: range, bits: int, columns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts): for each text the sum of ``table``'s rows over its n-grams, and their number."""
    sums, counts = np.zeros((len(texts), columns)), np.zeros(len(texts))
    if not len(texts):
        return sums, counts
    buf, starts = joined(texts)
    for _, bucket, fine in grams(buf, sizes, bits):
        begin = np.minimum(starts, len(bucket))
        for c in range(columns):
            value = (table if columns == 1 else table[:, c])[bucket]
            value[~fine] = 0
            total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
            sums[:, c] += total[np.append(begin[1:], len(bucket))] - total[begin]
        total = np.concatenate([[0], np.cumsum(fine)])
        counts += total[np.append(begin[1:], len(bucket))] - total[begin]
    return sums, counts
