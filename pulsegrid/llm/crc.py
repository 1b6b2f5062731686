"""CRC-32 of many byte spans at once.

The remainder of a span is linear: the XOR of one contribution for each byte, which depends on the byte and on its
distance from the end of the span, and of a constant for the length.  Contributions come from a table for distances
below REACH and are folded by ``bitwise_xor.reduceat``.  Longer spans are cut into blocks of REACH bytes from their end,
whose remainders are folded in pairs, the left one moved over the bytes of the right one.
"""

from __future__ import annotations

import numpy as np

#: Reversed polynomial of CRC-32 and the value that its register starts with (fixed values).
POLYNOMIAL, START = 0xEDB88320, 0xFFFFFFFF
#: Distances in the table: bytes of a block.
REACH = 64
#: Contributions folded at a time.
FOLDED = 1 << 16


def _bytes() -> np.ndarray:
    """Remainder of each byte alone."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = (r >> np.uint32(1)) ^ np.where(r & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return r


_BYTE = _bytes()


def _past_zero(r: np.ndarray) -> np.ndarray:
    """Remainders after one further byte 0."""
    return (r >> np.uint32(8)) ^ _BYTE[r & np.uint32(255)]


def _positions() -> np.ndarray:
    rows = [_BYTE]
    for _ in range(REACH - 1):
        rows.append(_past_zero(rows[-1]))
    return np.concatenate(rows)


_POSITION = _positions()


def _lengths() -> np.ndarray:
    """Length constants of 0 to REACH - 1 bytes: the start value moved over them."""
    r = np.full(1, START, np.uint32)
    out = []
    for _ in range(REACH):
        out.append(r)
        r = _past_zero(r)
    return np.concatenate(out)


_LENGTH = _lengths()


def _move(r: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Remainders moved over as many bytes 0 as the four tables stand for, one for each byte of the register."""
    out = tables[0][r & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[k][(r >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _first_mover() -> np.ndarray:
    r = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(REACH):
        r = _past_zero(r)
    return r


_MOVERS = [_first_mover()]


def _mover(level: int) -> np.ndarray:
    """Tables that move over REACH * 2**level bytes."""
    while len(_MOVERS) <= level:
        _MOVERS.append(_move(_MOVERS[-1], _MOVERS[-1]))
    return _MOVERS[level]


def length_constants(lengths: np.ndarray) -> np.ndarray:
    r, blocks, level = _LENGTH[lengths % REACH], lengths // REACH, 0
    while (blocks >> level).any():
        r = np.where((blocks >> level) & 1, _move(r, _mover(level)), r)
        level += 1
    return r


def _remainders(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Remainders of spans of 1 to REACH bytes."""
    out = np.empty(len(starts), np.uint32)
    length = ends - starts
    upto = np.concatenate([[0], np.cumsum(length)])
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + FOLDED, "right")) - 1)
        n = length[i:j]
        first = upto[i:j] - upto[i]
        at = np.arange(upto[j] - upto[i])
        left = np.repeat(first + n - 1, n) - at
        at += np.repeat(starts[i:j] - first, n)
        out[i:j] = np.bitwise_xor.reduceat(_POSITION[(left << 8) + data[at]], first)
        i = j
    return out


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``data[start:end]`` for each of many spans, which may overlap; that of no bytes is 0."""
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    length = ends - starts
    out = length_constants(length) ^ np.uint32(0xFFFFFFFF)
    short = (length > 0) & (length <= REACH)
    out[short] ^= _remainders(data, starts[short], ends[short])
    long = np.flatnonzero(length > REACH)
    step = 0
    while step < len(long):
        blocks = -(-length[long[step:]] // REACH)
        several = long[step:step + max(1, int(np.searchsorted(np.cumsum(blocks), FOLDED // REACH, "right")))]
        out[several] ^= _folded(data, starts[several], ends[several])
        step += len(several)
    return out


def _folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Remainders of spans of more than REACH bytes: of their blocks, then of pairs of blocks, until one is left of each."""
    count = -(-(ends - starts) // REACH)
    first = np.cumsum(count) - count
    number = np.repeat(count, count) - 1 - (np.arange(count.sum()) - np.repeat(first, count))  # blocks after this one
    stop = np.repeat(ends, count) - number * REACH
    r = _remainders(data, np.maximum(np.repeat(starts, count), stop - REACH), stop)
    level = 0
    while (count > 1).any():
        odd = count % 2
        padded = np.zeros(int((count + odd).sum()), np.uint32)  # an odd number of blocks gets an empty one before them
        padded[np.arange(len(r)) + np.repeat(np.cumsum(odd), count)] = r
        r = _move(padded[0::2], _mover(level)) ^ padded[1::2]
        count = (count + odd) // 2
        level += 1
    return r
