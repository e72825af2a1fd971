"""Vectorised text kernels: numpy over the byte buffers of Arrow string columns.

All of them work on a chunk of whole texts laid end to end. Words and hashes
never cross from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18  # texts are handled in chunks of about this size, long ones alone

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_P = _U((1 << 31) - 1)
#: Spans are hashed by two polynomials modulo the prime 2**31 - 1. (Modulo a
#: power of two, texts like the Thue-Morse word collide for every base.)
_BASES = (1207559927, 1753049123)
_INVERSES = tuple(pow(b, -1, int(_P)) for b in _BASES)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_CODE = mix((np.arange(256, dtype=_U) + _U(1)) * _U(_ODD))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Codes under which A-Z equal a-z.
LOWER_CODE = BYTE_CODE[LOWER]

#: True for bytes inside words: everything but space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: True for 0-9, A-Z, a-z and every byte beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_lo:_hi] = True

def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, up to one multiple of it."""
    x = (x & _P) + (x >> _U(31))
    return (x & _P) + (x >> _U(31))


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1."""
    x = _fold(x)
    return np.where(x >= _P, x - _P, x)


_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**31 - 1, up to one multiple of it."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.ones(size, dtype=_U)
        done = 1
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = _fold(have[:more] * _U(pow(base, done, int(_P))))
            done += more
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def text_chunks(column: pa.ChunkedArray | pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole texts of about ``limit`` bytes; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    if column.null_count:  # bytes below a null do not count
        lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        column = column.fill_null(b"")
        raw = column.buffers()
        offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + n + 1]
        assert (np.diff(offsets) == lengths).all()
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of its first word (one more at the end)."""
    word = inside[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = np.flatnonzero(np.diff(offsets))
    first[offsets[full]] = word[offsets[full]]
    last[offsets[full + 1] - 1] = word[offsets[full + 1] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray, code: np.ndarray = BYTE_CODE) -> tuple[np.ndarray, ...]:
    """For each polynomial the sums of code[byte] * base**position, with which ``span_hash`` works."""
    return prefix_sums(code & _P, data), prefix_sums(code >> _U(33), data, 1)


def prefix_sums(code: np.ndarray, at: np.ndarray | None, which: int = 0) -> np.ndarray:
    """Sums of code[at] * base**position for one polynomial; codes have 31 bits at most."""
    values = code if at is None else code[at]
    term = values * powers(_BASES[which], len(values))
    sums = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum((term & _P) + (term >> _U(31)), out=sums[1:])
    return sums


def sequence_hash(values: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``prefix_hash`` for a sequence of well-mixed 64-bit values (lines of a text)."""
    return prefix_sums(values & _P, None), prefix_sums(values >> _U(33), None, 1)


def _spans(first: np.ndarray, last: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return _residue(_fold(last - first) * inverse)


def span_hash(sums: tuple[np.ndarray, ...], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span (62 bits, spread over 64), the same wherever it stands."""
    low, high = (_spans(s[starts], s[ends], powers(i, len(s))[starts]) for s, i in zip(sums, _INVERSES, strict=True))
    return mix((low | (high << _U(31))) + (ends - starts).astype(_U) * _U(_ODD))


def window_hash(sums: tuple[np.ndarray, ...], width: int) -> np.ndarray:
    """``span_hash`` of every span of ``width`` bytes, in order of their starts."""
    n = max(len(sums[0]) - width, 0)
    low, high = (_spans(s[:n], s[width:], powers(i, n)) for s, i in zip(sums, _INVERSES, strict=True))
    return mix((low | (high << _U(31))) + _U(width * _ODD % (1 << 64)))


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i] .. words[i+k-1] for each i that has them, folded in word by word."""
    n = max(len(words) - k + 1, 0)
    out = np.full(n, k, dtype=_U)
    for j in range(k):
        out = mix(out * _U(_ODD) + words[j : j + n])
    return out


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over values[i] .. values[i+width-1]."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def winnow(grams: np.ndarray, usable: np.ndarray, width: int) -> np.ndarray:
    """Positions of the grams that are smallest in some window of ``width`` grams; equal ones all stay.

    usable: whether the window that starts at a gram lies in one text.
    """
    if len(grams) < width:  # no window
        return np.zeros(0, dtype=np.intp)
    low = sliding(grams, width, np.minimum)
    low = np.where(usable[: len(low)], low, _U(0))
    pad = np.zeros(width - 1, dtype=_U)
    return np.flatnonzero((grams == sliding(np.concatenate([pad, low, pad]), width, np.maximum)) & (grams != 0))
