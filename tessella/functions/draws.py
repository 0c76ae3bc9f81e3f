"""Draws for whole blocks at once: arrays of them follow from one MD5, and SQL can repeat each."""

from __future__ import annotations

import math
import struct
from hashlib import md5

import numpy as np

#: Polynomials run over the whole numbers below it.
PRIME = 2**31 - 1
#: Steps of a keyed bijection; each needs two words of a key.
STEPS = 10
#: An odd number that spreads the bits of a step's hash; its products with 32 bits fit a signed long.
SPREAD = np.uint32(0x45D9F3B)
#: Draws that are made at once.
AT_ONCE = 1 << 21


def words(*keys: object) -> np.ndarray:
    """The four 32-bit words of the keys' MD5."""
    return np.frombuffer(md5(":".join(map(str, keys)).encode()).digest(), ">u4").astype(np.int64)


#: What MD5's steps add, and by how many bits they turn a word.
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNED = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
#: Texts that go through the steps together.
_TOGETHER = 1 << 16


def _first_words(said: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    """``first_words`` of numbers that have so many digits, in a text of one block (55 bytes at most)."""
    size = len(said) + digits
    block = said.ljust(size, b"\0") + b"\x80"
    words = list(struct.unpack("<16I", block.ljust(56, b"\0") + struct.pack("<Q", 8 * size)))
    for i in range(size - 1, len(said) - 1, -1):
        rest = numbers // np.uint32(10)
        digit, numbers = numbers - rest * np.uint32(10), rest
        words[i // 4] = ((digit + np.uint32(48)) << np.uint32(8 * (i % 4))) + np.uint32(words[i // 4])
    a, b, c, d = (np.full(len(numbers), v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # the last three make the other words
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        if isinstance(word, int):
            f += np.uint32((word + _ADDED[i]) % 2**32)
        else:
            f += word
            f += np.uint32(_ADDED[i])
        turn = _TURNED[kind][i % 4]
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(0x67452301)).byteswap()


def first_words(said: str, first: int, last: int) -> np.ndarray:
    """The first 32 bits of the MD5 of ``said`` with each number from ``first`` up to ``last`` behind it, as ``scalars.draw`` gives them.

    Thousands of texts go through MD5's steps together, as calls one by one would take many times as long.
    """
    text, out, lo = said.encode(), np.empty(last - first, np.uint32), first
    while lo < last:
        digits = len(str(lo))
        hi = min(last, lo + _TOGETHER, 10**digits)
        if len(text) + digits <= 55 and hi <= 2**32:
            out[lo - first : hi - first] = _first_words(text, np.arange(lo, hi, dtype=np.uint32), digits)
        else:
            out[lo - first : hi - first] = [int.from_bytes(md5(text + str(k).encode()).digest()[:4], "big") for k in range(lo, hi)]
        lo = hi
    return out


def cubic(coefficients: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For every row of four words their cubic at each ``k``, modulo ``PRIME``; any four places of a row are independent."""
    c = coefficients[:, :, None]
    return (((c[:, 3] * k + c[:, 2]) % PRIME * k + c[:, 1]) % PRIME * k + c[:, 0]) % PRIME


def bits(keys: list[str]) -> np.ndarray:
    """A row of 128 bits for each key."""
    return np.unpackbits(np.frombuffer(b"".join(md5(k.encode()).digest() for k in keys), np.uint8)).reshape(-1, 128)


def bijection_keys(seed: str, replicates: range) -> np.ndarray:
    """The words of the bijection of each replicate."""
    return np.array([np.concatenate([words(seed, b, half) for half in range(STEPS // 2)]) for b in replicates], np.uint32).reshape(-1, 2 * STEPS)


def _hashed(x: np.ndarray, a: np.ndarray, b: np.ndarray, below: int) -> np.ndarray:
    """A number below ``below`` for each x, all modulo 2**32."""
    t = x * a + b
    t = (t ^ (t >> np.uint32(15))) * SPREAD
    return ((t >> np.uint32(16)) * np.uint32(below)) >> np.uint32(16)


def _through(x: np.ndarray, keys: np.ndarray, high: int, low: int) -> np.ndarray:
    """One pass: the two digits of x take turns in being shifted by a hash of the other."""
    left, right = x // np.uint32(low), x % np.uint32(low)
    for step in range(STEPS):
        a, b = keys[:, 2 * step, None] | np.uint32(1), keys[:, 2 * step + 1, None]
        if step % 2 == 0:
            left = left + _hashed(right, a, b, high)
            left -= np.uint32(high) * (left >= high)
        else:
            right = right + _hashed(left, a, b, low)
            right -= np.uint32(low) * (right >= low)
    return left * np.uint32(low) + right


def places(keys: np.ndarray, n: int, first: int = 0, last: int | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Where each replicate's bijection of 0..n-1 takes the numbers from ``first`` up to ``last``, or those of ``at``.

    The pass is a bijection of the smallest rectangle of about square shape that holds n
    numbers; what falls outside 0..n-1 walks on until it is inside.  ``n`` is 2**32 at most.
    """
    if n > 2**32:
        raise ValueError(f"{n} rows in a group; bijections reach to 2**32")
    high = math.isqrt(max(n - 1, 0)) + 1
    low = -(-n // high)
    given = np.arange(first, n if last is None else last, dtype=np.uint32) if at is None else at.astype(np.uint32)
    x = np.broadcast_to(given, (len(keys), len(given)))
    x = _through(x, keys, high, low)
    row, at = np.nonzero(x >= n)
    while len(row):
        x[row, at] = _through(x[row, at][:, None], keys[row], high, low)[:, 0]
        out = x[row, at] >= n
        row, at = row[out], at[out]
    return x
