"""Words of texts and their hashes, from arrays over the bytes."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes that are hashed at once.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            with np.errstate(over="ignore"):
                size = len(self.up)
                self.up = np.r_[self.up, self.up * _U(pow(self.base, size, 2**64))]
                self.down = np.r_[self.down, self.down * _U(pow(self.inverse, size, 2**64))]
        return self.up[:n], self.down[:n]


#: Bytes of a word that are hashed by tables; longer words are hashed one by one.
SHORT = 48


def _tables() -> np.ndarray:
    """A random number for each half of the hash, place in a word and byte; none for what stands between words."""
    out = np.random.default_rng(35).integers(0, 2**64, (2, SHORT, 256), dtype=_U)
    out[:, :, BLANK] = 0
    return out.reshape(2, -1)


_TABLES = _tables()


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of anything but ASCII white space starts and stops."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], BLANK[raw], [True]])))
    return edge[0::2], edge[1::2]


def word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, half: int = 0) -> np.ndarray:
    """One half of a 128-bit hash of each word, a piece of the text at a time.

    The numbers of a word's places and bytes are independent of each other, so two words
    have one hash with probability 2**-64 whatever they are, and the halves are independent.
    """
    out, done, n = np.empty(len(start), _U), 0, len(start)
    sizes = stop - start
    long = np.flatnonzero(sizes > SHORT)
    while done < n:  # so many words as a piece holds, one at least
        lo = int(start[done])
        to = max(done + 1, int(np.searchsorted(stop, lo + PIECE, "right")))
        if to == done + 1 and sizes[done] > SHORT:
            done = to
            continue
        a = (start[done:to] - lo).astype(np.int32)
        size = int(stop[to - 1]) - lo
        place = np.arange(size, dtype=np.int32)
        place -= np.repeat(a, np.diff(a, append=np.int32(size)))
        np.minimum(place, SHORT - 1, out=place)
        out[done:to] = np.add.reduceat(_TABLES[half].take((place << 8) | raw[lo : lo + size]), a)
        done = to
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : stop[i]], half + 1)
    return mix(out)
