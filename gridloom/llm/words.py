"""Vectorised word positions and 64-bit word hashes over a piece of a text column (numpy, used inside tasks).

Words of up to 16 bytes are taken as two 64-bit numbers, which say all that is in them; these are mixed by eight rounds of
addition, rotation and exclusive or. Longer words are hashed by SipHash-2-4. Unlike words share a hash by chance only, once in
2**64. Hashes depend on the word alone, hence agree between tasks, machines and runs.
"""

from __future__ import annotations

import numpy as np
from pandas.util import hash_array

#: The key of the hashes of long words, 16 letters.
_KEY = "words of gridloo"
_ROUND_KEYS = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64) for k in range(8)]
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def halves(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and second 8 bytes of raw[start:end] for each span, as numbers; zeros stand beyond its end."""
    at = np.ndarray((len(raw) + 8,), "<u8", raw + bytes(16), strides=(1,))
    length = ends - starts
    first = at[starts] & _MASKS[np.minimum(length, 8)]
    second = at[np.minimum(starts + 8, len(raw))] & _MASKS[np.clip(length - 8, 0, 8)]
    return first, second


def hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, parts: tuple | None = None) -> np.ndarray:
    """The hash of raw[start:end] for each span; ``parts`` are their halves where known."""
    x, y = parts or halves(raw, starts, ends)
    out = x + np.uint64(0xD6E8FEB86659FD93) * (ends - starts).astype(np.uint64)
    for key in _ROUND_KEYS:
        x = ((x >> np.uint64(8) | x << np.uint64(56)) + y) ^ key
        y = (y << np.uint64(3) | y >> np.uint64(61)) ^ x
    out += mix(x ^ mix(y))
    long = np.flatnonzero(ends - starts > 16)
    if len(long):
        words = np.empty(len(long), object)
        words[:] = [raw[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        out[long] = hash_array(words, hash_key=_KEY, categorize=False)
    return out


def utf8_offsets(points: np.ndarray) -> np.ndarray:
    """Where each code point, and the end, stands in the UTF-8 form of the points."""
    size = (points >= 0x80).astype(np.int8) + np.int8(1)
    size += points >= 0x800
    size += points >= 0x10000
    out = np.zeros(len(points) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return out


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def owners(at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which text each place lies in, places of each text); places are in order, ``first`` is where each text begins."""
    counts = np.diff(np.append(np.searchsorted(at, first), len(at)))
    return np.repeat(np.arange(len(first)), counts), counts


#: Bytes that part words: space and the five control characters from tab to carriage return.
PART = np.zeros(256, bool)
PART[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts: for each word its text's number, its span in bytes, its hash."""

    def __init__(self, texts: list[str], lower: bool = False):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        whole = b"\n".join(raw)
        whole = whole.lower() if lower else whole
        self.bytes = np.frombuffer(whole, np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes + 1)))[: len(raw)] if raw else np.zeros(0, np.int64)
        self.starts, self.ends = runs(~PART[self.bytes])
        self.doc, self.counts = owners(self.starts, self.offsets)
        self.hashes = hashes(whole, self.starts, self.ends)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))  # of each text, in words

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position of the first word, hash) of every window of ``width`` words."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        value = np.zeros(len(at), np.uint64)
        for k in range(width):
            value = value * np.uint64(0xD6E8FEB86659FD93) + self.hashes[at + k]
        return self.doc[at], at, mix(value)

    def shingle_sets(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of every text, sorted by text and hash; a text of fewer words has its whole sequence as one."""
        doc, _, value = self.shingles(width)
        few = np.flatnonzero((self.counts > 0) & (self.counts < width))
        if len(few):
            short = np.zeros(len(few), np.uint64)
            for k in range(width - 1):
                has = self.counts[few] > k
                short[has] = short[has] * np.uint64(0xA0761D6478BD642F) + self.hashes[self.first[few[has]] + k]
            doc, value = np.concatenate((doc, few)), np.concatenate((value, mix(short + self.counts[few].astype(np.uint64))))
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        return doc[new], value[new]
