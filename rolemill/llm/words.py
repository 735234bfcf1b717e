"""Words of many texts at once: positions in one byte buffer, and hashes of word runs.

A word is a run of bytes other than space and 0x09-0x0D.  Words are hashed by mixing
their bytes, runs of words by polynomials modulo 2**64 over prefix sums of word hashes,
finished with a bit mixer, so any run is hashed in constant time.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
U64 = np.uint64
LONG = 512  # bytes of a word that are mixed eight at a time
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection for each seed)."""
    x = x ^ U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


def hash_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of ``values[start:end]`` for every range; equal content gives equal hashes."""
    base = int(mix(np.array([seed + 11], U64))[0]) | 1
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * _powers(base, len(values)), out=sums[1:])
    back = _powers(pow(base, -1, 1 << 64), len(values) + 1)
    found = (sums[ends] - sums[starts]) * back[starts]
    return mix(found + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93), seed)


class Words:
    """Word positions of an array of texts (null: no words)."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offs[0]:offs[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
        offs = offs - offs[0]
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            data = table[data]
        is_space = np.zeros(256, bool)
        is_space[list(SPACES)] = True
        space = is_space[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        before = np.concatenate(([True], space[:-1])) if len(data) else space
        after = np.concatenate((space[1:], [True])) if len(data) else space
        self.data, self.offs = data, offs
        self.starts = np.flatnonzero(~space & (before | edge[:-1]))
        self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        #: Words of text ``j`` are ``first[j]:first[j + 1]``.
        self.first = np.searchsorted(self.starts, offs)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash per word: its bytes eight at a time, each mixed into what came before, then its length.

        Short words of one length never share a hash, others by chance alone.  Words of more than
        ``LONG`` bytes are hashed by BLAKE2.
        """
        lens = self.ends - self.starts
        raw = np.concatenate((self.data, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(self.data) + 1,), "<u8", raw.data, strides=(1,))
        out = np.full(len(lens), seed + 1, U64)
        short, done = np.flatnonzero(lens <= LONG), 0
        while len(short):
            left = lens[short] - done
            out[short] = mix(out[short] ^ (eight[self.starts[short] + done] & _FIRST_BYTES[np.minimum(left, 8)]), seed)
            done += 8
            short = short[left > 8]
        for i in np.flatnonzero(lens > LONG).tolist():
            word = raw[self.starts[i]:self.ends[i]].tobytes()
            out[i] = int.from_bytes(blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
        return mix(out + lens.astype(U64) * U64(0xD6E8FEB86659FD93), seed)

    def joined(self, keep: np.ndarray, j: int) -> bytes:
        """The kept words of text ``j`` joined by one space."""
        raw = self.data.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = raw
        a, b = self.first[j], self.first[j + 1]
        return b" ".join([raw[s:e] for s, e, k in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(),
                                                       keep[a:b].tolist()) if k])


def runs(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``k`` words inside one text, and the text of each."""
    n = int(first[-1]) if len(first) else 0
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(n)
    fits = at + k <= first[text + 1]
    return at[fits], text[fits]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out
