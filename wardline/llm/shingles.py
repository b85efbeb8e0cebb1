"""Word shingles of whole texts as sorted distinct 64-bit hashes, computed over Arrow buffers.

A-Z are lower-cased, words are runs of bytes other than 0x20 and 0x09-0x0D, a set holds the distinct
runs of ``size`` words; a text with fewer words has one shingle, its whole sequence; no word, none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes hashed together, unless a single text is longer.
STRIDE = 2 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    def __init__(self, size: int = 5):
        self.size = size
        self.places = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        self.masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A hash of each word, eight bytes after eight: what was mixed before decides what the next eight do."""
        padded = np.zeros(len(data) + 8, dtype=np.uint8)
        padded[: len(data)] = data
        eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        out = mix(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        left = np.flatnonzero(lengths <= LONG_WORD)
        for k in range(0, LONG_WORD, 8):
            left = left[lengths[left] > k]
            if not len(left):
                break
            some = eights[starts[left] + k] & self.masks[np.minimum(lengths[left] - k, 8)]
            out[left] = mix((out[left] ^ some) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1))
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : starts[i] + lengths[i]].tobytes())
        return out

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """One sorted distinct array for each text; null counts as empty."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRIDE, "right")) - 1)
            yield from self._stretch(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], valid[at:to])
            at = to

    def _stretch(self, data: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> Iterator[np.ndarray]:
        n, none = len(data), np.zeros(0, dtype=np.uint64)
        if not n:
            yield from (none for _ in valid)
            return
        lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(n + 1, dtype=bool)  # a text ends here, whatever stands around
        edge[offsets] = True
        before = np.r_[False, word[:-1]] & ~edge[:-1]
        after = np.r_[word[1:], False] & ~edge[1:]
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
        words = self.words(lower, starts, ends - starts + 1)
        doc = np.searchsorted(offsets, starts, "right") - 1
        first = np.searchsorted(doc, np.arange(len(valid) + 1))
        if len(words) >= self.size:
            m = len(words) - self.size + 1
            long = mix(sum((words[j : j + m] * self.places[j] for j in range(self.size)), np.zeros(m, dtype=np.uint64)))
        for k in range(len(valid)):
            a, b = first[k], first[k + 1]
            if a == b or not valid[k]:
                yield none
            elif b - a < self.size:
                whole = np.zeros(1, dtype=np.uint64)
                for j in range(a, b):
                    whole = whole + words[j : j + 1] * self.places[j - a]
                yield mix(whole + np.uint64(b - a))
            else:
                s = np.sort(long[a : b - self.size + 1])
                yield s[np.r_[True, s[1:] != s[:-1]]]
