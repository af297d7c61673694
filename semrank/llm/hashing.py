"""Vectorised hashing of words and word n-grams over Arrow text columns.

All functions work on bounded slices of a record batch, so memory follows the slice (or one text), never the partition.
Texts longer than a slice are hashed in pieces that end between two words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 15

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def keys(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 7919)) * _U(_BASE)) | _U(1)


class WordClass:
    """Which bytes belong to words, and what each byte counts as."""

    def __init__(self, word: np.ndarray, fold_case: bool):
        self.word = word
        self.letter = np.arange(256, dtype=np.uint8)
        if fold_case:
            self.letter[65:91] += 32
        #: Words' bytes as they count, all others as spaces.
        self.spaced = bytes(np.where(word, self.letter, 0x20).astype(np.uint8))

    def normal(self, text: str | None) -> bytes:
        """The words of a text, joined by one space."""
        # Bytes that split() takes for spaces are in no word of either class.
        return b" ".join((text or "").encode().translate(self.spaced).split())


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    for a, b in ranges:
        m[a : b + 1] = True
    return m


#: Words `[^\x20\x09-\x0D]+`, unchanged.
SPACED = WordClass(~_bytes((0x20, 0x20), (0x09, 0x0D)), fold_case=False)
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased.
FOLDED = WordClass(_bytes((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)), fold_case=True)



def _hash_words(buf: np.ndarray, cuts: np.ndarray, cls: WordClass, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts buf[cuts[i]:cuts[i+1]]; offsets of each text's words.

    A word's hash is that of its length and the sum of its 8-byte blocks, each mixed under a key of its place and the seed: not
    a polynomial, whose sums cancel for some words under every base.
    """
    n = len(buf)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(cuts), dtype=np.int64)
    inside = cls.word[buf]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = cuts[:-1]
    before[firsts[firsts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = cuts[1:]
    after[lasts[lasts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = cls.letter[buf]
    at_byte = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    key = _place_keys(seed, 1 + int(size.max(initial=1) - 1) // 8)
    sums = mix((at_byte[starts] & _LOW[np.minimum(size, 8)]) ^ key[0])
    more = np.flatnonzero(size > 8)
    if len(more):  # the blocks after the first
        blocks = (size[more] - 1) // 8
        first = np.cumsum(blocks) - blocks
        word = np.repeat(np.arange(len(more)), blocks)
        place = np.arange(len(word)) - first[word] + 1
        block = at_byte[starts[more][word] + 8 * place] & _LOW[np.minimum(size[more][word] - 8 * place, 8)]
        sums[more] += np.add.reduceat(mix(block ^ key[place]), first)
    return mix(sums + size.astype(np.uint64) * _U(_BASE)), np.searchsorted(starts, cuts)


#: Masks of the lowest 0 to 8 bytes.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _place_keys(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(_BASE) + _U(seed) * _U(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and the n+1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    cuts = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), cuts
    return np.frombuffer(data, dtype=np.uint8), cuts


def word_slices(column: pa.Array | pa.ChunkedArray, cls: WordClass, seed: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, offsets of each row's words) of consecutive rows of about SLICE_BYTES."""
    buf, cuts = text_bytes(column)
    rows, lo = len(cuts) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + SLICE_BYTES, side="right")) - 1)
        hi = min(hi, rows, lo + SLICE_ROWS)
        part = buf[cuts[lo] : cuts[hi]]
        if len(part) <= 2 * SLICE_BYTES:
            hashes, offs = _hash_words(part, cuts[lo : hi + 1] - cuts[lo], cls, seed)
            yield lo, hi, hashes, offs
        else:  # one long text
            found, at = [], 0
            while at < len(part):
                end = min(len(part), at + SLICE_BYTES)
                while end < len(part) and cls.word[part[end - 1]] and cls.word[part[end]]:
                    step = np.flatnonzero(~cls.word[part[end : end + SLICE_BYTES]])
                    end = end + (int(step[0]) if len(step) else min(SLICE_BYTES, len(part) - end))
                found.append(_hash_words(part[at:end], np.array([0, end - at]), cls, seed)[0])
                at = end
            hashes = np.concatenate(found)
            yield lo, hi, hashes, np.array([0, len(hashes)], dtype=np.int64)
        lo = hi


def ngrams(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of each n consecutive words (also across texts: see inside())."""
    k = keys(seed, n)
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = words[: len(words) - n + 1] * k[0]
    for j in range(1, n):
        out += words[j : len(words) - n + 1 + j] * k[j]
    return mix(out)


def inside(offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-grams that lie within one text, and the row of each."""
    count = np.maximum(np.diff(offs) - n + 1, 0)
    rows = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return np.arange(int(count.sum())) - first[rows] + offs[:-1][rows], rows


def digest(words: bytes) -> bytes:
    """16 bytes that tell different byte strings apart: no two are known, or can be made with any known effort, to share them."""
    return hashlib.blake2b(words, digest_size=16).digest()


def digests(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """digest() of each, as two arrays of 64-bit integers."""
    both = np.frombuffer(b"".join(map(digest, words)), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]
