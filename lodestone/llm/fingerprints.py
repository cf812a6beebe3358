"""64-bit SimHash fingerprints of whole texts, and the Golay code that buckets them.

The fingerprint follows a fixed definition: A-Z lower-cased, words are runs of anything but
ASCII white space, shingles are three words joined by one space (fewer words: all of them),
each shingle hashed with XXH64 seed 42; a bit is 1 when more than half of the hashes set it.

The code is the perfect binary Golay code [23, 12, 7]: each 23-bit word lies within 3 bits
of exactly one codeword.  Two words one bit apart need not decode alike, yet the codeword of
either lies within 4 bits of the other.  So when one side is filed under its own codeword and
the other looks under every codeword within 4 bits (1 of them, or 6), no such pair is missed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash

SEED = 42
SHINGLE_WORDS = 3
_FEW = 1 << 19  # hashes expanded to bits at once: 32 MB


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; empty for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = SHINGLE_WORDS - 1
    hashed = xxhash.xxh64_intdigest
    spans = zip(starts[:-last].tolist(), ends[last:].tolist(), strict=True)
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - last)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many hashes set each bit, bit 0 first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _FEW):
        part = np.ascontiguousarray(hashes[at : at + _FEW]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of one text; zero when it has no words."""
    hashes = shingle_hashes(text)
    ones = 2 * _set_bits(hashes) > len(hashes)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def _golay() -> tuple[np.ndarray, list[np.ndarray]]:
    """The syndrome of each bit position, and for each syndrome the error patterns of at most
    four bits that explain it, lightest first; from the generator x^11+x^10+x^6+x^5+x^4+x^2+1."""
    generator = 0b110001110101

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= generator << (bit - 11)
        return word

    single = [remainder(1 << i) for i in range(23)]
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= single[b]
            light = patterns[syndrome][0].bit_count() if patterns[syndrome] else weight
            if weight < 4 or light == 3:
                patterns[syndrome].append(sum(1 << b for b in bits))
    return np.array(single, np.int64), [np.array(p, np.int64) for p in patterns]


_SINGLE, _LISTS = _golay()
#: Per syndrome: up to six patterns, and how many there are.
_COUNT = np.array([len(p) for p in _LISTS], np.int64)
_PATTERN = np.array([np.pad(p, (0, 6 - len(p))) for p in _LISTS], np.int64)


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices of the codewords within four bits of each 23-bit word, the nearest one
    first, and how many of the six hold."""
    words = words.astype(np.int64)
    syndrome = np.zeros(len(words), np.int64)
    for bit in range(23):
        syndrome ^= np.where(words >> bit & 1, _SINGLE[bit], 0)
    return (words[:, None] ^ _PATTERN[syndrome]) >> 11, _COUNT[syndrome]


#: A fingerprint's three segments: first bit and width.  Widths under 23 are padded with zeros.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which fingerprints (uint64) are filed: row numbers and int64 keys.

    At most three differing bits leave, once the segment with the most of them is set aside,
    at most one in each of the other two.  So for each pair of segments a key joins their
    codeword indices.  Of two words one bit apart exactly one has odd weight: odd words take
    all their codewords and even words the nearest alone, and the two still share one.
    """
    found = []
    for first, width in SEGMENTS:
        words = (prints >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        index, count = codewords(words)
        found.append((index, np.where(np.bitwise_count(words) & 1, count, 1)))
    rows, keys = [], []
    for pair, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        for a in range(6):
            for b in range(6):
                held = np.flatnonzero((found[i][1] > a) & (found[j][1] > b))
                rows.append(held)
                keys.append(pair << 24 | found[i][0][held, a] << 12 | found[j][0][held, b])
    return np.concatenate(rows), np.concatenate(keys)
