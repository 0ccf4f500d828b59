"""Word shingles of a text as 64-bit numbers, and parity sketches over them."""

from __future__ import annotations

import numpy as np

WORDS = 5
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct numbers of the shingles of ``WORDS`` words; the whole sequence as one if there are fewer, none if no words.

    Bytes split and lower-case exactly as asked: at blank and 0x09 to 0x0D, and A to Z only.
    """
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(WORDS, len(words))
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        total = total * PRIME + codes[j:len(codes) - n + 1 + j]
    return np.unique(mix(total))


class Bands:
    """Size bands: scheme i serves all pairs whose larger set has 4**i up to 4**(i+1) - 1 shingles.

    Two sets of a <= b shingles that link have a symmetric difference of at most (a + b) / 7 and b <= 4a / 3. A set takes part in the
    scheme of its own size and, if a larger partner may lie in the next one, there as well.
    """

    LEVELS = 4

    @staticmethod
    def of(size: int) -> list[tuple[int, int]]:
        """(scheme, largest difference from any partner there)."""
        own = (size.bit_length() - 1) // 2
        above = 4 ** (own + 1)
        largest = 4 * size // 3
        out = [(own, (size + min(largest, above - 1)) // 7)]
        if largest >= above:
            out.append((own + 1, (size + largest) // 7))
        return out

    @staticmethod
    def blocks(scheme: int, level: int) -> int:
        """Blocks of a sketch; at the last level as many as there are numbers, a block for each shingle."""
        return 3 * 4 ** (scheme + level) if level < Bands.LEVELS - 1 else 1 << 62


def least_level(shingles: np.ndarray, scheme: int, difference: int) -> int:
    """The coarsest level at which more blocks of this set are filled than a linked one can differ in."""
    for level in range(Bands.LEVELS - 1):
        if len(np.unique(mix(shingles) % np.uint64(Bands.blocks(scheme, level)))) > difference:
            return level
    return Bands.LEVELS - 1


def block_keys(shingles: np.ndarray, scheme: int, level: int, difference: int, frequent: np.ndarray) -> np.ndarray:
    """Keys of the first ``difference`` + 1 filled blocks of the parity sketch, blocks of frequent shingles last.

    A shingle toggles one bit of one block; a block is kept as the XOR of its toggled bits' codes. A block can only differ
    between two sets if a shingle of their symmetric difference falls into it, so linked sets share a key.
    """
    n = Bands.blocks(scheme, level)
    place = mix(shingles) % np.uint64(n)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        place = place + np.where(frequent[at] == shingles, np.uint64(n), np.uint64(0))
    order = np.argsort(place, kind="stable")
    place = place[order]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    value = np.bitwise_xor.reduceat(shingles[order], starts)[:difference + 1]
    salt = np.uint64((scheme * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    return mix(value ^ mix(place[starts[:difference + 1]] + salt))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity sketch in 64-bit words: every shingle toggles one bit; as many bits as the power of two above the shingles, at least a word."""
    bits = max(64, 1 << len(shingles).bit_length())
    return np.packbits(np.bincount((shingles >> np.uint64(20)) % np.uint64(bits), minlength=bits).astype(np.uint8) & 1).view(np.uint64)


def fold(words: np.ndarray) -> np.ndarray:
    """The sketch of half as many bits (itself if it is one word)."""
    return words[:len(words) // 2] ^ words[len(words) // 2:] if len(words) > 1 else words


def may_link(size_a: int, sketch_a: np.ndarray, size_b: int, sketch_b: np.ndarray) -> bool:
    """False only if the sets can't link: by their sizes, or because the Hamming distance of the sketches, which is at most the
    symmetric difference, is too large. The longer sketch is folded to the shorter one's bits."""
    small, large = sorted((size_a, size_b))
    if not small or 4 * small < 3 * large:
        return False
    while len(sketch_a) > len(sketch_b):
        sketch_a = fold(sketch_a)
    while len(sketch_b) > len(sketch_a):
        sketch_b = fold(sketch_b)
    return 7 * int(np.bitwise_count(sketch_a ^ sketch_b).sum()) <= size_a + size_b


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 75 * (len(a) + len(b) - both)
