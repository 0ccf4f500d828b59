"""Exact token ids of a lower-casing word BPE, with the words of a batch encoded once.

Such a tokenizer never joins characters across white space, so the ids of a text are those of its blank-separated chunks one
after another. Chunks repeat a lot: each Python worker keeps the ids of the chunks it has met from task to task, at most ``MOST_KEPT`` bytes
of them; when that is full, those that were not met since half of it was filled go. A chunk of Latin letters with closing marks is put together
from the ids of its lower-case word, which the tokenizer's model gives without the normalizing that changes nothing in it, and those of its
marks; all others go to the tokenizer as they are. Texts with control characters that Python and the tokenizer may class differently
go to the tokenizer whole.
"""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Callable

import numpy as np

MOST_KEPT = 64 << 20
PER_ENTRY = 180  # bytes of a key, a value and their place in the table beside their own length
TAIL = string.punctuation
ODD = re.compile("[\x1c-\x1f]")
ABOVE_LATIN = "ɐ"
# byte-level models name each byte by a printable character
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - {*PRINTABLE}))}


class Kept(dict):
    """Ids by string, made on first use; ``rest`` holds those that a fuller table had before."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make, self.rest, self.held = make, {}, 0

    def __missing__(self, key: str) -> bytes:
        ids = self.rest.get(key)
        if ids is None:
            ids = self.make(key)
        self.held += PER_ENTRY + 3 * len(key)
        self[key] = ids
        return ids

    def shrink(self, most: int) -> None:
        """Called now and then: at most twice ``most`` bytes stay."""
        if self.held > most:
            self.rest, self.held = dict(self), 0
            self.clear()


class WordIds:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks, self.words = Kept(self._chunk), Kept(self._word)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text."""
        for kept in (self.chunks, self.words):
            kept.shrink(MOST_KEPT // 4)
        ids_of = self.chunks.__getitem__
        return [
            self._whole(text) if ODD.search(text) else np.frombuffer(b"".join(map(ids_of, text.split())), dtype="<u4")
            for text in texts
        ]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(TAIL)
        lower = self._lower(word)
        if lower is None:
            return self._whole(chunk).tobytes()
        return self.words[lower] + self.words[chunk[len(word):]] if len(word) < len(chunk) else self.words[lower]

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case word, or of marks."""
        if not word.isalpha():
            return self._whole(word).tobytes()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_NAMES)
        return b"".join([token.id.to_bytes(4, "little") for token in self.model.tokenize(word)])

    @staticmethod
    def _lower(word: str) -> str | None:
        """The lower-case form of a word of Latin letters, as the tokenizer sees it; None where that isn't plain."""
        if not word.isalpha() or not (word.isascii() or max(word) < ABOVE_LATIN):
            return None
        lower = word.lower()
        return lower if lower.isalpha() else None


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The worker's coder, kept from task to task."""
    return WordIds(path)
