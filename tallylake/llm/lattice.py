"""Lattices of a SentencePiece vocabulary over many chunks of text at once, in numpy.

A chunk is a stretch that no piece crosses: blanks and the word behind them, or a line break. Each distinct chunk of a batch gets one row of
nodes, a node per character and one for its end. A node's edges are kept by piece length (slot 0 is one character), so edge (node,
slot) leads to node + slot + 1. Backward sums turn piece probabilities into each edge's probability among all ways to finish.
"""

from __future__ import annotations

import functools
import re

import numpy as np

BLANK = "▁"
HELD = "\ud800"  # stands for a BLANK character of the text itself; no valid text holds it
CHUNK = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


class Vocabulary:
    """Pieces, their log-probabilities and a trie in hash tables.

    A byte-pair model ranks its pieces instead of weighing them; a piece of rank r counts 1 / (r + 10) before scaling.
    """

    def __init__(self, path: str, temperature: float = 1.0) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.byte_id = np.zeros(256, dtype=np.int32)
        pieces: dict[str, int] = {}
        raw: list[bytes] = []
        rank = np.full(self.size, float(self.size))
        for i in range(self.size):
            piece = model.id_to_piece(i)
            raw.append(piece.replace(BLANK, " ").encode())
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                raw[i] = bytes([int(piece[1:-1], 16)])
            elif model.is_control(i) or model.is_unknown(i):
                raw[i] = b""
            else:
                pieces[piece] = i
                rank[i] = min(max(-model.get_score(i), 0.0), float(self.size))
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_length = np.array([len(piece) for piece in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        weight = -np.log(rank + 10.0)
        self.logp = ((weight - np.log(np.exp(weight).sum())) / temperature).astype(np.float64)
        self.byte_logp = float(self.logp[self.byte_id[0]])
        self.longest = max(map(len, pieces))
        self._grow_trie(pieces)

    def _grow_trie(self, pieces: dict[str, int]) -> None:
        letters = sorted({ch for piece in pieces for ch in piece})
        self.letter = np.zeros(0x110001, dtype=np.int32)
        self.letter[[ord(ch) for ch in letters]] = np.arange(1, len(letters) + 1)
        steps: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        for piece, i in pieces.items():
            state = 0
            for ch in piece:
                key = (state, int(self.letter[ord(ch)]))
                if key not in steps:
                    steps[key] = len(piece_at)
                    piece_at.append(-1)
                state = steps[key]
            piece_at[state] = i
        self.piece_at = np.array(piece_at, dtype=np.int32)
        self.bits = int(len(steps)).bit_length() + 2
        self.keys, self.targets = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        for (state, letter), target in steps.items():
            key = (state << 16) | letter
            slot = int(self._slot(np.array([key]))[0])
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.targets[slot] = key, target

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Next trie states, -1 where there is none."""
        keys = (states.astype(np.int64) << 16) | letters
        slots = self._slot(keys)
        out = np.full(len(keys), -1, dtype=np.int32)
        open_ = np.flatnonzero(letters > 0)
        while len(open_):
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.targets[slots[open_[hit]]]
            open_ = open_[(held >= 0) & ~hit]
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def chunks(self, text: str) -> list[str]:
        return CHUNK.findall(BLANK + text.replace(BLANK, HELD).replace(" ", BLANK)) if text else []

    def decode(self, ids: np.ndarray) -> str:
        length = self.raw_length[ids]
        end = np.cumsum(length)
        at = np.repeat((self.raw_start[ids] - end + length).astype(np.int32), length)
        at += np.arange(len(at), dtype=np.int32)
        return self.raw[at].tobytes().decode("utf-8", "replace")[1:]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """Ids with characters outside the vocabulary (size + code point) as their bytes' ids."""
        odd = np.flatnonzero(ids >= self.size)
        if not len(odd):
            return ids
        parts, start = [], 0
        for i in odd:
            ch = chr(int(ids[i]) - self.size)
            data = (BLANK if ch == HELD else ch).encode()
            parts += [ids[start:i], self.byte_id[np.frombuffer(data, dtype=np.uint8)]]
            start = i + 1
        return np.concatenate([*parts, ids[start:]])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, temperature: float = 1.0) -> Vocabulary:
    """The worker's vocabulary, kept from task to task."""
    return Vocabulary(path, temperature)


class Lattices:
    def __init__(self, vocabulary: Vocabulary, chunks: list[str]) -> None:
        v = vocabulary
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        self.root = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(chunks) else np.zeros(0, dtype=np.int64)
        codes = np.frombuffer("\x00".join([*chunks, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        n = len(codes)
        ends = self.root + sizes
        letters = v.letter[codes]
        letters[ends] = 0
        self.is_end = np.zeros(n + 1, dtype=bool)
        self.is_end[ends] = True
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.flatnonzero(~self.is_end[:n])
        states = np.zeros(len(at), dtype=np.int32)
        for length in range(v.longest):
            states = v.step(states, letters[np.minimum(at + length, n - 1)])
            alive = states >= 0
            at, states = at[alive], states[alive]
            if not len(at):
                break
            found.append((at, v.piece_at[states]))
        self.ids = np.full((n, max(1, len(found))), -1, dtype=np.int32)
        for slot, (at, ids) in enumerate(found):
            self.ids[at, slot] = ids
        unknown = np.flatnonzero((self.ids[:, 0] < 0) & ~self.is_end[:n])
        self.ids[unknown, 0] = np.where(codes[unknown] < 0x80, v.byte_id[codes[unknown] & 0x7F], v.size + codes[unknown])
        self._weigh(v, codes, ends, sizes)

    def _weigh(self, v: Vocabulary, codes: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> None:
        n, width = self.ids.shape
        # sums over a chunk stay small, so single precision does, unless a chunk is very long
        kind = np.float32 if not n or sizes.max() < 100 else np.float64
        priced = np.append(v.logp, -np.inf).astype(kind)
        beta = np.zeros(n + width + 1, dtype=kind)
        left = np.repeat(ends, sizes + 1)[:n] - np.arange(n)  # characters to the chunk's end
        order = np.argsort(left.astype(np.int32), kind="stable")
        bounds = np.searchsorted(left[order], np.arange(1, (left.max() if n else 0) + 2))
        self.logq = np.full((n, width), -np.inf, dtype=np.float32)
        self.cumulative = np.full((n, width), 2.0, dtype=np.float32)
        for length, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), 1):
            nodes = order[a:b]
            used = min(length, width)  # no piece crosses the chunk's end
            ids = self.ids[nodes, :used]
            weight = priced[np.minimum(ids, v.size)]  # -1, no piece, takes the last as well
            odd = np.flatnonzero(ids[:, 0] >= v.size)
            if len(odd):
                code = codes[nodes[odd]]
                weight[odd, 0] = v.byte_logp * (2 + (code > 0x7FF) + (code > 0xFFFF))
            weight += beta[nodes[:, None] + np.arange(1, used + 1)]
            top = weight.max(axis=1, keepdims=True)
            weight -= top
            run = np.cumsum(np.exp(weight), axis=1, dtype=np.float32)
            total = run[:, -1:].copy()
            gained = np.log(total)
            beta[nodes] = (top + gained)[:, 0]
            self.logq[nodes, :used] = weight - gained
            run /= total
            run[run >= 1.0] = 2.0  # from the last edge on
            self.cumulative[nodes, :used] = run

    def walk(self, starts: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One random way to the end from each start node: (nodes, slots, number of edges per start).

        ``draw(which, nodes)`` gives uniform numbers for the starts that are still under way.
        """
        which, nodes = np.arange(len(starts)), starts.copy()
        count = np.zeros(len(starts), dtype=np.int64)
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = ~self.is_end[nodes]
        which, nodes = which[live], nodes[live]
        while len(which):
            slots = (self.cumulative[nodes] > draw(which, nodes).astype(np.float32)[:, None]).argmax(axis=1)
            taken.append((which, nodes, slots))
            count[which] += 1
            nodes = nodes + slots + 1
            live = ~self.is_end[nodes]
            which, nodes = which[live], nodes[live]
        first = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(starts) else count
        all_nodes, all_slots = np.zeros(count.sum(), dtype=np.int64), np.zeros(count.sum(), dtype=np.int64)
        for step, (who, at, slot) in enumerate(taken):
            all_nodes[first[who] + step], all_slots[first[who] + step] = at, slot
        return all_nodes, all_slots, count
