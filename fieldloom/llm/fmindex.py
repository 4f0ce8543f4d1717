"""An FM-index over integer symbols: suffix array, Burrows-Wheeler transform, wavelet matrix with bit-packed
ranks, sampled suffix positions. All searches are vectorised over many patterns."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; the text ends with a unique smallest symbol. The first sort packs as many symbols as fit in a key; later
    ones only sort suffixes that still share their group with others."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    step = min(62 // bits, n)
    wide = np.concatenate([text.astype(np.int64), np.zeros(step, np.int64)])
    keys = np.zeros(n, np.int64)
    for k in range(step):
        keys = keys << bits | wide[k : n + k]
    order = np.argsort(keys)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    at, suffixes, keys = np.arange(n), order, keys[order]
    while True:
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[suffixes] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        tied = ~(new & np.append(new[1:], True))
        at, suffixes = at[tied], suffixes[tied]
        if not len(at):
            return order
        keys = rank[suffixes] * (n + 1) + rank[np.minimum(suffixes + step, n)] + 1
        again = np.argsort(keys)
        keys, suffixes = keys[again], suffixes[again]
        order[at] = suffixes
        step *= 2


class Bits:
    """A bit vector with constant-time ranks: 64-bit words and a running count before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes().ljust((len(packed) // 8 + 1) * 8, b"\0"), np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = int(len(bits) - self.before[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class FMIndex:
    def __init__(self, text: np.ndarray):
        """text: symbols 0..s-1, of which 0 occurs once, at the end."""
        n, self.n = len(text), len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.symbols = int(text.max()) + 1
        counts = np.bincount(text, minlength=self.symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[Bits] = []
        self.depth = max(1, int(self.symbols - 1).bit_length())
        rest = bwt
        for k in range(self.depth - 1, -1, -1):
            bit = (rest >> k & 1).astype(bool)
            self.levels.append(Bits(bit))
            rest = np.concatenate([rest[~bit], rest[bit]])
        symbols = np.arange(self.symbols)
        self.base = self._path(symbols, np.zeros(self.symbols, np.int64))
        marked = sa % SAMPLE == 0
        self.marked, self.samples = Bits(marked), sa[marked]
        self.is_marked = marked

    def _path(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, k in zip(self.levels, range(self.depth - 1, -1, -1), strict=True):
            ones = level.rank1(i)
            i = np.where(symbol >> k & 1, level.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i of the transform."""
        return self._path(symbol, i) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of patterns of one length: which occur, and their intervals of suffixes."""
        alive = np.flatnonzero((patterns < self.symbols).all(axis=1))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            if not len(alive):
                break
            c = patterns[alive, k]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
        return alive, low, high

    def _symbol_at(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for level in self.levels:
            bit = level.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)
            ones = level.rank1(i)
            i = np.where(bit == 1, level.zeros + ones, i - ones)
            out = out << 1 | bit.astype(np.int64)
        return out

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to the nearest sampled one."""
        out = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.is_marked[at]
            done = at[hit]
            out[todo[hit]] = self.samples[self.marked.rank1(done)] + steps
            todo, at = todo[~hit], at[~hit]
            c = self._symbol_at(at)
            at = self.first[c] + self.rank(c, at)
            steps += 1
        return out
