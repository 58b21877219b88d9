"""A compressed full-text index of word sequences: suffix order, BWT, wavelet matrix, matching statistics."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Suffixes are sorted by this many symbols, which is more than any pattern's length.
DEPTH = 128


class Bits:
    """A bit vector with ranks: 64-bit blocks and a count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(U64)
        ones = np.bitwise_count(self.blocks).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in front of position i."""
        block = i >> 6
        mask = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)


class Wavelet:
    """A wavelet matrix: the symbols' bits from the highest, each level sorted stably by the bit above."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels: list[tuple[int, Bits, int]] = []
        rest = symbols
        for level in range(max(int(largest).bit_length(), 1) - 1, -1, -1):
            bit = (rest >> level & 1).astype(bool)
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            rest = np.concatenate([rest[~bit], rest[bit]])
        every = np.arange(largest + 1)
        self.start = self._descend(every, np.zeros(largest + 1, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            one = bits.rank(i)
            i = np.where(symbol >> level & 1, zeros + one, i - one)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in front of position i."""
        return self._descend(symbol, i) - self.start[symbol]


class Sparse:
    """Minima over any range of an array, by tables of powers of two."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        while 2 << (len(self.tables) - 1) <= len(values):
            half = 1 << (len(self.tables) - 1)
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-half], last[half:]))
        self.flat = np.concatenate(self.tables)
        self.at = np.cumsum([0, *(len(t) for t in self.tables[:-1])])

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of each range low to high - 1, which isn't empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.flat[self.at[level] + low], self.flat[self.at[level] + high - (1 << level)])

    def before(self, i: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The last position up to i whose value is under the limit; 0 if there is none."""
        for level in range(len(self.tables) - 1, -1, -1):
            step = 1 << level
            ok = i - step + 1 >= 0
            at = np.where(ok, i - step + 1, 0)
            i = np.where(ok & (self.flat[self.at[level] + np.minimum(at, len(self.tables[level]) - 1)] >= limit), i - step, i)
        return np.maximum(i, 0)

    def after(self, i: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The first position from i on whose value is under the limit; the length if there is none."""
        n = len(self.tables[0])
        for level in range(len(self.tables) - 1, -1, -1):
            step = 1 << level
            ok = i + step <= n
            at = np.where(ok, i, 0)
            i = np.where(ok & (self.flat[self.at[level] + np.minimum(at, len(self.tables[level]) - 1)] >= limit), i + step, i)
        return i


class Index:
    """Index of sequences, each with an owner's number; symbol 0 ends a sequence."""

    def __init__(self, sequences: list[np.ndarray], owner: np.ndarray):
        sizes = np.array([len(s) for s in sequences], np.int64)
        words, inverse = np.unique(np.concatenate(sequences), return_inverse=True)
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(int((sizes + 1).sum()), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = inverse + 1
        self.text, self.begin, self.sizes = text, ends - sizes, sizes
        n = len(text)
        ranks, rank, size = [], text.astype(np.int32), 1
        while True:
            ranks.append(rank)
            shifted = np.zeros(n, np.int64)
            shifted[: max(n - size, 0)] = rank[size:] + 1
            key = rank.astype(np.int64) << 32 | shifted
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            size *= 2
            if size >= DEPTH:
                break
        self.n = n
        # Longest common prefix of neighbours in suffix order, up to DEPTH - 1, from the ranks of each length.
        a, b = order[:-1], order[1:]
        common = np.zeros(n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            x, y = a + common, b + common
            ok = (x < n) & (y < n)
            same = ok & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
            common += same * (1 << k)
        self.common = Sparse(np.concatenate([[0], common]).astype(np.uint8))
        self.owner = Sparse(np.repeat(owner, sizes + 1)[order].astype(np.int32))
        largest = len(words)
        self.wavelet = Wavelet(text[order - 1], largest)
        count = np.bincount(text, minlength=largest + 1)
        self.first = np.cumsum(count) - count

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: suffixes that begin with the symbol and go on as those from low to high - 1 do."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + both[: len(symbol)], self.first[symbol] + both[len(symbol) :]

    def wider(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger interval of a shorter common prefix, and that prefix's length."""
        left = self.common.tables[0][low].astype(np.int64)
        right = np.where(high < self.n, self.common.tables[0][np.minimum(high, self.n - 1)].astype(np.int64), 0)
        length = np.maximum(left, right)
        # All of the interval shares more than this; grow to where a neighbour shares less.
        low = np.where(length > 0, self.common.before(low, length), 0)
        high = np.where(length > 0, self.common.after(np.minimum(high, self.n), length), self.n)
        return low, high, length

    def statistics(self, owner: np.ndarray) -> np.ndarray:
        """For each position of the text, how long a match of what begins there is in a sequence with a smaller owner.

        All sequences are read from their ends at once. A match is extended to the left by one
        step of backward search; if no smaller owner has it, it is shortened to the next wider
        interval first, until one has it or nothing is left.
        """
        out = np.zeros(self.n, np.int64)
        low, high, length = np.zeros(len(owner), np.int64), np.full(len(owner), self.n), np.zeros(len(owner), np.int64)
        lanes = np.argsort(-self.sizes, kind="stable")
        sizes = self.sizes[lanes]
        for k in range(int(sizes[0]) if len(sizes) else 0):
            busy = lanes[: np.searchsorted(-sizes, -k)]
            place = self.begin[busy] + self.sizes[busy] - 1 - k
            todo = np.arange(len(busy))
            while len(todo):
                lane = busy[todo]
                a, b = self.step(self.text[place[todo]], low[lane], high[lane])
                some = a < b
                some[some] = self.owner.least(a[some], b[some]) < owner[lane[some]]
                done = lane[some]
                low[done], high[done] = a[some], b[some]
                length[done] += 1
                left = todo[~some]
                lane = busy[left]
                empty = length[lane] == 0
                todo = left[~empty]
                lane = busy[todo]
                # Strictly shorter: intervals of one and the same set of suffixes are passed over.
                low[lane], high[lane], shorter = self.wider(low[lane], high[lane])
                length[lane] = np.minimum(shorter, length[lane] - 1)
            out[place] = length[busy]
        return out
