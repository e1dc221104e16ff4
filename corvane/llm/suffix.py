"""Suffix array of many short strings by two-stage sorting, and its adjacent common prefixes."""

from __future__ import annotations

import numpy as np

#: Symbols of nine bits (a byte plus one; 0 ends a string) in a sort key.
CHUNK = 7


class SuffixArray:
    """Strings' suffixes in order. Each string ends with a symbol of its own, below all bytes, that sorts by place."""

    def __init__(self, strings: list[bytes]):
        joined = b"".join(s + b"\0" for s in strings)
        lengths = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(lengths + 1) - 1
        self.text = np.frombuffer(joined, np.uint8).astype(np.int64) + 1
        self.text[self.ends] = 0
        n = len(self.text)
        self.owner = np.repeat(np.arange(len(strings)), lengths + 1)
        self.left = self.ends[self.owner] - np.arange(n)  # symbols before the string's end
        padded = np.concatenate([self.text, np.zeros(CHUNK, np.int64)])
        self.keys = np.zeros(n, np.int64)
        for j in range(CHUNK):
            self.keys = (self.keys << 9) | np.where(self.left > j, padded[j : j + n], 0)
        self.order = self._sorted()

    def _key(self, at: np.ndarray, last: np.ndarray, chunk: int) -> np.ndarray:
        """Sort keys of the symbols from a chunk on; `last` are the ends of the suffixes' strings, whose key is 0."""
        return self.keys.take(np.minimum(at + chunk * CHUNK, last))

    def _direct(self, at: np.ndarray) -> np.ndarray:
        """Sort these suffixes by their symbols, those still tied chunk by chunk; equal strings by place."""
        key = self.keys.take(at)
        by = np.argsort(key, kind="stable")
        order, key = at[by], key[by]
        tied, new = np.arange(len(order)), np.concatenate([[True], key[1:] != key[:-1], [True]])[: len(order) + 1]
        some, last = order, order + self.left.take(order)
        for chunk in range(1, int(self.left.max(initial=0)) // CHUNK + 1):
            more = np.flatnonzero(~(new[:-1] & new[1:]))
            if not len(more):
                break
            tied, some, last, new = tied[more], some[more], last[more], np.append(new[more], True)
            key = self._key(some, last, chunk)
            falls = np.flatnonzero((key[1:] < key[:-1]) & ~new[1:-1])
            if len(falls):  # only ties that aren't in order yet are sorted
                of = np.cumsum(new[:-1]) - 1
                odd = np.zeros(int(of[-1]) + 1, bool)
                odd[of[falls]] = True
                these = np.flatnonzero(odd[of])
                again = these[np.lexsort((key[these], of[these]))]  # stable, so that equal ones stay in place order
                some[these], last[these], key[these] = some[again], last[again], key[again]
                order[tied[these]] = some[these]
            new[1:-1] |= key[1:] != key[:-1]
        return order

    def _sorted(self) -> np.ndarray:
        text, n = self.text, len(self.text)
        rise = np.sign(np.concatenate([np.diff(text), [1]]))
        decided = np.where(rise != 0, np.arange(n), n - 1)
        decided = np.minimum.accumulate(decided[::-1])[::-1]
        small = rise[decided] > 0  # smaller than its successor; runs of a symbol go with their end
        small[self.ends] = True
        direct = self._direct(np.flatnonzero(small & (text > 0)))
        first = np.searchsorted(text[direct], np.arange(258))
        buckets: list[list[np.ndarray]] = [[] for _ in range(257)]

        def induce(at: np.ndarray, now: int) -> np.ndarray:
            """Put the larger suffixes just before these at their bucket's head; those of the bucket in hand come back."""
            before = at[at > 0] - 1
            before = before[~small[before]]
            symbols = text[before]
            ahead = before[symbols != now]
            by = np.argsort(text[ahead], kind="stable")
            ahead = ahead[by]
            cuts = np.flatnonzero(np.diff(text[ahead])) + 1
            for part in np.split(ahead, cuts):
                if len(part):
                    buckets[text[part[0]]].append(part)
            return before[symbols == now]

        out = [self.ends]
        induce(self.ends, 0)
        for symbol in np.unique(text)[1:] if n else []:
            wave = np.concatenate(buckets[symbol]) if buckets[symbol] else np.zeros(0, np.int64)
            while len(wave):
                out.append(wave)
                wave = induce(wave, symbol)
            own = direct[first[symbol] : first[symbol + 1]]
            if len(own):
                out.append(own)
                induce(own, symbol)
        return np.concatenate(out)

    def common(self) -> np.ndarray:
        """Symbols that each suffix shares with the one before it in order; 0 for the first."""
        a, b = self.order[:-1], self.order[1:]
        most = np.minimum(self.left[a], self.left[b])
        same, open_ = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for chunk in range(int(most.max(initial=0)) // CHUNK + 1):
            rows = np.flatnonzero(open_)
            if not len(rows):
                break
            x, y = (self._key(at, at + self.left[at], chunk) for at in (a[rows], b[rows]))
            differ = x ^ y
            same[rows] += sum((differ < 1 << 9 * j).astype(np.int8) for j in range(CHUNK))
            open_[rows] = differ == 0
        return np.concatenate([[0], np.minimum(same, most)])

    def alike(self, width: int) -> np.ndarray:
        """Whether each suffix has its first `width` symbols, none of them an end, in common with the one before it in order."""
        out = self.left.take(self.order) >= width
        out[:1] = False
        out[1:] &= self.left.take(self.order[:-1]) >= width
        rows = np.flatnonzero(out)
        steps = sorted({*range(0, max(width - CHUNK, 0), CHUNK), width - CHUNK}, reverse=True) if width >= CHUNK else []
        for step in steps:  # neighbours differ late, if at all
            differ = self.keys.take(self.order[rows] + step) != self.keys.take(self.order[rows - 1] + step)
            out[rows[differ]] = False
            rows = rows[~differ]
        for step in range(width if width < CHUNK else 0):
            out[rows] &= self.text.take(self.order[rows] + step) == self.text.take(self.order[rows - 1] + step)
        return out
