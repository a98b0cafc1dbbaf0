"""FM-index over a delimited list of words, searched for many queries at once.

The index holds the Burrows-Wheeler transform of "word, delimiter, word, delimiter, ...", with the words sorted and unlike.
A query is read from its end: an interval of suffix ranks for all queries, narrowed by one symbol a step. Counting the symbols before a
rank is a search in the sorted (symbol, rank) pairs, which gives the new rank at once. Whole queries at a time are numpy arrays; memory
follows the words and queries of one call.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Ranks in an interval up to which its symbols are read from the transform; wider ones ask for each symbol of the alphabet.
NARROW = 64


def _codes(words: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Order of the suffixes of words that end with symbol 0: by their symbols up to the end of the word, equal ones by place.

    First by as many symbols as fit a 62-bit number, then by prefix doubling within the words.
    """
    n = len(text)
    here = np.arange(n)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, here)] - here  # symbols before the end of the word
    per = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(per):
        key = (key << bits) | np.where(j <= left, text[np.minimum(here + j, n - 1)], 0)
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order[1:]] != key[order[:-1]]] | (left[order] < per)
    step = per
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order
        key = rank * n + np.where(step <= left, rank[np.minimum(here + step, n - 1)], 0)
        order = np.argsort(key, kind="stable")
        fresh = np.r_[True, key[order[1:]] != key[order[:-1]]]
        step *= 2


class FmIndex:
    """Index of sorted, distinct words without the character zero."""

    def __init__(self, words: Sequence[str]):
        codes = _codes([w + "\0" for w in words])
        self.alphabet, text = np.unique(codes, return_inverse=True)
        if len(codes) != sum(map(len, words)) + len(words) or (text == 0).sum() != len(words):
            raise ValueError("a word holds the delimiter")
        text = text.astype(np.int64)
        self.n, self.sigma = len(text), len(self.alphabet)
        self.bwt = text[suffix_order(text, max(1, int(self.sigma - 1).bit_length())) - 1]  # the symbol before the first is the last delimiter
        ranks = np.argsort(self.bwt, kind="stable")
        self.keys = self.bwt[ranks] * self.n + ranks
        self.before = np.empty(self.n, np.int64)  # rank of the suffix that is longer by the symbol before
        self.before[ranks] = np.arange(self.n)
        self.words = len(words)

    def symbols(self, words: Sequence[str]) -> np.ndarray:
        """Symbols of joined words; -1 for those of no word."""
        codes = _codes(words)
        at = np.minimum(np.searchsorted(self.alphabet, codes), self.sigma - 1)
        return np.where(self.alphabet[at] == codes, at, -1)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes with a symbol more in front; empty where there is none."""
        return np.searchsorted(self.keys, c * self.n + lo), np.searchsorted(self.keys, c * self.n + hi)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All one-symbol extensions but the delimiter of some intervals: (interval's place, symbol, lo, hi), by place."""
        width = hi - lo
        found = []
        few = np.flatnonzero((width > 0) & (width <= NARROW))
        if len(few):
            w = width[few]
            place = np.repeat(few, w)
            at = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(lo[few], w)
            c = self.bwt[at]
            order = np.argsort(place * self.sigma + c, kind="stable")
            place, c, to = place[order], c[order], self.before[at[order]]
            head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (c[1:] != c[:-1])])
            tail = np.r_[head[1:], len(place)] - 1
            found.append((place[head], c[head], to[head], to[tail] + 1))
        many = np.flatnonzero(width > NARROW)
        for c in range(1, self.sigma) if len(many) else ():
            a, b = self.extend(np.int64(c), lo[many], hi[many])
            ok = a < b
            found.append((many[ok], np.full(ok.sum(), c), a[ok], b[ok]))
        if not found:
            return (np.empty(0, np.int64),) * 4
        place, c, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = np.flatnonzero(c > 0)
        keep = keep[np.argsort(place[keep], kind="stable")]
        return place[keep], c[keep], a[keep], b[keep]

    def one_error(self, queries: Sequence[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) places of the words at distance one whose last `exact[query]` symbols are those of the query.

        The exact part is matched first, then the rest with one symbol put in, left out or replaced. Of the edits that give the same
        word, the one nearest to the front is taken, so no pair comes twice.
        """
        size = np.array([len(q) for q in queries], np.int64)
        flat, ends = self.symbols(queries), np.cumsum(size)
        none = np.empty(0, np.int64)

        def symbol(q: np.ndarray, t: int) -> np.ndarray:
            """The symbol `t` before the last, -2 in front of the query."""
            if not len(flat):
                return np.full(len(q), -2)
            return np.where(t < size[q], flat[np.maximum(ends[q] - 1 - t, 0)], -2)

        zero = (np.flatnonzero(exact <= size), none, none)
        zero = (zero[0], np.zeros(len(zero[0]), np.int64), np.full(len(zero[0]), self.words))
        one, out = (none, none, none), []
        for t in range(int(size.max(initial=0)) + 1):
            q, lo, hi = zero
            nxt = []
            c = symbol(q, t)
            open_ = np.flatnonzero(exact[q] <= t)
            if len(open_):
                spans, which = np.unique(lo[open_] * (self.n + 1) + hi[open_], return_inverse=True)
                place, kc, ka, kb = self.children(spans // (self.n + 1), spans % (self.n + 1))
                count = np.bincount(place, minlength=len(spans))
                head = np.cumsum(count) - count
                reps = count[which]
                at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(head[which], reps)
                by, sym = np.repeat(open_, reps), kc[at]
                other = sym != c[by]
                by, a, b = by[other], ka[at[other]], kb[at[other]]
                one = tuple(np.concatenate(x) for x in zip(one, (q[by], a, b), strict=True))  # put in before the next symbol
                more = t < size[q[by]]
                nxt.append((q[by][more], a[more], b[more]))  # in place of it
                skip = open_[(t < size[q[open_]]) & (symbol(q[open_], t + 1) != c[open_])]
                nxt.append((q[skip], lo[skip], hi[skip]))  # it is left out
            oq, olo, ohi = one
            whole = np.flatnonzero(size[oq] == t)
            if len(whole):
                a, b = self.extend(np.int64(0), olo[whole], ohi[whole])
                hit = np.flatnonzero(a < b)
                out.append((oq[whole][hit], a[hit]))
            rest = np.flatnonzero(size[oq] > t)
            a, b = self.extend(symbol(oq[rest], t), olo[rest], ohi[rest])
            ok = a < b
            nxt.append((oq[rest][ok], a[ok], b[ok]))
            one = tuple(np.concatenate(x) for x in zip(*nxt, strict=True))
            rest = np.flatnonzero(size[q] > t)
            a, b = self.extend(c[rest], lo[rest], hi[rest])
            ok = a < b
            zero = (q[rest][ok], a[ok], b[ok])
            if not len(zero[0]) and not len(one[0]):
                break
        if not out:
            return none, none
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
