"""Jaro-Winkler likeness of many words with many, over numbers in place of texts.

Two blocks of words are compared as a product of matrices first: their letters in common, each with its number of occurrence, bound
what they can be alike. What can be alike enough is measured by bits, a word's places being those of a 64-bit number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np

#: Longest word that is measured by bits, buckets of letters that bound a pair's common letters, entries of a product of matrices, and pairs measured at once.
WIDE, LETTERS, ENTRIES, AT_ONCE = 64, 64, 1 << 20, 1 << 15
ONE = np.uint64(1)


def winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = next(c for c in map(chr, range(len(a) + 1)) if c not in a)  # stands where b's letters are taken
    left, hits, at = b, [], []
    for i, c in enumerate(a):
        j = left.find(c, max(0, i - reach), i + reach + 1)
        if j >= 0:
            left = left[:j] + used + left[j + 1 :]
            hits.append(c)
            at.append(j)
    if not hits:
        return 0.0
    m = len(hits)
    swaps = sum(c != b[j] for c, j in zip(hits, sorted(at))) // 2  # whole pairs of letters out of place
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def windows() -> np.ndarray:
    """The places of the other word that a place may meet, as bits, by reach and place."""
    out = np.zeros((WIDE // 2, WIDE), np.uint64)
    for reach in range(WIDE // 2):
        for i in range(WIDE):
            out[reach, i] = sum(1 << j for j in range(max(0, i - reach), min(WIDE, i + reach + 1)))
    return out


WINDOWS = windows()


class Words:
    """Words of 1 to WIDE letters as numbers: code points, lengths, occurrences of letters and beginnings."""

    def __init__(self, words: list[str]):
        self.words, n = words, len(words)
        self.length = np.fromiter(map(len, words), np.int64, n)
        wide = int(self.length.max(initial=1))
        self.codes = np.zeros((n, WIDE + 1), np.uint32)  # a last column, which is empty, for places beyond the end
        self.codes[:, :wide] = np.array(words, f"U{wide}").view(np.uint32).reshape(n, wide)
        inside = np.arange(wide) < self.length[:, None]
        bucket = np.where(inside, self.codes[:, :wide] % LETTERS, LETTERS)
        times = np.zeros((n, wide), np.int64)
        for i in range(1, wide):
            times[:, i] = (bucket[:, :i] == bucket[:, i : i + 1]).sum(axis=1)
        self.rows, places = np.nonzero(inside)
        self.letters = bucket[self.rows, places] + LETTERS * times[self.rows, places]

    def matrix(self, known: np.ndarray) -> np.ndarray:
        """A row of ones and zeros for each word: which of the known letters it has."""
        out = np.zeros((len(self.words), len(known)), np.float32)
        at = np.minimum(np.searchsorted(known, self.letters), len(known) - 1)
        own = known[at] == self.letters
        out[self.rows[own], at[own]] = 1
        return out


def begins(a: Words, b: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the beginnings of 1 to 4 letters in both; a word that ends before has none that another has."""
    out = []
    for k in range(1, 5):
        own = np.concatenate([a.codes[:, :k], b.codes[:, :k]])
        ids = np.unique(own, axis=0, return_inverse=True)[1].reshape(-1)
        x, y = ids[: len(a.words)], ids[len(a.words) :]
        out.append((np.where(a.length >= k, x, -1), np.where(b.length >= k, y, -2)))
    return out


class Pairs:
    """Likenesses of words a with words b, of which pairs are asked by number."""

    def __init__(self, a: Words, b: Words):
        self.a, self.b, self.begins = a, b, begins(a, b)
        self.alphabet = np.unique(a.codes)  # begins with the 0 of empty places
        self.ids = np.searchsorted(self.alphabet, a.codes)

    def common_beginning(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum((x[i] == y[j]).astype(np.int64) for x, y in self.begins)

    def measured(self, i: np.ndarray, j: np.ndarray, least: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs whose likeness is ``least`` or more, with it."""
        out = []
        for k in range(0, len(i), AT_ONCE):
            out.append(self.few(i[k : k + AT_ONCE], j[k : k + AT_ONCE], least if np.isscalar(least) else least[k : k + AT_ONCE]))
        return tuple(map(np.concatenate, zip(*out))) if out else (i, j, np.zeros(0))

    def few(self, i: np.ndarray, j: np.ndarray, least: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, at = np.unique(j, return_inverse=True)
        places = np.zeros((len(own), len(self.alphabet) + 1), np.uint64)  # a letter's places in a word b; the last column has letters that no word a has
        for k in range(int(self.b.length[own].max(initial=0))):
            code = self.b.codes[own, k]
            letter = np.minimum(np.searchsorted(self.alphabet, code), len(self.alphabet) - 1)
            letter = np.where(self.alphabet[letter] == code, letter, len(self.alphabet))
            inside = self.b.length[own] > k
            places[np.flatnonzero(inside), letter[inside]] |= ONE << np.uint64(k)
        n, m = self.a.length[i], self.b.length[j]
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
        taken, hits = np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64)
        flat, base = places.reshape(-1), at * places.shape[1]
        for k in range(int(n.max(initial=0))):
            free = flat[base + self.ids[i, k]] & ~taken & WINDOWS[:, k][reach]
            if k >= n.min():
                free[k >= n] = 0
            first = free & (~free + ONE)
            taken |= first
            hits |= (first != 0).astype(np.uint64) << np.uint64(k)
        common = np.bitwise_count(taken).astype(np.int64)
        start = self.common_beginning(i, j) * 0.1
        most = (common / n + common / m + 1) / 3
        kept = np.flatnonzero((common > 0) & (most + start * (1 - most) >= least - 1e-9))
        i, j, n, m, common, start, hits, taken = (x[kept] for x in (i, j, n, m, common, start, hits, taken))
        apart = np.zeros(len(i), np.int64)
        for _ in range(int(common.max(initial=0))):
            x, y = hits & (~hits + ONE), taken & (~taken + ONE)
            apart += self.a.codes[i, np.bitwise_count(x - ONE)] != self.b.codes[j, np.bitwise_count(y - ONE)]  # the empty column where none is left
            hits ^= x
            taken ^= y
        jaro = (common / n + common / m + (common - apart // 2) / common) / 3
        score = jaro + start * (1 - jaro)
        kept = score >= (least if np.isscalar(least) else least[kept])
        return i[kept], j[kept], score[kept]

    def likely(self, least: float, best: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs that can have a likeness of ``least``, or of what ``best`` has for a word a by then, with what they can have, block by block."""
        a, b = self.a, self.b
        known = np.intersect1d(a.letters, b.letters)
        if not len(known):
            return
        x, y = a.matrix(known).T.copy(), b.matrix(known)
        first_a, first_b = self.begins[0]
        order = np.lexsort((first_b, b.length))
        fresh = np.flatnonzero(np.diff(b.length[order], prepend=-1) | np.diff(first_b[order], prepend=-9))
        at_once = max(ENTRIES // max(x.shape[1], 1), 1)
        inverse = 1 / a.length
        for first, last in zip(fresh, [*fresh[1:], len(order)]):
            for k in range(first, last, at_once):
                rows = order[k : min(k + at_once, last)]
                bound = np.full(len(a.words), least) if best is None else np.maximum(best, least)
                p = np.where(first_a == first_b[rows[0]], 0.4, 0.0)
                need = (3 * (bound - p) / (1 - p) - 1) / (inverse + 1 / b.length[rows[0]])
                common = y[rows] @ x
                j, i = np.nonzero(common >= (np.maximum(need, 1) - 1e-4).astype(np.float32))
                if not len(i):
                    continue
                jaro = common[j, i].astype(float)
                j = rows[j]
                jaro = (jaro / a.length[i] + jaro / b.length[j] + 1) / 3
                most = jaro + self.common_beginning(i, j) * 0.1 * (1 - jaro)
                kept = most >= bound[i] - 1e-9
                if kept.any():
                    yield i[kept], j[kept], most[kept]


def parted(words: list[str]) -> tuple[list[str], list[str], bool]:
    """Words that are measured by bits, longer ones, and whether there is the empty one."""
    return [w for w in words if 0 < len(w) <= WIDE], [w for w in words if len(w) > WIDE], "" in words


def long_pairs(left: list[str], right: list[str], least: float) -> Iterator[tuple[str, str, float]]:
    """Pairs of which one word at least is longer than WIDE, alike by ``least`` or more; few in names, so each is measured by itself."""
    def counted(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), LETTERS), np.int32)
        for row, w in zip(out, words):
            for c, k in Counter(w).items():
                row[ord(c) % LETTERS] += k
        return out

    if not any(len(w) > WIDE for w in (*left, *right)):
        return
    x, y = counted(left), counted(right)
    n, m = (np.fromiter(map(len, w), np.int64, len(w)) for w in (left, right))
    for i, w in enumerate(left):
        asked = np.flatnonzero((np.maximum(m, len(w)) > WIDE) & (m > 0)) if w else np.zeros(0, np.int64)
        for k in range(0, len(asked), AT_ONCE):
            part = asked[k : k + AT_ONCE]
            common = np.minimum(y[part], x[i]).sum(axis=1)
            jaro = (common / n[i] + common / m[part] + 1) / 3
            for j in part[(common > 0) & (jaro + 0.4 * (1 - jaro) >= least - 1e-9)]:
                if (score := winkler(w, right[j])) >= least:
                    yield w, right[j], score


def alike(left: list[str], right: list[str], least: float) -> Iterator[tuple[list[str], list[str], np.ndarray]]:
    """Words a and b and scores of all pairs of a likeness of ``least`` (above 0) or more, in parts."""
    (a, _, no_a), (b, _, no_b) = parted(left), parted(right)
    if no_a and no_b:
        yield [""], [""], np.ones(1)
    part = []
    for pair in long_pairs(left, right, least):
        part.append(pair)
        if len(part) == AT_ONCE:
            yield (found := list(zip(*part)))[0], found[1], np.array(found[2])
            part = []
    if part:
        yield (found := list(zip(*part)))[0], found[1], np.array(found[2])
    if not a or not b:
        return
    pairs = Pairs(Words(a), Words(b))
    for i, j in gathered((i, j) for i, j, _ in pairs.likely(least)):
        i, j, score = pairs.measured(i, j, least)
        if len(i):
            yield [a[k] for k in i.tolist()], [b[k] for k in j.tolist()], score


def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The parts, put together to some AT_ONCE pairs."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= AT_ONCE:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def nearest(left: list[str], right: list[str], owners: list[str], least: float) -> Iterator[tuple[str, str, float]]:
    """For each word of ``left`` that has any of a likeness of ``least`` (above 0) or more: the word, the smallest owner among its nearest, and their likeness.

    Words that can't be nearer than what is found aren't measured.
    """
    found: dict[str, tuple[float, str]] = {}

    def seen(word: str, score: float, owner: str) -> None:
        old = found.get(word)
        if old is None or score > old[0] or (score == old[0] and owner < old[1]):
            found[word] = (score, owner)

    owner_of = dict(zip(right, owners))
    (a, _, no_a), (b, _, no_b) = parted(left), parted(right)
    if no_a and no_b:
        seen("", 1.0, owner_of[""])
    for w, other, score in long_pairs(left, right, least):
        seen(w, score, owner_of[other])
    if a and b:
        pairs, own = Pairs(Words(a), Words(b)), [owner_of[w] for w in b]
        best = np.array([found[w][0] if w in found else 0.0 for w in a])
        for i, j, most in pairs.likely(least, best):
            order = np.lexsort((-most, i))
            top = order[np.flatnonzero(np.diff(i[order], prepend=-1))]  # the first of each word to be measured is what can be nearest
            rest = np.ones(len(i), bool)
            rest[top] = False
            for chosen in (top, np.flatnonzero(rest)):
                chosen = chosen[most[chosen] >= best[i[chosen]] - 1e-9]
                x, y, score = pairs.measured(i[chosen], j[chosen], np.maximum(best[i[chosen]], least))
                np.maximum.at(best, x, score)
                kept = score >= best[x]
                for p, q, s in zip(x[kept].tolist(), y[kept].tolist(), score[kept].tolist()):
                    seen(a[p], s, own[q])
    for word, (score, owner) in found.items():
        yield word, owner, score
