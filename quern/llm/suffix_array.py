"""Suffix arrays by induced sorting, and permuted common prefixes, as array operations.

Suffixes are classified as larger or smaller than their right neighbour. Leftmost-smaller substrings are sorted by a
first induction and named; the string of names is sorted by the same steps, recursively, until no name repeats; a second
induction places every suffix. Bytes are induced bucket by bucket, names by sorts of their runs. Common
prefixes are computed where they can't be derived from the text position before, and derived elsewhere.
"""

from __future__ import annotations

import numpy as np


def smaller(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one. The last symbol is a sentinel, smaller than all others."""
    n = len(text)
    out = np.zeros(n, bool)
    out[-1] = True
    if n > 1:
        known = np.append(text[:-1] != text[1:], True)
        out[:-1] = text[:-1] < text[1:]
        # an equal pair has the type of the next position where the type is known
        at = np.where(known, np.arange(n), n - 1)
        out = out[np.minimum.accumulate(at[::-1])[::-1]]
    return out


def _spread(found: list[np.ndarray], text: np.ndarray, slots: list[list[np.ndarray]]) -> None:
    """Append suffixes, in order, to the slots of their first symbols."""
    every = np.concatenate(found) if len(found) > 1 else found[0]
    if not len(every):
        return
    first = text[every]
    order = np.argsort(first, kind="stable")
    every, first = every[order], first[order]
    cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
    for part, symbol in zip(np.split(every, cuts), first[np.concatenate([[0], cuts])].tolist(), strict=True):
        slots[symbol].append(part)


def _pass(text: np.ndarray, wanted: np.ndarray, symbols, seeds: list[np.ndarray], n: int) -> list[np.ndarray]:
    """One induction: visit buckets in an order of symbols; what stands in a bucket places its left neighbours of the wanted type.

    seeds are the suffixes of the other type in a bucket, in order of the visit. Returns the placed ones per bucket.
    """
    slots: list[list[np.ndarray]] = [[] for _ in range(n)]
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * n
    for c in symbols:
        wave = np.concatenate(slots[c]) if slots[c] else np.zeros(0, np.int32)
        slots[c] = []
        own, found = [], []
        while len(wave):
            own.append(wave)
            left = wave[wave > 0] - 1
            left = left[wanted[left]]
            here = text[left] == c  # a run of one symbol stays in its bucket
            found.append(left[~here])
            wave = left[here]
        if own:
            out[c] = np.concatenate(own)
        seed = seeds[c]
        if len(seed):
            left = seed[seed > 0] - 1
            found.append(left[wanted[left]])
        if found:
            _spread(found, text, slots)
    return out


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones in order."""
    none = np.zeros(0, np.int32)
    seeds = [none] * size
    first = text[lms]
    order = np.argsort(first, kind="stable")
    cuts = np.searchsorted(first[order], np.arange(size + 1))
    for c in range(size):
        seeds[c] = lms[order[cuts[c] : cuts[c + 1]]]
    large = _pass(text, ~small, range(size), seeds, size)
    placed = _pass(text, small, range(size - 1, -1, -1), [x[::-1] for x in large], size)
    parts: list[np.ndarray] = []
    for c in range(size):
        parts += [large[c], placed[c][::-1]]
    out = np.concatenate(parts)
    # the sentinel has no right neighbour that could place it; it comes first
    return np.concatenate([np.array([len(text) - 1], np.int32), out]) if len(out) < len(text) else out


def _told_apart(rank: np.ndarray, alike: np.ndarray) -> None:
    """Give each of the places that share a rank one of its own, by the ranks of the places that follow, twice as far each round.

    Every run of such places ends at one whose rank is its own already, so what isn't told apart yet lies within a run."""
    reach = 1
    while len(alike):
        old = rank[alike]
        ahead = rank[alike + reach]
        order = np.argsort(old * len(rank) + ahead)
        alike, old, ahead = alike[order], old[order], ahead[order]
        place = np.arange(len(alike))
        first = np.concatenate([[True], old[1:] != old[:-1]])
        new = first.copy()
        new[1:] |= ahead[1:] != ahead[:-1]
        begin = np.maximum.accumulate(np.where(new, place, 0))
        rank[alike] = old + begin - np.maximum.accumulate(np.where(first, place, 0))
        alone = new & np.append(new[1:], True)
        alike, reach = alike[~alone], 2 * reach


def _induce_names(text: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The same for a string of names, whose buckets are too many and too small to be visited one by one: larger suffixes
    of a bucket go by the run that leads each to a leftmost-smaller one, and smaller ones by the run to a larger one."""
    many = np.bincount(text, minlength=size)
    start = np.cumsum(many) - many
    seeds = lms[np.argsort(text[lms], kind="stable")]
    first = text[seeds]
    per = np.bincount(first, minlength=size)
    larger = np.flatnonzero(~small)
    larges = np.bincount(text[larger], minlength=size)
    rank = np.full(len(text), -1, np.int64)
    rank[seeds] = (start + larges - np.cumsum(per) + per)[first] + np.arange(len(seeds))
    rank[larger] = start[text[larger]]
    _told_apart(rank, larger[larges[text[larger]] > 1])
    smalls = np.flatnonzero(small)
    rank[smalls] = (start + larges)[text[smalls]]
    _told_apart(rank, smalls[(many - larges)[text[smalls]] > 1])
    out = np.empty(len(text), np.int64)
    out[rank] = np.arange(len(text))
    return out


def _alike(text: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether pairs of substrings of equal lengths, which overlap little, are the same."""
    if not len(a):
        return np.zeros(0, bool)
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    return np.logical_and.reduceat(text[np.repeat(a, lengths) + within] == text[np.repeat(b, lengths) + within], first)


def _sort(text: np.ndarray, size: int, induce, same) -> np.ndarray:
    """The suffixes in order: leftmost-smaller substrings are sorted by an induction and named, the string of names is
    sorted in the same way where a name repeats, and a second induction places every suffix."""
    n = len(text)
    small = smaller(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    sorted_once = induce(text, small, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = sorted_once[is_lms[sorted_once]]
    # names: equal substrings, from one leftmost-smaller place to the next, share one
    stop = np.zeros(n, np.int64)
    stop[lms] = np.append(lms[1:], n - 1) - lms + 1
    length = stop[by_substring]
    equal = np.zeros(len(by_substring), bool)
    pair = np.flatnonzero(length[1:] == length[:-1]) + 1
    equal[pair] = same(text, by_substring[pair - 1], by_substring[pair], length[pair])
    if not equal.any():
        return induce(text, small, by_substring, size)
    name = np.zeros(n, np.int64)
    name[by_substring] = np.cumsum(~equal) - 1
    names = name[lms]
    return induce(text, small, lms[_sort(names, int(names.max()) + 1, _induce_names, _alike)], size)


def _words(text: np.ndarray) -> np.ndarray:
    """Eight symbols from each place on, as one number, first symbol highest."""
    out = np.zeros(len(text), np.uint64)
    padded = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.uint64)
    for k in range(8):
        out |= padded[k : k + len(text)] << np.uint64(56 - 8 * k)
    return out


def _same(text: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether pairs of substrings of equal lengths are the same."""
    ok = np.ones(len(a), bool)
    live, at = np.arange(len(a)), 0
    while len(live):
        x, y, left = words[a[live] + at], words[b[live] + at], lengths[live] - at
        drop = (np.maximum(0, 8 - left) * 8).astype(np.uint64)
        cut = drop < 64
        differ = (x >> np.minimum(drop, np.uint64(63))) != (y >> np.minimum(drop, np.uint64(63)))
        ok[live[differ & cut]] = False
        at += 8
        live = live[(left > 8) & ~(differ & cut)]
    return ok


def suffix_array(text: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of a uint8 string in order; its last symbol must be 0 and stand nowhere else."""
    if len(text) <= 1:
        return np.zeros(len(text), np.int32)
    words = _words(text) if words is None else words
    return _sort(text, int(text.max()) + 1, _induce, lambda t, a, b, lengths: _same(t, words, a, b, lengths))


def permuted_lcp(text: np.ndarray, order: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """For each place, the length that its suffix shares with the suffix before it in order.

    A place whose left neighbour equals that of its predecessor shares one symbol less than the place to its left
    does; only the other, irreducible places are compared, eight symbols at a time.
    """
    n = len(text)
    words = _words(text) if words is None else words
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    irreducible = np.ones(n, bool)
    i = np.flatnonzero(before[1:] > 0) + 1
    irreducible[i] = text[i - 1] != text[before[i] - 1]
    at = np.flatnonzero(irreducible)
    length = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] >= 0)
    step = 0
    while len(live):
        a, b = at[live] + step, before[at[live]] + step
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        end = differ != 0
        # leading equal symbols of a word, from the place of its highest bit that differs
        high = np.zeros(int(end.sum()), np.int64)
        d = differ[end]
        for bit in (32, 16, 8):
            big = d >= np.uint64(1) << np.uint64(bit)
            high += np.where(big, bit, 0)
            d = np.where(big, d >> np.uint64(bit), d)
        length[live[end]] = step + 7 - high // 8
        live = live[~end]
        step += 8
    last = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    full = np.zeros(n, np.int64)
    full[at] = length
    return full[last] - (np.arange(n) - last)
