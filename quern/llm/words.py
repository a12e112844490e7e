"""Runs of bytes (words, lines) as numbers: hashes that structure in the bytes doesn't break, and exact names."""

from __future__ import annotations

import numpy as np
import xxhash

from quern.llm.common import mix64

#: Runs above so many bytes are hashed one by one.
LONG_BYTES = 128
#: Bytes that batches need behind their last one, so that eight can be loaded anywhere.
SLACK = 8
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
#: Masks of the lowest 0 to 8 bytes.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of marked bytes begin and end; rows, which begin at offsets, cut them."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(SLACK, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(raw) + 1,), (1,))


def hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run: its eights are mixed in one after another, which isn't linear in any of them."""
    if not len(first):
        return np.zeros(0, np.uint64)
    eights, length = _eights(raw), last - first
    out = mix64(length.astype(np.uint64) * _ODD)
    live, at = np.flatnonzero(length <= LONG_BYTES), 0
    while len(live):
        left = length[live] - at
        out[live] = mix64((out[live] + (eights[first[live] + at] & _LOW[np.minimum(left, 8)])) * _STEP ^ _ODD)
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(length > LONG_BYTES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[first[i] : last[i]].tobytes(), 7)
    return out


def equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether pairs of runs of one length each, that begin at a and b, have the same bytes."""
    ok = np.ones(len(a), bool)
    eights = _eights(raw)
    live, at = np.flatnonzero((a != b) & (length > 0)), 0
    while len(live):
        left = length[live] - at
        differ = ((eights[a[live] + at] ^ eights[b[live] + at]) & _LOW[np.minimum(left, 8)]) != 0
        ok[live[differ]] = False
        at += 8
        live = live[~differ & (left > 8)]
    return ok


def names(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pick and which: a run of each kind of equal bytes, and the place in pick of each run's kind.

    Kinds are those of hashes; each run's bytes are compared with those of its kind's, and should a kind hold different
    bytes, all runs are named by their bytes.
    """
    _, pick, which = np.unique(hashes(raw, first, last), return_index=True, return_inverse=True)
    length = last - first
    same = length == length[pick][which]
    if same.all() and equal(raw, first, first[pick][which], length).all():
        return pick, which
    known: dict[bytes, int] = {}
    pick, which = [], np.zeros(len(first), np.int64)
    for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        k = known.setdefault(raw[a:b].tobytes(), len(known))
        if k == len(pick):
            pick.append(i)
        which[i] = k
    return np.array(pick, np.int64), which
