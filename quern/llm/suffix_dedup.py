"""Removal of byte strings that documents with smaller ids hold already, by suffix arrays over shards.

A window is a string of the given length. The least hashed gram in it is its anchor: equal windows have equal anchors
at equal places, so a shard that gets all windows of an anchor can judge them. Runs of windows with one anchor are
shipped as one string. First, only hashes of anchors are exchanged, and blocks of documents learn which anchors other
documents hold too. Then each block deals its distinct strings of those, with the smallest id that has each in the
block, to shards by anchor. A shard merges equal strings and leaves aside those that differ from all others in each
stretch about the anchor that a shared window would hold; it builds the suffix array of the rest by induced sorting,
takes its permuted common prefixes, and reads off groups of suffixes that share a whole window. The smallest id of each
window goes back to the blocks that have a larger one; they compare and cut.

No step gathers the documents that hold one string: a passage that a third of all documents share reaches a shard once
per block, and the tables of anchors once per batch that is read.

Blocks and shards are sized in bytes of text, which both grow with the input's root, so that the number of strings' blobs, one
for each block and shard, grows as the input. Strings go by 64-bit hashes; where
strings of one hash become one, in a block or in a shard, their bytes are compared, so that no two different ones do.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import words as W
from quern.llm.common import bound_arrow, mix64, spans_by_bytes, text_bytes
from quern.llm.minhash import BASE, BYTE, POWERS
from quern.llm.suffix_array import _words, permuted_lcp, suffix_array

#: Text of a block of documents: so much up to PLAIN_BYTES of input, from there on growing with the input's root to at most
#: MOST_BLOCK_BYTES, so that a block still has several strings for a shard.
BLOCK_BYTES, MOST_BLOCK_BYTES, PLAIN_BYTES = 4 << 20, 32 << 20, 1 << 30
#: Text of all documents for each shard, which grows likewise. Shards get the strings of shared anchors only, which overlap.
SHARD_BYTES, MOST_SHARD_BYTES = 4 << 20, 16 << 20
#: Text of one suffix array; strings of one anchor stay together.
ARRAY_BYTES = 1 << 20
#: Text of all documents for each bucket of anchors, of which there are no more than blocks.
BUCKET_BYTES = 16 << 20
#: Text and rows whose anchors a task announces at once.
ANNOUNCE_BYTES, ROW_BITS = 32 << 20, 16
#: Bytes of text that one call of the anchor search gets, so that its arrays stay in a core's cache; a longer text is searched in overlapping pieces.
CALL_BYTES = 1 << 16
PIECE_BYTES = 1 << 20
#: Bytes of an anchor gram.
GRAM = 20
#: High bits of a gram's hash that choose the anchor; the low bits of the key hold its place.
CHOICE_BITS = 40
#: Bits of an anchor's hash that are exchanged to find shared ones. A false match only ships more strings.
SHARE_BITS = 64 - ROW_BITS
#: Places of an anchor in a window that one stretch serves.
STRETCH = 8
LAST = np.iinfo(np.int64).max
CODEC = "zstd"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob: lengths and types, then the bytes of each, plane by plane."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    whole = len(head).to_bytes(4, "little") + head + body
    return len(whole).to_bytes(8, "little") + pa.Codec(CODEC).compress(whole, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    whole = pa.Codec(CODEC).decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    size = int.from_bytes(whole[:4], "little")
    at, out = 4 + size, []
    for item in whole[4:at].decode().split(";"):
        kind, n = item.split(",")
        dtype, n = np.dtype(kind), int(n)
        planes = np.frombuffer(whole, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n) if n else np.zeros(0, dtype))
        at += n * dtype.itemsize
    return out


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums of the bytes, and the powers that shift them to a common place."""
    up, down = POWERS.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * up[:-1], out=sums[1:])
    return sums, down


def _hashes(sums: np.ndarray, down: np.ndarray, start, stop) -> np.ndarray:
    """Hashes of substrings, the same wherever they stand."""
    return mix64((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * BASE)


def _grams(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the substrings of a length, the same wherever they stand."""
    n = len(raw) - gram + 1
    if gram < 8:
        at = np.arange(n)
        return _hashes(*_sums(raw), at, at + gram)
    # eight bytes from each place on, as one number
    eight = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,)).copy()
    out, high = eight[:n] * BASE, np.empty(n, np.uint64)
    for at in range(8, gram, 8):
        out ^= np.right_shift(out, np.uint64(32), out=high)
        out += eight[min(at, gram - 8) :][:n]
        out *= BASE
    out ^= np.right_shift(out, np.uint64(29), out=high)
    out *= BASE
    out ^= np.right_shift(out, np.uint64(32), out=high)
    return out


def _anchors_of(raw: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """row, first start, last start, anchor hash and anchor's place of each run of windows that share an anchor."""
    n, gram = len(raw) - window + 1, min(GRAM, window)
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    hashed = _grams(raw, gram)
    place_bits = np.uint64(64 - CHOICE_BITS)
    mask = (np.uint64(1) << place_bits) - np.uint64(1)
    key = hashed & ~mask
    key |= np.arange(len(key), dtype=np.uint64)
    wide, have = window - gram + 1, 1
    while have < wide:  # the least key of wide places, by doubling
        step = min(have, wide - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    # runs end where the anchor changes, where a row begins, and where no window of the row begins any more
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    for edge in (offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - window + 1)):
        new[edge[edge < n]] = True
    begin = np.flatnonzero(new)
    row = np.searchsorted(offsets, begin, side="right") - 1
    ok = begin + window <= offsets[row + 1]
    last = np.append(begin[1:], n)[ok] - 1
    row, first = row[ok], begin[ok]
    at = (key[first] & mask).astype(np.int64)
    # an anchor's hash is a minimum, so it is mixed again to spread evenly
    return row, first, last, mix64(hashed[at] ^ BASE), at


def _pieces(raw: np.ndarray, offsets: np.ndarray, window: int):
    """Calls of the anchor search over rows: (row of the first offset, raw, offsets, how far the piece lies in its row)."""
    for lo, hi in spans_by_bytes(offsets, CALL_BYTES):
        o = offsets[lo : hi + 1]
        size = int(o[-1] - o[0])
        if size <= PIECE_BYTES:
            yield lo, raw[o[0] : o[-1]], o - o[0], 0
            continue
        for begin in range(0, max(1, size - window + 1), PIECE_BYTES):
            part = raw[o[0] + begin : min(o[0] + begin + PIECE_BYTES + window - 1, o[-1])]
            yield lo, part, np.array([0, len(part)]), begin


def _ids(column) -> np.ndarray:
    """Ids as numbers; null comes after all others."""
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by(keys: np.ndarray):
    """(key, places) for each distinct key."""
    if not len(keys):
        return
    order = np.argsort(keys.astype(np.uint16) if int(keys.max()) < 1 << 16 else keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    bounds = [0, *cuts.tolist(), len(keys)]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(keys[order[lo]]), order[lo:hi]


#: Rows to a bucket of anchors, and rows that a batch sends to a block directly.
TO_BUCKET, TO_BLOCK = 0, 1
ROUTED = T.StructType([T.StructField("kind", T.LongType()), T.StructField("number", T.LongType()), T.StructField("data", T.BinaryType())])
BLOBS = T.StructType([T.StructField("number", T.LongType()), T.StructField("data", T.BinaryType())])


def _steps(sorted_numbers: np.ndarray) -> np.ndarray:
    return np.diff(sorted_numbers, prepend=np.uint64(0))


def _first_of(keys: np.ndarray) -> np.ndarray:
    """True at the first of equal neighbours."""
    return np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)


def _named(raw: np.ndarray, first: np.ndarray, size: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pick and of: a run of each kind of equal bytes, and each run's place in pick. Kinds are those of hashes, or of bytes should a hash stand for several."""
    _, pick, of = np.unique(string, return_index=True, return_inverse=True)
    if (size == size[pick][of]).all() and W.equal(raw, first, first[pick][of], size).all():
        return pick, of
    known: dict[bytes, int] = {}
    kinds = [known.setdefault(raw[a : a + n].tobytes(), k) for k, (a, n) in enumerate(zip(first.tolist(), size.tolist(), strict=True))]
    return np.unique(np.array(kinds, np.int64), return_inverse=True)


def _checks(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of runs, which tells strings of one hash apart."""
    return np.array([zlib.crc32(raw[a : a + n].tobytes()) for a, n in zip(first.tolist(), size.tolist(), strict=True)], np.uint32)


def _blobs(numbers: list[int], blobs: list[bytes]):
    return pa.table([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], names=BLOBS.names)


def _announced(found: list[np.ndarray], homes: list[np.ndarray], buckets: int):
    """What some rows announce, from their anchors with the row in the low bits and the rows' blocks."""
    every, home = np.sort(np.concatenate(found)), np.concatenate(homes)
    every = every[_first_of(every)]
    anchor, block = every >> np.uint64(ROW_BITS), home[(every & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64)]
    begin = np.flatnonzero(_first_of(anchor))
    times = np.diff(np.append(begin, len(anchor)))
    out = []
    for bucket, at in _by(_bucket(anchor[begin] << np.uint64(ROW_BITS), buckets)):
        own = begin[at]
        out.append((TO_BUCKET, bucket, pack(_steps(anchor[own]), block[own].astype(np.uint32), (times[at] > 1).astype(np.uint8))))
    both = np.repeat(times > 1, times)
    anchor, block = anchor[both], block[both]
    for number, at in _by(block):
        out.append((TO_BLOCK, number, pack(_steps(np.unique(anchor[at])))))
    kind, number, data = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(number, pa.int64()), pa.array(data, pa.binary())], names=ROUTED.names)


def _announce(window: int, buckets: int):
    """Step 1, on documents as they are read: each anchor of some batches to its bucket, once, and whether two documents of
    them have it; anchors of two documents also to all their blocks."""

    def run(batches):
        found, homes, rows, size = [], [], 0, 0
        for batch in batches:
            if found and (size > ANNOUNCE_BYTES or rows + batch.num_rows > 1 << ROW_BITS):
                yield _announced(found, homes, buckets)
                found, homes, rows, size = [], [], 0, 0
            raw, offsets = text_bytes(batch.column(1))
            for row0, part, offs, _ in _pieces(raw, offsets, window):
                row, _, _, anchor, _ = _anchors_of(part, offs, window)
                if len(anchor):
                    found.append(anchor >> np.uint64(ROW_BITS) << np.uint64(ROW_BITS) | (row + (row0 + rows)).astype(np.uint64))
            homes.append(batch.column(2).to_numpy(zero_copy_only=False))
            rows, size = rows + batch.num_rows, size + len(raw)
        if found:
            yield _announced(found, homes, buckets)

    return run


def _share(key, table):
    """Step 2, a bucket of anchors: tell blocks which of their anchors two documents or more hold. Rows to a block pass."""
    if key[0].as_py() == TO_BLOCK:
        anchors = [np.cumsum(unpack(x.as_py())[0], dtype=np.uint64) for x in table.column("data")]
        return _blobs([key[1].as_py()], [pack(_steps(np.unique(np.concatenate(anchors))))])
    parts = [unpack(x.as_py()) for x in table.column("data")]
    anchor = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    block, twice = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    order = np.argsort(anchor)
    anchor, block, twice = anchor[order], block[order], twice[order]
    begin = np.flatnonzero(_first_of(anchor))
    size = np.diff(np.append(begin, len(anchor)))
    shared = np.repeat((size > 1) | np.maximum.reduceat(twice, begin).astype(bool), size)
    anchor, block = anchor[shared], block[shared]
    groups = list(_by(block))
    return _blobs([home for home, _ in groups], [pack(_steps(np.unique(anchor[at]))) for _, at in groups])


def _strings(raw: np.ndarray, offsets: np.ndarray, window: int, shared: np.ndarray | None = None):
    """row, first start, last start (in raw), anchor and string hash of the runs of windows of a block's rows, and how far the
    anchor lies from the first start; of shared anchors only, if given."""
    found = []
    for row0, part, offs, begin in _pieces(raw, offsets, window):
        row, first, last, anchor, at = _anchors_of(part, offs, window)
        if shared is not None:
            short = anchor >> np.uint64(64 - SHARE_BITS)
            ok = shared[np.minimum(np.searchsorted(shared, short), len(shared) - 1)] == short
            row, first, last, anchor, at = row[ok], first[ok], last[ok], anchor[ok], at[ok]
        if not len(row):
            continue
        string = _hashes(*_sums(part), first, last + window)
        base = offsets[row0] + begin
        found.append((row + row0, first + base, last + base, anchor, string, (at - first).astype(np.uint8)))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint8))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _least(of: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, LAST)
    np.minimum.at(out, of, ids)
    return out


def _ship(window: int, buckets: int):
    """Step 3, a block of documents and its shared anchors: the block's distinct strings of those, with their smallest ids, by shard."""

    def run(docs, flags):
        if not docs.num_rows or not flags.num_rows:
            return _blobs([], [])
        shared = np.unique(np.concatenate([np.cumsum(unpack(x.as_py())[0], dtype=np.uint64) for x in flags.column("data")]))
        raw, offsets = text_bytes(docs.column("text"))
        ids, home = _ids(docs.column("id").combine_chunks()), docs.column("block")[0].as_py()
        row, first, last, anchor, string, inner = _strings(raw, offsets, window, shared)
        pick, of = _named(raw, first, last - first + window, string)
        low = _least(of, ids[row], len(pick))
        first, inner, size = first[pick], inner[pick], last[pick] - first[pick] + window
        names, blobs = [], []
        for bucket, at in _by(_bucket(anchor[pick], buckets)):
            stop = np.cumsum(size[at])
            text = raw[np.repeat(first[at] - (stop - size[at]), size[at]) + np.arange(int(stop[-1]))]
            names.append(bucket)
            blobs.append(pack(np.full(1, home, np.int64), low[at], inner[at], size[at].astype(np.uint32), text))
        return _blobs(names, blobs)

    return run


def window_owners(text: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """For each place of a shard text, the least owner of the places whose suffixes share a whole window with it."""
    words = _words(text)
    order = suffix_array(text, words)
    common = permuted_lcp(text, order, words)[order]
    begin = np.flatnonzero(np.concatenate([[True], common[1:] < window]))
    least = np.minimum.reduceat(owner[order], begin)
    out = np.empty(len(text), owner.dtype)
    out[order] = np.repeat(least, np.diff(np.append(begin, len(order))))
    return out


def _stretches(sums: np.ndarray, down: np.ndarray, at: np.ndarray, size: np.ndarray, inner: np.ndarray, window: int) -> list[np.ndarray]:
    """For each few places that an anchor may have in a window: hashes of the bytes that all windows with it at one of them
    hold, for each string; 0 where the string has no such window.

    Strings that share a window share its anchor's place in it, and so one of these stretches."""
    wide, out = window - min(GRAM, window), []
    inner = inner.astype(np.int64)
    for lo in range(0, wide + 1, STRETCH):
        hi = min(lo + STRETCH - 1, wide)
        has = np.flatnonzero(np.maximum(lo, inner - size + window) <= np.minimum(hi, inner))
        begin = (at + inner)[has] - lo
        out.append(np.zeros(len(at), np.uint64))
        out[-1][has] = _hashes(sums, down, begin, begin + window - (hi - lo)) | np.uint64(1)
    return out


def _meet(stretches: list[np.ndarray]) -> np.ndarray:
    """Which strings have a stretch that another string has too."""
    out = np.zeros(len(stretches[0]), bool)
    for hashed in stretches:
        has = np.flatnonzero(hashed)
        _, kind, times = np.unique(hashed[has], return_inverse=True, return_counts=True)
        out[has[times[kind] > 1]] = True
    return out


def _compared(text: np.ndarray, at: np.ndarray, size: np.ndarray, owner: np.ndarray, name: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """name of the string, first place, number and smallest id of each run of windows of a string that have one smallest id."""
    # the shard text: strings, each before an end mark 1, then the sentinel 0; bytes of UTF-8 are at most 0xF7
    length = size + 1
    stop = np.cumsum(length)
    total = int(length.sum())
    shard = np.zeros(total + 1, np.uint8)
    place = np.arange(total) - np.repeat(stop - length, length)
    inner = place < np.repeat(size, length)
    source = np.repeat(at, length) + place
    shard[:-1] = np.where(inner, text[np.where(inner, source, 0)] + np.uint8(2), np.uint8(1))
    del source, inner
    owners = np.full(len(shard), LAST)
    owners[:-1] = np.repeat(owner, length)
    least = window_owners(shard, owners, window)[:-1]
    # runs of starts with one smallest id
    start = np.flatnonzero(place <= np.repeat(size, length) - window)
    which, place, least = np.repeat(name, length)[start], place[start], least[start]
    new = np.flatnonzero(_first_of(which) | _first_of(least))
    return which[new], place[new], np.diff(np.append(new, len(which))), least[new]


def _judge(window: int):
    """Step 4, a shard: the smallest ids of windows, as runs of starts of strings, to blocks whose own ids are larger."""

    def run(table):
        parts = [unpack(x.as_py()) for x in table.column("data")]
        home = np.concatenate([np.repeat(p[0], len(p[1])) for p in parts])
        low = np.concatenate([p[1] for p in parts])
        size = np.concatenate([p[3] for p in parts]).astype(np.int64)
        text = np.concatenate([p[4] for p in parts])
        hashed = []
        for _, _, inner, own, raw in parts:
            stop = np.cumsum(own, dtype=np.int64)
            sums, down = _sums(raw)
            own = own.astype(np.int64)
            at = stop - own
            hashed.append([_hashes(sums, down, at, stop), _hashes(sums, down, at + inner, at + inner + min(GRAM, window)), *_stretches(sums, down, at, own, inner, window)])
        string, gram, *stretches = (np.concatenate(x) for x in zip(*hashed, strict=True))
        del parts, table, hashed
        at = np.cumsum(size) - size
        # equal strings of all blocks become one
        pick, to = _named(text, at, size, string)
        names = string[pick]
        size, at = size[pick], at[pick]
        owner = _least(to, low, len(pick))
        # a string that meets no other needs no comparison: its windows are its own
        several = _meet([x[pick] for x in stretches])
        live = np.flatnonzero(several)
        grams = gram[pick][live]
        order = np.argsort(grams, kind="stable")
        live, grams = live[order], grams[order]
        # a suffix array for each run of anchors
        edge = np.flatnonzero(_first_of(grams))
        chunk = (np.cumsum(size[live] + 1) - 1)[edge] // ARRAY_BYTES
        cuts = [*edge[_first_of(chunk)].tolist(), len(live)]
        told = [_compared(text, at[own], size[own], owner[own], own, window) for own in (live[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True))]
        which, place, runs, least = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*told, strict=True) if told else [()] * 4))
        single = np.flatnonzero(~several)
        of = np.concatenate([which, single])
        begin = np.concatenate([place, np.zeros(len(single), np.int64)])
        count = np.concatenate([runs, size[single] - window + 1])
        value = np.concatenate([least, owner[single]])
        order = np.argsort(of, kind="stable")
        of, begin, count, value = of[order], begin[order], count[order], value[order]
        bounds = np.searchsorted(of, np.arange(len(pick) + 1))
        told = np.flatnonzero(_least(of, value, len(pick))[to] < low)
        runs = np.diff(bounds)[to[told]]
        block, string = np.repeat(home[told], runs), np.repeat(to[told], runs)
        use = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + bounds[string]
        groups = list(_by(block))
        said, of = np.unique(string, return_inverse=True)
        check = _checks(text, at[said], size[said])
        return _blobs([n for n, _ in groups], [pack(names[string[g]], begin[use[g]].astype(np.uint32), count[use[g]].astype(np.uint32), value[use[g]], check[of[g]]) for _, g in groups])

    return run


def _cover(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, blobs: list[bytes], window: int) -> np.ndarray:
    """Which bytes of a block's rows a smaller id holds: in the block, or as the shards tell."""
    change = np.zeros(len(raw) + 1, np.int32)
    row, first, last, _, string, _ = _strings(raw, offsets, window)
    pick, of = _named(raw, first, last - first + window, string)
    names, own = string[pick], ids[row]
    low = _least(of, own, len(names))
    told = [unpack(b) for b in blobs]
    key, begin, count, value, check = (np.concatenate([t[k] for t in told]) if told else np.zeros(0, np.uint64) for k in range(5))
    order = np.argsort(key, kind="stable")
    key, begin, count, value, check = key[order], begin[order].astype(np.int64), count[order].astype(np.int64), value[order].astype(np.int64), check[order]
    lo, hi = np.searchsorted(key, names, side="left"), np.searchsorted(key, names, side="right")
    runs = (hi - lo)[of]
    at = np.repeat(np.arange(len(of)), runs)
    use = np.arange(len(at)) - np.repeat(np.cumsum(runs) - runs, runs) + lo[of[at]]
    _, kind, times = np.unique(names, return_inverse=True, return_counts=True)
    alike = np.flatnonzero(times[kind] > 1)  # strings of the block that share a hash: shards told of each under it
    if len(alike):
        sums = np.zeros(len(names), np.uint32)
        sums[alike] = _checks(raw, first[pick[alike]], (last - first)[pick[alike]] + window)
        mine = (times[kind][of[at]] == 1) | (check[use] == sums[of[at]])
        at, use = at[mine], use[mine]
        runs = np.bincount(at, minlength=len(of))
    # strings that no shard told of are held in this block only
    plain = np.flatnonzero((runs == 0) & (low[of] < own))
    np.add.at(change, first[plain], 1)
    np.subtract.at(change, last[plain] + window, 1)
    held = value[use] < own[at]
    start = first[at[held]] + begin[use[held]]
    np.add.at(change, start, 1)
    np.subtract.at(change, start + count[use[held]] - 1 + window, 1)
    return np.cumsum(change[:-1]) > 0


def _finish(out_schema: list[str], window: int):
    """Step 5, a block of documents and what shards told it: cut and count."""

    def run(docs, told):
        raw, offsets = text_bytes(docs.column("text"))
        ids = _ids(docs.column("id").combine_chunks()) if docs.num_rows else np.zeros(0, np.int64)
        gone = _cover(raw, offsets, ids, [x.as_py() for x in told.column("data")], window)
        before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        rises = np.concatenate([[0], np.cumsum(gone & (~before | edge[:-1]))])
        sums = np.concatenate([[0], np.cumsum(gone)])
        kept, where = raw[~gone], offsets - sums[offsets]
        texts = [kept[a:b] for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
        columns = {"id": docs.column("id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(np.diff(sums[offsets])), "n_spans": pa.array(np.diff(rises[offsets]))}
        if "text" in out_schema:
            known = docs.column("text").is_valid().to_pylist()
            columns["text"] = pa.array([k.tobytes().decode("utf-8", "ignore") if ok else None for k, ok in zip(texts, known, strict=True)], pa.string())
        columns["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in texts], pa.string())
        return pa.table([columns[c] if c in columns else docs.column(c) for c in out_schema], names=out_schema)

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, keep: list[str] | None = None) -> DataFrame:
    """Remove each byte that a string of window bytes covers which also starts in a document with a smaller id.

    Result: id_col, n_bytes, n_removed, n_spans (maximal removed runs) long, kept_sha256 string, a row per input row.
    With keep, a list of further columns of docs, also the kept text as text_col and those columns; where a cut
    splits a character, what is left of it is dropped from the text, not from the digest.

    Strings are judged on the input and never cross documents. Null counts as the empty text and stays null in the
    text returned. A row with a null id comes after all ids; a row with the largest 64-bit id ties with it, and neither
    cuts the other. Rows that repeat an id don't count as smaller than each other either. A very long text is searched in
    overlapping pieces and makes a block larger by itself. Ids are whole numbers. Columns that aren't named aren't read.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    text = docs[text_col].cast("string")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    block_bytes, shard_bytes = (int(min(max(most, plain), max(plain, plain * (total / PLAIN_BYTES) ** 0.5))) for plain, most in ((BLOCK_BYTES, MOST_BLOCK_BYTES), (SHARD_BYTES, MOST_SHARD_BYTES)))
    blocks, shards = max(1, -(-total // block_bytes)), max(1, -(-total // shard_bytes))
    buckets = max(1, -(-total // max(block_bytes, BUCKET_BYTES)))
    more = keep or []
    extra = [docs[c].alias(f"_{i}") for i, c in enumerate(more)]
    whole = docs.select(docs[id_col].alias("id"), text.alias("text"), F.pmod(F.xxhash64(docs[id_col], text), F.lit(blocks)).cast("long").alias("block"), *extra)
    read = whole.select("id", "text", "block")
    told = read.where(F.octet_length("text") >= window).mapInArrow(_announce(window, buckets), ROUTED)
    flags = told.groupBy("kind", "number").applyInArrow(lambda key, t: _share(key, t), BLOBS)
    strings = read.groupBy("block").cogroup(flags.groupBy("number")).applyInArrow(_ship(window, shards), BLOBS)
    spans = strings.groupBy("number").applyInArrow(_judge(window), BLOBS)
    kinds = {"id": docs.schema[id_col].dataType, "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "text": T.StringType(), "kept_sha256": T.StringType()} | {f"_{i}": docs.schema[c].dataType for i, c in enumerate(more)}
    names = ["id", "n_bytes", "n_removed", "n_spans", *(["text"] if keep is not None else []), "kept_sha256", *(f"_{i}" for i in range(len(more)))]
    schema = T.StructType([T.StructField(c, kinds[c]) for c in names])
    out = (whole if more else read).groupBy("block").cogroup(spans.groupBy("number")).applyInArrow(_finish(names, window), schema)
    back = {"id": id_col, "text": text_col} | {f"_{i}": c for i, c in enumerate(more)}
    return out.select([F.col(c).alias(back.get(c, c)) for c in names])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, size_col: str = "n_chars") -> DataFrame:
    """docs, all columns, with cut texts, and their lengths in size_col where docs has it; texts cut until no word is left go.

    Texts that nothing was cut from stay as they are, null and empty ones included.
    """
    more = [c for c in docs.columns if c not in (id_col, text_col)]
    found = cut_repeats(docs, id_col, text_col, window, keep=more)
    rows = found.where((F.col("n_removed") == 0) | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    size = {c: F.when(F.col("n_removed") == 0, F.col(c)).otherwise(F.char_length(text_col)).cast(docs.schema[c].dataType).alias(c) for c in more if c == size_col}
    return rows.select(*(size.get(c, F.col(c)) for c in docs.columns))
