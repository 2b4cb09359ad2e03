"""Problem 4: complaints of evaluation splits that also occur, or nearly, in training.

Two texts overlap if an edit distance of at most ``SHARE`` times the longer
length turns one into the other, over consistent lower-case letters and digits.
The join is exact:

* A training text's prefix is ``tau + 1`` shingles that don't overlap, where tau
  bounds the edits of any pair the text is in: the choice whose shingles the
  fewest evaluation texts hold. Fewer edits than shingles leave one whole.
* Evaluation texts are indexed by all their shingles that any prefix holds.
  Both sides' postings are shuffled by shingle, each once, whatever the number
  of texts. A shingle held by many is a grid of cells, so that no task gets it all.
* The prefix cuts a text, joined at its ends, into ``m = tau + 1`` boxes. Of at
  most ``d`` edits, some box has none and every chain of ``l`` boxes from there
  on at most ``l * d / m`` (cycle lemma), so a posting also holds which characters
  are odd in number in the ``WINDOW`` places from its shingle on: an edit changes
  at most two of them. All postings of a shingle on both sides are compared as a
  matrix of windows; position and length then filter what is left.
* Where rows repeat a lot, only one row of each text gives postings; which one it
  is stands in a bit map of row ids (a few more may pass).
* Pairs that are left are filtered by the odd characters of whole texts, then
  verified with Spark's own Levenshtein distance.

Rows are brought in only at the end, so copies cost nothing before that.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm import lookalike
from labelforge.session import cut_lineage

#: Edits allowed per character of the longer text.
SHARE = 0.15
#: Longest shingle. Short texts have shorter ones, as many as they need.
SHINGLE = 4
#: Places of a posting's window.
WINDOW = 40
#: Buckets of shingles (2 to the power of) in which texts are counted: bounds what is broadcast to 16 MB.
BITS = 20
#: Postings of a shingle in one cell, of evaluation and of training texts.
CELL_EVAL, CELL_TRAIN = 50_000, 200_000
#: Postings, and pairs of postings, that a task should meet.
TASK_POSTINGS, TASK_HITS = 1_500_000, 4_000_000_000
#: Copies over which the rows of a hot text are spread.
SALTS = 16
#: Evaluation texts up to which the odd characters of all are broadcast (40 bytes each); more are shuffled.
FEW_TEXTS = 500_000
#: Pairs up to which their texts are fetched by a broadcast of their ids (16 bytes each); those of more are shuffled.
FEW_PAIRS = 200_000
#: Share of distinct texts from which on it doesn't pay to find one row of each before postings are made.
MOSTLY_NEW = 0.8
#: Bits of the map of these rows (2 to the power of), at most: 32 MB.
MARKS = 28

_BLOCK = 120  # least length of the pieces in which a long text's shingles are chosen
_CELLS = 1_000_000  # characters of a batch, padding included
_HITS = 1 << 17  # pairs of postings that are compared at once: what fits into a cache
_DENSE = 2_000  # pairs of a block of postings from which on they are compared as a matrix
_SPAN = 7  # places that postings of a block begin in (2 to the power of)
_HELD = 1_000_000  # postings that a task gathers before it sends them
_FAR = 0xFFFF  # farthest position that is told; what lies beyond passes the filters
_NEVER = np.int32(1 << 29)
_DEAREST = 1 << 21
_KEPT = 500_000  # texts a task remembers, to send each only once


def tau_of(length: np.ndarray) -> np.ndarray:
    """Most edits of any pair that a text of this length is in (the other may be longer)."""
    return np.floor(SHARE * np.floor(length / (1 - SHARE) + 1e-9) + 1e-9).astype(np.int64)


def shingle_of(length: np.ndarray) -> np.ndarray:
    """Size of the shingles of a training text, so that its prefix fits into it."""
    return np.clip(length // (tau_of(length) + 1), 1, SHINGLE)


@functools.cache
def _sizes_met(length: int) -> tuple[int, ...]:
    """Sizes of shingles of the training texts that an evaluation text may pair with."""
    least, most = max(1, int(np.ceil((1 - SHARE) * length - 1e-9))), int(length / (1 - SHARE) + 1e-9)
    return tuple(np.unique(shingle_of(np.arange(least, most + 1))).tolist())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _batches(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index, lengths and characters (padded) of texts of similar lengths."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * lengths[order[end]] <= _CELLS:
            end += 1
        own = order[at:end]
        at = end
        n = lengths[own]
        codes = np.zeros((len(own), int(n.max())), dtype=np.uint64)
        codes[np.arange(codes.shape[1])[None, :] < n[:, None]] = np.frombuffer("".join(texts[k] for k in own).encode("utf-32-le"), dtype=np.uint32)
        yield own, n, codes


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """A 32-bit hash of the shingle that starts at each place; its first BITS are its bucket."""
    h = np.full((len(codes), codes.shape[1] - size + 1), size, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[:, k : codes.shape[1] - size + 1 + k]
        h ^= h >> np.uint64(29)
    return (_mix(h) >> np.uint64(32)).astype(np.uint32)


def bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint32(32 - BITS)).astype(np.int64)


def windows(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Characters (hashed to 64) that are odd in number in the window from each place on; a text goes on at its start."""
    ring = np.arange(codes.shape[1] + WINDOW)[None, :] % lengths[:, None]
    bits = np.uint64(1) << (_mix(codes) & np.uint64(63))
    odd = np.zeros((len(codes), ring.shape[1] + 1), dtype=np.uint64)
    np.bitwise_xor.accumulate(np.take_along_axis(bits, ring, axis=1), axis=1, out=odd[:, 1:])
    width = np.minimum(WINDOW, lengths)
    ends = np.arange(codes.shape[1])[None, :] + width[:, None]
    return np.take_along_axis(odd, ends, axis=1) ^ odd[:, : codes.shape[1]]


def odd_characters(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters (hashed to 128) that are odd in number in each text."""
    h = _mix(codes + np.uint64(0x51ED27))
    bits = np.where(np.arange(codes.shape[1])[None, :] < lengths[:, None], np.uint64(1) << (h & np.uint64(63)), np.uint64(0))
    high = (h & np.uint64(64)) > 0
    return tuple(np.bitwise_xor.reduce(np.where(high == side, bits, np.uint64(0)), axis=1).view(np.int64) for side in (False, True))


def _cheapest(costs: np.ndarray, size: int, wanted: np.ndarray) -> np.ndarray:
    """For each column of ``costs``: which starts of ``wanted`` shingles that don't overlap cost least in all."""
    width, rows = costs.shape
    most = int(wanted.max())
    best = np.full((size + 1, most + 1, rows), _NEVER, dtype=np.int32)  # of the last places only
    best[:, 0] = 0
    taken = np.zeros((width + 1, most + 1, rows), dtype=bool)
    for end in range(1, width + 1):
        now, before = best[end % (size + 1)], best[(end - 1) % (size + 1)]
        if end < size:
            now[:] = before
            continue
        with_it = best[(end - size) % (size + 1)][:-1] + costs[end - size][None, :]
        np.less(with_it, before[1:], out=taken[end, 1:])
        np.minimum(before[1:], with_it, out=now[1:])
    chosen = np.zeros((width, rows), dtype=bool)
    left, cursor, every = wanted.copy(), np.full(rows, width), np.arange(rows)
    for end in range(width, size - 1, -1):
        here = cursor == end
        take = here & taken[end, left, every]
        chosen[end - size] = take
        left -= take
        cursor -= np.where(take, size, here)
    return chosen


def prefixes(keys: np.ndarray, lengths: np.ndarray, size: int, held: np.ndarray) -> np.ndarray:
    """Which shingles (a mask of ``keys``) are in each text's prefix: ``tau + 1`` that don't overlap and are held least.

    A long text is cut into blocks; every block gives its part of the shingles,
    so the work is linear in the length.
    """
    m = tau_of(lengths) + 1
    blocks = np.maximum(1, lengths // _BLOCK)
    row = np.repeat(np.arange(len(lengths)), blocks)
    k = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first, last = lengths[row] * k // blocks[row], lengths[row] * (k + 1) // blocks[row]
    wanted = m[row] * last // lengths[row] - m[row] * first // lengths[row]
    places = first[:, None] + np.arange(int((last - first).max()))[None, :]
    inside = places + size <= last[:, None]
    places = np.minimum(places, keys.shape[1] - 1)
    costs = np.where(inside, np.minimum(held[bucket(keys[row[:, None], places])], _DEAREST), _NEVER).astype(np.int32)
    mask = np.zeros(keys.shape, dtype=bool)
    b, at = np.nonzero(_cheapest(np.ascontiguousarray(costs.T), size, wanted).T)
    mask[row[b], first[b] + at] = True
    return mask


def _boxes(row: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Boxes that the window from each chosen shingle on touches; ``row, start`` in order."""
    n, big = lengths[row], np.int64(int(lengths.max()) + WINDOW + 1)
    flat = row * big + start
    from_start = np.searchsorted(flat, row * big)
    ahead = np.searchsorted(flat, flat + np.minimum(WINDOW, n)) - np.arange(len(flat))
    around = np.searchsorted(flat, row * big + np.clip(start + np.minimum(WINDOW, n) - n, 0, start)) - from_start
    return ahead + around


def _slack(lengths: np.ndarray) -> np.ndarray:
    """By how much the windows of a short text's partners may differ in length."""
    own = np.minimum(WINDOW, lengths)
    least, most = np.ceil((1 - SHARE) * lengths - 1e-9), np.floor(lengths / (1 - SHARE) + 1e-9)
    return np.maximum(own - np.minimum(WINDOW, least), np.minimum(WINDOW, most) - own).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of little-endian numbers, all lowest ones first: those that are mostly 0 compress."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplaned(data: memoryview, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, n).T).reshape(-1).view(kind)


_FIELDS = (("key", np.uint32), ("id", np.uint32), ("odd", np.uint64), ("pos", np.uint16), ("rest", np.uint16), ("boxes", np.uint8))


def _packed(eval_side: bool, part: np.ndarray, fields: dict[str, np.ndarray]) -> Iterator[tuple[int, bool, int, bytes]]:
    """Postings by partition, sorted by shingle, as compressed columns."""
    if part.max(initial=0) < 1 << 16:
        # one number to sort by
        order = np.argsort(part.astype(np.uint64) << np.uint64(48) | fields["key"].astype(np.uint64) << np.uint64(16) | fields["pos"].astype(np.uint64))
    else:
        order = np.lexsort((fields["pos"], fields["key"], part))
    part = part[order]
    ends = np.flatnonzero(np.diff(part, append=-1)) + 1
    compress = zstandard.ZstdCompressor(level=1).compress
    start = 0
    for end in ends.tolist():
        own = order[start:end]
        keys = fields["key"][own]
        data = [_planes(np.diff(keys, prepend=np.uint32(0)))] + [_planes(fields[f].astype(kind)[own]) for f, kind in _FIELDS[1:] if f in fields]
        yield int(part[start]), eval_side, end - start, compress(b"".join(data))
        start = end


def _unpacked(n: int, data: bytes) -> dict[str, np.ndarray]:
    raw, out, at = memoryview(zstandard.ZstdDecompressor().decompress(data)), {}, 0
    for f, kind in _FIELDS:
        if at < len(raw):
            width = n * np.dtype(kind).itemsize
            out[f] = _unplaned(raw[at : at + width], n, kind)
            at += width
    out["key"] = np.cumsum(out["key"], dtype=np.uint32)
    return out


class _Layout:
    """Where postings go: a shingle's cells are ``across`` parts of the training side times ``down`` parts of the evaluation side.

    ``marks`` of the evaluation and the training side: rows that give postings.
    """

    def __init__(self, held: np.ndarray, chosen: np.ndarray, least: int, marks: "tuple[_Marks | None, _Marks | None]" = (None, None)):
        self.marks = marks
        self.held = np.minimum(held, _DEAREST).astype(np.int32)
        self.down = np.where(chosen > 0, -(-held // CELL_EVAL), 0).astype(np.int32)
        self.across = (-(-chosen // CELL_TRAIN)).astype(np.int32)
        live = chosen > 0
        postings = int((held[live] * self.across[live]).sum() + (chosen[live] * self.down[live]).sum())
        self.parts = max(least, -(-postings // TASK_POSTINGS), -(-int((held[live].astype(np.float64) * chosen[live]).sum()) // TASK_HITS))

    def cells(self, keys: np.ndarray, ids: np.ndarray, eval_side: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which posting goes to which partition; one goes to several if its shingle is hot on the other side."""
        b = bucket(keys)
        copies, split = (self.across, self.down) if eval_side else (self.down, self.across)
        n = copies[b]
        which = np.repeat(np.arange(len(keys)), n)
        other = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        own = ids[which] % np.maximum(split[b[which]], 1)
        down, across = (own, other) if eval_side else (other, own)
        cell = _mix((keys[which].astype(np.uint64) << np.uint64(32)) ^ (down.astype(np.uint64) << np.uint64(16)) ^ across.astype(np.uint64))
        return which, (cell % np.uint64(self.parts)).astype(np.int64)


class _Marks:
    """Row ids in a map of 2**bits bits: ``has`` is true for each of them, and for few others."""

    def __init__(self, words: np.ndarray, values: np.ndarray, bits: int):
        self.bits, self.map = bits, np.zeros(1 << bits - 6, dtype=np.uint64)
        self.map[words] = values

    @staticmethod
    def place(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Word and bit of each id."""
        at = _mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)
        return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def has(self, ids: np.ndarray) -> np.ndarray:
        word, bit = self.place(ids, self.bits)
        return self.map[word] & bit > 0


def _marked(frames: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        word, bit = _Marks.place(frame["row_id"].to_numpy(), bits)
        yield pd.DataFrame({"word": word, "bit": bit.view(np.int64)})


def _texts(frames: Iterator[pd.DataFrame], marks: _Marks | None = None) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Ids and consistent letters and digits of the rows that have any, and are marked."""
    for frame in frames:
        frame = frame[frame["text"].notna()]
        if marks:
            frame = frame[marks.has(frame["row_id"].to_numpy())]
        norms = lookalike.letters_and_digits_of(frame["text"].tolist())
        kept = [k for k, t in enumerate(norms) if t]
        if kept:
            yield frame["row_id"].to_numpy()[kept], [norms[k] for k in kept]


def _hashes(norms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes that stand for a text."""
    raw = [t.encode() for t in norms]
    return np.array([xxhash.xxh64_intdigest(t) for t in raw], dtype=np.uint64).view(np.int64), np.array([xxhash.xxh32_intdigest(t, 7) for t in raw], dtype=np.uint32).view(np.int32)


def _first(nid: np.ndarray, seen: set[int]) -> np.ndarray:
    """Places of texts that the task has not met, each once."""
    out = []
    for k, h in enumerate(nid.tolist()):
        if h not in seen:
            if len(seen) >= _KEPT:
                seen.clear()
            seen.add(h)
            out.append(k)
    return np.array(out, dtype=np.int64)


_INFO = "row_id bigint, nid bigint, check int, fresh boolean, odd0 bigint, odd1 bigint, bucket int, n bigint"


def _described(frames: Iterator[pd.DataFrame], held: np.ndarray | None) -> Iterator[pd.DataFrame]:
    """Hashes, odd characters and length of each row, then how many texts of the task hold a shingle, or have it in their prefix if ``held`` is given."""
    total, seen = np.zeros(1 << BITS, dtype=np.int64), set()
    for ids, norms in _texts(frames):
        nid, check = _hashes(norms)
        new = np.zeros(len(norms), dtype=bool)
        new[_first(nid, seen)] = True
        odd = np.zeros((2, len(norms)), dtype=np.int64)
        for own, lengths, codes in _batches(norms):
            odd[:, own] = odd_characters(codes, lengths)
            fresh = new[own]
            for keys, mask, _ in _shingled(codes[fresh], lengths[fresh], held):
                if held is None:
                    # a text counts once for each of its shingles
                    row, _ = np.nonzero(mask)
                    pairs = np.unique(row.astype(np.int64) << BITS | bucket(keys[mask]))
                    total += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
                else:
                    total += np.bincount(bucket(keys[mask]), minlength=1 << BITS)
        yield pd.DataFrame({"row_id": ids, "nid": nid, "check": check, "fresh": new, "odd0": odd[0], "odd1": odd[1], "bucket": -1, "n": [len(t) for t in norms]})
    if len(some := np.flatnonzero(total)):
        yield pd.DataFrame({"row_id": 0, "nid": 0, "check": 0, "fresh": False, "odd0": 0, "odd1": 0, "bucket": some, "n": total[some]})


def _shingled(codes: np.ndarray, lengths: np.ndarray, held: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shingles, a mask of those to post, and which texts they are of; all that partners may ask for, or the prefixes if ``held`` is given."""
    if not len(lengths):
        return
    if held is None:
        sizes = {size for n in np.unique(lengths).tolist() for size in _sizes_met(n)}
        for size in sizes:
            own = np.flatnonzero([size <= n and size in _sizes_met(n) for n in lengths.tolist()])
            if len(own):
                keys = shingles(codes[own], size)
                yield keys, np.arange(keys.shape[1])[None, :] + size <= lengths[own][:, None], own
        return
    size_of = shingle_of(lengths)
    for size in np.unique(size_of).tolist():
        own = np.flatnonzero(size_of == size)
        keys = shingles(codes[own], size)
        yield keys, prefixes(keys, lengths[own], size, held), own


def _postings(frames: Iterator[pd.DataFrame], eval_side: bool, layout: _Layout) -> Iterator[pd.DataFrame]:
    """Packed postings of a task's texts, by partition."""
    seen: set[int] = set()
    waiting: list[tuple[np.ndarray, dict[str, np.ndarray]]] = []

    def sent() -> pd.DataFrame:
        fields = {f: np.concatenate([w[1][f] for w in waiting]) for f in waiting[0][1]}
        rows = list(_packed(eval_side, np.concatenate([w[0] for w in waiting]), fields))
        waiting.clear()
        return pd.DataFrame(rows, columns=["part", "eval", "n", "data"])

    for _, norms in _texts(frames, layout.marks[not eval_side]):
        nid, _ = _hashes(norms)
        new = _first(nid, seen)
        if not len(new):
            continue
        ids, norms = (nid[new] & 0xFFFFFFFF).astype(np.uint32), [norms[k] for k in new]
        for own, lengths, codes in _batches(norms):
            odd = windows(codes, lengths)
            for keys, mask, of in _shingled(codes, lengths, None if eval_side else layout.held):
                row, pos = np.nonzero(mask)
                fields = {"key": keys[mask], "id": ids[own[of[row]]], "odd": odd[of[row], pos], "pos": np.minimum(pos, _FAR), "rest": np.minimum(lengths[of[row]] - pos, _FAR)}
                if not eval_side:
                    fields["boxes"] = np.minimum(_boxes(row, pos, lengths[of]), 255)
                which, part = layout.cells(fields["key"], fields["id"], eval_side)
                waiting.append((part, {f: v[which] for f, v in fields.items()}))
            if sum(len(w[0]) for w in waiting) >= _HELD:
                yield sent()
    if waiting:
        yield sent()


def _runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a new value of any of the columns begins."""
    new = np.ones(len(sorted_by[0]), dtype=bool)
    new[1:] = functools.reduce(np.logical_or, (x[1:] != x[:-1] for x in sorted_by))
    return new


def _spread(first: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``i`` and each of ``first[i]`` and the ``n[i] - 1`` numbers that follow, about ``_HITS`` at once."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        done = ends[at] - n[at]
        to = max(at + 1, int(np.searchsorted(ends, done + _HITS, "right")))
        own = n[at:to]
        yield np.repeat(np.arange(at, to), own), np.repeat(first[at:to] - (ends[at:to] - own - done), own) + np.arange(int(own.sum()))
        at = to


class _Index:
    """Postings of evaluation texts, by shingle and position."""

    def __init__(self, rows: list[dict[str, np.ndarray]]):
        fields = {f: np.concatenate([r[f] for r in rows]) for f in rows[0]}
        where = fields["key"].astype(np.uint64) << np.uint64(16) | fields["pos"]
        order = np.lexsort((fields["id"], where))
        # tasks that met the same text sent the same postings
        order = order[_runs(where[order], *(fields[f][order] for f in ("id", "odd", "rest")))]
        self.where, self.id, self.odd, self.pos, self.rest = where[order], fields["id"][order], fields["odd"][order], fields["pos"][order].astype(np.int64), fields["rest"][order].astype(np.int64)

    def probe(self, t: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        """Pairs (training id, evaluation id, as one number) that pass all filters of their postings."""
        where = t["key"].astype(np.uint64) << np.uint64(16) | t["pos"]
        order = np.argsort(where)
        where, t = where[order], {f: x[order] for f, x in t.items()}
        pos, rest, boxes = (t[f].astype(np.int64) for f in ("pos", "rest", "boxes"))
        n = pos + rest
        m = tau_of(n) + 1
        told = (pos < _FAR) & (rest < _FAR) & (boxes < 255)
        slack = _slack(n)
        most = np.where(told, 2 * (boxes * (m - 1) // m) + slack, 64).astype(np.uint8)
        key = where & ~np.uint64(_FAR)
        least, last = key | np.where(told, np.maximum(pos - m + 1, 0), 0).astype(np.uint64), key | np.where(told, np.minimum(pos + m - 1, _FAR), _FAR).astype(np.uint64)

        def close(p: np.ndarray, v: np.ndarray) -> np.ndarray:
            # for those left: the edits that this very pair may have
            edits = np.floor(SHARE * np.maximum(n[p], self.pos[v] + self.rest[v]) + 1e-9).astype(np.int64)
            near = np.abs(pos[p] - self.pos[v]) + np.abs(rest[p] - self.rest[v]) <= edits
            near &= np.bitwise_count(self.odd[v] ^ t["odd"][p]) <= 2 * (boxes[p] * edits // m[p]) + slack[p]
            near |= ~told[p] | (self.pos[v] >= _FAR) | (self.rest[v] >= _FAR)
            return np.unique(t["id"][p[near]].astype(np.uint64) << np.uint64(32) | self.id[v[near]])

        # a block: postings of a shingle that begin in the same span of places
        start = np.flatnonzero(_runs(where >> np.uint64(_SPAN)))
        size = np.diff(start, append=len(n))
        first = np.searchsorted(self.where, np.minimum.reduceat(least, start), "left")
        found = np.searchsorted(self.where, np.maximum.reduceat(last, start), "right") - first
        dense = size * found >= _DENSE
        held, waiting = 0, []
        for begin, end, a, wide in zip(*(x[dense].tolist() for x in (start, start + size, first, found)), strict=True):
            rows, theirs = max(1, _HITS // wide), self.odd[None, a : a + wide]
            for r in range(begin, end, rows):
                some = slice(r, min(end, r + rows))
                hit = np.flatnonzero(np.bitwise_count(t["odd"][some, None] ^ theirs) <= most[some, None])
                if len(hit):
                    p, v = np.divmod(hit, wide)
                    waiting.append((p + r, v + a))
                    held += len(hit)
                if held >= _HITS:
                    yield close(*map(np.concatenate, zip(*waiting)))
                    held, waiting = 0, []
        if waiting:
            yield close(*map(np.concatenate, zip(*waiting)))
        rare = np.flatnonzero(np.repeat(~dense & (found > 0), size))
        first = np.searchsorted(self.where, least[rare], "left")
        found = np.searchsorted(self.where, last[rare], "right") - first
        for i, v in _spread(first, found):
            p = rare[i]
            hit = np.flatnonzero(np.bitwise_count(self.odd[v] ^ t["odd"][p]) <= most[p])
            yield close(p[hit], v[hit])


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's rows come by partition, the evaluation side first; it is indexed, the rest probes, many at once."""
    part, head, index, waiting = -1, [], None, []

    def met() -> Iterator[pd.DataFrame]:
        if not waiting:
            return
        probes = {f: np.concatenate([w[f] for w in waiting]) for f in waiting[0]}
        waiting.clear()
        found, held = [], 0
        for pairs in index.probe(probes):
            found.append(pairs)
            held += len(pairs)
            if held >= _HELD:
                yield pd.DataFrame({"pair": np.unique(np.concatenate(found)).view(np.int64)})
                found, held = [], 0
        if found:
            yield pd.DataFrame({"pair": np.unique(np.concatenate(found)).view(np.int64)})

    for frame in frames:
        for row in frame.itertuples(index=False):
            if row.part != part:
                yield from met()
                part, head, index = row.part, [], None
            if row.eval:
                head.append(_unpacked(row.n, row.data))
            elif head:
                index = index or _Index(head)
                waiting.append(_unpacked(row.n, row.data))
                if sum(len(w["key"]) for w in waiting) >= _HELD:
                    yield from met()
    yield from met()


def _counts(info: DataFrame) -> np.ndarray:
    """Texts by bucket; at most 2**BITS rows whatever the input."""
    rows = info.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, dtype=np.int64)
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def _short(nid: Column) -> Column:
    """The part of a text's hash that postings hold; several texts may share it."""
    return nid.bitwiseAND(F.lit(0xFFFFFFFF))


def _once(info: DataFrame) -> tuple[_Marks | None, float, int]:
    """The rows that give postings if texts repeat a lot, the share of such rows among those of ``info`` that are a task's first, and about how many texts there are."""
    fresh = info.where("fresh")
    n, texts = fresh.agg(F.count("*"), F.approx_count_distinct("nid", 0.02)).first()
    if texts >= MOSTLY_NEW * n:
        return None, 1.0, n
    bits = min(MARKS, max(10, (16 * texts).bit_length()))
    words = fresh.groupBy("nid").agg(F.min("row_id").alias("row_id")).mapInPandas(lambda frames: _marked(frames, bits), "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    return _Marks(words["word"].to_numpy(dtype=np.int64), words["bit"].to_numpy(dtype=np.int64).view(np.uint64), bits), texts / n, texts


def _scaled(counts: np.ndarray, share: float) -> np.ndarray:
    return np.ceil(counts * share).astype(np.int64)


def candidates(train: DataFrame, valid: DataFrame, layout) -> DataFrame:
    """``t, v``: hashes of training and evaluation texts that pass all filters."""
    packed = "part int, eval boolean, n int, data binary"
    sides = [rows.mapInPandas(lambda frames, own=own: _postings(frames, own, layout.value), packed) for rows, own in ((valid, True), (train, False))]
    spread = sides[0].union(sides[1]).repartitionById(layout.value.parts, "part").sortWithinPartitions("part", F.desc("eval"))
    pairs = spread.mapInPandas(_joined, "pair bigint")
    # partitioned as the join that follows needs it, so pairs are shuffled once
    return pairs.select(_short(F.shiftright("pair", 32)).alias("t_id"), _short(F.col("pair")).alias("v_id")).repartition("t_id").distinct()


def _named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, norms in _texts(frames):
        nid, check = _hashes(norms)
        yield pd.DataFrame({"nid": nid, "check": check, "norm": norms})


def near_texts(train: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs ``t, t_check, v, v_check`` of hashes of texts within the distance, and ``row_id, nid, check`` of either side's rows.

    The sides have ``row_id, text``. Null texts and texts without a letter or
    digit have no row; equal texts are a pair.
    """
    spark = train.sparkSession
    valid_info = cut_lineage(valid.mapInPandas(lambda frames: _described(frames, None), _INFO))
    valid_marks, valid_share, valid_texts = _once(valid_info)
    held = spark.sparkContext.broadcast(_scaled(_counts(valid_info), valid_share))
    train_info = cut_lineage(train.mapInPandas(lambda frames: _described(frames, held.value), _INFO))
    train_marks, train_share, _ = _once(train_info)
    layout = spark.sparkContext.broadcast(_Layout(held.value, _scaled(_counts(train_info), train_share), int(spark.conf.get("spark.sql.shuffle.partitions")), (valid_marks, train_marks)))
    sides = {"t": (train, train_info.where("bucket < 0")), "v": (valid, valid_info.where("bucket < 0"))}

    found = candidates(train, valid, layout)
    for x, (_, info) in sides.items():
        # a task's first sight of a text only, so that a hot one is a row of each task
        texts = info.where("fresh").select(_short(F.col("nid")).alias(f"{x}_id"), F.col("nid").alias(x), F.col("odd0").alias(f"{x}0"), F.col("odd1").alias(f"{x}1"), F.col("n").alias(f"{x}n"))
        if x == "v" and valid_texts <= FEW_TEXTS:
            texts = F.broadcast(texts.distinct())
        else:
            texts = texts.repartition(f"{x}_id").distinct()
        found = found.join(texts, f"{x}_id").drop(f"{x}_id")
    odd = F.bit_count(F.col("t0").bitwiseXOR(F.col("v0"))) + F.bit_count(F.col("t1").bitwiseXOR(F.col("v1")))
    most = F.floor(SHARE * F.greatest("tn", "vn") + 1e-9)
    # an edit changes at most two characters' oddness
    close = cut_lineage(found.where(odd <= 2 * most).select("t", "v"))
    few = close.count() <= FEW_PAIRS
    small = F.broadcast if few else lambda df: df

    pairs = close
    for x, (rows, info) in sides.items():
        wanted = small(close.select(F.col(x).alias("nid")).distinct())
        some = info.join(wanted, "nid", "left_semi").groupBy("nid", "check").agg(F.min("row_id").alias("row_id"))
        named = rows.join(small(some.select("row_id")), "row_id", "left_semi").mapInPandas(_named, "nid bigint, check int, norm string").distinct()
        pairs = pairs.join(named.toDF(x, f"{x}_check", f"{x}_norm"), x)
    most = F.floor(SHARE * F.greatest(F.length("t_norm"), F.length("v_norm")) + 1e-9)
    near = pairs.where(F.levenshtein("t_norm", "v_norm") <= most).select("t", "t_check", "v", "v_check")
    return near, *(info.select("row_id", "nid", "check") for _, info in sides.values())


def overlaps(train: DataFrame, valid: DataFrame, column: str = "input", id_col: str = "row_id") -> DataFrame:
    """``train_row_id, valid_row_id`` of all overlapping rows, copies included.

    Null texts, texts without a letter or digit and rows without an id never
    overlap. Other columns don't matter; repeated rows give repeated pairs.
    """
    near, t_rows, v_rows = near_texts(*(rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("row_id"), F.col(column).alias("text")) for rows in (train, valid)))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    side = lambda rows, x: rows.select(F.col("nid").alias(x), F.col("check").alias(f"{x}_check"), F.col("row_id").alias(f"{x}_row"), F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).alias("salt"))
    left = near.select("*", salts).join(side(t_rows, "t"), ["t", "t_check", "salt"]).select("t_row", "v", "v_check", salts)
    return left.join(side(v_rows, "v"), ["v", "v_check", "salt"]).select(F.col("t_row").alias("train_row_id"), F.col("v_row").alias("valid_row_id"))


def report(pairs: DataFrame, valid: DataFrame) -> DataFrame:
    """Pairs, evaluation rows in pairs, and evaluation rows per split and source."""
    per_row = pairs.groupBy(F.col("valid_row_id").alias("row_id")).agg(F.count("*").alias("links"))
    rows = valid.select("row_id", "split_name", "source").join(per_row, "row_id", "left")
    return rows.groupBy("split_name", "source").agg(F.count("*").alias("rows"), F.count("links").alias("overlapping_rows"), F.coalesce(F.sum("links"), F.lit(0)).alias("pairs"))
