"""Removal of repeated passages with suffix arrays by induced sorting.

Texts are written in blocks of a few MB. A window of LENGTH bytes is known by the least hash of the
GRAM-byte strings in it; a stretch of windows with the same one is a segment. Equal windows have the
same least hash, so a shard that holds all segments of a hash sees all their copies:

1. Blocks send their hashes, in buckets; hashes that two documents share go back to their blocks.
   A hash under which more bytes stand than a suffix array takes is hot, as that at the end of a passage
   which many documents hold: its windows are known by the LENGTH - 1 bytes instead that they share with
   one neighbour, and those hashes are sent once more. No more than 2 bytes are then free under a hash.
2. Blocks send the segments of shared hashes to shards, equal segments once with their least id.
3. A shard takes together the equal segments of all blocks. Where a hash has several different
   segments, what none of the others can share is cut off their ends, seen from the string that has
   the hash, and equal rests are taken together again. If several rests are left, it builds their
   suffix array (`suffixes`) and common prefixes; suffixes whose common prefixes are LENGTH or more
   form a class of equal windows, whose first document is the least.
4. Blocks get back, per segment, the first document of every window, and mark what repeats.

Only bytes in arrays travel, no row per window. Segments are recomputed from a block where needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import common, suffixes

LENGTH, GRAM = 50, 16
BLOCK_BYTES = 2_000_000
#: Bytes of text per bucket of hashes and per shard of segments, and bytes of a suffix array.
BUCKET_BYTES, SHARD_BYTES, ARRAY_BYTES = 64_000_000, 32_000_000, 1_500_000

_U = np.uint64
_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = [_U(pow(_FACTOR, k, 1 << 64)) for k in (1, 2, 4, 8)]
_PIECE = 1 << 17
_NONE = np.iinfo(np.int64).max


def _packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpacked(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`block, size, ids, sizes, data`: the UTF-8 texts of `id, text` in the order of a task, in blocks of
    about `block_bytes`; longer texts alone. Written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def row():
            return pa.record_batch(
                [pa.array([(part << 32) + count], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                 pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(texts))], pa.binary())],
                names=["block", "size", "ids", "sizes", "data"],
            )

        for batch in batches:
            for part_of in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                for i, text in zip(part_of.column(0).to_pylist(), part_of.column(1).to_pylist()):
                    data = text.encode("utf-8")
                    if texts and size + len(data) > block_bytes:
                        yield row()
                        ids, texts, size, count = [], [], 0, count + 1
                    ids.append(i), texts.append(data)
                    size += len(data)
        if texts:
            yield row()

    return common.cut(docs.mapInArrow(run, "block long, size long, ids array<long>, sizes array<long>, data binary"))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every GRAM-byte string."""
    h = _TABLE[data]
    step = 1
    for power in _POWERS:  # after these, h[i] depends on the 16 bytes from i
        h = h[:-step] * power + h[step:]
        step *= 2
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    return h


def _window_hashes(data: np.ndarray) -> np.ndarray:
    """The least hash of the GRAM-byte strings of every window of LENGTH bytes."""
    out = []
    for begin in range(0, max(len(data) - LENGTH + 1, 0), _PIECE):
        h = _gram_hashes(data[begin : begin + _PIECE + LENGTH - 1])
        width = 1
        span = LENGTH - GRAM + 1
        while 2 * width <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        rest = span - width
        out.append(np.minimum(h[: len(h) - rest], h[rest:]) if rest else h)
    return np.concatenate(out) if out else np.empty(0, _U)


def _split(data: np.ndarray, least: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows with those in `hot` (sorted) split, and where each split window's string begins, else -1.

    A window is taken with the one before or after it, as the string that has its hash stands at an even or odd
    place: by the LENGTH - 1 bytes that both hold. Equal windows find the same bytes.
    """
    keys, begins = least.copy(), np.full(len(least), -1)
    if not len(hot):
        return keys, begins
    rank = np.searchsorted(hot, least)
    chosen = hot[np.minimum(rank, len(hot) - 1)] == least
    for begin in range(0, len(least), _PIECE):
        at = np.flatnonzero(chosen[begin : begin + _PIECE])
        if not len(at):
            continue
        h = _gram_hashes(data[begin : begin + _PIECE + LENGTH - 1])
        of = np.searchsorted(hot, h)
        holds = np.flatnonzero(hot[np.minimum(of, len(hot) - 1)] == h)
        places = np.sort(of[holds] * len(h) + holds)
        place = places[np.searchsorted(places, rank[begin + at] * len(h) + at)] % len(h)
        x = at + (place - at) % 2
        key = np.zeros(len(x), _U)
        for step in (0, GRAM, 2 * GRAM, LENGTH - 1 - GRAM):
            key = (key ^ h[x + step]) * _U(_FACTOR)
            key ^= key >> _U(31)
        keys[begin + at], begins[begin + at] = key, begin + x
    return keys, begins


def _shareable(texts: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of what each segment can share with others of its key; `keys` is sorted.

    Equal windows agree around the one string with the key's hash. On either side a segment shares no more than
    with its neighbours in the order of what stands there. Where a segment holds that string twice, its
    whole key is left as it is.
    """
    n, side = len(texts), LENGTH - GRAM
    sizes = np.fromiter(map(len, texts), np.int64, n)
    before, after = np.zeros((n, side), np.uint8), np.zeros((n, side), np.uint8)
    place, found = np.zeros(n, np.int64), np.zeros(n, np.int64)
    total = np.cumsum(sizes)
    for part in np.split(np.arange(n), np.flatnonzero(np.diff(total // 1_000_000)) + 1):
        data = np.frombuffer(b"".join(texts[part[0] : part[-1] + 1]) + bytes(GRAM), np.uint8)
        begins = np.cumsum(sizes[part]) - sizes[part]
        owner = np.repeat(np.arange(len(part)), sizes[part])
        at = np.flatnonzero(_gram_hashes(data)[: len(owner)] == keys[part][owner])
        at = at[at + GRAM <= (begins + sizes[part])[owner[at]]]
        found[part] = np.bincount(owner[at], minlength=len(part))
        place[part[owner[at]]] = at - begins[owner[at]]
        step = np.arange(side)
        left, right = place[part][:, None] - 1 - step, place[part][:, None] + GRAM + step
        has = left >= 0
        before[part] = np.where(has, data[np.where(has, left + begins[:, None], 0)], 0)
        has = right < sizes[part][:, None]
        after[part] = np.where(has, data[np.where(has, right + begins[:, None], 0)], 0)

    def shared(context: np.ndarray) -> np.ndarray:
        padded = np.zeros((n, (side + 7) // 8 * 8), np.uint8)
        padded[:, :side] = context
        words = padded.view(">u8")
        order = np.lexsort((*[words[:, k] for k in range(words.shape[1] - 1, -1, -1)], keys))
        agree = context[order[1:]] == context[order[:-1]]
        size = np.where(agree.all(axis=1), side, agree.argmin(axis=1))
        size[keys[order[1:]] != keys[order[:-1]]] = 0
        most = np.zeros(n, np.int64)
        most[order] = np.maximum(np.append(size, 0), np.append(0, size))
        return most

    begin = place - np.minimum(shared(before), place)
    end = place + GRAM + np.minimum(shared(after), sizes - place - GRAM)
    odd = np.isin(keys, keys[found != 1])
    return np.where(odd, 0, begin), np.where(odd, sizes, end)


class _Block:
    """A block's bytes and its segments: `start` (byte), `windows`, `key` (hash), `doc` (number in the block) and
    whether its hash is `split`, being in `hot` (sorted)."""

    def __init__(self, ids: list, sizes: list, data: bytes, hot: np.ndarray):
        self.text = zstandard.ZstdDecompressor().decompress(data)
        self.bytes = np.frombuffer(self.text, np.uint8)
        self.ids = np.array([-1 if i is None else i for i in ids], np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        least, begins = _split(self.bytes, _window_hashes(self.bytes), hot)
        valid = np.zeros(len(least) + 1, np.int64)
        usable = (self.sizes >= LENGTH) & np.array([i is not None for i in ids], bool)
        np.add.at(valid, self.begins[usable], 1)
        np.add.at(valid, self.begins[usable] + self.sizes[usable] - LENGTH + 1, -1)
        valid = np.cumsum(valid)[:-1] > 0
        # A document ends LENGTH - 1 windows before the next one starts, so no run crosses documents.
        new = np.append(True, (least[1:] != least[:-1]) | (begins[1:] != begins[:-1]) | ~valid[:-1])[: len(least)]
        self.start = np.flatnonzero(new & valid)
        ends = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)[: len(least)]) + 1
        self.windows = ends - self.start
        self.key = least[self.start]
        self.split = begins[self.start] >= 0
        self.doc = np.searchsorted(self.begins, self.start, side="right") - 1

    def digests(self) -> np.ndarray:
        """Hashes that tell segments of up to 2 * LENGTH - GRAM bytes apart; of longer ones they see so much."""
        out = []
        for part in np.split(np.arange(len(self.start)), np.flatnonzero(np.diff(self.start // _PIECE)) + 1):
            if not len(part):
                continue
            begin, last = self.start[part], self.start[part] + self.windows[part] + LENGTH - 1 - GRAM
            first = begin[0]
            h = _gram_hashes(self.bytes[first : first + _PIECE + 3 * LENGTH])
            digest = self.windows[part].astype(_U)
            for step in range(0, 2 * LENGTH - GRAM, GRAM):
                digest = (digest ^ h[np.minimum(np.minimum(begin + step, last) - first, len(h) - 1)]) * _U(_FACTOR)
                digest ^= digest >> _U(31)
            out.append(digest)
        return np.concatenate(out) if out else np.empty(0, _U)

    def distinct(self, shared: np.ndarray):
        """Segments whose key is in `shared` (sorted): their numbers, the number of the distinct segment each
        is a copy of, and the first of each distinct one."""
        at = np.searchsorted(shared, self.key)
        kept = np.flatnonzero((at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == self.key)) if len(shared) else np.empty(0, np.int64)
        found: dict[bytes, int] = {}
        begin = self.start[kept].tolist()
        end = (self.start[kept] + self.windows[kept] + LENGTH - 1).tolist()
        text = self.text
        copy = np.fromiter((found.setdefault(text[a:b], len(found)) for a, b in zip(begin, end)), np.int64, len(kept))
        first = np.full(len(found), len(kept), np.int64)
        np.minimum.at(first, copy, np.arange(len(kept)))
        return kept, copy, kept[first]


def _block_of(batch: pa.RecordBatch, row: int) -> _Block:
    column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    hot = column["hot"][row].as_py() if "hot" in column else None
    return _Block(column["ids"][row].as_py(), column["sizes"][row].as_py(), column["data"][row].as_py(),
                  np.sort(np.concatenate([np.frombuffer(k, _U) for k in hot or [b""]])))


def _send_hashes(buckets: int, split: bool):
    """Hashes of a block by bucket: whether two documents have them, and the number of different segments.
    All hashes, or those alone that were split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = _block_of(batch, r)
                digest = block.digests()
                order = np.lexsort((digest, block.key))
                if split:
                    order = order[block.split[order]]
                key, doc, digest = block.key[order], block.ids[block.doc[order]], digest[order]
                if not len(key):
                    continue
                new = np.append(True, key[1:] != key[:-1])
                begins = np.flatnonzero(new)
                twice = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins)
                count = np.add.reduceat((new | np.append(True, digest[1:] != digest[:-1])).astype(np.uint32), begins)
                key = key[begins]
                home = (key % _U(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                key, twice, count, home = key[order], twice[order], count[order].astype(np.uint32), home[order]
                used, first = np.unique(home, return_index=True)
                last = np.append(first[1:], len(home))
                yield pa.record_batch(
                    [pa.array(used.astype(np.int64)), pa.array(np.full(len(used), batch.column("block")[r].as_py(), np.int64)),
                     pa.array([np.ascontiguousarray(key[a:b]).tobytes() for a, b in zip(first, last)], pa.binary()),
                     pa.array([np.packbits(twice[a:b]).tobytes() for a, b in zip(first, last)], pa.binary()),
                     pa.array([_packed(count[a:b]) for a, b in zip(first, last)], pa.binary())],
                    names=["bucket", "block", "keys", "twice", "count"],
                )

    return run


def _shared_hashes(most: int | None):
    """Per block its hashes that two documents have; apart those with more than `most` segments, counted per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches, 1):
            yield shared_of(group)

    def shared_of(group: pa.RecordBatch) -> pa.RecordBatch:
        block = group.column(1).to_numpy()
        keys, offsets = common.lists(group.column(2), _U)
        sizes = np.diff(offsets)
        twice = np.concatenate([
            np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(group.column(3).to_pylist(), sizes)
        ]).astype(bool)
        segments = np.concatenate([_unpacked(c, np.uint32) for c in group.column(4).to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        counts = np.diff(np.append(begins, len(ordered)))
        shared, hot = np.zeros((2, len(keys)), bool)
        shared[order] = np.repeat((counts > 1) | np.maximum.reduceat(twice[order], begins), counts)
        if most is not None:
            hot[order] = np.repeat(np.add.reduceat(segments[order], begins) > most, counts)
        rows = np.flatnonzero(np.add.reduceat(shared, offsets[:-1], dtype=np.int64) > 0)

        def of(chosen: np.ndarray) -> pa.Array:
            parts = (slice(offsets[r], offsets[r + 1]) for r in rows)
            return pa.array([keys[p][chosen[p]].tobytes() for p in parts], pa.binary())

        return pa.record_batch([pa.array(block[rows]), of(shared & ~hot), of(shared & hot)], names=["block", "keys", "hot"])

    return run


def _send_segments(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = _block_of(batch, r)
                shared = np.sort(np.concatenate([np.frombuffer(k, _U) for k in batch.column("shared")[r].as_py() or [b""]]))
                kept, copy, first = block.distinct(shared)
                if not len(kept):
                    continue
                least = np.full(len(first), _NONE)
                np.minimum.at(least, copy, block.ids[block.doc[kept]])
                key, windows, start = block.key[first], block.windows[first], block.start[first]
                home = ((key >> _U(20)) % _U(shards)).astype(np.int64)
                for shard in np.unique(home).tolist():
                    own = np.flatnonzero(home == shard)
                    data = b"".join(block.text[a : a + w + LENGTH - 1] for a, w in zip(start[own].tolist(), windows[own].tolist()))
                    yield pa.record_batch(
                        [pa.array([shard], pa.int64()), batch.column("block").slice(r, 1),
                         pa.array([key[own].tobytes()], pa.binary()), pa.array([_packed(windows[own])], pa.binary()),
                         pa.array([_packed(least[own])], pa.binary()),
                         pa.array([zstandard.ZstdCompressor(level=3).compress(data)], pa.binary())],
                        names=["shard", "block", "keys", "windows", "least", "data"],
                    )

    return run


def first_documents(segments: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of `segments`, the least document of the segments that hold the same bytes, as runs:
    segment, first window, number of windows, document. By suffix array and common prefixes."""
    data = b"".join(segments)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    begins = np.cumsum(sizes + 1) - sizes - 1
    s = np.ones(len(data) + len(segments) + 1, np.int64)  # 1 ends a segment, 0 the text
    inside = np.ones(len(s), bool)
    inside[begins + sizes] = False
    inside[-1] = False
    s[inside] = np.frombuffer(data, np.uint8).astype(np.int64) + 2
    s[-1] = 0
    sa = suffixes.suffix_array(s)
    prefix = suffixes.common_prefixes(s, sa)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    document = np.append(least[owner], _NONE)
    left = np.append(begins[owner] + sizes[owner] - np.arange(len(owner)), 0)
    document[left < LENGTH] = _NONE  # no window starts here
    heads = np.flatnonzero(prefix < LENGTH)
    # Suffixes with fewer than LENGTH bytes left never share LENGTH symbols with a window: they hold the mark.
    classes = np.minimum.reduceat(document[sa], heads)
    first = np.empty(len(s), np.int64)
    first[sa] = np.repeat(classes, np.diff(np.append(heads, len(sa))))
    windows = np.flatnonzero(left >= LENGTH)
    value, seg = first[windows], owner[windows]
    new = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (seg[1:] != seg[:-1])))
    return seg[new], windows[new] - begins[seg[new]], np.diff(np.append(new, len(windows))), value[new]


def _runs_of_keys(texts: list[bytes], keys: np.ndarray, segs: np.ndarray, first: np.ndarray, width: np.ndarray,
                  array_bytes: int) -> list[tuple]:
    """Runs (segment, first window, windows, document) of the segments `segs`, sorted by key."""
    begin, end = _shareable(texts, keys)
    windows = np.maximum(end - begin - LENGTH + 1, 0)
    own = first[segs]
    cut = windows > 0
    tail = width[segs] - begin - windows
    runs = [
        (segs[~cut], np.zeros((~cut).sum(), np.int64), width[segs][~cut], own[~cut]),
        (segs[cut], np.zeros(cut.sum(), np.int64), begin[cut], own[cut]),
        (segs[cut], (begin + windows)[cut], tail[cut], own[cut]),
    ]
    rests: dict[tuple[int, bytes], int] = {}
    chosen = np.flatnonzero(cut)
    rest = np.fromiter(
        (rests.setdefault((k, texts[i][a:b]), len(rests)) for i, k, a, b in
         zip(chosen.tolist(), keys[chosen].tolist(), begin[chosen].tolist(), end[chosen].tolist())), np.int64, len(chosen),
    )
    n = len(rests)
    least = np.full(n, _NONE)
    np.minimum.at(least, rest, own[chosen])
    rest_key = np.fromiter((k for k, _ in rests), _U, n)  # sorted, as keys are
    strings = [t for _, t in rests]
    new = np.append(True, rest_key[1:] != rest_key[:-1])[:n]
    counts = np.diff(np.append(np.flatnonzero(new), n))
    single = np.repeat(counts == 1, counts)
    parts = [(np.flatnonzero(single), np.zeros(single.sum(), np.int64),
              np.fromiter((len(strings[i]) - LENGTH + 1 for i in np.flatnonzero(single).tolist()), np.int64), least[single])]
    mixed = np.flatnonzero(~single)
    if len(mixed):
        # The rests of one key stay in one suffix array; several keys share one.
        group = np.cumsum(np.fromiter((len(strings[i]) for i in mixed.tolist()), np.int64)) // array_bytes
        group = group[np.maximum.accumulate(np.where(new[mixed], np.arange(len(mixed)), 0))]
        for part in np.split(mixed, np.flatnonzero(np.diff(group)) + 1):
            seg, at, length, value = first_documents([strings[i] for i in part.tolist()], least[part])
            parts.append((part[seg], at, length, value))
    of, at, length, value = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(of, kind="stable")
    of, at, length, value = of[order], at[order], length[order], value[order]
    count = np.bincount(of, minlength=n)
    start = np.cumsum(count) - count
    c = count[rest]
    rows = np.repeat(start[rest] - np.cumsum(c) + c, c) + np.arange(c.sum())
    runs.append((np.repeat(segs[chosen], c), at[rows] + np.repeat(begin[chosen], c), length[rows], value[rows]))
    return runs


def _resolve(array_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches, 1):
            blocks_, keys, windows, least = group.column(1).to_numpy(), [], [], []
            texts: dict[bytes, int] = {}
            copies = []
            for r in range(group.num_rows):
                key = np.frombuffer(group.column(2)[r].as_py(), _U)
                w = _unpacked(group.column(3)[r].as_py(), np.int64)
                data = zstandard.ZstdDecompressor().decompress(group.column(5)[r].as_py())
                ends = np.cumsum(w + LENGTH - 1)
                cuts = zip((ends - w - LENGTH + 1).tolist(), ends.tolist())
                copies.append(np.fromiter((texts.setdefault(data[a:b], len(texts)) for a, b in cuts), np.int64, len(w)))
                keys.append(key), windows.append(w), least.append(_unpacked(group.column(4)[r].as_py(), np.int64))
            n = len(texts)
            copy = np.concatenate(copies)
            first = np.full(n, _NONE)
            np.minimum.at(first, copy, np.concatenate(least))
            key, width = np.empty(n, _U), np.empty(n, np.int64)
            key[copy], width[copy] = np.concatenate(keys), np.concatenate(windows)
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            counts = np.diff(np.append(begins, n))
            several = order[np.repeat(counts > 1, counts)]  # a segment alone under its key is one class
            alone = order[np.repeat(counts == 1, counts)]
            runs = [(alone, np.zeros(len(alone), np.int64), width[alone], first[alone])]
            listed = list(texts)
            if len(several):
                runs += _runs_of_keys([listed[i] for i in several.tolist()], key[several], several, first, width, array_bytes)
            seg, at, length, value = (np.concatenate(x) for x in zip(*runs))
            order = np.argsort(seg, kind="stable")
            order = order[length[order] > 0]
            seg, at, length, value = seg[order], at[order], length[order], value[order]
            count = np.bincount(seg, minlength=n)
            begin = np.cumsum(count) - count
            for r, own in enumerate(copies):
                c = count[own]
                rows = np.repeat(begin[own] - np.cumsum(c) + c, c) + np.arange(c.sum())
                yield pa.record_batch(
                    [pa.array(blocks_[r : r + 1]), pa.array([group.column(2)[r].as_py()], pa.binary()),
                     pa.array([_packed(c)], pa.binary()), pa.array([_packed(at[rows])], pa.binary()),
                     pa.array([_packed(length[rows])], pa.binary()), pa.array([_packed(value[rows])], pa.binary())],
                    names=["block", "keys", "count", "at", "length", "first"],
                )

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            block = _block_of(batch, r)
            answers = batch.column("answers")[r].as_py() or []
            change = np.zeros(len(block.bytes) + 1, np.int64)
            sent = np.concatenate([np.frombuffer(a["keys"], _U) for a in answers]) if answers else np.empty(0, _U)
            kept, copy, first = block.distinct(np.unique(sent))
            if len(kept):
                # A shard answers a block's distinct segments in the order in which they were sent: by first copy.
                number = np.empty(len(first), np.int64)
                counts, columns, done = [], [], 0
                home_of = {}
                for k, a in enumerate(answers):
                    for key in np.unique(np.frombuffer(a["keys"], _U)).tolist():
                        home_of[key] = k
                home = np.fromiter((home_of[k] for k in block.key[first].tolist()), np.int64, len(first))
                for k, a in enumerate(answers):
                    own = np.flatnonzero(home == k)
                    number[own] = done + np.arange(len(own))
                    done += len(own)
                    counts.append(_unpacked(a["count"], np.int64))
                    columns.append([_unpacked(a[c], np.int64) for c in ("at", "length", "first")])
                count = np.concatenate(counts)
                at, length, value = (np.concatenate(x) for x in zip(*columns))
                begin = np.cumsum(count) - count
                one = number[copy]
                c = count[one]
                rows = np.repeat(begin[one] - np.cumsum(c) + c, c) + np.arange(c.sum())
                holder = np.repeat(kept, c)
                repeated = value[rows] < block.ids[block.doc[holder]]
                a = (block.start[holder] + at[rows])[repeated]
                np.add.at(change, a, 1)
                np.add.at(change, a + length[rows][repeated] + LENGTH - 1, -1)
            gone = np.cumsum(change)[:-1] > 0
            total = np.append(0, np.cumsum(gone))
            ends = block.begins + block.sizes
            removed = total[ends] - total[block.begins]
            opens = gone & ~np.append(False, gone[:-1])[: len(gone)]
            inner = block.begins[(block.sizes > 0)]
            opens[inner] = gone[inner]  # a run ends with its document
            opened = np.append(0, np.cumsum(opens))
            spans = opened[ends] - opened[block.begins]
            kept_bytes = block.bytes[~gone].tobytes()
            left = np.append(0, np.cumsum(~gone))
            digest = [hashlib.sha256(kept_bytes[a:b]).hexdigest() for a, b in zip(left[block.begins].tolist(), left[ends].tolist())]
            yield pa.record_batch(
                [batch.column("ids")[r].values, pa.array(block.sizes), pa.array(removed), pa.array(spans), pa.array(digest, pa.string())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                    bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES,
                    array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """One row per row of `docs`: `id, n_bytes, n_removed, n_spans, kept_sha256`.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller
    id. Strings do not cross documents. A null text is empty. A document with a null id keeps all and
    removes nothing elsewhere; rows that repeat an id do not remove each other. A hash with more than
    `array_bytes` of different segments is split.
    """
    texts = common.keyed_texts(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    held = blocks(texts, block_bytes)
    total = held.agg(F.sum("size")).first()[0] or 0
    buckets, shards = 1 + total // bucket_bytes, 1 + total // shard_bytes

    def shared_of(blocks_: DataFrame, split: bool) -> DataFrame:
        hashes = blocks_.mapInArrow(
            _send_hashes(buckets, split), "bucket long, block long, keys binary, twice binary, count binary"
        )
        most = None if split else array_bytes // (2 * LENGTH - GRAM)
        return common.cut(common.hosted(hashes, ["bucket"]).mapInArrow(
            _shared_hashes(most), "block long, keys binary, hot binary"
        ))

    shared = shared_of(held, False)
    hot = shared.filter(F.length("hot") > 0).groupBy("block").agg(F.collect_list("hot").alias("hot"))
    split = not hot.isEmpty()
    if split:
        hot = common.cut(hot)
        shared = shared.union(shared_of(held.join(hot, "block"), True))
    shared = shared.groupBy("block").agg(F.collect_list("keys").alias("shared"))
    if split:
        shared = shared.join(hot, "block", "left")
    segments = held.join(shared, "block").mapInArrow(
        _send_segments(shards), "shard long, block long, keys binary, windows binary, least binary, data binary"
    )
    answers = common.hosted(segments, ["shard"]).mapInArrow(
        _resolve(array_bytes), "block long, keys binary, count binary, at binary, length binary, first binary"
    )
    answers = common.cut(answers.groupBy("block").agg(
        F.collect_list(F.struct("keys", "count", "at", "length", "first")).alias("answers")
    ))
    marked = held.join(answers, "block", "left")
    return (marked.join(hot, "block", "left") if split else marked).mapInArrow(
        _marked, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def op5_substrings(spark, sf_dir):
    return without_repeats(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
