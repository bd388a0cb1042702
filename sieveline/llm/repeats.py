"""Removal of repeated byte strings: strings grouped by minimizer anchors, dealt out over tasks.

A longest-previous-factor array would tell for each place of the corpus the longest string there that also starts earlier; where
it reaches ``length`` bytes, those bytes are a later copy. Only whether it does matters, so neither that array nor previous or
next smaller values are computed: strings of ``length`` bytes are grouped by their bytes, and one has an earlier match if it isn't
in the smallest document of its group.

No task sees the whole corpus. Each string of ``length`` bytes has an anchor, its leftmost k-mer of least hash: equal strings
have equal k-mers at equal places. So it's enough to sort suffixes whose anchors have the same k-mer against each other:

1. k-mers of anchors, each once per portion of a task, meet in buckets of their hash; those of two documents or more are told
   to these documents. Most anchors are unique and end here.
2. For the anchors left, the bytes of all strings they stand for (one span of at most ``2 * length - k`` bytes) meet in buckets
   of the k-mer, each distinct span once per portion, and are sorted there. What is removed is told to the documents.
3. Each document unites its removed ranges.

A portion resolves its own copies itself: only the smallest document of equal k-mers or spans goes on. A passage that stands in a
third of all documents hence costs a bucket one entry per portion. A bucket is kept compressed and worked off in sets of about
``HELD`` entries, equal k-mers or windows in one set, so that a task's memory doesn't follow the bucket's size. Where it ends, though, the spans of one k-mer reach into each
document's own text and are all different. Anchors are counted per k-mer in step 1, and the windows of those with more than ``HOT``
are dealt singly, by a hash of all their bytes, so that no k-mer needs to fit into a task. Every comparison that counts is made
on bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import batches as arrow

LENGTH, KMER = 50, 20
#: Bytes looked at in one go, anchors of a portion, entries a bucket is meant to hold, windows sorted in one go.
CHUNK, PORTION, BUCKET, SORTED = 1 << 18, 1 << 20, 1 << 20, 1 << 18
#: Entries of a bucket that are unpacked in one go. The rest of it stays compressed.
HELD = 1 << 17
#: Anchors of one k-mer that may meet in one bucket, at every size; hot k-mers that may be broadcast.
HOT, SENT = 1 << 14, 1 << 22
_M = 0x9E3779B97F4A7C15
_U = np.uint64
_HALF = _U(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each run of ``size`` bytes, joined from runs of doubled lengths."""
    part, width, power = data.astype(_U) + _U(1), 1, _M
    out, done = None, 0
    while True:
        if size & width:
            out = part if out is None else out[: len(out) - width] * _U(power) + part[done:]
            done += width
        if done == size:
            return out
        part = part[:-width] * _U(power) + part[width:]
        width, power = 2 * width, power * power % (1 << 64)


def anchors(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of concatenated texts that end at ``ends``: each anchor's place, first and last window start, and k-mer hash."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),)
    if len(data) < length:
        return none
    hashes = _mix(_rolling(data, k))
    least, place = hashes, np.arange(len(hashes), dtype=np.int32)
    width, want = 1, length - k + 1
    while width < want:
        by = min(width, want - width)
        left = least[:-by] <= least[by:]
        place = np.where(left, place[:-by], place[by:])
        least = np.where(left, least[:-by], least[by:])
        width += by
    inside = np.ones(len(place), bool)
    for e in ends.tolist():
        inside[max(0, e - length + 1): e] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none
    at = place[starts]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    at = at[first].astype(np.int64)
    return at, starts[first], starts[last], hashes[at]


def _chunks(batches: Iterable[pa.RecordBatch], overlap: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches with the text as their last column, as bytes of about CHUNK size: data, ends, row in the batch, place in the
    text, batch. A longer text comes in pieces that overlap, so that each of its windows is in exactly one of them."""
    for batch in arrow.portions(batches, 1000):
        texts = batch.column(batch.num_columns - 1).to_pylist()
        held, rows, offs, size = [], [], [], 0

        def out():
            ends = np.cumsum([len(h) for h in held])
            return np.frombuffer(b"".join(held), np.uint8), ends, np.array(rows), np.array(offs, np.int64), batch

        for row, text in enumerate(texts):
            for off in range(0, max(1, len(text) - overlap), CHUNK - overlap):
                piece = text[off: off + CHUNK]
                if size and size + len(piece) > CHUNK:
                    yield out()
                    held, rows, offs, size = [], [], [], 0
                held.append(piece)
                rows.append(row)
                offs.append(off)
                size += len(piece)
        if held:
            yield out()


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length as planes of their bytes, compressed."""
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() if c.ndim == 1 else c.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(blob: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(data) // sum(np.dtype(k).itemsize * w for k, w in kinds)
    out, at = [], 0
    for kind, width in kinds:
        size = np.dtype(kind).itemsize * width * n
        part = data[at: at + size]
        out.append(part.reshape(n, width) if width > 1 else np.ascontiguousarray(part.reshape(-1, n).T).view(kind).reshape(n))
        at += size
    return out


def _gathered(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Columns of all parts, each joined by itself; ``held`` is empty afterwards."""
    columns: list = [list(c) for c in zip(*held, strict=True)]
    held.clear()
    for i, parts in enumerate(columns):
        columns[i] = np.concatenate(parts)
        parts.clear()
    return columns


def _in_order(columns: list[np.ndarray], order: np.ndarray) -> list[np.ndarray]:
    """The columns' rows in an order, one column after the other put in place of the former one."""
    for i, c in enumerate(columns):
        columns[i] = c[order]
    return columns


def _in_sets(blobs: list[bytes], kinds: tuple[tuple[str, int], ...], most: int,
             hashes: Callable[[list[np.ndarray]], np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Columns of all blobs in sets of about ``most`` entries; entries of one hash are in one set. Each set unpacks the blobs anew."""
    size = sum(np.dtype(k).itemsize * w for k, w in kinds)
    sets = -(-sum(zstandard.frame_content_size(b) for b in blobs) // (size * most))
    for t in range(sets):
        held = []
        for b in blobs:
            columns = _unpacked(b, *kinds)
            if sets > 1:
                own = np.flatnonzero(hashes(columns) % _U(sets) == t)
                columns = [c[own] for c in columns]
            held.append(tuple(columns))
            del columns
        if (columns := _gathered(held))[0].size:
            yield columns


def _dealt(bucket: np.ndarray, n: int, *columns: np.ndarray, rows: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """The columns, or these ``rows`` of them, by bucket, in their present order within each."""
    bucket = bucket.astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n + 1))
    order = order if rows is None else rows[order]
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        part = order[bounds[b]: bounds[b + 1]]
        yield b, _packed(*(c[part] for c in columns))


def _blobs(items: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for item in items:
        held.append(item)
        size += len(item[1])
        if size > 1 << 21:
            yield pa.record_batch([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], ["bucket", "data"])
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], ["bucket", "data"])


def _anyhow(turn: int) -> int:
    """A bucket below 0 for the task's result of this number: other tasks and turns have others, or all tasks' would meet in one."""
    return -1 - TaskContext.get().partitionId() - (turn << 32)


def _by_bucket(df: DataFrame, n: int, reduce: Callable[[list[bytes]], Iterator[pa.RecordBatch]],
               local: Callable[[bytes], pa.RecordBatch], schema: str,
               single: Callable[[list[bytes]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Blobs of a bucket together into ``reduce``, those of buckets from ``n`` on into ``single``; those of buckets below 0, dealt
    anyhow, one by one into ``local``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            # Blobs are views of their batch.
            for bucket, data in zip(batch.column(0).to_pylist(), (v.as_buffer() for v in batch.column(1)), strict=True):
                if bucket < 0:
                    yield local(data)
                    continue
                if bucket != at:
                    if held:
                        yield from (reduce if at < n else single)(held)
                    at, held = bucket, []
                held.append(data)
        if held:
            yield from (reduce if at < n else single)(held)

    # A partition has one bucket of each kind; dealt by their hash, some would have several and others none.
    return df.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket").mapInArrow(run, schema)


def _batch(schema: dict[str, pa.DataType], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], list(schema))


def _shared_kmers(texts: DataFrame, length: int, k: int, n: int, hot: int) -> DataFrame:
    """``doc, kmer``: anchors' k-mers of each document that at least one other document has as well; and, without a document, those
    of more than ``hot`` anchors. A k-mer is told by half of its hash: another one that shares it is asked about, or dealt singly,
    without need, in each document alike."""

    def portions(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        held, size, turn = [], 0, 0

        def out() -> Iterator[tuple[int, bytes]]:
            nonlocal turn
            columns = _gathered(held)
            h, d = _in_order(columns, np.lexsort(columns[::-1]))
            del columns
            times = np.diff(np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h)))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
            h, d = h[new], d[new]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            shared = ~first | np.concatenate([~first[1:], [False]])
            if shared.any():
                by = np.lexsort((h[shared], d[shared]))
                turn += 1
                yield _anyhow(turn), _packed(h[shared][by], d[shared][by])
            h, d = h[first], d[first]
            yield from _dealt((h >> _U(32)) * _U(n) >> _U(32), n, h, d, times)

        for data, ends, rows, _, batch in _chunks(batches, length - 1):
            at, _, _, kmer = anchors(data, ends, length, k)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[rows]
            held.append((_mix(kmer * _U(_M)), ids[np.searchsorted(ends, at, side="right")]))
            size += len(at)
            if size >= PORTION:
                yield from out()
                size = 0
        if size:
            yield from out()

    kinds = (("u8", 1), ("i8", 1))
    schema = {"doc": pa.int64(), "kmer": pa.int32()}

    def told(h: np.ndarray, d: np.ndarray | pa.Array) -> pa.RecordBatch:
        return _batch(schema, d, (h & _HALF).astype(np.uint32).view(np.int32))

    def reduce(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        for columns in _in_sets(blobs, (*kinds, ("i8", 1)), 2 * HELD, lambda c: c[0]):
            yield from met(columns)

    def met(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, d, times = _in_order(columns, np.lexsort((columns[1], columns[0])))
        begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        many = h[begins[np.add.reduceat(times, begins) > hot]]
        if len(many):
            yield told(many, pa.nulls(len(many), pa.int64()))
        sizes = np.diff(np.append(begins, len(h)))
        other = np.repeat(d[begins] != d[begins + sizes - 1], sizes)
        h, d = h[other], d[other]
        for a in range(0, len(h), 1 << 19):
            yield told(h[a: a + (1 << 19)], d[a: a + (1 << 19)])

    def local(blob: bytes) -> pa.RecordBatch:
        return told(*_unpacked(blob, *kinds))

    sent = texts.select("doc", "data").mapInArrow(lambda b: _blobs(portions(b)), "bucket bigint, data binary")
    return _by_bucket(sent, n, reduce, local, "doc bigint, kmer int")


#: How a range of windows is removed: by itself, like the windows from ``rep`` on, or all of them like the one at ``rep``.
DIRECT, MOVED, LIKE = 0, 1, 2
_RANGES = {c: pa.int64() for c in ("doc", "tag", "mode", "rep", "first", "last")}
_RANGES_SQL = ", ".join(f"{c} bigint" for c in _RANGES)


def _runs(doc: np.ndarray, tag: np.ndarray, rep: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Ranges in order, adjacent ones joined: those removed by themselves (``rep`` < 0), those moved by the same distance, and
    single windows that are all like one."""
    mode = np.where(rep < 0, DIRECT, MOVED)
    apart = np.where(rep < 0, 0, first - rep)

    def joined(key: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((columns[4], key, *columns[2::-1]))
        doc, tag, mode, rep, first, last, key = (c[order] for c in (*columns, key))
        differs = np.any([c[1:] != c[:-1] for c in (doc, tag, mode, key)], axis=0)
        begins = np.flatnonzero(np.concatenate([[True], differs | (first[1:] != last[:-1] + 1)]))
        return [doc[begins], tag[begins], mode[begins], rep[begins], first[begins], last[np.append(begins[1:], len(doc)) - 1]]

    out = joined(apart, doc, tag, mode, np.maximum(rep, 0), first, last)
    single = (out[2] == MOVED) & (out[4] == out[5])
    if not single.any():
        return out
    alone = [c[single] for c in out]
    alone = joined(alone[3], *alone)
    alone[2] = np.full(len(alone[0]), LIKE)
    return [np.concatenate([c[~single], d]) for c, d in zip(out, alone, strict=True)]


def _later_windows(spans: np.ndarray, sizes: np.ndarray, kmer: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Entry and window of those windows of distinct spans that start in an entry of a smaller document as well.

    Suffixes that begin at a window, cut at ``length`` bytes, are sorted; within a run of equal ones the first document keeps.
    """
    strings = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(spans).reshape(-1), length)
    windows = sizes.astype(np.int64) - length + 1
    order = np.argsort(kmer, kind="stable")
    ends = np.cumsum(windows[order])
    groups = np.append(np.flatnonzero(np.concatenate([[True], kmer[order][1:] != kmer[order][:-1]])), len(order))
    entries, places, g = [], [], 0
    while g < len(groups) - 1:
        to = g + 1
        base = ends[groups[g]] - windows[order[groups[g]]]
        while to < len(groups) - 1 and ends[groups[to + 1] - 1] - base <= SORTED:
            to += 1
        part = order[groups[g]: groups[to]]
        g = to
        n = windows[part]
        entry = np.repeat(part, n)
        place = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
        # A k-mer with very many spans: its windows are sorted in several sets told apart by a byte sum, equal ones in one.
        times = -(-len(entry) // (2 * SORTED))
        sums = np.zeros(len(entry), np.int64)
        if times > 1:
            sums = spans[entry, place].astype(np.int64) * 31 + spans[entry, place + length - 1] * 7 + spans[entry, place + length // 2]
        for t in range(times):
            own = np.flatnonzero(sums % times == t) if times > 1 else np.arange(len(entry))
            if not len(own):
                continue
            e, p = entry[own], place[own]
            text = np.ones((len(own), length + 1), np.uint8)
            text[:, :length] = strings[e * spans.shape[1] + p]
            keys = text.view(f"S{length + 1}").reshape(-1)
            suffixes = np.lexsort((docs[e], keys))
            keys, e, p = keys[suffixes], e[suffixes], p[suffixes]
            begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            least = np.repeat(docs[e[begins]], np.diff(np.append(begins, len(keys))))
            later = docs[e] > least
            entries.append(e[later].astype(np.int32))
            places.append(p[later].astype(np.uint8))
    return (np.concatenate(entries), np.concatenate(places)) if entries else (np.zeros(0, np.int64),) * 2


def _removed_ranges(texts: DataFrame, length: int, k: int, n: int) -> DataFrame:
    """``doc, tag, rep, first, last``: window starts of a text (``doc, tag``) that are removed, from first to last; with ``rep``
    from 0 on, windows that share the fate of those at ``rep``, where the text has the same bytes. ``texts``: ``doc, tag, kmers,
    hot, data``; windows of k-mers in ``hot`` are dealt singly."""
    widest = 2 * length - k
    window = (("u1", length), ("i8", 1), ("i8", 1), ("i8", 1))
    kinds = (("u1", widest), ("u1", 1), ("u1", 1), ("i8", 1), ("i8", 1), ("i8", 1))

    def portions(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        held, size, turn = [], 0, 0

        def out() -> Iterator[tuple[int, bytes]]:
            nonlocal turn
            columns = _gathered(held)
            span, lens, at, doc, tag, pos, kmer, hot = _in_order(columns, np.lexsort((*columns[5:2:-1], _span_hash(*columns[:2]))))
            del columns
            same = _equal_to_former(span, lens, at)
            begins = np.flatnonzero(~same)
            counts = np.diff(np.append(begins, len(doc)))
            rep, last = np.repeat(pos[begins], counts), pos + lens - length
            later_spans = doc > np.repeat(doc[begins], counts)
            # Equal spans under one document: those of its first text are told their fate by the first place, another text asks itself.
            twin = same & ~later_spans & (tag == np.repeat(tag[begins], counts))
            ranges = [c[later_spans] for c in (doc, tag, np.full(len(doc), -1), pos, last)]
            ranges = [np.concatenate(c) for c in zip(ranges, [doc[twin], tag[twin], rep[twin], pos[twin], last[twin]], strict=True)]
            if len(ranges[0]):
                turn += 1
                yield _anyhow(turn), _packed(*_runs(*ranges))
            single = np.flatnonzero(~later_spans & ~twin & hot)
            for part in _in_portions(single[np.argsort(kmer[single], kind="stable")], lens.astype(np.int64) - length + 1):
                strings, own, later = _first_windows(*_windows(span, lens, part, length), doc, tag, pos)
                if later.any():
                    turn += 1
                    yield _anyhow(turn), _packed(*_runs(own[0][later], own[1][later], np.full(later.sum(), -1), own[2][later], own[2][later]))
                strings, *own = (c[~later] for c in (strings, *own))
                yield from _dealt(_U(n) + ((_window_hash(strings) >> _U(32)) * _U(n) >> _U(32)), 2 * n, strings, *own)
            go = np.flatnonzero(~later_spans & ~twin & ~hot)
            go = go[np.lexsort((pos[go], tag[go], doc[go]))]
            yield from _dealt((kmer[go] >> _U(32)) * _U(n) >> _U(32), n, span, lens, at, doc, tag, pos, rows=go)

        for data, ends, rows, offs, batch in _chunks(batches, length - 1):
            at, first, last, kmer = anchors(data, ends, length, k)
            kmer = _mix(kmer * _U(_M))
            piece = np.searchsorted(ends, at, side="right")
            # Shared k-mers of the rows at hand, each made its own by the row's number.
            mine = np.unique(rows)

            def listed(lists: pa.ListArray, asked: np.ndarray, mine: np.ndarray = mine) -> np.ndarray:
                values, bounds = lists.values.to_numpy(zero_copy_only=False).view(np.uint32), lists.offsets.to_numpy()
                known = np.sort(np.concatenate([values[bounds[r]: bounds[r + 1]] + _U(r << 32) for r in mine.tolist()]))
                return known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked if len(known) else np.zeros(len(asked), bool)

            asked = (kmer & _HALF) + (rows[piece].astype(_U) << _U(32))
            hit = np.flatnonzero(listed(batch.column(2), asked))
            if not len(hit):
                continue
            begin, lens = first[hit], last[hit] - first[hit] + length
            strings = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(widest, np.uint8)), widest)
            span = np.where(np.arange(widest) < lens[:, None], strings[begin], np.uint8(0))
            hot = listed(batch.column(3), asked[hit])
            piece, row = piece[hit], rows[piece[hit]]
            pos = begin - (ends[piece] - np.diff(np.append(0, ends))[piece]) + offs[piece]
            doc, tag = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
            held.append((span, lens.astype(np.uint8), (at[hit] - begin).astype(np.uint8), doc, tag, pos, kmer[hit], hot))
            size += len(hit)
            if size >= PORTION // 4:
                yield from out()
                size = 0
        if size:
            yield from out()

    def reduce(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        for columns in _in_sets(blobs, kinds, HELD, lambda c: _mix(_rolling_at(c[0], c[2], k) * _U(_M))):
            yield from met(columns)

    def met(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        span, lens, at, doc, tag, pos = _in_order(columns, np.lexsort((*columns[5:2:-1], _span_hash(*columns[:2]))))
        new = ~_equal_to_former(span, lens, at)
        begins = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        later = doc > doc[begins][which]
        ranges = [[doc[later], tag[later], np.full(later.sum(), -1), pos[later], pos[later] + lens[later] - length]]
        # Distinct spans of k-mers that have more than one.
        kmer = _rolling_at(span[begins], at[begins], k)
        order = np.argsort(kmer, kind="stable")
        alone = np.concatenate([[True], kmer[order][1:] != kmer[order][:-1], [True]])
        several = np.sort(order[~(alone[:-1] & alone[1:])])
        if len(several):
            d = begins[several]
            e, w, to = _in_a_row(*_later_windows(span[d], lens[d], kmer[several], doc[d], length))
            # The same windows for each text of the span's first document.
            firsts = np.flatnonzero(~later)
            per = np.bincount(which[firsts], minlength=len(begins))
            at_first = np.cumsum(per) - per
            group = several[e]
            times = per[group]
            pick = firsts[np.repeat(at_first[group], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            ranges.append([doc[pick], tag[pick], np.full(len(pick), -1), pos[pick] + np.repeat(w, times), pos[pick] + np.repeat(to, times)])
        ranges = [np.concatenate(c) for c in zip(*ranges, strict=True)]
        if len(ranges[0]):
            yield _batch(_RANGES, *_runs(*ranges))

    def local(blob: bytes) -> pa.RecordBatch:
        return _batch(_RANGES, *_unpacked(blob, *[("i8", 1)] * len(_RANGES)))

    def single(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        for strings, doc, tag, pos in _in_sets(blobs, window, SORTED, lambda c: _window_hash(c[0])):
            _, (doc, tag, pos), later = _first_windows(strings, np.arange(len(doc)), np.zeros(len(doc), np.int64), doc, tag, pos)
            if later.any():
                yield _batch(_RANGES, *_runs(doc[later], tag[later], np.full(later.sum(), -1), pos[later], pos[later]))

    sent = texts.select("doc", "tag", "kmers", "hot", "data").mapInArrow(lambda b: _blobs(portions(b)), "bucket bigint, data binary")
    return _by_bucket(sent, n, reduce, local, _RANGES_SQL, single)


def _in_a_row(entry: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, first and last place of windows that follow each other in an entry."""
    order = np.lexsort((place, entry))
    entry, place = entry[order], place[order].astype(np.int64)
    begins = np.flatnonzero(np.append(True, (entry[1:] != entry[:-1]) | (place[1:] != place[:-1] + 1))[: len(entry)])
    return entry[begins], place[begins], place[np.append(begins[1:], len(entry))[: len(begins)] - 1]


def _equal_to_former(span: np.ndarray, lens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an entry has the span and the anchor of the one before it."""
    same = np.concatenate([[False], (lens[1:] == lens[:-1]) & (at[1:] == at[:-1])])
    for a in range(1, len(span), 1 << 14):
        part = span[a - 1: a + (1 << 14)]
        same[a: a + (1 << 14)] &= (part[1:] == part[:-1]).all(axis=1)
    return same


def _in_portions(entries: np.ndarray, windows: np.ndarray) -> Iterator[np.ndarray]:
    """Entries in order, at most SORTED windows at a time, or one entry."""
    ends = np.cumsum(windows[entries])
    a = 0
    while a < len(entries):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - windows[entries[a]] + SORTED, side="right")))
        yield entries[a:b]
        a = b


def _windows(span: np.ndarray, lens: np.ndarray, entries: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Bytes, entry and place of each window of the entries."""
    n = lens[entries].astype(np.int64) - length + 1
    entry = np.repeat(entries, n)
    place = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
    strings = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(span).reshape(-1), length)
    return strings[entry * span.shape[1] + place], entry, place


def _window_hash(strings: np.ndarray) -> np.ndarray:
    return _span_hash(strings, np.full(len(strings), strings.shape[1]))


def _first_windows(strings: np.ndarray, entry: np.ndarray, place: np.ndarray, doc: np.ndarray, tag: np.ndarray,
                   pos: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Windows with equal ones side by side: bytes; document, tag and start; whether a smaller document has the same bytes."""
    own = [doc[entry], tag[entry], pos[entry] + place]
    hashes = _window_hash(strings)
    order = np.lexsort((*own[::-1], hashes))
    differs = (strings[order][1:] != strings[order][:-1]).any(axis=1)
    if (differs & (hashes[order][1:] == hashes[order][:-1])).any():
        # Different bytes with one hash: by their bytes.
        order = np.lexsort((*own[::-1], *strings.T[::-1]))
        differs = (strings[order][1:] != strings[order][:-1]).any(axis=1)
    strings, own = strings[order], [c[order] for c in own]
    begins = np.flatnonzero(np.concatenate([[True], differs]))
    return strings, own, own[0] > np.repeat(own[0][begins], np.diff(np.append(begins, len(strings))))


def _span_hash(span: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """To bring equal spans together; whether they are equal is told by their bytes."""
    out = lens.astype(_U)
    for i in range(0, span.shape[1], 8):
        word = np.zeros((len(span), 8), np.uint8)
        word[:, : span.shape[1] - i] = span[:, i: i + 8]
        out = _mix(out * _U(_M) + word.view(_U)[:, 0])
    return out


def _rolling_at(span: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k-mer at a place of each span, hashed."""
    out = np.zeros(len(span), _U)
    rows = np.arange(len(span))
    for i in range(k):
        out = out * _U(_M) + span[rows, at.astype(np.int64) + i] + _U(1)
    return out


def _union(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges from first up to end, in order, with those that touch joined."""
    if not len(first):
        return first, end
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    begins = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    return first[begins], end[np.append(begins[1:], len(first)) - 1]


def _removed(mode: np.ndarray, rep: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges that the removed windows of one text cover, from its own and its repeated ranges."""
    own = mode == DIRECT
    a, b = _union(first[own], last[own] + 1)
    more: list[tuple[int, int]] = []
    for m, r, f, t in zip(*(c[~own].tolist() for c in (mode, rep, first, last)), strict=True):
        size = t - f + 1 if m == MOVED else 1
        i = max(0, int(np.searchsorted(a, r, side="right")) - 1)
        while i < len(a) and a[i] < r + size:
            lo, hi = max(int(a[i]), r), min(int(b[i]), r + size)
            if lo < hi:
                more.append((lo + f - r, hi + f - r) if m == MOVED else (f, t + 1))
            i += 1
    a, b = (np.concatenate([x, np.array([p[i] for p in more], np.int64)]) for i, x in enumerate((a, b)))
    return _union(a, b + length - 1)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = KMER) -> DataFrame:
    """``id_col, n_bytes, spans, kept`` per row of ``docs``: byte ranges removed (array of ``start, end``) and the bytes left.

    Removed is each byte covered by a string of ``length`` bytes that also starts in a document with a smaller id; ids are
    integers. Texts are their UTF-8 bytes, a null text is empty. Rows without an id neither lose bytes nor count as earlier;
    rows with one id are one document, so none removes from the other. Other columns are not read.
    """
    if not 8 <= k <= length <= 128:
        raise ValueError("8 <= k <= length <= 128 is needed")
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text_col, F.lit("")).alias("_text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    # Anchors are about 2 of (length - k + 2) places; more buckets than partitions are of no use, fewer leave tasks idle.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(parts, 2 * int(size) // (length - k + 2) // BUCKET + 1)
    named = source.where(F.col("doc").isNotNull() & (F.octet_length("_text") >= length))
    kmers = _shared_kmers(named.select("doc", F.col("_text").cast("binary").alias("data")), length, k, n, HOT)
    hot = kmers.where("doc IS NULL").select(F.col("kmer").alias("hot"))
    # A byte begins one anchor at most, so there are no more hot k-mers than this. If they might be too many to broadcast, they are
    # joined by a shuffle, in which Spark splits a k-mer of very many documents.
    hot = F.broadcast(hot) if int(size) // max(1, HOT) <= SENT else hot.hint("merge")
    lists = kmers.where("doc IS NOT NULL").join(hot, F.col("kmer") == F.col("hot"), "left").groupBy("doc").agg(
        F.collect_list("kmer").alias("kmers"), F.collect_list("hot").alias("hot"))
    texts = source.select("doc", F.xxhash64("_text").alias("tag"), F.col("_text").cast("binary").alias("data"))
    # Both joins read the named texts dealt by document: Spark shuffles them once.
    dealt = texts.where(F.col("doc").isNotNull())
    asked = dealt.join(lists, "doc").select("doc", "tag", "kmers", "hot", "data")
    ranges = _removed_ranges(asked, length, k, n).groupBy("doc").agg(F.collect_list(F.struct(*list(_RANGES)[1:])).alias("ranges"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in arrow.portions(batches):
            doc, tags, ranges, texts = batch.columns
            columns = [c.to_numpy(zero_copy_only=False) for c in ranges.values.flatten()]
            bounds, known = ranges.offsets.to_pylist(), ranges.is_valid().to_pylist()
            found, kept, sizes = [], [], []
            for row, (tag, text) in enumerate(zip(tags.to_pylist(), texts.to_pylist(), strict=True)):
                spans, parts, at = [], [], 0
                if known[row]:
                    tagged, *mine = (c[bounds[row]: bounds[row + 1]] for c in columns)
                    mine = [c[tagged == tag] for c in mine]
                    spans = list(zip(*(c.tolist() for c in _removed(*mine, length)), strict=True))
                for a, b in spans:
                    parts.append(text[at:a])
                    at = b
                kept.append(b"".join(parts) + text[at:] if spans else text)
                found.append([{"start": a, "end": b} for a, b in spans])
                sizes.append(len(text))
            yield pa.record_batch([doc, pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary())],
                                  ["doc", "n_bytes", "spans", "kept"])

    joined = dealt.join(ranges, "doc", "left").select("doc", "tag", "ranges", "data")
    none = F.lit(None).cast(joined.schema["ranges"].dataType).alias("ranges")
    joined = joined.unionAll(texts.where(F.col("doc").isNull()).select("doc", "tag", none, "data"))
    out = joined.mapInArrow(cut, "doc bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return out.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "spans", "kept")
