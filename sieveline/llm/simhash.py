"""Near-duplicates by SimHash: a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most k of them agree in at least 8 - k of their 8 bytes. Postings are kept for
sets of 8 - k byte positions at once, that is for the intersections of that many (position, byte) lists: a pair reaches the
guaranteed number of shared positional bytes exactly if some posting holds both. Inside a posting shared bytes are
tallied, pairs below the minimum left, and the rest verified by counting bits. A posting whose 5 bytes are given has at
most 2^24 different members, so none is unbounded, and equal fingerprints are one member from the start.

What leaves a posting is a spanning forest of its links, not its pairs. A link is told only by the first position set that
shows it; a set that leaves one out relies on that earlier set, where both ends are members and so are connected as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.batches import portions
from sieveline.llm.components import components
from sieveline.llm.storage import written

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Hashes whose bits are counted at a time.
TALLIED = 1 << 15
#: Members of a posting up to which each is compared with all others not yet reached; beyond, differing bits are enumerated.
COMPARED = 1 << 13
#: A fingerprint that one of so many rows has is joined to its rows where they are.
HOT = 2000


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, with repeats; no word gives 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    digest, starts, ends = xxhash.xxh64_intdigest, starts[:n].tolist(), ends[size - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, TALLIED):
        hashes = np.array([digest(data[a:b], seed) for a, b in zip(starts[at:at + TALLIED], ends[at:at + TALLIED], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``id_col, fp`` (a signed long) per row of ``docs``; null texts have no words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            fps = np.array([fingerprint(t, size, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def position_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of 8 - max_bits byte positions, in the order in which they may tell a link."""
    return list(combinations(range(8), 8 - max_bits))


def masks(max_bits: int) -> np.ndarray:
    return np.array([sum(0xFF << 8 * p for p in s) for s in position_sets(max_bits)], np.uint64)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Of the exclusive or of two fingerprints: bytes that are equal at their position."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1, dtype=np.int8)


def linked(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification."""
    ok = shared_bytes(x) >= 8 - max_bits
    ok[ok] = np.bitwise_count(x[ok]) <= max_bits
    return ok


def forest(members: np.ndarray, max_bits: int, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among the distinct ``members`` of one posting, as pairs of arrays."""
    if len(members) <= COMPARED:
        left = members
        while len(left) > 1:
            wave, left = left[:1], left[1:]
            while len(wave) and len(left):
                node, wave = wave[0], wave[1:]
                near = linked(left ^ node, max_bits)
                if near.any():
                    reached, left = left[near], left[~near]
                    yield np.full(len(reached), node), reached
                    wave = np.concatenate([wave, reached])
        return
    free = [b for b in range(64) if not mask >> b & 1]
    flips = np.array([sum(1 << b for b in c) for k in range(1, max_bits + 1) for c in combinations(free, k)], np.uint64)
    left = np.sort(members)
    reached = np.zeros(len(left), bool)
    for i in range(len(left)):
        if reached[i]:
            continue
        reached[i], wave = True, [i]
        while wave:
            node = left[wave.pop()]
            want = node ^ flips
            at = np.minimum(np.searchsorted(left, want), len(left) - 1)
            at = at[left[at] == want]
            at = at[~reached[at]]
            if len(at):
                reached[at] = True
                yield np.full(len(at), node), left[at]
                wave += at.tolist()


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints (column ``fp``) that connect all that differ in ``max_bits`` bits or fewer."""
    if not 0 < max_bits < 8:
        raise ValueError("max_bits has to be from 1 to 7")
    all_masks = masks(max_bits)
    postings = F.array(*[F.struct(F.lit(j).alias("s"), F.col("fp").bitwiseAND(F.lit(int(m.astype(np.int64)))).alias("key")) for j, m in enumerate(all_masks)])
    index = fps.select("fp", F.inline(postings)).select("s", "key", "fp").repartition("s", "key").sortWithinPartitions("s", "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(s: int, members: np.ndarray) -> Iterator[pa.RecordBatch]:
            for u, v in forest(np.unique(members), max_bits, int(all_masks[s])):
                # The first set whose positions all agree tells the link.
                first = ((u ^ v)[:, None] & all_masks[None, :] == 0).argmax(axis=1) == s
                if first.any():
                    yield pa.record_batch([pa.array(x[first].view(np.int64)) for x in (u, v)], ["u", "v"])

        held: list[np.ndarray] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            s, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((s[1:] != s[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate([[0], cuts, [len(fp)]])
            big = np.flatnonzero(np.diff(bounds) > 1)
            if at != (s[0], key[0]):
                if held and sum(map(len, held)) > 1:
                    yield from told(at[0], np.concatenate(held))
                held, at = [], (s[0], key[0])
            if len(bounds) == 2:
                held.append(fp)
                continue
            held.append(fp[: bounds[1]])
            if sum(map(len, held)) > 1:
                yield from told(at[0], np.concatenate(held))
            for g in big:
                if 0 < g < len(bounds) - 2:
                    yield from told(int(s[bounds[g]]), fp[bounds[g]: bounds[g + 1]])
            held, at = [fp[bounds[-2]:]], (s[-1], key[-1])
        if held and sum(map(len, held)) > 1:
            yield from told(at[0], np.concatenate(held))

    return index.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``id_col, fp, component_id`` per row of ``docs``; ``component_id`` is the smallest id reachable over links.

    Texts without words (null, empty, white space) have fingerprint 0 and are linked like any other. Repeated rows come
    back as often as they are given. A null id never becomes a component's id while it has another. An empty table
    gives none. Other columns are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col, size, seed), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count("*").alias("n"))
    found = components(links(nodes.select("fp"), max_bits))
    member = found.join(nodes, found["node"] == nodes["fp"]).select("node", "root", "rep")
    least = member.groupBy("root").agg(F.min("rep").alias("least"))
    named = member.join(least, "root").select("node", "least")
    # Fingerprints outside any component stand for their own copies.
    ids = written(nodes.join(named, nodes["fp"] == named["node"], "left").select("fp", F.coalesce("least", "rep").alias("component_id"), "n"), "ids")
    # No more than HOT fingerprints can have as many copies as that; their rows aren't brought together.
    hot = F.broadcast(ids.where(F.col("n") * HOT >= fps.count()))
    common = fps.join(hot, "fp").select(id_col, "fp", "component_id")
    rest = fps.join(hot.select("fp"), "fp", "left_anti").join(ids.drop("n"), "fp").select(id_col, "fp", "component_id")
    return common.unionAll(rest)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay.

    A row that repeats another's id and text is the same document and goes as well. Rows without an id can't be told apart
    and stay. Of rows that share an id but not the text, only those go whose own text is a copy.
    """
    found = near_duplicates(docs, id_col, text_col, **settings)
    is_copy = F.col(id_col) != F.col("component_id")
    judged = found.groupBy(F.col(id_col).alias("_gone")).agg(F.min(is_copy).alias("_every"), F.max(is_copy).alias("_any")).where("_any")
    named = docs.where(F.col(id_col).isNotNull())
    kept = named.join(judged, docs[id_col] == judged["_gone"], "left_anti")
    # Ids of which some texts are copies and others aren't: by fingerprint.
    size, seed = settings.get("size", SHINGLE), settings.get("seed", SEED)

    @F.pandas_udf("bigint")
    def own(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(np.array([fingerprint(t, size, seed) for t in part], np.uint64).view(np.int64))

    mixed = named.join(judged.where("NOT _every"), docs[id_col] == judged["_gone"], "left_semi").dropDuplicates([id_col, text_col])
    mixed = mixed.withColumn("_own_fp", own(F.coalesce(text_col, F.lit(""))))
    copies = found.where(is_copy).select(F.col(id_col).alias("_copy_id"), F.col("fp").alias("_copy_fp")).distinct()
    same = (F.col("_own_fp") == F.col("_copy_fp")) & (mixed[id_col] == copies["_copy_id"])
    mixed = mixed.join(copies, same, "left_anti").select(docs.columns)
    return kept.dropDuplicates([id_col, text_col]).unionByName(mixed).unionByName(docs.where(F.col(id_col).isNull()))
