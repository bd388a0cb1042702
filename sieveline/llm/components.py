"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.storage import written

#: Links that one task contracts at a time before the first round; more are contracted in several portions.
CONTRACTED = 1 << 20


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task as stars around the smallest node they connect: union-find over bounded portions."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in parent if find(x) != x]
        return pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        if len(parent) > CONTRACTED:
            yield stars()
            parent.clear()
    yield stars()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node with a link: ``root`` is the smallest node reachable. ``links``: two long columns ``u, v``.

    Links may repeat, in either direction, or join a node to itself; nulls are no links. Rounds go on until no link
    changes; each is written to the shared folder, so neither its lineage nor an executor's loss reaches further back. A
    node with very many links is never gathered: minima are pre-aggregated, and joins on a hot node can be split.
    """
    links = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = written(links.mapInArrow(_contract, "u bigint, v bigint").distinct(), "links")
    before = None
    while True:
        # u > v holds for every row. Large star: larger neighbours are linked to the smallest one.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node's smaller neighbours are linked to the smallest of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(small, "u")
        edges = written(near.select("u", F.col("m").alias("v")).unionAll(
            near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select("v", "v").distinct())
