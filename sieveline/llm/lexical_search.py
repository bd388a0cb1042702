"""Exact ranked lexical search: trees of balls over sparse document vectors, pruned by bounds on inner products.

A document is a vector over the terms of the queries: how much each term it holds is worth in it, whole numbers. A query is
a vector of term weights, whole numbers too, and a score is their inner product. Each task gathers the vectors it reads
into blocks, and a block into a binary tree: a node is split between two far-apart documents by distance, halves of equal
size, until a leaf holds few. A node keeps its centre and its radius, and the reach along each axis from the centre. For a
query q no document below scores more than ``q . centre`` plus the smaller of ``|q| * radius`` and the reach along q's axes;
both are rounded up. A query opens nodes in the order of their bounds and stops at the first one below its k-th
score so far, so what is left out cannot be among its best, ties included. Leaves are scored in integers.

The best of all tasks (k for each query and task at most, whatever the number of documents) are ranked once more. What is
broadcast are the terms and weights of one portion of the queries, of bounded size; more queries are more passes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.batches import portions
from sieveline.llm.storage import written

#: Bytes of query texts in one portion: what the driver collects and broadcasts at a time.
PORTION = 4 << 20
#: Documents of a leaf; numbers that the nodes of a block may hold (16 bytes each); postings of a block.
LEAF, NODE_NUMBERS, POSTINGS = 48, 4 << 20, 2_000_000
#: What a relevance is at most, and how far a document's length counts, in hundredths.
SCALE, LENGTH_SHARE = 1_000_000_000, 90

#: Bytes of UTF-8 with A-Z lower-cased and all other ASCII but digits and letters a space.
_KEPT = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, ASCII digits and characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_KEPT).split()


@dataclass(frozen=True)
class Queries:
    """One portion of the queries: their ids, and each one's places in the list of all terms."""

    ids: list
    places: list[np.ndarray]
    vocabulary: dict[bytes, int]


def portion_count(queries: DataFrame, text_col: str) -> int:
    size = queries.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-size // PORTION))


def _load(queries: DataFrame, id_col: str, text_col: str, part: int, parts: int) -> Queries:
    """The queries of a portion; rows with one id are one query."""
    share = F.pmod(F.xxhash64(id_col), F.lit(parts)) == part
    rows = queries.where(share).select(F.col(id_col), F.col(text_col).cast("binary")).collect() if parts > 1 else queries.select(
        F.col(id_col), F.col(text_col).cast("binary")).collect()
    held: dict[object, set[bytes]] = {}
    for key, text in rows:
        held.setdefault(key, set()).update(terms(bytes(text or b"")))
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*held.values())))}
    ids = list(held)
    return Queries(ids, [np.array(sorted(vocabulary[t] for t in held[i]), np.int64) for i in ids], vocabulary)


def vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """``_doc, n, places, counts`` of each document with a term at all: its length in terms and how often it holds each of
    ``vocabulary``, by place in it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for batch in portions(batches):
            ids, lengths, ends, places, counts = [], [], [0], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms(text or b"")
                if not words:
                    continue
                found = Counter(map(place, words))
                found.pop(None, None)
                order = sorted(found)
                ids.append(key)
                lengths.append(len(words))
                places += order
                counts += map(found.__getitem__, order)
                ends.append(len(places))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (places, counts)]
            yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(lengths, pa.int64()), *lists], ["_doc", "n", "places", "counts"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(
        count, f"_doc {kind}, n long, places array<int>, counts array<int>")


def weights(documents: int, df: dict[int, int], size: int) -> np.ndarray:
    """Weight of each term: the thousandfold logarithm of how rare it is, rounded down."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(size)], np.int64)


# --- the tree of one block -------------------------------------------------------------------------------------------


class Block:
    """Documents as sparse rows: ``values[starts[i]:starts[i + 1]]`` at ``places[...]``; every row has at least one."""

    def __init__(self, places: np.ndarray, values: np.ndarray, sizes: np.ndarray, axes: int):
        self.places, self.values, self.axes = places, values, axes
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.floats = values.astype(float)
        self.norms = np.add.reduceat(self.floats**2, self.starts[:-1])
        self.order = np.arange(len(sizes))
        self.nodes: list[tuple[int, int, int]] = []  # first and end in order, number of the second child or 0
        self.radius: list[float] = []
        centres, reaches = [], []
        self._split(0, len(sizes), centres, reaches)
        # One row per axis: a query reads those of its terms.
        self.centres, self.reaches = np.ascontiguousarray(np.array(centres).T), np.ascontiguousarray(np.array(reaches).T)
        self._arrange()

    def _flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the numbers of the rows lie, and where each row begins among them."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.repeat(self.starts[rows] - begins, sizes) + np.arange(sizes.sum()), begins

    def _distances(self, rows: np.ndarray, flat: np.ndarray, begins: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Squared distances to a dense point, rounded up."""
        norm = float(point @ point)
        products = np.add.reduceat(self.floats[flat] * point[self.places[flat]], begins)
        return np.maximum(self.norms[rows] - 2 * products + norm, 0) + 1e-9 * (self.norms[rows] + norm)

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.axes)
        out[self.places[self.starts[row]:self.starts[row + 1]]] = self.floats[self.starts[row]:self.starts[row + 1]]
        return out

    def _split(self, a: int, b: int, centres: list, reaches: list) -> None:
        rows = self.order[a:b]
        flat, begins = self._flat(rows)
        places, values = self.places[flat], self.floats[flat]
        centre = np.bincount(places, values, self.axes) / len(rows)
        most = np.zeros(self.axes)
        np.maximum.at(most, places, values)
        me = len(self.nodes)
        far = self._distances(rows, flat, begins, centre)
        self.nodes.append((a, b, 0))
        self.radius.append(math.sqrt(far.max()) * (1 + 1e-9))
        centres.append(centre)
        reaches.append(most - centre)
        if len(rows) <= LEAF:
            return
        one = self._dense(rows[int(far.argmax())])
        from_one = self._distances(rows, flat, begins, one)
        other = self._dense(rows[int(from_one.argmax())])
        lean = from_one - self._distances(rows, flat, begins, other)
        self.order[a:b] = rows[np.argsort(lean, kind="stable")]
        middle = (a + b) // 2
        self._split(a, middle, centres, reaches)
        self.nodes[me] = (a, b, len(self.nodes))
        self._split(middle, b, centres, reaches)

    def _arrange(self) -> None:
        """Rows in the order of the leaves, so that a leaf is one slice."""
        flat, begins = self._flat(self.order)
        self.places, self.values = self.places[flat], self.values[flat]
        self.starts = np.append(begins, len(flat))
        del self.floats, self.norms

    def bounds(self, places: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each node what no document below can exceed, rounded up."""
        w = weight.astype(float)
        near = w @ self.centres[places]
        reach = np.minimum(math.sqrt(float(w @ w)) * np.array(self.radius), w @ self.reaches[places])
        return (near + reach) * (1 + 1e-9) + 1

    def scores(self, a: int, b: int, dense: np.ndarray) -> np.ndarray:
        """Exact scores of the rows of a leaf; ``dense`` has the query's weight at its places and zero elsewhere."""
        lo, hi = self.starts[a], self.starts[b]
        return np.add.reduceat(self.values[lo:hi] * dense[self.places[lo:hi]], self.starts[a:b] - lo)


class Best:
    """The k highest scores of a query so far; equal ones by the smaller id, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """A score below this can't get in."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, ids: list, scores: np.ndarray) -> None:
        for i in np.flatnonzero(scores >= self.least()):
            self.rows.append((-int(scores[i]), ids[i] is None, ids[i]))
        self.rows.sort(key=lambda r: r[:2] if r[1] else r)
        del self.rows[self.k:]


def search_block(block: Block, ids: list, places: list[np.ndarray], weight: np.ndarray, best: list[Best], dense: np.ndarray) -> int:
    """Look for each query's best among the documents of a block, best nodes first; how many leaves were scored."""
    opened = 0
    for at, found in zip(places, best, strict=True):
        if not len(at):
            continue
        bounds = block.bounds(at, weight[at])
        dense[at] = weight[at]
        queue = [(-bounds[0], 0)]
        while queue and -queue[0][0] >= found.least():
            _, node = heappop(queue)
            a, b, second = block.nodes[node]
            if second:
                heappush(queue, (-bounds[node + 1], node + 1))
                heappush(queue, (-bounds[second], second))
            else:
                opened += 1
                found.add(ids[a:b], block.scores(a, b, dense))
        dense[at] = 0
    return opened


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text",
                   query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each query: ``query_id, rank`` (from 1), ``doc_id, score``.

    Scores are whole numbers above zero; equal ones go by the smaller document id, null ids last. Rows of queries with one
    id (null is one too) are one query with the terms of all. Document rows are ranked each by itself, repeated or not. A
    null or empty text has no terms: as a document it counts nowhere, as a query it has no rows. Empty tables give no rows.
    Texts are whole, of any length. Other columns are not read.
    """
    parts = portion_count(queries, query_text)
    found = [_ranked(docs, _load(queries, query_id, query_text, p, parts), k, doc_id, doc_text, query_id, queries, f"search-{p}") for p in range(parts)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _ranked(docs: DataFrame, queries: Queries, k: int, doc_id: str, doc_text: str, query_id: str, table: DataFrame, name: str) -> DataFrame:
    spark = docs.sparkSession
    held = written(vectors(docs, doc_id, doc_text, queries.vocabulary), name)
    documents, total = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Only terms of the queries, so this table is as bounded as the portion.
    df = {r.place: r.n for r in held.select(F.explode("places").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    axes = len(queries.vocabulary)
    shared = spark.sparkContext.broadcast((weights(documents, df, axes), queries.places))
    doc_kind, query_kind = docs.schema[doc_id].dataType.simpleString(), table.schema[query_id].dataType.simpleString()
    # As many documents as the nodes of their tree leave room for.
    most = max(2 * LEAF, LEAF * NODE_NUMBERS // (4 * max(1, axes)))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, places = shared.value
        best, dense = [Best(k) for _ in places], np.zeros(axes, np.int64)
        ids: list = []
        parts: list[tuple[np.ndarray, ...]] = []
        id_type = None

        def flush() -> None:
            if ids:
                place, value, sizes = (np.concatenate(c) for c in zip(*parts, strict=True))
                block = Block(place, value, sizes, axes)
                search_block(block, [ids[i] for i in block.order], places, weight, best, dense)
                ids.clear()
                parts.clear()

        for batch in portions(batches):
            id_type = batch.schema.field(0).type
            sizes = batch.column("places").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            place = batch.column("places").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            length = 100 - LENGTH_SHARE + LENGTH_SHARE * n * documents // total
            value = SCALE * tf // (1000 * tf + 8 * np.repeat(length, sizes))
            some = np.flatnonzero(sizes)
            keys = batch.column(0).to_pylist()
            ids += [keys[i] for i in some]
            parts.append((place, value, sizes[some]))
            if len(ids) >= most or sum(len(p[0]) for p in parts) >= POSTINGS:
                flush()
        flush()
        rows = [(q, key, -minus) for q, b in enumerate(best) for minus, _, key in b.rows]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), id_type, pa.int64()), strict=True)],
                                  ["_query", doc_id, "score"])

    hits = held.mapInArrow(search, f"_query int, `{doc_id}` {doc_kind}, score long")
    order = Window.partitionBy("_query").orderBy(F.desc("score"), F.asc_nulls_last(doc_id))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(queries.ids)), f"_query int, `{query_id}` {query_kind}")
    return ranked.join(F.broadcast(names), "_query").select(query_id, "rank", doc_id, "score")
