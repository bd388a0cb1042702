"""Quality classifier: Bradley-Terry scores learned from preference pairs, with a threshold at a score quantile.

A document's score is a weighted sum of features of its text. Of two documents the one with label 1 is preferred; weights
minimise the logistic loss on the differences of the pairs' features. The threshold is the score below which as large a
share of the labelled rows lies as has label 0. All labelled rows are learned from: their features stay in blocks on the
executors, and each step of the solver is one pass over them that brings back sums.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.batches import ROWS, portions
from sieveline.llm.storage import written

#: Labelled rows in a block, within which pairs are formed, and pairs for each row of a block's rarer label.
BLOCK, PAIRS = 4096, 12
#: Scores brought to the driver at most in search of the threshold, and places at which scores are counted before that.
GATHERED, EDGES = 100_000, 4096
_GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!", b"?",
           b"|", b"#$%&*", b"<>{}[]()=", b"\"'`", b"_-/+~^@\\:;")
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_CLASS[128:] = len(_GROUPS) + 1
N_CLASSES = len(_GROUPS) + 2
_STARTS_SENTENCE = re.compile(r"[.!?]\s")
N_FEATURES = N_CLASSES + 16


def features(text: str) -> np.ndarray:
    """What a score may see: shares of character classes, word lengths, repetition, lines and size; zeros for the empty text."""
    out = np.zeros(N_FEATURES)
    data = text.encode()
    if not data:
        return out
    shares = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=N_CLASSES) / len(data)
    # Small shares of rare characters matter most, hence the root.
    out[:N_CLASSES] = np.sqrt(shares)
    words = data.split()
    rest = out[N_CLASSES:]
    rest[0] = np.log1p(len(data))
    if not words:
        return out
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    rest[1], rest[2], rest[3], rest[4] = np.log1p(n), sizes.mean(), sizes.std(), np.log1p(sizes.max())
    rest[5] = len(ids) / n
    rest[6] = np.log(len(ids) + 1) / np.log(n + 1.5)
    rest[7] = np.bincount(code).max() / n
    if n > 1:
        rest[8] = np.count_nonzero(code[1:] == code[:-1]) / (n - 1)
    if n > 2:
        windows = (code[:-2] * n + code[1:-1]) * 1_000_003 + code[2:]
        rest[9] = 1 - len(np.unique(windows)) / (n - 2)
    lines = [x for x in data.split(b"\n") if x.strip()]
    rest[10] = np.log1p(len(lines))
    rest[11] = 1 - len(set(lines)) / len(lines)
    rest[12] = np.log1p(len(data) / len(lines))
    rest[13] = sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines)
    rest[14] = len(_STARTS_SENTENCE.findall(text)) / n
    rest[15] = np.count_nonzero(sizes <= 3) / n
    return out


@dataclass
class Scorer:
    """Weights of standardised features, and the threshold their sum is held against."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; 0.5 at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -500, 500)))


@dataclass
class Blocks:
    """Features and labels of ``rows`` rows, dealt over blocks by their hashed id."""

    blocks: DataFrame
    rows: int

    def __len__(self) -> int:
        return self.rows

    def over(self, part: Callable[[int, np.ndarray, np.ndarray], np.ndarray], join: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> np.ndarray:
        """``part(block, features, labels)`` of all blocks, joined in each task and then over the tasks; there is one block at least."""
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, got = 0, None
            for batch in batches:
                for block, x, y in zip(*(batch.column(i) for i in range(3))):
                    value = part(block.as_py(), np.frombuffer(x.as_buffer()).reshape(-1, N_FEATURES), np.frombuffer(y.as_buffer(), np.int8))
                    first, got = (block.as_py(), value) if got is None else (first, join(got, value))
            if got is not None:
                yield pa.record_batch([pa.array([first], pa.int32()), pa.array([got], pa.list_(pa.float64()))], ["first", "got"])

        # In the order of the blocks, as the last digits of a sum depend on its order.
        return reduce(join, [np.array(r.got) for r in sorted(self.blocks.mapInArrow(run, "first int, got array<double>").collect(), key=lambda r: r.first)])


def _pairs(block: int, y: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of label 1 and of label 0 that face each other: ``pairs`` for each row of the rarer label."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = pairs * min(len(good), len(bad))
    rng = np.random.default_rng(7 + block)
    chosen = [np.resize(rng.permutation(side), n)[rng.permutation(n)] for side in (good, bad)]
    return chosen[0], chosen[1]


def _ranked(rows: Blocks, raw: Callable[[np.ndarray], np.ndarray], k: int) -> tuple[float, float]:
    """The k-th and the next smallest score (k from 1, less than the number of rows), exactly.

    Scores are counted at places that close in on the k-th until few enough lie between two of them to be looked at.
    """
    ends = rows.over(lambda _, x, y: np.array([raw(x).min(), -raw(x).max()]), np.minimum)
    low, high, below, within = np.nextafter(ends[0], -np.inf), -ends[1], 0, len(rows)
    while within > GATHERED and np.nextafter(low, np.inf) < high:
        edges = np.unique(np.append(np.linspace(low, high, EDGES + 1)[1:-1], high))
        edges = edges[edges > low]
        counts = rows.over(lambda _, x, y: np.searchsorted(np.sort(raw(x)), edges, "right").astype(float))  # noqa: B023
        i = int(np.searchsorted(counts, k))
        low, high = edges[i - 1] if i else low, edges[i]
        below, within = (int(counts[i - 1]), int(counts[i] - counts[i - 1])) if i else (below, int(counts[i]) - below)
    if within > GATHERED and below + within > k:
        return float(high), float(high)  # one score that very many rows have
    one = within > GATHERED

    def near(_: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        r = raw(x)
        return np.append(r[(r > low) & (r <= high)][:0 if one else None], r[r > high].min(initial=np.inf))

    found = np.sort(rows.over(near, lambda a, b: np.append(a, b)))
    return (float(high), float(found[0])) if one else (float(found[k - 1 - below]), float(found[k - below]))


def fit(rows: Blocks, labels: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 50) -> Scorer:
    """Bradley-Terry weights by Newton's method; ``labels`` counts the rows of label 0 and 1 and the rows of the rarer label,
    block by block. With fewer than two labels nothing is preferred and every score is 0.5."""
    if not len(rows):
        return Scorer(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES))
    mean = rows.over(lambda _, x, y: x.sum(axis=0)) / len(rows)
    scale = np.sqrt(rows.over(lambda _, x, y: ((x - mean) ** 2).sum(axis=0)) / len(rows)) + 1e-9
    scale[scale < 1e-6] = 1.0
    out = Scorer(mean, scale, np.zeros(len(mean)))
    n = pairs * int(labels[2])
    if not n:
        return out

    def slopes(w: np.ndarray) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
        def part(block: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            good, bad = _pairs(block, y, pairs)
            d = (x[good] - x[bad]) / scale
            p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
            return np.append(((d * (p * (1 - p))[:, None]).T @ d).ravel(), d.T @ p)

        return part

    w = np.zeros(N_FEATURES)
    for _ in range(steps):
        got = rows.over(slopes(w)) / n
        step = np.linalg.solve(got[:-N_FEATURES].reshape(N_FEATURES, N_FEATURES) + ridge * np.eye(len(w)), got[-N_FEATURES:] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    out.weights = w
    out.threshold = float(np.mean(_ranked(rows, out.raw, min(int(labels[0]), len(rows) - 1))))
    return out


def _features(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts]).reshape(len(texts), N_FEATURES)


def score_column(scorer: Scorer):
    """``text -> score`` as a column function; only the text goes to Python, and only a number comes back."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [scorer.score(_features(list(texts[at:at + ROWS]))) for at in range(0, len(texts), ROWS)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return scored


def _feature_rows(rows: DataFrame) -> DataFrame:
    """``at, value`` with the features of ``text``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            value = pa.array(list(_features(batch.column(1).to_pylist())), pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), value], ["at", "value"])

    return rows.mapInArrow(run, f"at {rows.schema['at'].dataType.simpleString()}, value array<double>")


def _blocks(rows: DataFrame) -> DataFrame:
    """``block, x, y`` of ``block, at, value``: the features and labels of a block's rows, by id."""
    def pack(table: pa.Table) -> pa.Table:
        at = table["at"].combine_chunks()
        table = pa.table({"block": table["block"], "id": at.field("id"), "label": at.field("label"), "value": table["value"]}).sort_by("id")
        x = table["value"].combine_chunks().flatten().to_numpy()
        return pa.table({"block": table["block"][:1], "x": [x.tobytes()], "y": [table["label"].to_numpy().astype(np.int8).tobytes()]})

    return rows.groupBy("block").applyInArrow(pack, "block int, x binary, y binary")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Scorer:
    """A scorer from all labelled documents; ``labels`` with other values than 0 and 1, or none, are left out, as are labels of
    documents that aren't there. Of rows with one id, the text with the smallest hash is learned from.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND id IS NOT NULL")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = texts.join(known, "id").groupBy("id").agg(
        F.max("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    numbered = written(_feature_rows(rows.select(F.struct("id", "label").alias("at"), "text")), "features")
    count = numbered.count()
    block = F.pmod(F.xxhash64("at.id"), F.lit(-(-count // BLOCK) or 1)).cast("int").alias("block")
    packed = written(_blocks(numbered.select(block, "at", "value")), "blocks")
    found = Blocks(packed, count)

    def counts(_: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = np.bincount(y, minlength=2)
        return np.append(n, n.min())

    return fit(found, found.over(counts) if count else np.zeros(3))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` per row of ``docs``, from the text alone. Null counts as the empty text; repeated rows give repeated
    rows, an empty table none; other columns are not read."""
    return docs.select(id_col, score_column(scorer)(F.col(text_col)).alias("score"))


def drop_poor(docs: DataFrame, scorer: Scorer, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is below ``least``; all columns stay."""
    return docs.where(score_column(scorer)(docs[text_col]) >= least)
