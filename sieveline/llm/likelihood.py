"""Likelihood of texts under a subword model: a word's probability is the sum over all its segmentations into known pieces.

The pieces are those of an existing vocabulary; nothing is added to it. How likely each is, is learned: the file's own scores
are merge ranks, not probabilities, so pieces are counted over the training words as the vocabulary's tokenizer cuts them,
and each has its smoothed share. A word is spelled with a mark in front; every byte is a piece too, so every word can be
spelled. With F(0) = 1, F(i) is the sum of F(j) * p(piece from j to i) over the pieces that end at i, carried as logarithms.

Counting words shuffles one row per word and task. The recursion runs once for each different word of the corpus, where the
word's count lies. Documents then look words up: frequent ones (at most ``FREQUENT``, whatever the corpus) in a broadcast
table, all others by a join on the word; none of them is frequent, so no key of the join is hot.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.batches import portions
from sieveline.llm.storage import written

#: Added to each count: of a word in the base score, of a piece in the model.
ADDED = 0.1
#: Words of the broadcast table at most.
FREQUENT = 1 << 18
#: Different words, and their bytes, that a counting task holds before it passes them on.
HELD, HELD_BYTES = 300_000, 16 << 20
#: The end of a text, counted like a word. No word is empty.
END = b""
LN10 = math.log(10)


def learned_from(id_col: Column) -> Column:
    """True for the nine tenths of all rows that are learned from; never for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 10 != 0, F.lit(False))


def words(text: bytes | None) -> list[bytes]:
    """Words between white space, with A-Z lower-cased, and the end."""
    out = (text or b"").lower().split()
    out.append(END)
    return out


class Lattice:
    """Log probabilities (natural) of pieces by their bytes, and of words over all their segmentations."""

    def __init__(self, pieces: dict[bytes, float]):
        self.get, self.longest = pieces.get, [0] * 256
        for p in pieces:
            if p:
                self.longest[p[-1]] = max(self.longest[p[-1]], len(p))
        self.most = max(self.longest, default=0)

    def log(self, word: bytes) -> float:
        if word == END:
            return self.get(END)
        text, get, longest, most = b" " + word, self.get, self.longest, self.most
        before = [0.0]
        for i in range(1, len(text) + 1):
            ends = []
            for n in range(1, min(longest[text[i - 1]], i) + 1):
                p = get(text[i - n:i])
                if p is not None:
                    ends.append(before[-n] + p)
            top = max(ends)
            before.append(top if len(ends) == 1 else top + math.log(sum([math.exp(e - top) for e in ends])))
            if len(before) > 65_536:
                del before[:-most]
        return before[-1]


def spelled(path: str) -> list[bytes]:
    """The bytes of each piece of a vocabulary file, the mark of a word's beginning as a space; empty for control pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            out.append(END)
        else:
            out.append(b" " + piece[1:].encode() if piece[:1] == "▁" else piece.encode())
    return out


def piece_logs(spellings: list[bytes], counts: dict[int, int], ends: int) -> dict[bytes, float]:
    """Smoothed log share of each spelling, of every single byte and of the end; pieces spelled alike add up."""
    totals = Counter(dict.fromkeys([bytes([b]) for b in range(256)], 0))
    totals[END] += ends
    kinds = 257
    for i, spelling in enumerate(spellings):
        if spelling:
            totals[spelling] += counts.get(i, 0)
            kinds += 1
    whole = sum(totals.values()) + ADDED * len(totals)
    return {s: math.log((n + ADDED) / whole) for s, n in totals.items()}


@dataclass(frozen=True)
class Model:
    """What was learned. ``words``: word, count in training texts, count in all texts, log10 probability."""

    words: DataFrame
    tokens: int
    kinds: int

    def base(self, count: Column) -> Column:
        return F.log10((count + F.lit(ADDED)) / F.lit(self.tokens + ADDED * (self.kinds + 1)))


def word_counts(docs: DataFrame, learn: Column, text_col: str = "text") -> DataFrame:
    """``word, trained, seen``: each word of the corpus (bytes), how often training texts and all texts have it. The end of a
    text is the empty word."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained: Counter = Counter()
        other: Counter = Counter()

        def batch() -> pa.RecordBatch:
            found = list(trained.keys() | other.keys())
            here = np.array([trained[w] for w in found], np.int64)
            rows = [pa.array(found, pa.binary()), pa.array(here), pa.array(here + np.array([other[w] for w in found], np.int64))]
            trained.clear()
            other.clear()
            return pa.record_batch(rows, ["word", "trained", "seen"])

        size = 0
        for b in portions(batches):
            for text, learned in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (trained if learned else other).update(words(text))
                size += len(text or b"")
                if len(trained) + len(other) > HELD or size > 8 * HELD_BYTES and sum(map(len, trained)) + sum(map(len, other)) > HELD_BYTES:
                    yield batch()
                    size = 0
        yield batch()

    told = docs.select(F.col(text_col).cast("binary"), learn)
    rows = told.mapInArrow(count, "word binary, trained long, seen long")
    # Each task has summed up already. A fixed number of partitions: the words are few bytes, but each costs much time later.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "word").groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("seen").alias("seen"))


def learn(docs: DataFrame, vocabulary_path: str, learned: Column, text_col: str = "text") -> Model:
    """Count the words of all texts, and learn the pieces' shares from rows where ``learned`` is true.

    Null texts are empty: they have the end alone. Repeated rows count as often as they are there. Without training rows
    all counts are zero and every piece has the same share.
    """
    spark = docs.sparkSession
    counts = written(word_counts(docs, learned, text_col), "word-counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum((F.col("trained") > 0).cast("int")), F.lit(0))).first()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path)
        found = np.zeros(model.get_piece_size(), np.int64)
        ends = 0
        for b in portions(batches, 5000):
            texts, ns = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = model.encode([t.decode() for t in texts], num_threads=1)
            lengths = [len(x) for x in ids]
            flat = np.fromiter((i for x in ids for i in x), np.int64, sum(lengths))
            np.add.at(found, flat, np.repeat(ns, lengths))
            ends += int(sum(n for t, n in zip(texts, ns, strict=True) if t == END))
        some = np.flatnonzero(found)
        yield pa.record_batch([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(found[some], ends))], ["piece", "n"])

    # One row for each piece of the vocabulary file at most.
    pieces = {r.piece: r.n for r in counts.where("trained > 0").select("word", "trained").mapInArrow(cut, "piece int, n long")
              .groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(piece_logs(spelled(vocabulary_path), pieces, pieces.pop(-1, 0)))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for b in portions(batches, 5000):
            logs = [lattice.log(w) / LN10 for w in b.column(0).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(logs, pa.float64())], ["word", "trained", "seen", "log10"])

    weighed = counts.mapInArrow(weigh, "word binary, trained long, seen long, log10 double")
    return Model(written(weighed, "word-logs"), tokens, kinds)


def frequent_from(model_words: DataFrame, most: int = FREQUENT) -> int:
    """The least count from which on at most ``most`` words are seen as often, among the steps 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, …"""
    size = F.floor(F.log2("seen"))
    step = F.when(F.col("seen") < 4, F.col("seen")).otherwise(F.floor(F.col("seen") / F.pow(F.lit(2), size - 2)) * F.pow(F.lit(2), size - 2))
    steps = model_words.groupBy(step.cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()
    held, least = 0, None
    for r in sorted(steps, key=lambda r: -r["at"]):
        held += r.n
        if held > most:
            break
        least = r["at"]
    return least if least is not None else 1 << 62


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per document row: ``id_col, n_tokens, n_known, train_tokens, base_score, score``; scores are log10.

    The model must have been learned over these documents, whichever of them were trained on. Null texts are empty; null
    and repeated ids, repeated rows and texts of any length are rows like any other. An empty table gives no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    least = frequent_from(model.words, frequent)
    valued = model.words.select("word", (F.col("trained") > 0).alias("known"), model.base(F.col("trained")).alias("base"), "log10", "seen")
    often = valued.where(F.col("seen") >= least).drop("seen").toArrow()
    known, base, log10 = (often.column(c).to_pylist() for c in ("known", "base", "log10"))
    shared = spark.sparkContext.broadcast(dict(zip(often.column("word").to_pylist(), zip(known, base, log10, strict=True), strict=True)))
    kind = docs.schema[id_col].dataType.simpleString()

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, row, id_type = shared.value.get, TaskContext.get().partitionId() << 40, None
        for b in portions(batches):
            id_type = b.schema.field(0).type
            rows, rare, times, ends = [], [], [], [0]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = Counter(words(text))
                n_known, sum_base, sum_log = 0, 0.0, 0.0
                for w, n in found.items():
                    v = get(w)
                    if v is None:
                        rare.append(w)
                        times.append(n)
                    else:
                        n_known += n * v[0]
                        sum_base += n * v[1]
                        sum_log += n * v[2]
                ends.append(len(rare))
                rows.append((row, key, found.total(), n_known, sum_base, sum_log))
                row += 1
            types = [pa.int64(), id_type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((rare, pa.binary()), (times, pa.int64()))]
            yield pa.record_batch([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), *lists], ["_row", "_id", "n", "known", "base", "log10", "rare", "times"])

    looked = docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(
        look, f"_row long, _id {kind}, n long, known long, base double, log10 double, rare array<binary>, times array<long>")
    # Written once, so that row numbers are the same for both readers.
    held = written(looked, "looked-up")
    rare = held.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("_row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    rest = valued.where(F.col("seen") < least).drop("seen")
    times = F.col("times")
    sums = rare.join(rest, "word").groupBy("_row").agg(
        F.sum(times * F.col("known").cast("int")).alias("k"), F.sum(times * F.col("base")).alias("b"), F.sum(times * F.col("log10")).alias("l"))
    zero = F.lit(0)
    return held.drop("rare", "times").join(sums, "_row", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("k", zero)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("log10") + F.coalesce("l", F.lit(0.0))).alias("score"))
