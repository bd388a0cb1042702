"""Packing token sequences: vector bin packing by the dot-product heuristic, with examples cut where that avoids padding.

Each task packs what it reads, in one pass and without a shuffle: documents are tokenized, cut at the sequence length and
put into a pool of bounded size; the open sequence takes from the pool the piece whose demand vector (tokens, one segment,
loss-bearing tokens) has the largest dot product with the sequence's free capacity, both as shares of the limits. If
nothing fits any more, a piece is cut to fill the sequence. At the end of a task what is left is cut into sequences
whose lengths are powers of two. A task that runs again yields the same rows, as nothing depends on other tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from struct import pack as pack_ids
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.batches import portions

#: Words whose ids a worker remembers, in two generations. Only speed depends on it.
REMEMBERED = 600_000
#: Longer words are encoded each time.
LONGEST_REMEMBERED = 64
#: Characters of text tokenized at a time, and pieces among which the next one is chosen.
CHARS, POOL = 1 << 20, 1024


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most."""

    tokens: int = 4096
    segments: int = 1024
    loss_tokens: int = 4096


class WordIds(dict):
    """Token ids of texts as little-endian unsigned 32-bit numbers, put together from those of their words.

    That is right for a tokenizer that drops white space before it forms words, lower-cases, and never joins a letter and the
    punctuation behind it: a text's ids are then those of its space-separated parts, letters have the ids of their lower-case
    form, and a word that ends in a letter and one full stop, comma or the like those of what is before the mark and of the
    mark. Other tokenizers (``by_word`` is false) are given whole texts.

    The dictionary holds the ids of words. When it is full it becomes the older generation, from which words that still
    occur are taken over; what occurs no more goes with the next one.
    """

    MARKS = frozenset(".,;:|?!")
    #: What the tokenizer file must say for words to be encoded apart.
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.older = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model.tokenize
        self.by_word = self._drops_spaces(json.loads(self.tokenizer.to_str()))
        # Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + i for i, b in enumerate(hidden)}

    @classmethod
    def _drops_spaces(cls, said: dict) -> bool:
        normalizer, before, model = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}, said["model"]
        steps = before.get("pretokenizers") or [{}, {}]
        splits = steps[0].get("pattern", {}).get("Regex") == cls.SPLIT and steps[0].get("behavior") == "Removed" and bool(steps[0].get("invert"))
        bytewise = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        return (normalizer.get("normalizers") == cls.NORMALIZERS and splits and bytewise and model["type"] == "BPE"
                and not said.get("truncation") and not any(t["content"].isalpha() for t in said.get("added_tokens") or []))

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._of(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _of(self, word: str) -> bytes:
        if len(word) > 1 and word[-1] in self.MARKS and word[-2].isalpha():
            # Lower-cased or composed anew, the letter can end in a mark of its own, which then joins the one behind it.
            if word.isascii() or normalize("NFC", word[:-1]).lower()[-1:].isalpha():
                return self[word[:-1]] + self[word[-1]]
        if word.isalpha():
            if word.isascii():
                lower = word.lower()
                return self[lower] if lower != word else self._of_letters(word)
            lower = word.lower()
            if len(lower) == len(word) and "\u03a3" not in word and is_normalized("NFC", word) and is_normalized("NFC", lower) and lower.isalpha():
                return self[lower] if lower != word else self._of_letters(word.encode().decode("latin-1").translate(self.alphabet))
        return self.encoded(word) if word else b""

    def _of_letters(self, piece: str) -> bytes:
        """Ids of one run of lower-case letters, which is one word for the tokenizer's model."""
        ids = [t.id for t in self.model(piece)]
        return pack_ids(f"<{len(ids)}I", *ids)

    def texts(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [b"".join(map(self.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


@dataclass
class Piece:
    """Part of an example: its id, place, ids and the place of its first loss-bearing token."""

    key: object
    start: int
    ids: bytes
    whole: int
    loss_from: int = 0

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.loss_from))

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (Piece(self.key, self.start, self.ids[: 4 * at], self.whole, self.loss_from),
                Piece(self.key, self.start + at, self.ids[4 * at:], self.whole, self.loss_from))


class Packer:
    """Fills one sequence after another from a bounded pool; ``add`` and ``finish`` yield complete sequences."""

    def __init__(self, limits: Limits, pool: int = POOL, cut: bool = True):
        self.limits, self.size, self.may_cut = limits, pool, cut
        self.scale = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.pool: list[Piece] = []
        self.need = np.empty((4 * pool, 3))

    def _put(self, piece: Piece) -> None:
        if len(self.pool) == len(self.need):
            self.need = np.concatenate([self.need, np.empty_like(self.need)])
        self.need[len(self.pool)] = piece.length, 1, piece.loss
        self.pool.append(piece)

    def _take(self, i: int) -> Piece:
        piece, last = self.pool[i], self.pool.pop()
        if i < len(self.pool):
            self.pool[i], self.need[i] = last, self.need[len(self.pool)]
        return piece

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while self.may_cut and piece.length > self.limits.tokens or piece.loss > self.limits.loss_tokens:
            if not self.may_cut:
                raise ValueError(f"example {piece.key!r} exceeds the limits and may not be cut")
            full, piece = piece.cut(min(self.limits.tokens, self.limits.loss_tokens))
            yield [full]
        if piece.length > self.limits.tokens:
            raise ValueError(f"example {piece.key!r} exceeds the limits and may not be cut")
        self._put(piece)
        while len(self.pool) >= self.size:
            yield from self._fill()

    def finish(self) -> Iterator[list[Piece]]:
        while self.pool:
            yield from self._fill()

    def _fill(self) -> Iterator[list[Piece]]:
        free, chosen = self.scale.copy(), []
        while self.pool:
            need = self.need[: len(self.pool)]
            fits = (need <= free).all(axis=1)
            if fits.any():
                gain = np.where(fits, (need / self.scale) @ (free / self.scale), -1.0)
                piece = self._take(int(gain.argmax()))
            elif self.may_cut and free.min() >= 1:
                i = int(need[:, 0].argmax())
                piece, rest = self._take(i).cut(int(min(free[0], free[2])))
                self._put(rest)
            else:
                break
            chosen.append(piece)
            free -= (piece.length, 1, piece.loss)
        yield from ([chosen] if free[0] == 0 or not self.may_cut else powers(chosen))


def powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces as sequences whose lengths are powers of two, the longest first."""
    rest, total = list(reversed(pieces)), sum(p.length for p in pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out = []
        while room:
            piece = rest.pop()
            if piece.length > room:
                piece, more = piece.cut(room)
                rest.append(more)
            out.append(piece)
            room -= piece.length
        yield out


def pack_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
               limits: Limits = Limits(), loss_from: str | None = None, cut: bool = True) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids, doc_tokens, loss_tokens, sequence_id, offset``.

    Every text is tokenized whole and closed by ``end_id``; null counts as the empty text, which is that one id. ``ids``
    holds the piece's ids as little-endian unsigned 32-bit numbers. ``loss_from`` names a column with the place of the
    first loss-bearing token (null or none: all bear loss). Rows with equal or null ids are packed like any other. An
    empty table gives no rows. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"),
                         F.coalesce(F.col(loss_from) if loss_from else F.lit(None), F.lit(0)).cast("long").alias("_loss"))
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[Piece]:
        ids = word_ids(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in portions(batches, 2000):
            keys, texts, losses = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHARS):
                    size, to = size + len(texts[to]), to + 1
                for key, body, loss in zip(keys[at:to], ids.texts(texts[at:to]), losses[at:to], strict=True):
                    yield Piece(key, 0, body + end, len(body) // 4 + 1, loss)
                at = to

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = Packer(limits, cut=cut), TaskContext.get().partitionId() << 40
        id_type = None

        def sequences(checked: Iterable[pa.RecordBatch]) -> Iterator[list[Piece]]:
            for piece in pieces(checked):
                yield from packer.add(piece)
            yield from packer.finish()

        def noted():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield b

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = [id_col, "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        rows, held = [], 0
        for n, sequence in enumerate(sequences(noted())):
            offset = 0
            for p in sequence:
                rows.append((p.key, p.start, p.length, p.ids, p.whole, p.loss, first + n, offset))
                offset += p.length
            held += offset
            if held >= 1 << 20:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)

    schema = (f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, "
              "offset long")
    return source.mapInArrow(packed, schema)
