"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word's score for a language is the log probability of the word plus that of its character trigrams, by counts learned here; what
was never counted is smoothed, so an unknown word is judged by its trigrams. All words and trigrams of the sample are kept, each with the
languages it was seen in (``Items``). Languages that don't use the word's script are out. A word is a run of letters of one script; a longer run
than ``PIECE`` letters is several words, so text without spaces counts with all its letters. The best labelling of a text maximises the sum of
scores less a penalty for each switch. Texts are labelled exactly, in blocks of words that run side by side: each block is
solved for every label that may precede it, and the blocks of a text are then joined, so the longest text needs no more
steps than its number of blocks.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.batches import portions
from sieveline.llm.samples import bounded
from sieveline.llm.storage import written

#: Word characters of the regex engine that are neither letters nor decimal digits: fractions, Roman numerals, circled digits.
_NUMERALS = frozenset(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
#: Runs of letters, in a text without such numerals.
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: First code points of script ranges (fixed values).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0B80, "tamil"), (0x0E00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFF21, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"))
_STARTS = [s for s, _ in SCRIPTS]

#: Documents learned from, their characters altogether, and those of one of them. These bound what reaches the driver: no more
#: different words than characters, at 14 bytes each; in ordinary text they are far fewer.
SAMPLE, CHARACTERS, LONGEST = 12_000, 1 << 26, 1 << 22
#: A language uses a script if this share of its words does.
SCRIPT_SHARE = 0.01
#: Words of a block, scores of words remembered by a worker, letters of a piece.
BLOCK, REMEMBERED, PIECE = 256, 400_000, 64
_CLASSES = {name: "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for (a, s), b in zip(SCRIPTS, [*_STARTS[1:], 0x110000], strict=True) if s == name)
            for _, name in SCRIPTS}
SCRIPT_NAMES = list(_CLASSES)
_PIECES = re.compile("|".join(f"[{c}]{{1,{PIECE}}}" for c in _CLASSES.values()))


def spaced(text: str) -> str:
    """A text with a space for each numeral; a class that lists all of them would be tried on every character."""
    if text.isascii() or _NUMERALS.isdisjoint(text):
        return text
    return "".join([" " if c in _NUMERALS else c for c in text])


def words_of(text: str) -> list[str]:
    """Words of a lower-cased text: runs of letters of one script, long ones in pieces."""
    found = LETTERS.findall(spaced(text))
    if all(w.isascii() and len(w) <= PIECE for w in found):
        return found
    return [p for w in found for p in ((w,) if w.isascii() and len(w) <= PIECE else _PIECES.findall(w))]


def starts_of(text: str) -> list[int]:
    """Where the words of a text begin in it, as many as its lower-cased form has."""
    lower = text.lower()
    starts = [m.start() + p.start() for m in LETTERS.finditer(spaced(lower)) for p in _PIECES.finditer(m.group())]
    if len(lower) == len(text):
        return starts
    # A letter may become several.
    ends = np.cumsum([len(c.lower()) for c in text])
    return np.searchsorted(ends, starts, side="right").tolist()


def script(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i:i + 3] for i in range(len(w) - 2)]


def hashes(items: Iterable[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, items), np.uint64)


@dataclass
class Items:
    """Log probabilities of items, by the hash of an item, for the languages it was seen in; ``rest`` is for all others."""

    keys: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    logs: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(items: np.ndarray, langs: np.ndarray, counts: np.ndarray, scale: np.ndarray) -> Items:
        """From the count of each item in each language that has it. Additive smoothing keeps unseen items possible."""
        order = np.lexsort((langs, items))
        items, langs, counts = items[order], langs[order], counts[order]
        begins = np.flatnonzero(np.append(True, items[1:] != items[:-1])) if len(items) else np.zeros(0, np.int64)
        logs = np.log((counts + 0.5) / scale[langs]).astype(np.float32)
        return Items(items[begins], np.append(begins, len(items)), langs.astype(np.uint16), logs, np.log(0.5 / scale).astype(np.float32))

    def rows(self, items: np.ndarray) -> np.ndarray:
        """A row of log probabilities, one of each language, for each item."""
        out = np.tile(self.rest, (len(items), 1))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, items), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == items)
            first, n = self.starts[at[hit]], self.starts[at[hit] + 1] - self.starts[at[hit]]
            place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out[np.repeat(hit, n), self.langs[place]] = self.logs[place]
        return out


@dataclass
class Model:
    """Learned log probabilities per language, and the scripts each uses."""

    langs: list[str]
    words: Items | None = None
    grams: Items | None = None
    scripts: dict[str, list[bool]] = field(default_factory=dict)
    switch: float = 6.0
    least: float = -12.0

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of words for each language, relative to the best one and no less than ``least``; and whether any
        language uses the word's script."""
        count = len(self.langs)
        used = np.array([self.scripts.get(name, [False] * count) for name in SCRIPT_NAMES])
        at = {name: i for i, name in enumerate(SCRIPT_NAMES)}
        out, known = np.empty((len(words), count), np.float32), np.empty(len(words), bool)
        step = max(1, (1 << 18) // count)
        for a in range(0, len(words), step):
            part = words[a:a + step]
            raw = self.words.rows(hashes(part))
            index: dict[str, int] = {}
            grams = [index.setdefault(g, len(index)) for w in part for g in trigrams(w)]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            raw += np.add.reduceat(self.grams.rows(hashes(index))[grams], np.cumsum(sizes) - sizes, axis=0)
            usable = used[[at[script(w)] for w in part]]
            known[a:a + step] = some = usable.any(axis=1)
            best = np.where(usable, raw, -np.inf).max(axis=1, initial=-np.inf)
            best[~some] = 0
            out[a:a + step] = np.where(usable, np.maximum(self.least, raw - best[:, None]), np.where(some, self.least, 0)[:, None])
        return out, known


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
          switch: float = 6.0, characters: int = CHARACTERS, longest: int = LONGEST) -> Model:
    """A model of the languages in ``lang_col``, from at most ``sample`` rows with a text and a language.

    Learned from are texts of up to ``longest`` characters, in the order of their hashed ids until they have ``characters``
    altogether, each whole. Of rows with one id one is learned from; rows without a text or a language are not. Counting is a
    Spark job; the driver gathers hashes of words and trigrams with their counts, which the bounds of the sample keep small.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & (F.length("text") <= longest))
    chosen = bounded(rows.select("id"), "id", sample).distinct().select(F.col("id").alias("chosen"))
    # One row of an id, always the same one: a repeated id doesn't lift the bound.
    one = F.min_by(F.struct("lang", "text"), F.xxhash64("lang", "text")).alias("r")
    taken = written(rows.join(F.broadcast(chosen), F.col("id").eqNullSafe(F.col("chosen"))).groupBy("id").agg(one).select("id", "r.*"), "language-sample")
    # A running total over the lengths of the sample, in one task: a row of two numbers for each of its documents.
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = taken.select("id", F.length("text").alias("size")).select(F.col("id").alias("within"), so_far.alias("so_far")).where(F.col("so_far") <= characters)
    texts = taken.join(F.broadcast(within), F.col("id").eqNullSafe(F.col("within")), "left_semi").select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}

        def out() -> pa.RecordBatch:
            sizes = [len(c) for c in counts.values()]
            names = [np.repeat(np.array([key[i] for key in counts], object), sizes) for i in (0, 1)]
            items = [np.array([SCRIPT_NAMES.index(i) for i in c], np.uint64) if kind == "script" else hashes(c) for (_, kind), c in counts.items()]
            items = np.concatenate([np.zeros(0, np.uint64), *items]).view(np.int64)
            return pa.record_batch([*(pa.array(c, pa.string()) for c in names), pa.array(items),
                                    pa.array([n for c in counts.values() for n in c.values()], pa.int64())], ["lang", "kind", "item", "n"])

        for batch in portions(batches):
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = Counter(words_of(text.lower()))
                counts.setdefault((lang, "word"), Counter()).update(words)
                grams, used = counts.setdefault((lang, "gram"), Counter()), counts.setdefault((lang, "script"), Counter())
                for w, n in words.items():
                    used[script(w)] += n
                    for g in trigrams(w):
                        grams[g] += n
            if sum(map(len, counts.values())) > 1 << 20:
                yield out()
                counts.clear()
        yield out()

    counted = texts.mapInArrow(count, "lang string, kind string, item bigint, n bigint").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    totals = written(counted, "language-counts")
    sums = totals.groupBy("lang", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("different"))
    size = {(r.lang, r.kind): (r.n, r.different) for r in sums.collect()}
    langs = sorted({lang for lang, _ in size})
    if not langs:
        return Model([])
    model = Model(langs, switch=switch)
    at = {lang: i for i, lang in enumerate(langs)}

    def items(kind: str) -> Items:
        found = totals.where(F.col("kind") == kind).select("item", "lang", "n").toArrow()
        which = pc.index_in(found["lang"], pa.array(langs, pa.string())).to_numpy()
        scale = np.array([n + 0.5 * different + 1 for n, different in (size.get((lang, kind), (0, 0)) for lang in langs)])
        return Items.of(found["item"].to_numpy().view(np.uint64), which, found["n"].to_numpy(), scale)

    model = Model(langs, items("word"), items("gram"), switch=switch)
    for r in totals.where(F.col("kind") == "script").collect():
        share = r.n / size[(r.lang, "script")][0]
        model.scripts.setdefault(SCRIPT_NAMES[r.item], [False] * len(langs))[at[r.lang]] = share >= SCRIPT_SHARE
    return model


def viterbi(scores: np.ndarray, ends: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word. ``scores``: words x labels of all texts one after another, each up to its ``ends``."""
    n, labels = scores.shape
    begins = np.append(0, ends[:-1])
    per = -(-(ends - begins) // BLOCK)
    text = np.repeat(np.arange(len(ends)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = begins[text] + nth * BLOCK
    size = np.minimum(ends[text] - first, BLOCK)
    order = np.argsort(-size, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first_o, size_o = first[order], size[order]
    best = np.zeros((len(order), labels, labels), np.float32)
    longest = int(size_o[0]) if len(size_o) else 0
    came = np.empty((longest, len(order), labels, labels), np.uint8)
    stay = np.arange(labels, dtype=np.uint8)
    for t in range(longest):
        k = int(np.searchsorted(-size_o, -t))
        now = best[:k]
        if t == 0:
            now[:] = np.where(np.eye(labels, dtype=bool), 0, -switch)
            came[0, :k] = np.arange(labels, dtype=np.uint8)[:, None]
        else:
            top = now.argmax(axis=2).astype(np.uint8)
            away = np.take_along_axis(now, top[:, :, None].astype(np.int64), 2) - switch
            keep = now >= away
            came[t, :k] = np.where(keep, stay, top[:, :, None])
            now[:] = np.where(keep, now, away)
        now += scores[first_o[:k] + t][:, None, :]
    # Joining blocks: the best end label of each block for the texts that have one, block by block.
    blocks = np.cumsum(per) - per
    total = np.zeros((len(ends), labels), np.float32)
    via = np.zeros((len(text), labels), np.uint8)
    for b in range(int(per.max()) if len(per) else 0):
        own = np.flatnonzero(per > b)
        sums = total[own][:, :, None] + best[place[blocks[own] + b]]
        via[blocks[own] + b] = sums.argmax(axis=1)
        total[own] = sums.max(axis=1)
    last, before = np.zeros(len(text), np.uint8), np.zeros(len(text), np.uint8)
    label = total.argmax(axis=1).astype(np.uint8)
    for b in range(int(per.max()) - 1 if len(per) else -1, -1, -1):
        own = np.flatnonzero(per > b)
        at = blocks[own] + b
        last[at] = label[own]
        label[own] = before[at] = via[at, label[own]]
    out = np.zeros(n, np.uint8)
    now, start = last[order].astype(np.int64), before[order].astype(np.int64)
    for t in range(longest - 1, -1, -1):
        k = int(np.searchsorted(-size_o, -t))
        out[first_o[:k] + t] = now[:k]
        now[:k] = came[t, np.arange(k), start[:k], now[:k]]
    return out


class Labeller:
    """Labels texts with a model's languages, remembering the scores of words."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.rows, self.known = np.empty((0, len(model.langs)), np.float32), np.empty(0, bool)
        self.most = 4 * REMEMBERED // max(4, len(model.langs))

    def _index(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.at)
        if len(self.at) + len(new) > self.most:
            self.at, new = {}, set(words)
        if new:
            here, to = len(self.at), len(self.at) + len(new)
            if to > len(self.rows):
                more = max(to, min(2 * len(self.rows), self.most)) - len(self.rows)
                self.rows = np.concatenate([self.rows, np.empty((more, self.rows.shape[1]), np.float32)])
                self.known = np.concatenate([self.known, np.empty(more, bool)])
            fresh = list(new)
            self.rows[here:to], self.known[here:to] = self.model.scores(fresh)
            self.at.update(zip(fresh, range(here, to), strict=True))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str]) -> list[tuple[str, float, list[dict]]]:
        """Per text: its language, the share of letters in it, and spans of one language in code points."""
        model = self.model
        found = [words_of(t.lower()) for t in texts]
        some = [i for i, f in enumerate(found) if f and model.langs]
        out = [(UNKNOWN, 0.0, []) for _ in texts]
        if not some:
            return out
        words = [w for i in some for w in found[i]]
        sizes = np.array([len(found[i]) for i in some])
        ends = np.cumsum(sizes)
        index = self._index(words)
        labels = viterbi(self.rows[index], ends, model.switch)
        letters = np.fromiter(map(len, words), np.int64, len(words))
        # Letters of a script that no language uses speak for none: they lower the score.
        spoken = letters * self.known[index]
        for n, i in enumerate(some):
            a, b = ends[n] - sizes[n], ends[n]
            share = np.bincount(labels[a:b], spoken[a:b], len(model.langs))
            top = int(share.argmax())
            cuts = np.flatnonzero(labels[a + 1:b] != labels[a:b - 1]) + 1
            spans = [{"lang": model.langs[top], "start": 0, "end": len(texts[i])}]
            if len(cuts):
                # Spans begin with their first word.
                starts = starts_of(texts[i])
                marks = [0, *(starts[c] for c in cuts.tolist()), len(texts[i])]
                kinds = [model.langs[labels[a + c]] for c in (0, *cuts.tolist())]
                spans = [{"lang": k, "start": x, "end": y} for k, x, y in zip(kinds, marks[:-1], marks[1:], strict=True)]
            out[i] = (model.langs[top], float(share[top] / letters[a:b].sum()), spans)
        return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, spans`` per row of ``docs``, from the text alone.

    The score is the share of letters in the language; letters of scripts that no learned language uses are in none. A null
    text, one without letters, or a model without languages gives ``und``, score 0 and no spans. Repeated rows give
    repeated rows, an empty table none; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    portion = max(4096, (1 << 23) // max(1, len(model.langs)) ** 2)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in portions(batches, 2000):
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 4 * portion):
                    size, to = size + len(texts[to]), to + 1
                langs, scores, spans = zip(*labeller.label(texts[at:to]), strict=True)
                yield pa.record_batch([batch.column(0).slice(at, to - at), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)],
                                      [id_col, "lang_pred", "score", "spans"])
                at = to

    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, spans array<struct<lang: string, start: bigint, end: bigint>>")
