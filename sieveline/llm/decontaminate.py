"""Benchmark decontamination: a hash set of normalised test n-grams is looked up at every token of the training texts.

Each n-gram ("window") of a benchmark item is filed under its longest word. The corpus is scanned once: every token
probes that hash table, and only where it holds something are the whole window's words compared. No window of a
training text is built, hashed or shuffled unless its anchor word occurs in the benchmark, and what leaves the scan is
one row per document and one per verified place. Everything is a DataFrame expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.expr import let, pick
from sieveline.llm.words import ALNUM_GAP, ANY_CASE_WORD, ascii_lower, leading, split_words, word_count

WINDOW = 10
#: A table of windows is broadcast only up to this many bytes; a larger one is broken into blocks of at most that size.
BROADCAST_BYTES = 48 << 20


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows of all items: ``window, n, offset, anchor, items``.

    An item with fewer than ``size`` words is one window, one without words none. ``anchor`` is the longest word,
    ``offset`` its place in the window. Equal windows of several items are one row.
    """
    words = F.filter(split_words(ascii_lower(F.col(text_col)), ALNUM_GAP), lambda w: w != "")
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    windows = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, size))).alias("w"))
    longest = F.array_max(F.transform("w", lambda w, i: F.struct(F.char_length(w).alias("len"), w.alias("word"), (-i).alias("back"))))
    return windows.groupBy(F.array_join("w", " ").alias("window"), "w").agg(F.sort_array(F.collect_set("item")).alias("items")).select(
        "window", F.size("w").alias("n"), longest.alias("a"), "items").select(
        "window", "n", (-F.col("a.back")).alias("offset"), F.col("a.word").alias("anchor"), "items")


def _blocks(windows: DataFrame, limit: int) -> tuple[list[DataFrame], int]:
    """Windows by the hash of their anchor word, in blocks small enough to broadcast, and the shortest anchor's bytes.

    The size is measured first. The hash only files the windows: whatever it finds is compared word by word.
    """
    size, shortest = windows.agg(
        F.coalesce(F.sum(F.octet_length("window") + F.octet_length("anchor") + 24 * F.size("items") + 64), F.lit(0)),
        F.coalesce(F.min(F.octet_length("anchor")), F.lit(0))).first()
    table = windows.select(F.xxhash64("anchor").alias("key"), "offset", "n", F.substring_index("window", " ", 1).alias("head"),
                           F.substring_index("window", " ", -1).alias("tail"), "window", "items")
    n = -(-int(size) // limit) or 1
    return [table] if n == 1 else [table.where(F.pmod("key", F.lit(n)) == b) for b in range(n)], shortest


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",),
              size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: ``keep``, ``n_words`` and ``hits``, an array of ``start, n, items`` (word places from 0).

    ``keep`` has to identify a document. Null and empty texts have no words and no hits; an empty benchmark gives none
    either. Repeated rows under one key have their hits united. Other columns of ``docs`` are not read.
    """
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    parts = docs.select(*keys, split_words(ascii_lower(F.col(text_col)), ALNUM_GAP).alias("_words"))
    names = [f"_k{i}" for i in range(len(keep))]
    tokens = parts.select(*names, "_words", F.posexplode_outer("_words").alias("_at", "_word"))
    found = []
    words, start = F.col("_words"), F.col("_at") - F.col("offset")
    blocks, shortest = _blocks(item_windows(benchmark, size=size), broadcast_bytes)
    for b, block in enumerate(blocks):
        # The first element of each text stands for the document itself, once.
        first = (F.col("_at") == 0) & F.lit(b == 0)
        probed = tokens.where((F.octet_length("_word") >= shortest) | first).join(F.broadcast(block), F.xxhash64("_word") == F.col("key"), "left")
        # A window's outer words are compared in generated code; only what passes leaves it and has the array of all words
        # of its text copied, for the comparison of the whole window.
        likely = F.coalesce((F.get(words, start) == F.col("head")) & (F.get(words, start + F.col("n") - 1) == F.col("tail")), F.lit(False))
        hit = F.struct((start - leading(words)).alias("start"), F.col("n").alias("n"), F.col("items").alias("items"))
        found.append(probed.where(likely | first).select(*names, word_count(words).cast("long").alias("n_words"), F.when(
            likely & (F.when(likely, F.array_join(pick(words, start + 1, start + F.col("n")), " ")) == F.col("window")), hit).alias("h")))
    united = reduce(DataFrame.unionAll, found)
    out = united.groupBy(*names).agg(F.max("n_words").alias("n_words"), F.collect_list("h").alias("hits"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "n_words", "hits")


def covered(hits: Column) -> Column:
    """Words inside at least one hit: the length of the union of their intervals."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("a"), (h["start"] + h["n"]).alias("b"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["b"]).alias("end"),
        (acc["total"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).cast("long").alias("total")), lambda acc: acc["total"])


def report(hits: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per document: words, words hit, and the items found as a count and a digest of their sorted ids."""
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return hits.select(*keep, "n_words", covered(F.col("hits")).alias("n_hit"), items.alias("_items")).select(
        *keep, "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW,
                   min_hit_words: int = 1) -> DataFrame:
    """``docs`` without those that have ``min_hit_words`` or more words inside benchmark windows. All columns stay."""
    bad = find_hits(docs, benchmark, text_col, (id_col,), size).where(covered(F.col("hits")) >= min_hit_words).select(F.col(id_col).alias("_bad"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with the words inside benchmark windows cut from the text, each with the gap behind it."""
    found = find_hits(docs, benchmark, text_col, (id_col,), size).where(F.size("hits") > 0).select(F.col(id_col).alias("_id"), F.col("hits").alias("_hits"))
    text, hits = docs[text_col], found["_hits"]
    words, gaps = F.regexp_extract_all(text, F.lit(f"({ANY_CASE_WORD})"), 1), F.split(text, ANY_CASE_WORD)

    def cut(words: Column, gaps: Column) -> Column:
        kept = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: ~F.exists(hits, lambda h: (i > h["start"]) & (i <= h["start"] + h["n"])))
        return let(words, lambda w: let(gaps, lambda g: F.concat(F.element_at(g, 1), F.array_join(
            F.transform(kept, lambda i: F.concat(F.element_at(w, i), F.element_at(g, i + 1))), ""))))

    clean = F.when(F.size(hits) > 0, cut(words, gaps)).otherwise(text)
    joined = docs.join(found, docs[id_col].eqNullSafe(found["_id"]), "left")
    return joined.select(*[clean.alias(c) if c == text_col else docs[c] for c in docs.columns])
