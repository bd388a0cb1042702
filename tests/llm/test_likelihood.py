"""Likelihood by brute force over all segmentations, base scores by plain counting."""

import itertools
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sieveline.llm import likelihood as L
from sieveline.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


def segmentations(word):
    for cuts in itertools.product((False, True), repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        yield [word[a:b] for a, b in itertools.pairwise(at)]


def test_forward_recursion_sums_over_all_segmentations():
    logs = {b: math.log(p) for b, p in {b"": 0.1, b" ": 0.05, b" a": 0.2, b"b": 0.1, b"ab": 0.15, b" ab": 0.05, b"ba": 0.1, b"a": 0.25, "é".encode(): 0.01, b"\xc3": 1e-6, b"\xa9": 1e-6}.items()}
    lattice = L.Lattice(logs)
    for word in (b"a", b"ab", b"abab", b"bbaab", "abéba".encode()):
        want = sum(math.exp(sum(logs[p] for p in s)) for s in segmentations(b" " + word) if all(p in logs for p in s))
        assert math.isclose(lattice.log(word), math.log(want), rel_tol=1e-12)
    assert lattice.log(b"") == logs[b""]


def test_probabilities_of_all_words_sum_to_one_piece_by_piece():
    logs = L.piece_logs([b"", b" a", b"b", b"ab"], {1: 5, 2: 3}, 4)
    assert math.isclose(sum(map(math.exp, logs.values())), 1.0) and logs[b" a"] > logs[b"b"] > logs[b"ab"] and len(logs) == 259


def test_long_words_have_bounded_memory_and_the_same_result():
    lattice = L.Lattice(L.piece_logs([b" z", b"zz", b"zzz"], {0: 1, 1: 5, 2: 2}, 1))
    one, two = lattice.log(b"z" * 150_000), lattice.log(b"z" * 150_001)
    rate = lattice.log(b"z" * 60_001) - lattice.log(b"z" * 60_000)
    assert math.isclose(two - one, rate, rel_tol=1e-6) and math.isclose(one, 150_000 * rate, rel_tol=1e-3)


@pytest.mark.parametrize("frequent", [L.FREQUENT, 3, 0])
def test_scores_equal_plain_counting(table, awkward, frequent):
    rows = [*awkward, (10, "The the THE É é cat \x85sat\x0bon"), (11, "the cat"), (12, "unseen words zebra"), (20, "cat cat É")]
    docs = table(rows)
    learned = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    train = Counter(t for i, x in rows if i is not None and i % 3 for t in tokens(x))
    n, v = train.total(), len(train)
    model = L.learn(docs, PATH, learned)
    got = L.score(docs, model, frequent=frequent).collect()
    key = lambda i: (i is not None, i or 0)
    assert sorted((r.doc_id for r in got), key=key) == sorted((i for i, _ in rows), key=key)
    want = sorted((key(i), len(t), sum(train[w] > 0 for w in t), round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for i, x in rows for t in [tokens(x)])
    assert sorted((key(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    # The same sums from the words' own probabilities.
    logs = {bytes(r.word): r.log10 for r in model.words.collect()}
    assert set(logs) == {t.encode() for _, x in rows for t in tokens(x)}
    sums = sorted((key(i), round(sum(logs[t.encode()] for t in tokens(x)), 3)) for i, x in rows)
    assert sorted((key(r.doc_id), round(r.score, 3)) for r in got) == sums


def test_nothing_to_learn_from(table):
    docs = table([(1, "a b"), (2, None)])
    got = {r.doc_id: r for r in L.score(docs, L.learn(docs, PATH, F.lit(False))).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == 0.0 and got[1].score < got[2].score < 0
    empty = docs.limit(0)
    assert L.score(empty, L.learn(empty, PATH, F.lit(True))).count() == 0


def test_frequent_words_are_bounded(spark):
    words = spark.createDataFrame([(bytes([65 + i]), s) for i, s in enumerate([1, 1, 1, 2, 3, 9, 40, 41, 900])], "word binary, seen long")
    for most in range(10):
        least = L.frequent_from(words, most)
        assert words.where(F.col("seen") >= least).count() <= most
    assert L.frequent_from(words, 9) == 1


def test_query_learns_from_the_rest_and_tells_real_text_from_noise(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    train = Counter(t for i, x in rows.items() if zlib.crc32(str(i).encode()) % 10 for t in tokens(x))
    n, v = train.total(), len(train)
    got = QUERIES["op13_lattice_likelihood"](spark, SF_DIR).collect()
    assert {r.doc_id for r in got} == set(rows) and {r.train_tokens for r in got} == {n}
    for r in got:
        t = tokens(rows[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and r.n_tokens == len(t) and r.n_known == sum(train[w] > 0 for w in t)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [r for r in got if r.held_out and r.n_tokens > 50]
    assert held and all(-12 < r.score / r.n_tokens < 0 for r in held)
    # Words with their letters turned round are less likely.
    docs = spark.createDataFrame([(i, x if i % 2 else " ".join(w[::-1] for w in x.split())) for i, x in ((r.doc_id * 2 + k, rows[r.doc_id]) for r in held for k in (0, 1))], "doc_id bigint, text string")
    both = spark.createDataFrame([(10_000 + i, x) for i, x in rows.items()], "doc_id bigint, text string").unionByName(docs)
    scores = {r.doc_id: r.score for r in L.score(both, L.learn(both, PATH, F.col("doc_id") >= 10_000)).where("doc_id < 10000").collect()}
    assert sum(scores[i] > scores[i - 1] for i in scores if i % 2) > 0.95 * len(scores) / 2
