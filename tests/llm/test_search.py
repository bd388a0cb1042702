"""Ranked search: bounds hold, results equal brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import lexical_search as S

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, queries, k):
    held = [(i, Counter(terms(x))) for i, x in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, x in queries:
        wanted.setdefault(i, set()).update(terms(x))
    out = []
    for q, ts in wanted.items():
        rows = []
        for i, c in held:
            m = 10 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts)
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(q, at + 1, r[3], -r[0]) for at, r in enumerate(sorted(rows)[:k])]
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("leaf", [2, 48])
def test_search_equals_brute_force(table, awkward, spark, leaf, monkeypatch):
    monkeypatch.setattr(S, "LEAF", leaf)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(80)] + ["Über", "été", "漢字", "X9"]
    text = lambda n: ", ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [*awkward, *((100 + i, text(rng.randrange(1, 60))) for i in range(300))]
    docs += [(600 + i, docs[-1][1]) for i in range(30)]  # ties
    queries = [(i, text(rng.randrange(1, 12))) for i in range(25)] + [(3, "w70 w71"), (None, "W1 w2"), (90, None), (91, ""), (92, "nowhere"), (93, "a word1x1"), (94, "w79")]
    items = spark.createDataFrame(queries, "item_id bigint, text string").withColumn("rank", F.lit("x"))
    got = S.rank_documents(table(docs), items, k=10)
    assert order(tuple(r) for r in got.collect()) == order(brute(docs, queries, 10))


def test_portions_of_queries_and_empty_tables(table, spark, monkeypatch):
    docs = [(i, f"alpha beta{i % 3} gamma{i}") for i in range(40)]
    queries = [(i, f"alpha beta{i % 3} gamma{i * 7 % 40}") for i in range(9)]
    items = spark.createDataFrame(queries, "item_id bigint, text string")
    monkeypatch.setattr(S, "PORTION", 60)
    assert S.portion_count(items, "text") > 2
    assert order(tuple(r) for r in S.rank_documents(table(docs), items, k=3).collect()) == order(brute(docs, queries, 3))
    assert S.rank_documents(table([]), items).count() == 0 and S.rank_documents(table(docs), items.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    axes, rows = 200, []
    for i in range(1500):
        topic = i % 5
        at = np.unique(np.concatenate([rng.choice(20, 6), 20 + 36 * topic + rng.choice(36, 12)]))
        rows.append((at, rng.integers(1, 900_000, len(at))))
    sizes = np.array([len(a) for a, _ in rows])
    block = S.Block(np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]), sizes, axes)
    ids, opened, leaves = [int(i) for i in block.order], 0, sum(1 for _, _, second in block.nodes if not second)
    assert sorted(ids) == list(range(1500)) and max(b - a for a, b, second in block.nodes if not second) <= S.LEAF
    for topic in range(5):
        at = np.unique(np.concatenate([rng.choice(20, 2), 20 + 36 * topic + rng.choice(36, 8)]))
        weight = np.zeros(axes, np.int64)
        weight[at] = rng.integers(0, 9000, len(at))
        exact = np.array([int((weight[a] * v).sum()) for a, v in rows])
        bounds = block.bounds(at, weight[at])
        for (a, b, _), bound in zip(block.nodes, bounds, strict=True):
            assert exact[ids[a:b]].max() <= bound
        best = [S.Best(10)]
        opened += S.search_block(block, ids, [at], weight, best, np.zeros(axes, np.int64))
        want = sorted((-int(s), i) for i, s in enumerate(exact) if s > 0)[:10]
        assert [(s, i) for s, _, i in best[0].rows] == want
    assert opened < 0.75 * 5 * leaves


def test_one_document_as_often_as_it_likes(table, spark):
    docs = [(i, "same words here") for i in range(500)]
    items = spark.createDataFrame([(1, "same here"), (2, "words")], "item_id bigint, text string")
    got = S.rank_documents(table([*docs, (900, "other")]), items).collect()
    assert order(tuple(r) for r in got) == order(brute([*docs, (900, "other")], [(1, "same here"), (2, "words")], 10))
