"""Prefix scans and edits that overlap, against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sieveline.functions import expr as E
from sieveline.functions import spans as S

ENTITY = "array<struct<word:string,start:int,end:int,entity_group:string>>"


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 63, 64, 65, 513, 5000, 40_000])
def test_prefixes_equal_a_loop(spark, n):
    xs = [(i * 7919) % 101 - 50 for i in range(n)]
    df = spark.createDataFrame([(xs,)], "xs array<int>")
    total = E.prefixes(F.col("xs"), F.lit(0), lambda x: x, lambda a, b: a + b)
    most = E.prefixes(F.col("xs"), F.lit(-99), lambda x: x, lambda a, b: F.greatest(a, b))
    got = df.select(total.alias("t"), most.alias("m")).first()
    sums, tops, s, m = [], [], 0, -99
    for x in xs:
        sums.append(s)
        tops.append(m)
        s, m = s + x, max(m, x)
    assert got.t == sums and got.m == tops


def fold(text, entities, char="*"):
    for start, end, n in sorted(((s, e, len(w)) for w, s, e, _ in entities), reverse=True):
        text = text[:start] + char * n + text[end:]
    return text


def test_overlapping_entities_equal_one_edit_after_the_other(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        text = "".join(rng.choice("abcdé漢 ") for _ in range(rng.randrange(0, 60)))
        entities = []
        for _ in range(rng.randrange(0, 9)):
            start = rng.randrange(0, len(text) + 1)
            end = min(len(text), start + rng.randrange(0, 12))
            n = end - start if i % 2 else rng.randrange(0, 15)
            entities.append(("w" * n, start, end, "X"))
        rows.append((i, text, entities))
    df = spark.createDataFrame(rows, f"id int, text string, e {ENTITY}").repartition(4)
    got = {r.id: r.m for r in df.select("id", S.mask_entities(F.col("text"), F.col("e")).alias("m")).collect()}
    assert got == {i: fold(t, e) for i, t, e in rows}


def test_many_entities_are_one_scan(spark):
    n = 30_000
    df = spark.range(1).select(F.repeat(F.lit("ab cd "), F.lit(n)).alias("text"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        F.lit("cd").alias("word"), (6 * i + 3).alias("start"), (6 * i + 5).alias("end"), F.lit("X").alias("entity_group"))).alias("e"))
    at = time.perf_counter()
    assert df.select(S.mask_entities(F.col("text"), F.col("e")).alias("m")).first().m == "ab ** " * n
    assert time.perf_counter() - at < 60


def one_row(spark, n, start, end, ord_):
    fields = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        start(i).cast("int").alias("start"), end(i).cast("int").alias("end"), ord_(i).cast("int").alias("ord"),
        F.lit("t").alias("type"), F.lit("r").alias("rule"), F.lit("v").alias("value"), F.lit(0).alias("ordinal")))
    return spark.range(1).select(fields.cast(S.SPANS).alias("s"))


def keep_in_order(spans, key):
    """Greedy choice by marking places."""
    taken, kept = bytearray(max(e for _, e, _ in spans) + 1), []
    for s, e, o in sorted(spans, key=key):
        if not any(taken[s:e]):
            taken[s:e] = b"\1" * (e - s)
            kept.append((s, e, o))
    return sorted(kept)


@pytest.mark.parametrize("how, key", [(S.resolve_longest, lambda s: (s[0] - s[1], s[0], s[2])), (S.resolve_priority, lambda s: (s[2], s[0]))])
def test_one_island_of_very_many_spans(spark, how, key):
    n = 20_000
    df = one_row(spark, n, lambda i: i * 2, lambda i: i * 2 + 3 + i * 31 % 7, lambda i: i * 7919 % n)
    spans = [(i * 2, i * 2 + 3 + i * 31 % 7, i * 7919 % n) for i in range(n)]
    assert df.select(F.size(S.islands(F.col("s")))).first()[0] == 1
    got = df.select(how(F.col("s")).alias("k")).first().k
    assert [(k.start, k.end, k.ord) for k in got] == keep_in_order(spans, key)


def test_islands_of_every_size_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        spans = []
        for ord_ in range(rng.choice([0, 1, 2, 5, 31, 33, 120])):
            start = rng.randrange(0, 150)
            spans.append((start, start + rng.randrange(1, 15), ord_, "t", "r", "v", 0))
        rows.append((i, spans))
    df = spark.createDataFrame(rows, f"id int, s {S.SPANS}")
    got = df.select("id", S.resolve_longest(F.col("s")).alias("a"), S.resolve_priority(F.col("s")).alias("b"), S.merge_spans(F.col("s")).alias("m")).collect()
    plain = {i: [s[:3] for s in spans] for i, spans in rows}
    for r in got:
        if plain[r.id]:
            assert [(k.start, k.end, k.ord) for k in r.a] == keep_in_order(plain[r.id], lambda s: (s[0] - s[1], s[0], s[2]))
            assert [(k.start, k.end, k.ord) for k in r.b] == keep_in_order(plain[r.id], lambda s: (s[2], s[0]))
        else:
            assert r.a == r.b == r.m == []
        covered = sorted({p for s, e, _ in plain[r.id] for p in range(2 * s, 2 * e + 1)})  # doubled places: touching spans merge
        assert sorted({p for k in r.m for p in range(2 * k.start, 2 * k.end + 1)}) == covered
        assert all(a.end < b.start for a, b in zip(r.m, r.m[1:]))


def test_empty_and_absent_spans(spark):
    df = spark.createDataFrame([(0, [(5, 5, 0, "t", "r", "v", 0), (3, 7, 1, "t", "r", "v", 0), (7, 9, 2, "t", "r", "v", 0)]), (1, None)], f"id int, s {S.SPANS}")
    got = df.select("id", S.resolve_priority(F.col("s")).alias("k"), S.merge_spans(F.col("s")).alias("m")).orderBy("id").collect()
    assert [(k.start, k.end) for k in got[0].k] == [(5, 5), (7, 9)] and [(k.start, k.end) for k in got[0].m] == [(3, 9)]
    assert got[1].k is None and got[1].m is None


def test_merging_and_masking_grow_with_the_text(spark):
    def seconds(n):
        df = spark.range(1).select(F.repeat(F.lit("ab1 "), F.lit(n)).alias("t"))
        at = time.perf_counter()
        assert df.select(F.length(S.mask_merged(F.col("t"), S.find_spans(F.col("t"), "[0-9]", "d"), "*"))).first()[0] == 4 * n
        return time.perf_counter() - at

    seconds(1000)
    small, large = seconds(25_000), seconds(200_000)
    assert large < 8 * small * 2.5
