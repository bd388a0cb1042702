"""Operators that compare or combine documents, against brute force and by round trip."""

import hashlib
import random
import re
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sieveline.llm import components, pack, repeats, simhash

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1300)] + [(2000, 2000 + i) for i in range(99)]
    rng.shuffle(pairs)
    links = spark.createDataFrame([*pairs, (5, 5), (None, 7), pairs[0], pairs[0][::-1]], "u bigint, v bigint").repartition(7)
    got = {r.node: r.root for r in components.components(links).collect()}
    nodes = {n for p in pairs for n in p}
    assert {n: got.get(n, n) for n in nodes} == union(pairs, nodes)
    assert components.components(links.limit(0)).count() == 0


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(fps, most=3):
    a = np.array(fps, np.uint64)
    return [(i, int(i + 1 + j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= most)]


def test_near_duplicates_equal_brute_force(table, awkward):
    rng = random.Random(2)
    text = lambda n: [rng.choice("stone River of the old Mill É wind".split()) + str(rng.randrange(40)) for _ in range(n)]
    rows = list(awkward)
    for g in range(12):
        base = text(300)
        for c in range(8):
            copy = list(base)
            for _ in range(c // 2):
                copy[rng.randrange(300)] = "changed"
            rows.append((1000 + 20 * g + c, " ".join(copy)))
    got = simhash.near_duplicates(table(rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for key, t in rows:
        want.setdefault(key, set()).add(brute_fingerprint(t))
    for r in got:
        assert np.uint64(np.int64(r.fp)) in {np.uint64(x) for x in want[r.doc_id]}
    fps = sorted({f for v in want.values() for f in v})
    by = union(near(fps), range(len(fps)))
    least = {}
    for key, v in want.items():
        for f in v:
            c = by[fps.index(f)]
            least[c] = min((x for x in (least.get(c), key) if x is not None), default=None)
    for r in got:
        assert r.component_id == least[by[fps.index(int(np.int64(r.fp).view(np.uint64)))]]
    kept = simhash.drop_near_duplicates(table(rows))
    ids = [r.doc_id for r in kept.collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)) and set(named) == {v for v in least.values() if v is not None}
    assert ids.count(None) == 2 and set(kept.columns) == set(table(rows).columns)
    assert simhash.near_duplicates(table([])).count() == 0


def test_rows_with_one_id_go_by_their_own_text(table):
    words = lambda k, n: " ".join(f"{k}{i * 7 % 83}" for i in range(n))
    rows = [(1, words("a", 80)), (2, words("a", 80)), (2, words("b", 80)), (2, words("b", 80)), (2, None), (3, words("c", 60)), (4, words("a", 80))]
    kept = simhash.drop_near_duplicates(table(rows))
    want = [(1, words("a", 80)), (2, None), (2, words("b", 80)), (3, words("c", 60))]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert kept.columns == table(rows).columns


@pytest.mark.parametrize("compared", [1 << 13, 0])
def test_forest_connects_what_is_linked(monkeypatch, compared):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    fps = np.unique(np.random.default_rng(4).integers(0, 1 << 24, 2500, dtype=np.uint64) | np.uint64(0xABCDEF1234 << 24))
    pairs = [(int(a), int(b)) for u, v in simhash.forest(fps, 3, 0xFFFFFFFFFF000000) for a, b in zip(u, v, strict=True)]
    ids = [int(f) for f in fps]
    assert union(pairs, ids) == union([(ids[i], ids[j]) for i, j in near(ids)], ids) and len(pairs) < len(ids)


def test_position_sets_show_every_link():
    rng = random.Random(6)
    for _ in range(500):
        x = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(x & int(m) == 0 for m in simhash.masks(3))


def brute_repeats(docs, length):
    first = {}
    for key, b in docs:
        for i in range(len(b) - length + 1):
            first[b[i:i + length]] = min(first.get(b[i:i + length], key), key)
    out = []
    for key, b in docs:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < key:
                gone[i:i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((key, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(found):
    return sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found.collect())


def repeat_texts():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    parts = [text(rng.choice([20, 49, 50, 51, 60, 90, 300])) for _ in range(25)]
    rows = [(i, "".join(rng.choice([text(rng.randrange(80)), rng.choice(parts)]) for _ in range(rng.randrange(9)))) for i in range(250)]
    rows += [(300 + i, ["ab" * 90, "ab" * 30, "z" * 400, "z" * 49, "z" * 50, "abc" * 40, "xabcabcabc" * 12 + "abc" * 30][i % 7]) for i in range(14)]
    return rows + [(400, parts[0] + rows[3][1]), (401, parts[7] * 3), (5, parts[9]), (5, parts[9])]


@pytest.mark.parametrize(("length", "k"), [(50, 20), (30, 12)])
def test_repeats_equal_brute_force(table, length, k):
    rows = repeat_texts()
    got = rows_of(repeats.remove_repeats(table(rows), length=length, k=k))
    assert got == brute_repeats([(i, t.encode()) for i, t in rows], length)


def test_repeats_in_small_portions(table, monkeypatch):
    for name, size in (("CHUNK", 256), ("PORTION", 300), ("BUCKET", 200), ("SORTED", 500)):
        monkeypatch.setattr(repeats, name, size)
    rows = repeat_texts()
    assert rows_of(repeats.remove_repeats(table(rows))) == brute_repeats([(i, t.encode()) for i, t in rows], 50)


def test_windows_of_hot_kmers_are_dealt_singly(spark, table, monkeypatch):
    rows = repeat_texts()
    rng = random.Random(11)
    common = "this passage stands in very many of the documents, each time in other words"
    own = lambda: "".join(rng.choice("abcdefgh ") for _ in range(60))
    rows += [(1000 + i, own() + common + own()) for i in range(200)]
    expected = brute_repeats([(i, t.encode()) for i, t in rows], 50)
    most = {}
    for hot in (1 << 30, 20, 0):
        monkeypatch.setattr(repeats, "HOT", hot)
        sizes, by_bucket = [], repeats._by_bucket

        def spy(df, n, *rest, by_bucket=by_bucket, sizes=sizes):
            sizes.append(df.where("bucket >= 0").groupBy("bucket").agg({"bucket": "count"}).collect())
            assert hot == 1 << 30 or len(sizes) < 2 or any(r.bucket >= n for r in sizes[-1])
            return by_bucket(df, n, *rest)

        monkeypatch.setattr(repeats, "_by_bucket", spy)
        assert rows_of(repeats.remove_repeats(table(rows))) == expected
        monkeypatch.setattr(repeats, "_by_bucket", by_bucket)
        most[hot] = sum(r.bucket >= 0 for r in sizes[1])
    assert most[20] > most[1 << 30]
    # Joined by a shuffle where they might be too many to broadcast.
    monkeypatch.setattr(repeats, "SENT", 0)
    monkeypatch.setattr(repeats, "HOT", 20)
    assert rows_of(repeats.remove_repeats(table(rows))) == expected
    monkeypatch.setattr(repeats, "SENT", 1 << 22)
    monkeypatch.setattr(repeats, "HOT", 0)
    monkeypatch.setattr(repeats, "SORTED", 40)
    assert rows_of(repeats.remove_repeats(table(rows))) == expected


def test_windows_of_one_kmer_in_several_sets():
    rng = np.random.default_rng(9)
    spans = np.zeros((400, 80), np.uint8)
    for i in range(400):
        spans[i] = np.frombuffer(b"shared-kmer-of-twenty" * 4, np.uint8)[:80]
        spans[i, rng.integers(0, 80, 2)] = rng.integers(97, 99, 2)
    docs, sizes, kmer = rng.integers(0, 50, 400), np.full(400, 80), np.zeros(400, np.uint64)
    results = []
    for size in (1 << 19, 50):
        repeats.SORTED, old = size, repeats.SORTED
        e, w = repeats._later_windows(spans, sizes, kmer, docs, 50)
        repeats.SORTED = old
        results.append(sorted(zip(e.tolist(), w.tolist(), strict=True)))
    assert results[0] == results[1] and results[0]


def test_a_bucket_is_worked_off_in_bounded_memory(table, monkeypatch):
    """Four times the entries in one bucket need no more memory than the blobs themselves."""
    monkeypatch.setattr(repeats, "HELD", 1 << 13, raising=False)
    steps = []
    monkeypatch.setattr(repeats, "_by_bucket", lambda df, n, reduce, *rest: steps.append(reduce) or df)
    docs = table([(1, "x")])
    repeats._shared_kmers(docs.selectExpr("doc_id doc", "cast(text as binary) data"), 50, 20, 1, 1 << 14)
    repeats._removed_ranges(docs.selectExpr("doc_id doc", "1L tag", "array(1L) kmers", "array(1L) hot", "cast(text as binary) data"), 50, 20, 1)
    rng = np.random.default_rng(3)

    def blobs(step, n):
        """n strings, each in two documents."""
        span, hashes = rng.integers(0, 256, (n, 80), np.uint8), rng.integers(0, 1 << 63, n, np.uint64)
        for part in np.array_split(np.arange(2 * n), 16):
            own, doc = part % n, part // n + 1
            if step:
                yield repeats._packed(span[own], np.full(len(own), 80, np.uint8), np.full(len(own), 30, np.uint8), doc, doc, own)
            else:
                yield repeats._packed(hashes[own], doc, np.ones(len(own), np.int64))

    for step, reduce in enumerate(steps):
        peaks = []
        for n in (1 << 15, 1 << 17):
            held, told = list(blobs(step, n)), 0
            tracemalloc.start()
            for batch in reduce(held):
                told += batch.num_rows if not step else sum(batch["last"].to_numpy() - batch["first"].to_numpy() + 1)
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            assert told == (31 * n if step else 2 * n)
        assert peaks[1] < 1.5 * peaks[0] + sum(map(len, held)) / 8, (step, peaks)


def test_results_of_portions_are_dealt_over_all_tasks(table, monkeypatch):
    rng, dealt, by_bucket = random.Random(13), [], repeats._by_bucket

    def spy(df, *rest):
        dealt.append([r.bucket for r in df.where("bucket < 0").select("bucket").collect()])
        return by_bucket(df, *rest)

    monkeypatch.setattr(repeats, "_by_bucket", spy)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, text) for i in range(60)]
    assert rows_of(repeats.remove_repeats(table(rows))) == brute_repeats([(i, t.encode()) for i, t in rows], 50)
    assert len(dealt[0]) > 1 and all(len(set(b)) == len(b) for b in dealt)


def test_each_partition_has_one_bucket(spark, table):
    held = lambda blobs: iter([pa.record_batch([pa.array([len(blobs)], pa.int64())], ["blobs"])])
    sent = spark.range(240).selectExpr("id % 24 bucket", "cast('x' as binary) data")
    found = repeats._by_bucket(sent, 12, held, None, "blobs bigint", held).withColumn("at", F.spark_partition_id())
    assert sorted((r.at, r.blobs) for r in found.collect()) == [(i, 10) for i in range(12) for _ in range(2)]


@pytest.mark.parametrize("hot", [5, 1 << 14])
def test_kmers_that_are_told_alike(table, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "_HALF", np.uint64(7))
    rows = repeat_texts()
    assert rows_of(repeats.remove_repeats(table(rows))) == brute_repeats([(i, t.encode()) for i, t in rows], 50)


def test_repeats_of_awkward_rows(table, awkward):
    rows = [r for r in awkward if r[0] not in (4, None)]
    again = [*rows, (12, dict(rows)[9]), (13, dict(rows)[8])]
    assert rows_of(repeats.remove_repeats(table(again))) == brute_repeats([(i, (t or "").encode()) for i, t in again], 50)
    got = repeats.remove_repeats(table(awkward)).collect()
    assert len(got) == len(awkward) and all(not r.spans for r in got if r.doc_id is None)
    assert repeats.remove_repeats(table([])).count() == 0


def check_packing(rows, pieces, most=4096):
    """Round trip: each document's ids once, no gap in a sequence; the lengths of the sequences."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    docs, sequences = {}, {}
    for p in pieces:
        docs.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    assert set(docs) == {k for k, _ in rows}
    for key in docs:
        if sum(k == key for k, _ in rows) > 1 or key is None:
            continue
        ids = tokenizer.encode(dict(rows)[key] or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(docs[key], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert zlib.crc32(bytes(p.ids)) == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at:at + p.length]))
            at += p.length
        assert at == len(ids)
    lengths = []
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= most
        lengths.append(at)
    return lengths


def test_packing_round_trip(table, awkward):
    rng = random.Random(11)
    odd = ["don't stop now it's <|endoftext|> x<|startoftext|>y", "a\tb\r\nc\x0bd\x1ce", "İstanbul ǅ ſ ﬁ é ́x", "!" * 900]
    rows = awkward + [(100 + i, " ".join(rng.choice(["stone", "Über", "x,", "42"]) for _ in range(rng.choice([1, 5, 90, 900, 9000])))) for i in range(80)]
    rows += [(300 + i, t) for i, t in enumerate(odd)]
    lengths = check_packing(rows, pack.pack_texts(table(rows), TOKENIZER).collect())
    assert all(n & (n - 1) == 0 for n in lengths)
    assert pack.pack_texts(table([]), TOKENIZER).count() == 0


def test_limits_hold_together():
    rng = random.Random(12)
    limits = pack.Limits(tokens=64, segments=5, loss_tokens=40)
    for cut in (True, False):
        packer = pack.Packer(limits, pool=16, cut=cut)
        made = [pack.Piece(i, 0, bytes(4 * n), n, rng.randrange(n // 2, n) if i % 2 else n // 3) for i, n in enumerate(rng.choices(range(4, 40), k=300))]
        out = [s for p in made for s in packer.add(p)] + list(packer.finish())
        for s in out:
            assert sum(p.length for p in s) <= 64 and len(s) <= 5 and sum(p.loss for p in s) <= 40
        assert sum(p.length for s in out for p in s) == sum(p.length for p in made)
        if not cut:
            assert sorted(p.key for s in out for p in s) == list(range(300))
    with pytest.raises(ValueError, match="may not be cut"):
        list(pack.Packer(limits, cut=False).add(pack.Piece(1, 0, bytes(400), 100)))
