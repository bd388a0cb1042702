"""Operators that learn or estimate: exact parts against brute force, the rest by held-out accuracy."""

import functools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import language, preference, quality_rules
from sieveline.llm.samples import held_out

SF_DIR = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0D]+")


def test_viterbi_equals_the_plain_recurrence():
    rng = np.random.default_rng(1)
    for labels in (1, 2, 5):
        sizes = [1, 2, 255, 256, 257, 700, 3]
        scores = rng.normal(size=(sum(sizes), labels)).astype(np.float32) * 4
        ends = np.cumsum(sizes)
        got = language.viterbi(scores, ends, 3.0)
        for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
            best, s = scores[a].copy(), scores[a:b]
            for row in s[1:]:
                best = row + np.maximum(best, best.max() - 3.0)
            path = got[a:b]
            value = s[np.arange(len(s)), path].sum() - 3.0 * np.count_nonzero(path[1:] != path[:-1])
            assert abs(value - best.max()) < 1e-2


def language_rows():
    rng = random.Random(3)
    words = {"aa": ["lomi", "tari", "nepo", "suvi", "rako"], "bb": ["zxgrt", "kwolf", "brunt", "schlo", "gnarf"], "ru": ["слово", "дом", "река", "мир"]}
    return words, [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i, lang in enumerate(list(words) * 40)]


def test_languages_and_spans(spark, table, awkward):
    words, rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learn(docs)
    assert model.langs == ["aa", "bb", "ru"] and model.scripts["cyrillic"] == [False, False, True]
    mixed = " ".join(words["aa"] * 5) + ". " + " ".join(words["bb"] * 3) + "! " + " ".join(words["ru"] * 9)
    texts = [(1, mixed), (2, "река"), (3, "42 ++"), (4, "漢字")]
    got = {r.doc_id: r for r in language.predict(table(texts), model).collect()}
    assert [s.lang for s in got[1].spans] == ["aa", "bb", "ru"] and got[1].lang_pred == "ru"
    assert mixed[got[1].spans[1].start:].startswith("zxgrt") and got[1].spans[2].end == len(mixed)
    assert (got[2].lang_pred, got[2].score) == ("ru", 1.0) and (got[3].lang_pred, got[3].score) == ("und", 0.0) and got[4].lang_pred in model.langs
    odd = language.predict(table(awkward), model).collect()
    assert len(odd) == len(awkward) and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in odd if r.doc_id in (1, 2, 3, 8)} == {"und"}
    assert language.predict(table([]), model).count() == 0


def test_no_language_to_learn_from(table):
    model = language.learn(table([(1, "some text")]))
    assert model.langs == [] and language.predict(table([(1, "some text")]), model).first().lang_pred == "und"


def test_every_item_is_kept_with_its_counts(spark):
    # "hot" has ten words more frequent than any of "rare", and three of five thousand seen once.
    once = "abcdefghijklmnop"
    once = [f"q{a}{b}{c}" for a in once for b in once for c in once]
    hot = " ".join(f"{w} " * 50 for w in ("ka", "kb", "kc", "kd", "ke", "kf", "kg", "kh", "ki", "kj")) + " both" * 3 + " " + " ".join(once)
    rare = " ".join(["mi", "mu", "mo", "ma"] * 2 + ["both"] * 2 + ["me"])
    model = language.learn(spark.createDataFrame([(1, hot, "hot"), (2, rare, "rare")], "doc_id bigint, text string, lang string"))
    counts = [Counter(hot.split()), Counter(rare.split())]
    grams = [Counter() for _ in counts]
    for c, g in zip(counts, grams, strict=True):
        for w, n in c.items():
            g.update({t: n * language.trigrams(w).count(t) for t in set(language.trigrams(w))})
    for items, by in ((model.words, counts), (model.grams, grams)):
        names = sorted(set().union(*by)) + ["never", "seen"]
        assert len(items.keys) == len(names) - 2
        want = [[np.log((c[w] + 0.5) / (c.total() + 0.5 * len(c) + 1)) for c in by] for w in names]
        assert np.allclose(items.rows(language.hashes(names)), want, atol=1e-5)


def test_scores_equal_plain_sums(spark):
    words, rows = language_rows()
    model = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    asked = [w for of in words.values() for w in of] + ["xyz", "q", "ярко", "漢字", "lomizx"]
    got, known = model.scores(asked)
    assert known.tolist() == [w != "漢字" for w in asked]
    for w, row in zip(asked, got.tolist(), strict=True):
        raw = model.words.rows(language.hashes([w]))[0].astype(float) + sum(model.grams.rows(language.hashes([t]))[0].astype(float) for t in language.trigrams(w))
        usable = model.scripts.get(language.script(w), [False] * 3)
        best = max((r for r, ok in zip(raw, usable, strict=True) if ok), default=0)
        want = [max(-12.0, r - best) if ok else -12.0 for r, ok in zip(raw, usable, strict=True)] if any(usable) else [0.0] * 3
        assert np.allclose(row, want, atol=1e-4)


def test_many_languages_and_a_small_memory(spark, table, monkeypatch):
    monkeypatch.setattr(language, "REMEMBERED", 40)
    rng = random.Random(5)
    vocabulary = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for i in range(150)}
    texts = [(2 * i + j, " ".join(rng.choices(words, k=40)), lang) for i, (lang, words) in enumerate(vocabulary.items()) for j in (0, 1)]
    model = language.learn(spark.createDataFrame([t for t in texts if t[0] % 2 == 0], "doc_id bigint, text string, lang string"))
    assert len(model.langs) == 150 and len(model.words.logs) < 2 * 150 * 12
    got = {r.doc_id: r.lang_pred for r in language.predict(table([t[:2] for t in texts]), model).collect()}
    assert sum(got[i] == lang for i, _, lang in texts) >= 0.99 * len(texts)


def test_the_sample_is_bounded_in_characters(spark):
    rows = [(i, f"w{'abcdefghij'[i % 10]} " * 10, "aa") for i in range(50)] + [(100, "long " * 100, "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for most, texts in ((10 * 30, 10), (1 << 20, 50)):
        kept = language.learn(docs, longest=40, characters=most).words
        # Each text has ten words of one kind; the smoothing of unseen ones tells how many were counted.
        assert abs(0.5 / np.exp(float(kept.rest[0])) - (10 * texts + 0.5 * len(kept.keys) + 1)) < 0.01
        assert not np.isin(language.hashes(["long"]), kept.keys).any()


def test_words_are_runs_of_letters_for_every_code_point():
    for text in ("".join(f"a{c}b " for c in map(chr, range(0x30000)) if not 0xD800 <= ord(c) < 0xE000), "plain x1y_z", "é½è", ""):
        letters = "".join(c if c.isalpha() else " " for c in text)
        assert "".join(language.words_of(text)) == letters.replace(" ", "")
        runs, starts = letters.split(" "), language.starts_of(text)
        assert len(starts) >= sum(map(bool, runs)) and (len(text.lower()) != len(text) or all(text.lower()[i].isalpha() for i in starts))


def test_runs_without_spaces_count_with_all_letters(spark, table):
    words, rows = language_rows()
    model = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    aa, bb, ru = ("".join(words[k] * 20) for k in ("aa", "bb", "ru"))
    texts = [(1, aa[:64] + bb * 3), (2, aa[:40] + ru), (3, "İİ " + aa + " " + ru)]
    got = {r.doc_id: r for r in language.predict(table(texts), model).collect()}
    assert got[1].lang_pred == "bb" and got[2].lang_pred == "ru"
    assert [(s.lang, s.start) for s in got[2].spans] == [("aa", 0), ("ru", 40)]
    assert got[3].spans[-1].lang == "ru" and got[3].spans[-1].start == 4 + len(aa)
    for text in (aa + ru, "漢字かなカナabc한글", "x" * 1000, "straße Ωm élan", "𠀀𐐀z"):
        pieces = language.words_of(text.lower())
        assert "".join(pieces) == "".join(language.LETTERS.findall(text.lower()))
        assert all(len(p) <= language.PIECE and len({language.script(c) for c in p}) == 1 for p in pieces)
        assert len(language.starts_of(text)) == len(pieces)


def test_held_out_third(spark):
    import zlib

    ids = spark.range(50).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    assert {r.id: r.h for r in ids.select("id", held_out(F.col("id")).alias("h")).collect()} == {
        **{i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}, None: True}


def test_held_out_accuracy(spark):
    from sieveline.llm.queries import QUERIES

    docs, labels = (spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("documents", "labels"))
    told = QUERIES["op2_language_spans"](spark, SF_DIR).where("held_out").join(docs, "doc_id")
    assert told.where("lang = lang_pred").count() >= 0.98 * told.count()
    told = QUERIES["op7_preference_quality"](spark, SF_DIR).where("held_out").join(labels, "doc_id")
    assert told.where("quality = predicted").count() >= 0.95 * told.count()


def test_preferences(spark, table, awkward):
    docs = table([(i, f"Good plain words stand here in line {i}. And more of them follow." if i % 2 else f"BAD!! {i} BAD!! BAD!! " * 5) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, None), (None, 1), (999, 0), (1, 1)], "doc_id bigint, quality int")
    scorer = preference.learn(docs, labels)
    got = {r.doc_id: r.score for r in preference.score(docs, scorer).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(60))
    kept = preference.drop_poor(docs, scorer)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(1, 60, 2)) and kept.columns == docs.columns
    odd = preference.score(table(awkward), scorer).collect()
    assert len(odd) == len(awkward) and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (1, 2)}) == 1
    assert preference.score(table([]), scorer).count() == 0 and preference.drop_poor(table([]), scorer).count() == 0
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert {r.score for r in preference.score(docs, preference.learn(docs, few)).collect()} == {0.5}


def brute_counts(text):
    w, text = WORD.findall(text or ""), text or ""
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def counted(df):
    return sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in df.collect())


def test_one_row_of_an_id_is_learned_from(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["good", "words", "@@##", "x"]) for _ in range(20))) for i in range(20)]
    rows += [(7, f"another text {i % 3}") for i in range(50)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    sizes, old, learned = [], preference.fit, []
    monkeypatch.setattr(preference, "fit", lambda x, y: sizes.append(len(x)) or old(x, y))
    for order in (rows, rows[::-1]):
        learned.append(preference.learn(spark.createDataFrame(order, "doc_id bigint, text string").repartition(5), labels))
    assert sizes == [20, 20] and (learned[0].weights == learned[1].weights).all()


def test_preferences_are_learned_from_all_labelled_rows(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["good", "words", "stand", "here."] if rng.random() < (0.8 if i % 3 else 0.4) else ["@@##", "x", "BAD!"]) for _ in range(12))) for i in range(17_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(17_000)], "doc_id bigint, quality int")
    sizes, old = [], preference.fit
    monkeypatch.setattr(preference, "fit", lambda x, y: sizes.append((len(x), x, y)) or old(x, y))
    monkeypatch.setattr(preference, "GATHERED", 50)
    scorer = preference.learn(docs, labels)
    n, blocks, counts = sizes[0]
    assert n == 17_000 and blocks.blocks.count() == 5 and list(counts[:2]) == [5667, 11_333]
    x = np.array([preference.features(t) for _, t in rows])
    assert np.allclose(scorer.mean, x.mean(axis=0)) and np.allclose(scorer.scale, np.where(x.std(axis=0) < 1e-6, 1.0, x.std(axis=0) + 1e-9))
    # The pairs of all blocks, brought together: the slope of their loss is zero where the solver stopped.
    loss = np.zeros(preference.N_FEATURES)
    for r in blocks.blocks.collect():
        z, y = np.frombuffer(r.x).reshape(-1, preference.N_FEATURES), np.frombuffer(r.y, np.int8)
        good, bad = preference._pairs(r.block, y, preference.PAIRS)
        assert (y[good] == 1).all() and (y[bad] == 0).all() and set(bad) == set(np.flatnonzero(y == 0))
        d = (z[good] - z[bad]) / scorer.scale
        loss += d.T @ (1 / (1 + np.exp(d @ scorer.weights)))
    assert np.abs(loss / (preference.PAIRS * counts[2]) - 1e-3 * scorer.weights).max() < 1e-6
    ranked = np.sort(scorer.raw(x))
    assert abs(scorer.threshold - (ranked[5666] + ranked[5667]) / 2) < 1e-9


@pytest.mark.parametrize("gathered", [0, 3, 1000])
def test_the_place_of_the_threshold_is_exact(monkeypatch, gathered):
    monkeypatch.setattr(preference, "GATHERED", gathered)
    values = np.random.default_rng(3).choice(np.append(np.round(np.random.default_rng(2).normal(size=40), 2), [0.5, 0.5 + 2**-53, -1e300]), 300)

    class Held(list):
        def over(self, part, join=np.add):
            return functools.reduce(join, [part(i, b, None) for i, b in enumerate(np.array_split(values, 7))])

    for k in range(1, 300):
        assert preference._ranked(Held(values), lambda x: x, k) == tuple(np.sort(values)[k - 1:k + 1])


def test_quality_counts_equal_brute_force(table, awkward, monkeypatch):
    rng = random.Random(5)
    rows = [*awkward, *[(100 + i, "".join(rng.choice(["a", "b", "é", "#"]) + rng.choice([" ", " ", "\n", "\t", " \r"]) for _ in range(rng.randrange(40)))) for i in range(120)]]
    want = sorted((str(k), *brute_counts(t)) for k, t in rows)
    assert counted(quality_rules.text_counts(table(rows))) == want
    # All windows share one hash: they are told apart by their words.
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *cols: F.lit(0).cast("long"))
    short = [r for r in rows if r[0] != 4]
    assert counted(quality_rules.text_counts(table(short))) == sorted((str(k), *brute_counts(t)) for k, t in short)


def test_votes_are_weighed(spark):
    rng = random.Random(7)
    patterns = Counter()
    for i in range(4000):
        good = i % 5 > 0
        votes = [-1 if rng.random() < 0.2 else int(rng.random() < (0.999 if good else p)) for p in (0.2, 0.3, 0.4)] + [rng.choice([-1, 1])]
        patterns[tuple(votes)] += 1
    df = spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n bigint")
    got = {tuple(r.votes): r.posterior for r in quality_rules.pattern_posteriors(df, 4).collect()}
    assert set(got) == set(patterns) and got[1, 1, 1, 1] > 0.9 and got[0, 0, 0, 1] < 0.1 and all(0 <= p <= 1 for p in got.values())


def test_judged_quality(table, awkward):
    fine = [(200 + i, " ".join(f"word{i * j % 101}x{j}" for j in range(120)) + ".") for i in range(50)]
    bad = [(300 + i, "## $$ " * 60 + f"{i}") for i in range(8)]
    judged = {r.doc_id: r for r in quality_rules.judge_quality(table(fine + bad)).collect()}
    assert all(judged[k].kept for k, _ in fine) and not any(judged[k].kept for k, _ in bad)
    odd = quality_rules.judge_quality(table(awkward)).collect()
    assert len(odd) == len(awkward) and all(r.base_failed and not r.kept for r in odd if r.doc_id != 4)
    assert quality_rules.judge_quality(table([])).count() == 0
