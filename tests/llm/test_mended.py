"""Cases that once went wrong: letters that end in marks, other tokenizers, texts full of beginnings, numerals, unlearned scripts."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sieveline.llm import language, pack, secret_ledger

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def ids(tokenizer, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("form", ["TR{}.", "a{}", "{}b,", "{}{}!"])
def test_ids_are_the_tokenizers_for_every_code_point(form):
    texts = [form.format(c, c) for c in map(chr, range(0x30000)) if not 0xD800 <= ord(c) < 0xE000]
    own, want = pack.WordIds(WORD_BPE), ids(Tokenizer.from_file(WORD_BPE), texts)
    assert own.by_word
    wrong = [t for t, a, b in zip(texts, own.texts(texts), want, strict=True) if a != b]
    assert wrong == []


def test_other_tokenizers_are_given_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, texts = pack.WordIds(path), ["Hello world, again.", " two  spaces\n\n", "", "é漢字!"]
    assert not own.by_word and own.texts(texts) == ids(Tokenizer.from_file(path), texts)


def test_generations_of_remembered_words(monkeypatch):
    monkeypatch.setattr(pack, "REMEMBERED", 8)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "The.", "river", "İ.", "x1,", "ΣΑΣ", "don't", f"w{rng.randrange(50)}"]) for _ in range(30)) for _ in range(60)]
    own = pack.WordIds(WORD_BPE)
    assert own.texts(texts) == ids(Tokenizer.from_file(WORD_BPE), texts) and len(own) <= 8 and len(own.older) <= 8


def test_sweeps_equal_their_patterns():
    rng = random.Random(2)
    pem, jwt = (next(re.compile(r.pattern, re.ASCII) for r in secret_ledger.RULES if r.kind == k) for k in ("pem", "jwt"))
    for _ in range(3000):
        parts = ["-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----END EC PRIVATE KEY-----", "BEGIN PRIVATE KEY-----", "END PRIVATE KEY-----", "x\n", "-----"]
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert list(secret_ledger.pem_spans(text)) == [m.span() for m in pem.finditer(text)], text
        text = "".join(rng.choice(["eyJ", "eyJabcdefgh", "abcdefgh", "12345678", ".", ".", "..", "-", "_", " ", "é", "a"]) for _ in range(rng.randrange(16)))
        assert list(secret_ledger.jwt_spans(text)) == [m.span() for m in jwt.finditer(text)], text


@pytest.mark.parametrize("piece", ["-----BEGIN PRIVATE KEY-----\n", "-eyJ", "password=abcdefgh1 ", "eyJabcdefgh.", "-----END PRIVATE KEY-----"])
def test_five_megabytes_are_scanned_and_masked_in_seconds(spark, table, piece):
    text = piece * (5_000_000 // len(piece))
    at = time.perf_counter()
    found = secret_ledger.scanner(secret_ledger.RULES)(text)
    assert time.perf_counter() - at < 10 and (len(found) > 200_000 if "=" in piece else not found)
    if "=" in piece:
        got = secret_ledger.mask_secrets(table([(1, text), (2, "clean")])).orderBy("doc_id").collect()
        assert got[0].text == "[SECRET] " * len(found) and got[1].text == "clean" and time.perf_counter() - at < 40


@pytest.mark.parametrize("piece", ["-eyJ", "eyJabcdefgh", "-eyJ.", "eyJabcdefgh.short.", "eyJabcdefgh..", ".-eyJabcdefgh"])
def test_runs_with_few_dots_are_read_once(piece):
    jwt = next(re.compile(r.pattern, re.ASCII) for r in secret_ledger.RULES if r.kind == "jwt")
    few, many = piece * 40, piece * (400_000 // len(piece))
    assert list(secret_ledger.jwt_spans(few)) == [m.span() for m in jwt.finditer(few)]
    at = time.perf_counter()
    found = list(secret_ledger.jwt_spans(many))
    assert time.perf_counter() - at < 3 and bool(found) == bool(jwt.search(few))


def test_a_ledger_spares_scanned_blobs_and_gives_the_same_findings(table):
    rows = [(i, f"text {i % 7} token = 'abcdefgh{i % 5}xyz'") for i in range(40)] + [(50, None), (51, "")]
    whole, _ = secret_ledger.scan_versions(table(rows))
    first, entries = secret_ledger.scan_versions(table(rows[:20]))
    assert first.count() == 20
    rest, more = secret_ledger.scan_versions(table(rows), entries, entries)
    key = lambda df: sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in df.collect())
    assert key(rest) == key(whole)
    known = {bytes(r.blob) for r in entries.collect()}
    assert not known & {bytes(r.blob) for r in more.collect()} and more.count() == len({t or "" for _, t in rows}) - len(known)


def test_numerals_are_no_letters_and_unlearned_scripts_support_nothing(spark, table):
    learn = spark.createDataFrame([(i, "plain words of one tongue", "aa") for i in range(20)] + [(100 + i, "andere werter einer sprache", "bb") for i in range(20)], "doc_id bigint, text string, lang string")
    model = language.learn(learn)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(table([(1, "½ ² Ⅷ ① ੩ 7"), (2, "中文文本"), (3, "plain words 中文"), (4, "ªº plain")]), model).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] in ("aa", "bb") and got[2][1] == 0.0
    assert got[3][0] == "aa" and abs(got[3][1] - 10 / 12) < 1e-9 and got[4][0] == "aa"


def test_one_id_on_most_rows_keeps_the_bound(spark):
    rows = [(1, f"word{i}", "aa") for i in range(500)] + [(i, "anders", "bb") for i in range(2, 30)]
    model = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4), sample=100)
    # One word counted for "aa", whose smoothing tells how many were.
    assert abs(0.5 / np.exp(float(model.words.rest[0])) - (1 + 0.5 + 1)) < 1e-3
