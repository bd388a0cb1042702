"""Gates are necessary conditions: no text that a pattern matches may be kept from it."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.functions import obfuscation as O
from sieveline.functions import pii as P
from sieveline.functions import secrets as K
from sieveline.functions import spans as S
from sieveline.functions.regex import java_pattern

_GATED = [(p.type, p.pattern, p.literal, p.gate) for p in C.PII_DETECTION if p.literal or p.gate]
_GATED += [("address", p, None, C.GATE_ROAD_NUMBER) for p in C.OBFUSCATED_ADDRESSES]
_QUIET = settings(max_examples=120, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))


@pytest.mark.parametrize(("pattern", "literal", "gate"), [g[1:] for g in _GATED], ids=[f"{i}-{g[0]}" for i, g in enumerate(_GATED)])
def test_personal_data_gates(pattern, literal, gate):
    @_QUIET
    @given(st.from_regex(pattern))
    def check(text):
        assert literal in text if literal is not None else re.search(gate, text)

    check()


def _secret_gates():
    for name, pattern in (*C.KNOWN_TOKENS, ("jwt", C.JWT), ("high_entropy", C.ENTROPY_CANDIDATE)):
        if name in K._LITERALS:
            yield name, pattern, 0, re.escape(K._LITERALS[name])
        elif name in K._BY_KEY_WORD:
            yield name, pattern, 0, K._KEY_WORD
        elif name not in K._NO_RUN:
            yield name, pattern, 0, K._RUN % 19
    for name, pattern, _, flags, _ in C.CLOUD_RULES:
        if name in K._BY_URL:
            yield name, pattern, flags, "://"
        elif name not in K._NO_RUN:
            yield name, pattern, flags, K._RUN % 16


@pytest.mark.parametrize(("name", "pattern", "flags", "gate"), list(_secret_gates()))
def test_secret_gates(name, pattern, flags, gate):
    @_QUIET
    @given(st.from_regex(re.compile(pattern, flags)))
    def check(text):
        assert re.search(gate, text), name

    check()


PROBES = ["(12345) 서울특별시 강남구 -12", "12345 부산광역시 해운대구 , 12", "서울특별시 강남구 역삼로 12"]


def test_addresses_behind_separators(column):
    hits = column(PROBES, P.detect_pii)
    assert all("address" in h for h in hits)
    assert all("12" not in x[-4:] for x in column(PROBES, P.redact_priority))
    assert all(C.MASK_TOKEN in x for x in column(PROBES, lambda t: O.mask_addresses(t)[0]))
    assert column(PROBES, lambda t: O.mask_addresses(t)[1]) == [1, 1, 1]


def test_a_users_rule_has_no_gate(column):
    for name in ("github_token", "other", "candidate", "basic_auth_creds"):
        rules = [(name, r"gh-\d+", "block", 0, None)]
        assert column(["a gh-12 b"], lambda t, r=rules: F.size(K.cloud_secret_spans(t, r))) == [1]


def test_every_value_counts(column):
    text = " ".join(f"user{i}@example.com" for i in range(7))
    (hits,) = column([text], P.detect_pii)
    assert len(hits["email"]) == 7
    assert column([text], lambda t: P.annotate_counts(P.detect_pii(t)))[0]["email"] == 7
    assert len(column([text], lambda t: P.detect_pii(t, max_per_type=5))[0]["email"]) == 5


def test_patterns_that_can_match_nothing_are_refused():
    with pytest.raises(ValueError, match="can match empty text"):
        S.find_spans(F.col("text"), "(?=z)|foo", "x")


def test_conditions_ahead_of_numbers_and_addresses_change_no_hit(column):
    parts = ["+82 10-1234-5678", "(02) 345-6789", "공일공 일이삼사 오육칠팔", " \t\n      ", "call 010.1234.5678x", "٠١٢٣٤٥٦٧", "a-b 1 2", "word", "é", "82 8282828", *PROBES,
             "대전광역시 유성구 문화로 61", "x대구 수성구 들안로 12", "대전광역시 유성구 봉명동 12 한빛아파트 3동"]
    texts = [a + b + c for a in parts for b in ("", " ", "q") for c in parts]
    hits = 0
    for ahead, patterns in ((O.NUMBER_AHEAD, [C.NUMBER_BLOCK]), (O.ADDRESS_AHEAD, C.OBFUSCATED_ADDRESSES)):
        for p in patterns:
            found = [column(texts, lambda t, q=q: F.regexp_extract_all(t, F.lit(java_pattern(q)), F.lit(0))) for q in (p, ahead + p)]
            assert found[0] == found[1]
            hits += sum(map(len, found[0]))
    assert hits > 100


def _in_run():
    for name, pattern in (*C.KNOWN_TOKENS, (K.JWT_LABEL, C.JWT), (K.ENTROPY_LABEL, C.ENTROPY_CANDIDATE)):
        if name not in (*K._LITERALS, *K._BY_KEY_WORD, *K._NO_RUN):
            yield name, pattern, 0
    for name, pattern, _, flags, _ in C.CLOUD_RULES:
        if name not in (*K._BY_URL, *K._NO_RUN) and "(?i)" not in pattern:
            yield name, pattern, flags


@pytest.mark.parametrize(("name", "pattern", "flags"), list(_in_run()))
def test_tokens_are_found_in_the_runs_of_their_text(name, pattern, flags):
    @_QUIET
    @given(st.from_regex(re.compile(pattern, flags)))
    def check(text):
        runs = " ".join(re.findall(K._RUNS, text))
        assert re.search(K._IN_RUN[name], runs) if name in K._IN_RUN else runs

    check()


@pytest.mark.parametrize("name", K._BY_KEY_WORD)
def test_key_words_stand_in_front_of_a_sign(name):
    @_QUIET
    @given(st.from_regex(dict(C.KNOWN_TOKENS)[name]))
    def check(text):
        assert re.search(K._KEY_SIGN, text)

    check()
