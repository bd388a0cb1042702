import re

import pytest
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.functions.regex import engine_problem, group_pattern, java_pattern, rule_problem

TEXTS = [
    "번호010-1234-5678 tel 010-1234-5678, 02-123-4567", "a@b.com, x@y.org한 z@w.net\nq@r.io", "900101-1234567 900101-5234567 M12345678 m87654321",
    "10.0.0.1 fe80:0:0:0:0:0:0:1 1.2.3", "card 4111 1111 1111 1111 - 4111-1111-1111-1111 12345678901234567890", "11-22-123456-33 123-45-67890 12-1234567 21-12345678",
    "건강보험증: A12345678 NHIS 12345-678 nhis:123456", "TIN: 12-3456789 Tax ID 1234567 납세자번호 123-45", "대전광역시 유성구 문화로 61 3층, 전라북도 전주시 효자동 17-3번지",
    "(31456) 울산광역시 남구 달동 77 그리고 대전 서구 둔산동 12", "전라북도 전주시 완산구 효자동 17-3 푸른아파트 5동 904호", "é010-1234-5678 über01012345678 ٠١٠", "line\r\nnext x\n", "",
]


@pytest.mark.parametrize("name", ["EMAIL", "KR_MOBILE", "KR_PHONE", "CARD", "KR_RRN", "PASSPORT", "IP", "DRIVER_LICENSE", "FOREIGN_RRN", "BUSINESS_REG", "HEALTH_INSURANCE", "TAX_INFO", "EIN", "MILITARY_ID",
                                  "ADDRESS_ROAD", "ADDRESS_POSTAL", "ADDRESS_SIMPLE", "ADDRESS_BUILDING", "OBFUSCATED_EMAIL", "NUMBER_BLOCK", "JWT", "ENTROPY_CANDIDATE"])
def test_builtin_patterns_match_like_python(column, name):
    pattern = getattr(C, name)
    got = column(TEXTS, lambda t: F.regexp_extract_all(t, F.lit(java_pattern(pattern)), F.lit(0)))
    assert got == [[m[0] for m in re.finditer(pattern, t)] for t in TEXTS]


@pytest.mark.parametrize(("pattern", "flags"), [
    (r"(?P<my_q>['\"])x(?P=my_q)", 0), (r"[[a]&&b]+", 0), (r"[]x]+", 0), (r'{"k"', 0), (r"a{,2}b", 0), (r"x{2}", 0), (r"^a.c$", 8), (r"a.c", 16), (r"A b # c", 66), (r"\d+", 256), (r"end\Z", 0), (r"(?i)ÄB", 0)])
def test_dialect_translation(column, pattern, flags):
    texts = ["'x' \"x\"", "[a]&&b]", "]x", '{"k": 1}', "aab ab b", "xx", "abc\na\rc\nadc", "a\nc", "ab", "12 ٣", "end", "end\n", "äb ÄB"]
    got = column(texts, lambda t: t.rlike(java_pattern(pattern, flags)))
    assert got == [bool(re.search(pattern, t, flags)) for t in texts]


def test_group_pattern_only_for_top_level_groups():
    assert group_pattern(r"\bk=(?P<V>\w+);", "V").value_index == 2
    assert group_pattern(r"(a)(?P<V>b)", "V").value_index == 3
    assert group_pattern(r"x|y(?P<V>\w+)", "V") is None
    assert group_pattern(r"(?:k=(?P<V>\w+))?z", "V") is None
    assert group_pattern(r"k(?P<V>\w)?z", "V") is None
    assert group_pattern(r"(a)\1(?P<V>b)", "V") is None


def test_rule_problems(spark):
    assert rule_problem("a+") is None
    assert rule_problem("") == "empty rule"
    assert rule_problem("(a").startswith("does not compile")
    assert rule_problem("a*") == "matches empty text"
    assert rule_problem(r"\b") == "matches empty text"
    assert engine_problem(spark, java_pattern("a+")) is None
    assert engine_problem(spark, "(?<=a+)b(") is not None
