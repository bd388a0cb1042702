import random
import re

from pyspark.sql import functions as F

from sieveline.functions import spans as S

RULES = [("w", r"[a-c]+"), ("n", r"\d{2,}"), ("m", r"[b-z0-9]{3,}"), ("k", r"가+\d"), ("x", r"[a-z]\d")]


def _texts(n=60, size=160, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcz09 가é\n") for _ in range(rng.randint(0, size))) for _ in range(n)] + ["ab12" * 900, "", "zzz"]


def _raw(text):
    return [(m.start(), m.end(), i, name, m[0]) for i, (name, p) in enumerate(RULES) for m in re.finditer(p, text)]


def _spans(t):
    return S.spans_of(t, [S.SpanRule(p, name, ord=i) for i, (name, p) in enumerate(RULES)])


def _greedy(spans, key):
    kept = []
    for s in sorted(spans, key=key):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


def _tuples(rows):
    return [(r.start, r.end, r.ord, r.type, r.value) for r in rows]


def test_offsets_equal_python_finditer(column):
    texts = _texts()
    assert [_tuples(v) for v in column(texts, _spans)] == [_raw(t) for t in texts]


def test_named_group_offsets(column):
    texts = ["key = 'abc' key='key=' x", "KEY: zz; key=abcdef", "no", "키 key=가나다 end"]
    pattern = r"(?i)\bkey\s*[:=]\s*(?P<V>[^\s;]+)"
    got = column(texts, lambda t: S.find_spans(t, pattern, "v", group="V"))
    assert [[(s.start, s.end, s.value) for s in v] for v in got] == [[(*m.span("V"), m["V"]) for m in re.finditer(pattern, t)] for t in texts]


def test_resolve_longest(column):
    texts = _texts()
    got = column(texts, lambda t: S.resolve_longest(_spans(t)))
    assert [_tuples(v) for v in got] == [_greedy(_raw(t), lambda s: (s[0] - s[1], s[0], s[2])) for t in texts]


def test_resolve_priority(column):
    texts = _texts(seed=8)
    got = column(texts, lambda t: S.resolve_priority(_spans(t)))
    assert [_tuples(v) for v in got] == [_greedy(_raw(t), lambda s: (s[2], s[0])) for t in texts]


def _merged(spans):
    out = []
    for s, e, *_ in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_merge_and_mask(column):
    texts = _texts(seed=9)
    got = column(texts, lambda t: S.merge_spans(_spans(t)))
    assert [[(s.start, s.end) for s in v] for v in got] == [_merged(_raw(t)) for t in texts]

    def masked(t):
        for s, e in reversed(_merged(_raw(t))):
            t = t[:s] + "[M]" + t[e:]
        return t

    assert column(texts, lambda t: S.mask_merged(t, _spans(t), "[M]")) == [masked(t) for t in texts]


def test_merge_ignores_order_and_is_idempotent(column):
    def shuffled(t):
        return S.merge_spans(F.reverse(_spans(t)))

    texts = _texts(20)
    assert column(texts, shuffled) == column(texts, lambda t: S.merge_spans(_spans(t)))
    again = column(texts, lambda t: S.merge_spans(S.merge_spans(_spans(t))))
    assert again == column(texts, lambda t: S.merge_spans(_spans(t)))


def test_replacements(column):
    texts = _texts(seed=3)

    def want(t):
        return re.sub(r"\d+", "<#>", t)

    got = column(texts, lambda t: S.apply_replacements(t, F.transform(S.find_spans(t, r"\d+", "n"), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit("<#>").alias("replacement")))))
    assert got == [want(t) for t in texts]
    none = F.array
    assert column(["ab", None], lambda t: S.apply_replacements(t, none().cast(S.REPLACEMENTS))) == ["ab", None]


def test_values_by_type_keeps_first_seen_order(column):
    (got,) = column(["12 ab 34 12 ab c"], lambda t: S.values_by_type(S.spans_of(t, [S.SpanRule(r"\d+", "n"), S.SpanRule("[a-c]+", "w")])))
    assert got == {"n": ["12", "34"], "w": ["ab", "c"]}


def test_entities(spark):
    df = spark.createDataFrame([("call Kim at 5", [("Kim", 5, 8, "PER"), ("5", 12, 13, None)]), ("none", [])],
                               "text string, e array<struct<word:string,start:int,end:int,entity_group:string>>")
    rows = df.select(S.mask_entities(F.col("text"), F.col("e")).alias("m"), S.list_entities(F.col("e")).alias("l")).collect()
    assert [r.m for r in rows] == ["call *** at *", "none"]
    assert [tuple(x) for x in rows[0].l] == [("Kim", "PER", "5-8"), ("5", "UNKNOWN", "12-13")]
