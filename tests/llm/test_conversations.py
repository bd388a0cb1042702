"""Repair of conversations against a plain search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from sieveline.llm import conversation_repair as R
from sieveline.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
LAST = re.compile("([^\x20\x09-\x0D])[\x20\x09-\x0D]*\\Z")


def plain(rows):
    """``rows`` of one conversation as (turn, role, text), in order: summary and repaired lines, by the plain recurrence over rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    faults, seen = [], set()
    for _, role, text in rows:
        last = LAST.search(text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    # From the last row to the first: (cost, audit, lines) for each last initial.
    here = {q: (0, "", ()) for q in ("", "a")} | {"u": (5, "I", ("assistant:",)), "s": (10, "II", ("user:", "assistant:"))}
    name = {"u": "user", "a": "assistant"}
    for (_, role, text), fault in zip(reversed(rows), reversed(faults), strict=True):
        new = {}
        for q in ("", "s", "u", "a"):
            found = [(here[q][0] + 2, "D" + here[q][1], here[q][2])]
            if fault in ("", "truncated"):
                more, then = 5 * (fault == "truncated"), after[q]
                for initial in ([role[:1]] if role[:1] == then or (q == "" and role[:1] == "s") else []):
                    found.append((here[initial][0] + more, "K" + here[initial][1], (f"{role}:{text}", *here[initial][2])))
                found.append((here[then][0] + 1 + more, "R" + here[then][1], (f"{name[then]}:{text}", *here[then][2])))
            new[q] = min(found)
        for _ in range(3):
            for q, then in after.items():
                new[q] = min(new[q], (new[then][0] + 5, "I" + new[then][1], (f"{name[then]}:", *new[then][2])))
        here = new
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts, illegal, here[""][0], here[""][1]), list(here[""][2])


def ordered(rows):
    digest = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()
    key = lambda r: (r[0] is not None, r[0] or 0, " " if r[1] is None else r[1], digest(" " if r[1] is None else r[1], " " if r[2] is None else r[2]))
    return sorted(rows, key=key)


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(rng, n):
    out = []
    for c in range(n):
        for t in range(rng.randrange(1, 14)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No", "What?\n ", "", " \t", None, "So it goes!", f"Turn {t}.", f"turn {t}", "é"])
            out += [(c, rng.choice([t, t, t, t + 3, None]), role, text)] * rng.choice([1, 1, 1, 2, 9])
    return out


def test_cheapest_edits_equal_every_edit_tried():
    rng = random.Random(4)
    roles, texts = ["system", "user", "assistant", "tool"], ["Done.", "cut", "", "Done."]
    for _ in range(1500):
        rows = [(i, rng.choice(roles), rng.choice(texts) + rng.choice(["", f"{i}."])) for i in range(rng.randrange(9))]
        rows = list(itertools.chain.from_iterable([(i, r, x if rng.random() < 0.7 or not x else f"{x}{i}.")] * rng.choice([1, 1, 5]) for i, r, x in rows))
        want, _ = plain(rows)
        seen, symbols = set(), bytearray()
        for _, r, x in rows:
            last = LAST.search(x)
            fault = R.BLANK if not last else R.DUPLICATE if (r, x) in seen else R.SOUND if last[1] in ".!?" else R.CUT
            seen.add((r, x))
            symbols.append(4 * "suat".index(r[0]) + fault)
        assert R.cheapest(bytes(symbols)) == want[-2:]


def test_long_runs_halve():
    for rows in (1, 63, 64, 65, 1000, 100_001):
        cost, audit = R.cheapest(bytes([4]) * rows)
        # Users only: every other one becomes the assistant's, and one is left over or answered.
        assert cost == (rows + 1) // 2 + (1 if rows % 2 else 0) and len(audit) == rows
    assert R.runs_of(b"aab") == [(97, 2), (98, 1)] and R.runs_of(b"") == []


def test_repair_equals_brute_force(spark):
    rows = conversations(random.Random(7), 150) + [(None, 1, "user", "A lone row."), (None, None, None, None), (900, 5, "user", "x. " * 200_000), (901, 3, "assistant", "only")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for c in ("_c", "_t", "_h", "place", "edit", "audit", "head", "cost"):
        df = df.withColumn(c, F.lit("x"))
    df = df.repartition(5)
    got = {r.conv_id: r for r in R.repair_conversations(df).collect()}
    lines = {}
    for r in sorted(R.repaired_turns(df).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.place == len(lines[r.conv_id]) - 1
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        want, repaired = plain(ordered([x[1:] for x in rows if x[0] == c]))
        assert tuple(r)[1:-1] == want and r.repaired_sha256 == sha(repaired) and lines.get(c, []) == repaired
    assert R.repair_conversations(df.limit(0)).count() == R.repaired_turns(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    convs = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[c] += [(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    got = {r.conv_id: r for r in QUERIES["op11_repair_conversations"](spark, SF_DIR).collect()}
    assert set(got) == set(convs)
    for c, r in got.items():
        want, repaired = plain(ordered(convs[c]))
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want and r.repaired_sha256 == sha(repaired)


def test_conversations_without_rows_after_damage(spark):
    gone = next(t for t in range(999) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, gone, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    assert R.damaged(df).count() == 0
