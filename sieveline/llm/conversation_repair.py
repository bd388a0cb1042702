"""Repair of conversation structure at the least cost: a shortest path over role states, run by run.

A conversation is a sequence of symbols, one for each row: the class of its role (system, user, assistant, other) and its
fault. Its repaired roles must read ``(s?(ua)+)?``, so a state (nothing yet, behind a system row, behind a user row, behind
an assistant row) says all about the rows before it. A symbol is a 4 x 4 min-plus matrix of costs between states. Equal
consecutive symbols are collapsed to a run, and a run of n rows is n's binary digits: the matrices of 1, 2, 4, … equal
rows are squares of each other, made once and kept. Costs are carried from the last run to the first; then the choices are
unrolled from the first row on, taking at each row the least letter among those that still lead to the least cost.

Two passes read the rows. The first sees no texts: a row is its digest and a symbol, and a conversation becomes its audit
(one letter a row). The second merges the audits with the texts in order and yields the repaired rows one by one. A
conversation is one task's work in both, because its audit is one string and its digest one SHA-256; a task holds one
byte for each of the conversation's rows, never its texts, and what is sorted spills to disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.batches import portions

#: White space of the contract, and what ends a finished text.
SPACE, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 40
#: States: nothing yet, behind a system row, behind a user row, behind an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A symbol is 4 * class of role + fault. Classes: s, u, a, other; faults: none, truncated, blank, duplicate.
CLASSES, FAULTS = "sua", 4
SOUND, CUT, BLANK, DUPLICATE = range(4)
#: Costs behind the last row: a system row needs a pair behind it, a user row an answer.
DONE = (0, 2 * INSERT, INSERT, 0)
#: What an added user or assistant leads to from each state.
ADDED = (USER, USER, ASSISTANT, USER)
#: Rows of a run whose costs are held at once while its choices are unrolled.
UNROLLED = 64
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

Costs = tuple[int, int, int, int]
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


@cache
def steps(symbol: int) -> tuple[dict[str, tuple[int, int]], ...]:
    """For each state the edits of one row as ``{letter: (cost, next state)}``, letters in ASCII order."""
    kind, fault = divmod(symbol, FAULTS)
    out = []
    for state in range(4):
        found = {"D": (DELETE, state)}
        if fault < BLANK:
            more = TRUNCATED if fault == CUT else 0
            then = ADDED[state]
            kept = SYSTEM if kind == 0 and state == START else then if kind == then - 1 else None
            if kept is not None:
                found["K"] = (more, kept)
            found["R"] = (REROLE + more, then)
        out.append(found)
    return tuple(out)


@cache
def matrix(symbol: int, power: int) -> tuple[Costs, ...]:
    """Costs between states over ``2 ** power`` rows of one symbol, with any rows added before each of them."""
    if power:
        half = matrix(symbol, power - 1)
        return tuple(tuple(min(half[a][c] + half[c][b] for c in range(4)) for b in range(4)) for a in range(4))
    rows = []
    for state in range(4):
        costs, at, spent = [NEVER] * 4, state, 0
        for _ in range(3):
            for cost, then in steps(symbol)[at].values():
                costs[then] = min(costs[then], spent + cost)
            at, spent = ADDED[at], spent + INSERT
        rows.append(tuple(costs))
    return tuple(rows)


@cache
def _before(symbol: int, power: int, after: Costs) -> tuple[Costs, int]:
    """Costs to the end before ``2 ** power`` rows, from those behind them, as differences to the least of them and that least.

    ``after`` is such differences too: no two lie further apart than two additions cost, so few different ones exist."""
    m = matrix(symbol, power)
    costs = [min(m[a][b] + after[b] for b in range(4)) for a in range(4)]
    least = min(costs)
    return tuple(c - least for c in costs), least


def before(symbol: int, rows: int, after: Costs) -> tuple[Costs, int]:
    """The same for a run of ``rows`` equal symbols, by the powers that its length is made of."""
    power = total = 0
    while rows:
        if rows & 1:
            after, least = _before(symbol, power, after)
            total += least
        rows, power = rows >> 1, power + 1
    return after, total


def runs_of(symbols: bytes) -> list[tuple[int, int]]:
    """``(symbol, rows)`` of each run of equal symbols."""
    out, at = [], 0
    while at < len(symbols):
        same = len(symbols) - len(symbols[at:].lstrip(symbols[at:at + 1])) if symbols[at + 1:at + 2] == symbols[at:at + 1] else at + 1
        out.append((symbols[at], same - at))
        at = same
    return out


@cache
def _choice(symbol: int, state: int, after: Costs) -> tuple[bytes, int]:
    """Letters up to and with that of one row, and the state behind it."""
    here, least = _before(symbol, 0, after)
    edits, left = steps(symbol)[state], here[state] + least
    for letter in ("D", "I", "K", "R"):
        if letter == "I":
            if here[ADDED[state]] + least + INSERT == left:
                letters, then = _choice(symbol, ADDED[state], after)
                return b"I" + letters, then
        elif letter in edits:
            cost, then = edits[letter]
            if cost + after[then] == left:
                return letter.encode(), then
    raise AssertionError("no edit leads to the least cost")


def _unroll(symbol: int, rows: int, after: Costs, state: int, out: bytearray) -> int:
    """Append the choices for a run entered in ``state``; the state behind it. Long runs are halved, so that few costs are held."""
    while rows > UNROLLED:
        late = rows // 2
        state = _unroll(symbol, rows - late, before(symbol, late, after)[0], state, out)
        rows = late
    behind = [after]
    for _ in range(rows - 1):
        behind.append(_before(symbol, 0, behind[-1])[0])
    for costs in reversed(behind):
        letters, state = _choice(symbol, state, costs)
        out += letters
    return state


def cheapest(symbols: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest edits, of several the ASCII-least: D delete, I insert, K keep, R rerole."""
    runs, behind, total = runs_of(symbols), [DONE], 0
    for symbol, rows in reversed(runs):
        after, least = before(symbol, rows, behind[-1])
        behind.append(after)
        total += least
    total, state, out = total + behind.pop()[START], START, bytearray()
    for symbol, rows in runs:
        state = _unroll(symbol, rows, behind.pop(), state, out)
    while DONE[state]:
        out += b"I"
        state = ADDED[state]
    return total, out.decode()


# --- rows ------------------------------------------------------------------------------------------------------------


def _normal(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    blank = F.lit(" ")
    role, text = F.coalesce(F.col(role_col), blank), F.coalesce(F.col(text_col), blank)
    # The digest stands for role and text where texts are not at hand: in the first pass, and as the last sorting key.
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return rows.select(F.col(id_col).alias("_c"), F.col(turn_col).alias("_t"), role.alias("_r"), text.alias("_x"), digest.alias("_h"))


def _symbols(normal: DataFrame) -> DataFrame:
    """``_c, _t, _s``: conversation, turn and symbol of each row, in order. Texts stay behind."""
    ended = F.rtrim(F.col("_x"), F.lit(SPACE))
    fault = F.when(ended == "", BLANK).when(F.right(ended, F.lit(1)).isin(*ENDS), SOUND).otherwise(CUT)
    initial = F.left("_r", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    slim = normal.select("_c", "_t", "_r", "_h", kind.alias("_k"), fault.alias("_f")).repartition("_c")
    # Sorted inside its conversation's partition: no second shuffle, and a hot message is a sorted stretch, not a group held.
    seen = F.row_number().over(Window.partitionBy("_c", "_h").orderBy(F.asc_nulls_first("_t"))) > 1
    fault = F.when((F.col("_f") != BLANK) & seen, DUPLICATE).otherwise(F.col("_f"))
    marked = slim.select("_c", "_t", "_r", "_h", (F.col("_k") * FAULTS + fault).cast("tinyint").alias("_s"))
    return marked.sortWithinPartitions("_c", F.asc_nulls_first("_t"), "_r", "_h").select("_c", "_t", "_s")


def summary(symbols: bytes, turns: Iterable[int | None]) -> tuple:
    """``gaps, blank, duplicate, truncated, illegal, cost, audit`` of a conversation's rows in order."""
    first = last = None
    distinct = 0
    for t in turns:
        if t is not None and t != last:
            first, last, distinct = t if first is None else first, t, distinct + 1
    faults = [0] * FAULTS
    for s in range(4 * FAULTS):
        faults[s % FAULTS] += symbols.count(s)
    initials = [(CLASSES + " ")[s // FAULTS] for s in symbols]
    illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:], strict=False))
    cost, audit = cheapest(symbols)
    return (0 if first is None else last - first + 1 - distinct, faults[BLANK], faults[DUPLICATE], faults[CUT], illegal, cost, audit)


def _batched(rows: Iterable[tuple], types: list[pa.DataType], names: list[str], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size, strings counted by their length."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if weight >= size:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, weight = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _audits(symbols: DataFrame) -> DataFrame:
    kind = symbols.schema["_c"].dataType.simpleString()

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def conversations() -> Iterator[tuple]:
            nonlocal id_type
            current, held, turns, any_row = None, bytearray(), [], False
            for batch in batches:
                id_type = batch.schema.field(0).type
                for c, t, s in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                    if any_row and c != current:
                        yield current, *summary(bytes(held), turns)
                        held, turns = bytearray(), []
                    current, any_row = c, True
                    held.append(s)
                    if not turns or t != turns[-1]:
                        turns.append(t)
            if any_row:
                yield current, *summary(bytes(held), turns)

        rows = conversations()
        first = next(rows, None)
        if first is not None:
            long = pa.int64()
            yield from _batched((r for part in ([first], rows) for r in part), [id_type, *[long] * 6, pa.string()],
                                ["_c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return symbols.mapInArrow(judge, f"_c {kind}, {SUMMARY}")


def _merged(normal: DataFrame) -> DataFrame:
    """Each conversation's audit with its summary, followed by its rows in order."""
    audits = _audits(_symbols(normal))
    none = F.lit(None)
    fields = audits.columns[1:]
    heads = audits.select("_c", F.lit(0).alias("_head"), none.cast(normal.schema["_t"].dataType).alias("_t"), none.cast("string").alias("_r"),
                          none.cast("binary").alias("_h"), none.cast("string").alias("_x"), F.struct(*fields).alias("_a"))
    rows = normal.select("_c", F.lit(1).alias("_head"), "_t", "_r", "_h", "_x", none.cast(heads.schema["_a"].dataType).alias("_a"))
    return (heads.unionByName(rows).repartition("_c").sortWithinPartitions("_c", "_head", F.asc_nulls_first("_t"), "_r", "_h")
            .select("_c", "_r", "_x", "_a"))


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, dict | None, str | None, str, str]]:
    """``(conversation, summary, None, "", "")`` for each conversation, then ``(…, None, letter, role, text)`` for its repaired rows."""
    audit, at, state, current = "", 0, START, None

    def added() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at:at + 1] == "I":
            at, state = at + 1, ADDED[state]
            yield current, None, "I", NAMES[state], ""

    for batch in portions(batches):
        for c, role, text, head in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if head is not None:
                yield from added()
                current, audit, at, state = c, head["audit"], 0, START
                yield c, head, None, "", ""
                continue
            yield from added()
            letter, at = audit[at], at + 1
            if letter != "D":
                state = SYSTEM if letter == "K" and state == START and role[:1] == "s" else ADDED[state]
                yield c, None, letter, role if letter == "K" else NAMES[state], text
    yield from added()


def repaired_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations, one row per turn: ``id_col, place`` (from 0), ``edit`` (K, R or I), ``role, text``.

    Null ids are one conversation, null turns come first, a null role or text is one space. Rows of equal turn go by role,
    then by the digest of role and text; a repeated row is a duplicate. Empty texts are blank and go. Other columns are not
    read. An empty table gives no rows.
    """
    merged = _merged(_normal(rows, id_col, turn_col, role_col, text_col))
    kind = merged.schema["_c"].dataType.simpleString()

    def turns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def noted():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield b

        def placed():
            place = 0
            for c, head, letter, role, text in _edited(noted()):
                if head is not None:
                    place = 0
                    continue
                yield c, place, letter, role, text
                place += 1

        found = placed()
        first = next(found, None)
        if first is not None:
            yield from _batched((r for part in ([first], found) for r in part), [id_type, pa.int64(), pa.string(), pa.string(), pa.string()],
                                [id_col, "place", "edit", "role", "text"])

    return merged.mapInArrow(turns, f"`{id_col}` {kind}, place long, edit string, role string, text string")


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """One row per conversation: ``id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``repaired_sha256`` is the digest of the repaired ``role:text`` lines, fed one turn at a time. Nulls, ties, repeated
    rows and empty tables as in ``repaired_turns``.
    """
    merged = _merged(_normal(rows, id_col, turn_col, role_col, text_col))
    kind = merged.schema["_c"].dataType.simpleString()
    fields = [f.split()[0] for f in SUMMARY.split(", ")]

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def noted():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield b

        def conversations():
            held, digest, lines = None, hashlib.sha256(), 0
            for c, head, _, role, text in _edited(noted()):
                if head is not None:
                    if held is not None:
                        yield *held, digest.hexdigest()
                    held, digest, lines = (c, *(head[f] for f in fields)), hashlib.sha256(), 0
                    continue
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
            if held is not None:
                yield *held, digest.hexdigest()

        found = conversations()
        first = next(found, None)
        if first is not None:
            yield from _batched((r for part in ([first], found) for r in part), [id_type, *[pa.int64()] * 6, pa.string(), pa.string()],
                                [id_col, *fields, "repaired_sha256"])

    return merged.mapInArrow(digests, f"`{id_col}` {kind}, {SUMMARY}, repaired_sha256 string")


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id_col, turn_col, role_col, text_col`` with known damage, to measure a repair by: of twenty rows, told by the CRC-32 of
    ``id:turn``, one is dropped, one emptied, one loses its ``.!?``, one is repeated and one becomes the user's. Nulls are one
    space here."""
    space = F.lit(" ")
    spelled: list[Column] = [F.coalesce(F.col(c).cast("string"), space) for c in (id_col, turn_col)]
    kind = F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1]).cast("binary")) % 20
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    marked = rows.select(F.col(id_col), F.col(turn_col), F.when(kind == 4, "user").otherwise(role).alias(role_col),
                         F.when(kind == 1, "").when(kind == 2, F.translate(text, "".join(ENDS), "")).otherwise(text).alias(text_col),
                         F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("__copies"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("__copies")))
    return marked.withColumn("__copy", copies).select(id_col, turn_col, role_col, text_col)
