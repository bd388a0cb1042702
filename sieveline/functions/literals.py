"""Literals that a pattern cannot do without, and texts folded so that they are found whatever their case.

A rule can only match a text that contains one of its literals. One automaton over the literals of all rules names, in one
reading of a text, the few rules worth trying on it; what it costs does not depend on how many rules there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from re import _constants as K
from re import _parser

from sieveline.functions.regex import FLAG_ASCII, FLAG_IGNORECASE

#: More literals of one pattern than this would make the automaton large for little.
MOST = 64
_ONE_LETTER = {"ſ": "s", "ı": "i"}
_FOLD = str.maketrans(_ONE_LETTER)


def fold(text: str) -> str:
    """Lower case, with the two letters whose upper case is an ASCII letter written as that letter's lower case.

    A pattern that ignores case matches ``k`` in a Kelvin sign and ``s`` in a long s; both are found in the folded text.
    """
    return text.lower().translate(_FOLD)


def _usable(code: int, ignore_case: bool) -> bool:
    # A final sigma's lower case depends on what follows; letters beyond ASCII have case partners of many kinds.
    return code < 128 or (not ignore_case and code != 0x3A3)


def _worth(literals: frozenset[str]) -> int:
    """How rare a text with one of them may be: the length of the shortest; a lone letter or digit is worth nothing."""
    return min((len(x) if len(x) > 1 or not x.isalnum() else 0 for x in literals), default=0)


def _of_sequence(items: Iterable[tuple], ignore_case: bool) -> frozenset[str] | None:
    found: list[frozenset[str]] = []
    run: list[str] = []

    def close() -> None:
        if run:
            found.append(frozenset([fold("".join(run))]))
            run.clear()

    for op, arg in items:
        if op is K.LITERAL and _usable(arg, ignore_case):
            run.append(chr(arg))
            continue
        if op is not K.AT:  # a place has no width
            close()
        inner = _of_node(op, arg, ignore_case)
        if inner is not None:
            found.append(inner)
    close()
    return max(found, key=_worth, default=None)


def _of_node(op, arg, ignore_case: bool) -> frozenset[str] | None:
    if op is K.BRANCH:
        each = [_of_sequence(branch, ignore_case) for branch in arg[1]]
        if any(x is None for x in each):
            return None
        joined = frozenset().union(*each)
        return joined if len(joined) <= MOST else None
    if op is K.SUBPATTERN:
        _, on, off, inner = arg
        return _of_sequence(inner, bool((ignore_case or on & FLAG_IGNORECASE) and not off & FLAG_IGNORECASE))
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        least, _, inner = arg
        return _of_sequence(inner, ignore_case) if least else None
    if op is K.ATOMIC_GROUP:
        return _of_sequence(arg, ignore_case)
    return None


def mandatory(pattern: str, flags: int = 0) -> frozenset[str] | None:
    """Folded literals of which each text that ``pattern`` matches has at least one, once it is folded; None if none is known."""
    try:
        tree = _parser.parse(pattern, flags & ~FLAG_ASCII)
    except (re.error, OverflowError, ValueError):
        return None
    found = _of_sequence(tree, bool(tree.state.flags & FLAG_IGNORECASE))
    return found if found and _worth(found) else None


def automaton(literals: Sequence[frozenset[str]]):
    """Automaton over the literals of patterns ``0, 1, …``; ``named`` reads a folded text with it."""
    from ahocorasick import Automaton

    places: dict[str, list[int]] = {}
    for i, each in enumerate(literals):
        for literal in each:
            places.setdefault(literal, []).append(i)
    out = Automaton()
    for literal, at in places.items():
        out.add_word(literal, tuple(at))
    out.make_automaton()
    return out


def named(machine, text: str) -> list[int]:
    """Patterns one of whose literals the text has, in order. A literal is looked up once, however often it is there."""
    return sorted({i for at in {at for _, at in machine.iter(fold(text))} for i in at})
