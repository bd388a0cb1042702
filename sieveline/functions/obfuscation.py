"""Personal data written to dodge plain patterns: dot words, Hangul numerals, odd separators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import catalog as C
from sieveline.functions import spans as S
from sieveline.functions import text as X
from sieveline.functions.expr import let
from sieveline.functions.regex import java_pattern

# A number begins with seven places without a Latin letter. Looked for in front of each match, this passes over words by one
# table lookup a character, where the pattern itself would try its prefixes and its Unicode classes.
NUMBER_AHEAD = "(?=[^A-Za-z]{7})"
# Likewise all addresses begin with a Hangul syllable, a digit or a bracket.
ADDRESS_AHEAD = r"(?=[가-힣(\d])"
_ADDRESS_GATE = java_pattern(C.GATE_ROAD_NUMBER)
_ADDRESSES = tuple(java_pattern(ADDRESS_AHEAD + p) for p in C.OBFUSCATED_ADDRESSES)


def count_email(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.regexp_count(text, F.lit(java_pattern(C.OBFUSCATED_EMAIL)))).otherwise(
        F.when(text.isNotNull(), 0))


def mask_email(text: Column, token: str = C.MASK_TOKEN) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, java_pattern(C.OBFUSCATED_EMAIL), token)).otherwise(
        text)


def number_blocks(text: Column) -> Column:
    """Number-like runs as ``array<struct<start,end,kind,digits,phone_like>>``; kind is account, phone or none."""
    return let(text, _number_blocks)


def _number_blocks(text: Column) -> Column:
    found = S.find_spans(text, NUMBER_AHEAD + C.NUMBER_BLOCK, "number", gate=text.rlike("[^A-Za-z]{7}"))

    def classify(s: Column) -> Column:
        left = F.greatest(s["start"] - C.CONTEXT_CHARS, F.lit(0))
        context = F.substring(text, left + 1, s["end"] + C.CONTEXT_CHARS - left)

        def judged(ascii_: Column, digits: Column) -> Column:
            phone_like = ascii_.rlike(java_pattern(C.PHONE_HINT)) | F.length(digits).between(10, 12)
            kind = (F.when((F.length(digits) >= 10) & context.rlike(java_pattern(C.BANK_WORDS)), "account")
                    .when(phone_like, "phone").otherwise("none"))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), digits.alias("digits"),
                            phone_like.alias("phone_like"))

        return let(X.hangul_digits(s["value"]), lambda a: let(X.digits_only(a), lambda d: judged(a, d)))

    return F.transform(found, classify)


def mask_numbers(text: Column, blocks: Column, token: str = C.MASK_TOKEN) -> Column:
    risky = F.filter(blocks, lambda b: b["kind"] != "none")
    return S.apply_replacements(text, F.transform(risky, lambda b: F.struct(
        b["start"].alias("start"), b["end"].alias("end"), F.lit(token).alias("replacement"))))


def masked_addresses(text: Column, token: str = C.MASK_TOKEN) -> Column:
    """``struct<text,n>``: masked text and number of addresses; the five patterns are applied one after the other."""
    def step(state: Column, patterns: tuple[str, ...]) -> Column:
        if not patterns:
            return state
        java = patterns[0]
        return let(F.struct(state["text"].alias("text"), state["n"].alias("n"), F.regexp_count(state["text"], F.lit(java)).alias("more")), lambda s: let(F.struct(
            F.when(s["more"] > 0, F.regexp_replace(s["text"], java, token)).otherwise(s["text"]).alias("text"),
            (s["n"] + s["more"]).alias("n")), lambda done: step(done, patterns[1:])))

    done = F.when(text.rlike(_ADDRESS_GATE), step(F.struct(text.alias("text"), F.lit(0).alias("n")), _ADDRESSES))
    return F.coalesce(done, F.struct(text.alias("text"), F.when(text.isNotNull(), 0).alias("n")))


def mask_addresses(text: Column, token: str = C.MASK_TOKEN) -> tuple[Column, Column]:
    """(masked text, number of addresses) as of ``masked_addresses``."""
    done = masked_addresses(text, token)
    return done["text"], done["n"]


def count_kind(blocks: Column, kind: str) -> Column:
    return F.size(F.filter(blocks, lambda b: b["kind"] == kind))


def _partial_email(email: Column) -> Column:
    flat = F.replace(email, F.lit(" "), F.lit(""))
    local = F.substring_index(flat, "@", 1)
    at = F.locate("@", flat)
    domain = F.substring(flat, at + 1, F.length(flat))
    shown = F.when(F.length(local) <= 2, 1).otherwise(2)
    return F.concat(F.substring(local, F.lit(1), shown), F.repeat(F.lit("*"), F.length(local) - shown),
                    F.lit("@"), domain)


def partial_samples(normalized: Column, types: Column) -> Column:
    """Audit-safe samples of an already normalised text, one per listed type; null when there are none.

    E-mail keeps two characters and the domain, numbers keep the first three and last four digits, addresses the outer
    two characters on each side.
    """
    return let(normalized, lambda text: _partial_samples(text, types))


def _first_digits(blocks: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(blocks, test), F.lit(1))["digits"]


def _partial_samples(normalized: Column, types: Column) -> Column:
    email = F.when(F.contains(normalized, F.lit("@")), F.regexp_extract(normalized, java_pattern(C.OBFUSCATED_EMAIL), 0)).otherwise("")
    # A block can be phone-like and account-like at once; the phone sample looks at the phone test alone.
    digits = let(number_blocks(normalized), lambda blocks: F.struct(
        _first_digits(blocks, lambda b: b["kind"] == "account").alias("account"),
        _first_digits(blocks, lambda b: b["phone_like"]).alias("phone")))
    address = F.when(normalized.rlike(_ADDRESS_GATE), F.trim(F.coalesce(*[X.blank_to_null(F.regexp_extract(normalized, p, 0)) for p in _ADDRESSES])))

    return let(F.struct(email.alias("email"), digits.alias("digits"), address.alias("address")), lambda found: _samples(found, types))


def _samples(found: Column, types: Column) -> Column:
    email, address = found["email"], found["address"]
    account, phone = found["digits"]["account"], found["digits"]["phone"]

    def wants(t: str) -> Column:
        return F.array_contains(types, t)

    def tail(d: Column) -> Column:
        return F.right(d, F.lit(4))

    samples = F.array(
        F.when(wants("email") & (email != ""), _partial_email(email)),
        F.when(wants("account"), F.concat(
            F.substring(account, 1, 3), F.lit("."),
            F.repeat(F.lit("*"), F.greatest(F.length(account) - 7, F.lit(0))), F.lit("."), tail(account))),
        F.when(wants("phone"), F.when(F.length(phone) >= 7, F.concat(F.substring(phone, 1, 3), F.lit(".****."), tail(phone)))
               .when(phone.isNotNull(), "[PHONE]")),
        F.when(wants("address"), F.when(F.length(address) > 6, F.concat(
            F.substring(address, 1, 2), F.lit("***"), F.right(address, F.lit(2)))).when(address.isNotNull(), "[ADDRESS]")),
    )
    return X.blank_to_null(F.array_join(F.array_compact(samples), ", "))
