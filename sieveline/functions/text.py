"""Scalar text functions built from Spark's own expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import catalog as C
from sieveline.functions.expr import let
from sieveline.functions.regex import java_pattern


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def decode_prompt(prompt: Column, encoding: Column) -> Column:
    """Base64 to UTF-8 where the request says so; null where it is neither, which the caller rejects."""
    return F.when(F.coalesce(encoding, F.lit(False)), decode_rule(prompt)).otherwise(prompt)


def decode_rule(rule: Column) -> Column:
    """Base64 rule text; null when it is no base64 or no UTF-8, so the caller can set it aside."""
    raw = F.try_to_binary(rule, F.lit("base64"))
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8"))


def truncate_utf8(s: Column, limit: int) -> tuple[Column, Column]:
    """(text cut to ``limit`` bytes without splitting a character, original size when cut else null)."""
    if limit <= 0:
        return s, F.lit(None).cast("int")
    size = F.octet_length(s)
    head = F.encode(s, "UTF-8")
    # A UTF-8 character has at most four bytes, so one of these four cuts falls on a boundary.
    cuts = [F.substring(head, F.lit(1), F.lit(max(limit - back, 0))) for back in range(4)]
    cut = F.coalesce(*[F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")) for c in cuts])
    return F.when(size > limit, cut).otherwise(s), F.when(size > limit, size)


def truncate_chars(s: Column, limit: int | None) -> Column:
    if not limit or limit <= 0:
        return s
    n = F.length(s)
    note = F.concat(F.lit("... (truncated, total="), n.cast("string"), F.lit(")"))
    return F.when(n > limit, F.concat(F.substring(s, 1, limit), note)).otherwise(s)


def preview_chunk(text: Column, chars: int = C.CHUNK_CHARS) -> Column:
    return F.substring(text, 1, chars)


def hash_text(s: Column) -> Column:
    return F.sha2(blank_to_null(s), 256)


def hash_content(content: Column) -> Column:
    return F.sha2(content, 256)


def apply_storage_policy(response: Column, *, hash_only: bool = False, store_text: bool = True,
                         max_bytes: int = 200_000) -> Column:
    """What of a response may be stored: its hash, its cut text, or nothing."""
    if hash_only:
        text, size, digest = F.lit(None).cast("string"), F.lit(0), hash_text(response)
    elif store_text:
        text, size = truncate_utf8(response, max_bytes)
        digest = F.lit("")
    else:
        text, size, digest = F.lit(None).cast("string"), F.lit(0), F.lit("")
    return F.struct(text.alias("text"), size.cast("int").alias("text_truncated_bytes"), digest.alias("hash_sha256"))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def shannon_entropy(s: Column) -> Column:
    """Bits per character."""

    def bits(v: Column) -> Column:
        def weight(acc: Column, ch: Column) -> Column:
            share = (F.length(v) - F.length(F.replace(v, ch, F.lit("")))) / F.length(v)
            return acc - let(share, lambda p: F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))

        return F.when(F.length(v) > 0, F.aggregate(F.array_distinct(F.split(v, "")), F.lit(0.0), weight)).otherwise(F.lit(0.0))

    return let(s, bits)


def token_shape(s: Column, hex_first: bool = False) -> Column:
    """base64, hex or mixed. Every hex string has the base64 shape too, so by default hex is never answered."""
    base64 = F.when(s.rlike(C.BASE64_SHAPE), "base64")
    hexa = F.when(s.rlike(C.HEX_SHAPE), "hex")
    return F.coalesce(*([hexa, base64] if hex_first else [base64, hexa]), F.lit("mixed"))


def is_high_entropy(s: Column, hex_first: bool = False) -> Column:
    def limit(which: int) -> Column:
        base64, hexa, mixed = (F.lit(C.ENTROPY_LIMITS[k][which]) for k in ("base64", "hex", "mixed"))
        shape = token_shape(s, hex_first)
        return F.when(shape == "base64", base64).when(shape == "hex", hexa).otherwise(mixed)

    # Length first: short candidates are the common case and never pay for the entropy.
    return (F.length(s) >= limit(0)) & (shannon_entropy(s) >= limit(1))


def luhn_valid(s: Column) -> Column:
    digits = F.regexp_replace(s, r"\D", "")
    return F.coalesce((F.length(digits) > 0) & F.call_function("luhn_check", digits), F.lit(False))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: v if v is None or unicodedata.is_normalized("NFKC", v) else unicodedata.normalize("NFKC", v))


# Besides ASCII: accented Latin-1 letters, Hangul syllables and unified ideographs: each is its own compatibility normal form and
# none combines with another, so a text made of them only is normal already.
STABLE_CHARS = "À-ÿ가-힣一-鿿"
# ASCII is passed by one range test per character; only the others are looked at more closely.
_UNSTABLE = rf"[^\x00-\x7F](?<![{STABLE_CHARS}])"


def nfkc(text: Column) -> Column:
    """Compatibility normal form; texts that are normal by their alphabet never cross to Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(_UNSTABLE), text)), text)


def normalize_obfuscation(text: Column, unicode_form: bool = True) -> Column:
    """NFKC, then the words people write for a dot become a dot."""
    return F.regexp_replace(nfkc(text) if unicode_form else text, "|".join(C.DOT_WORD_LIST), ".")


def hangul_digits(text: Column) -> Column:
    return F.translate(text, C.HANGUL_NUMERALS, C.ASCII_NUMERALS)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, java_pattern(r"[^\d]"), "")


def unified_decision(c: Column) -> Column:
    return F.upper(F.coalesce(c.cast("string"), F.lit("")))


def std_action(final_action: Column) -> Column:
    upper = F.upper(F.coalesce(final_action, F.lit("")))
    return (F.when(upper.startswith("MASK"), C.MASKING).when(upper.startswith("BLOCK"), C.BLOCK)
            .otherwise(C.ALLOW))


def block_message(category: Column, brand: str = "GUARD") -> Column:
    return F.concat(
        F.lit(f"[{brand}] 프롬프트 차단\n{brand} 정책에 의해 민감정보가 프롬프트에 포함된 것으로 탐지되었습니다.\n❌탐지 유형은 '"),
        category,
        F.lit("' 입니다.\n민감 정보를 전송할 경우, 기밀 정보 또는 개인 정보 유출등의 피해가 발생할 수 있으니 각별한 주의를 부탁드려요\n"
              f"요청하신 프롬프트는 {brand}에 의해서 요청이 차단되었습니다.\n세부 지침 사항은 관리자에게 문의해주세요\n        "))


def mask_message(category: Column, brand: str = "GUARD") -> Column:
    return F.concat(
        F.lit(f"[{brand}] 프롬프트 마스킹\n{brand} 정책에 의해 민감정보가 프롬프트에 포함된 것으로 탐지되었습니다.\n❌탐지 유형은 '"),
        category, F.lit("' 입니다.\n세부 지침 사항은 관리자에게 문의해주세요\n        "))


def service_name(code: Column) -> Column:
    """Code to service name, empty for codes the table does not hold."""
    names = F.create_map(*[F.lit(x) for kv in C.SERVICE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit(""))


def user_key(email: Column, service: Column) -> Column:
    return F.concat(email, F.lit("_"), service.cast("string"))


def safe_get(body: Column, path: str, type_: str = "string", default: Column | None = None) -> Column:
    """Value at a path of a variant, or the default when any step is missing, null or of another type."""
    found = F.try_variant_get(body, path, type_)
    return found if default is None else F.coalesce(found, default)
