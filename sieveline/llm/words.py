"""Words of a text as column expressions: no Python on the executors."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between words of ASCII letters, digits and any other characters beyond ASCII, in lower-cased text.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text of either case.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What stands between words that only white space separates.
SPACE_GAP = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def split_words(text: Column, gap: str) -> Column:
    """Words of ``text``; the first and the last element may be empty. Null counts as the empty text."""
    return F.split(F.coalesce(text, F.lit("")), gap)


def leading(parts: Column) -> Column:
    """1 if the first element of ``split_words`` is empty, else 0."""
    return (F.element_at(parts, 1) == "").cast("int")


def word_count(parts: Column) -> Column:
    """Words in the result of ``split_words``, without empty elements."""
    trailing = (F.element_at(parts, -1) == "").cast("int")
    return F.greatest(F.lit(0), F.size(parts) - leading(parts) - trailing)
