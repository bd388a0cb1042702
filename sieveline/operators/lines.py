"""Masking whole lines of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_lines(text: Column, risky: Column, token: str = "[MASKED]") -> Column:
    """Lines whose 1-based number is in ``risky`` become the token; done in the text's row, nothing is exploded."""
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.when(
        F.array_contains(risky, i + 1), F.lit(token)).otherwise(line))
    return F.when(F.coalesce(F.size(risky), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(text)


def risky_line_numbers(verdicts: DataFrame, key: str) -> DataFrame:
    """Distinct risky line numbers per text from a long verdict table.

    Duplicates fall away in the partial aggregate, so an array never exceeds the number of lines of its text.
    """
    return (verdicts.where(F.col("risk") == "risky").groupBy(key)
            .agg(F.array_sort(F.collect_set("line")).alias("risky_lines")))


def mask_by_verdicts(df: DataFrame, key: str, text: str, verdicts: DataFrame, token: str = "[MASKED]") -> DataFrame:
    """Texts with their risky lines masked and listed."""
    risky = risky_line_numbers(verdicts, key)
    return df.join(risky, key, "left").withColumn(
        "masked_text", mask_lines(F.col(text), F.col("risky_lines"), token))
