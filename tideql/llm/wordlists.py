"""Texts as lists of lower-case alphanumeric words, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """The words with one space between them: A-Z lowered, all other ASCII signs but digits and letters apart."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN, " "))


def listed(normal_text: Column) -> Column:
    """The words; of an empty text, none."""
    return F.when(normal_text == "", F.array().cast("array<string>")).otherwise(F.split(normal_text, " "))


#: The same in DuckDB.
SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
