"""Text analysis and value parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of the text index.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def tokens(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-cased runs of letters and digits without stop words, in order; null gives an empty list."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def safe_int(text: Column, default: int = 0) -> Column:
    """text as an int, default where it is null or no number."""
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(default))


def none_if_zero(n: Column) -> Column:
    return F.nullif(n, F.lit(0))


def safe_bool(text: Column) -> Column:
    """True for 1, true and yes in any case; null and all else is false."""
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes"), F.lit(False))


def parse_date(text: Column) -> Column:
    """An ISO date and time, with or without a trailing Z, in UTC; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", ""))


def simple_tags(text: Column) -> Column:
    """Tags of the two plain archive formats, <a><b> and |a|b|."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[<>|]+"), lambda x: F.trim(x) != "")


def mentions(text: Column, length: int = 500) -> Column:
    """Capitalised ASCII words of three letters or more within the first `length` characters."""
    return F.filter(F.regexp_extract_all(F.substring(text, 1, length), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[A-Z][a-zA-Z]{2,}$"))


def long_numbers(text: Column) -> Column:
    """Runs of at least four digits that stand alone, as an answer cites ids."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[0-9]{4,}$"))


def excerpt(text: Column, length: int) -> Column:
    """text cut after `length` characters, an ellipsis where something was cut."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)
