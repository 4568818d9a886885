"""Cleaning and reading of label text, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\p{Z}\x85]+"
#: Signs that surround a code, and signs that lead a field's value.
AROUND, LEADING = ":.,;-_|'\"`=*", ":.-_|;,'\" ="
DATE = r"(20\d{2})[-/.](\d{2})[-/.](\d{2})"
BARCODE = r"(?<!\d)\d{12,14}(?!\d)"
NUMBER = r"\d+(?:[.,]\d+)?"


def normalize_code(code: Column) -> Column:
    return F.upper(F.regexp_replace(code, WHITE, ""))


def clean_code(value: Column) -> Column:
    """The code without white space and the signs around it; null when nothing is left."""
    return F.nullif(F.btrim(normalize_code(value), F.lit(AROUND)), F.lit(""))


def letters_key(word: Column) -> Column:
    """Letters and digits of a key, digits as the letters they are read for."""
    return F.translate(F.upper(F.regexp_replace(F.coalesce(word, F.lit("")), r"[^\p{L}\p{Nd}]", "")), "1058", "IOSB")


def char_class(char: Column) -> Column:
    """0 letter, 1 digit, 2 other."""
    return F.when(char.rlike(r"^\p{L}"), 0).when(char.rlike(r"^\p{Nd}"), 1).otherwise(2)


def plausible_token(token: Column, least: int, most: int) -> Column:
    digits = F.length(F.regexp_replace(token, r"[^\p{Nd}]", ""))
    letters = F.length(F.regexp_replace(token, r"[^\p{L}]", ""))
    n = F.length(token)
    return F.coalesce(
        n.between(least - 1, most + 2) & (digits >= 3) & (letters >= 1) & ~token.rlike("[.,:;%\"']") & token.rlike(r"^[\p{L}\p{Nd}]") & (digits + letters >= n - 1),
        F.lit(False),
    )


def first_number(text: Column) -> Column:
    return F.replace(F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def barcode(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, BARCODE, 0), F.lit(""))


def iso_date(text: Column) -> Column:
    return F.when(text.rlike(DATE), F.concat_ws("-", *(F.regexp_extract(text, DATE, g) for g in (1, 2, 3))))


def field_value(words: Column) -> Column:
    """A field's value from its words: dates go, and the signs in front."""
    joined = F.regexp_replace(F.concat_ws(" ", words), DATE, "")
    return F.trim(F.ltrim(F.trim(joined), F.lit(LEADING)))


def metres(quantity: Column) -> Column:
    """A length in metres; yards are told by the first Y or M."""
    n = first_number(quantity)
    return F.when(F.regexp_extract(F.upper(quantity), "[YM]", 0) == "Y", n * 0.9144).otherwise(n)


def weight_consistency(gsm: Column, width_cm: Column, quantity_m: Column, net_kg: Column) -> Column:
    implied = gsm * (width_cm / 100.0) * quantity_m / 1000.0
    return F.when((net_kg > 0) & (implied > 0), net_kg / implied)
