"""Text functions as columns. `(?U)` makes Java's \\s, \\d, \\w and \\b know all of Unicode."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Characters that recognition confuses, and what they stand for.
CONFUSED, MEANT = "|lOoSBZ", "I100582"
# Numbers with separators, then plain ones.
NUMBER_PATTERNS = (r"(?U)(?i)\b[E0]*\d[\d\s\.,]{5,14}\d\b", r"(?U)(?i)\b[E0]*\d{6,10}\b")
# The same where words, digits and white space are those of ASCII; Java's own \b takes letters of all alphabets for words.
# What precedes a number is looked at behind its first character, as few characters can be that.
_FIRST, _END = "[Ee0-9](?<![0-9A-Za-z_].)", "(?![0-9A-Za-z_])"
_LED = "(?:(?<=[Ee0])[Ee0]*[0-9]|(?<=[0-9]))"
ASCII_NUMBER_PATTERNS = (rf"{_FIRST}{_LED}[0-9 \t\n\f\r.,]{{5,14}}[0-9]{_END}", rf"{_FIRST}(?:(?<=[Ee0])[Ee0]*[0-9]{{6,10}}|(?<=[0-9])[0-9]{{5,9}}){_END}")
#: Wherever a line may end.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def is_blank(text: Column) -> Column:
    """True for null and for texts of white space alone."""
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def lines(text: Column) -> Column:
    """The stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: x != "")


def normalize(text: Column) -> Column:
    """Confused characters replaced by digits and capitals."""
    return F.translate(text, CONFUSED, MEANT)


def normalize_digit_spans(text: Column) -> Column:
    """Only words that hold a digit are normalised, so that markers such as FORM stay as they are."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(w.rlike("[0-9]"), normalize(w)).otherwise(w)), " ")


def clean_number(number: Column) -> Column:
    """The digits of a number of 6 to 10 digits; null for anything else."""
    bare = F.ltrim(F.regexp_replace(F.translate(number, " .,", ""), r"\A[Ee]", ""), F.lit("0"))
    return F.when(bare.rlike(r"\A[0-9]{6,10}\z"), bare)


def extract_numbers(text: Column, ascii_only: bool = False) -> Column:
    """All different numbers of a text, those with separators first.

    ascii_only: a letter beyond ASCII ends a word, and any ASCII white space separates, as in RE2."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (ASCII_NUMBER_PATTERNS if ascii_only else NUMBER_PATTERNS)])
    if ascii_only:
        found = F.transform(found, lambda x: F.translate(x, "\t\n\f\r", "    "))
    return F.array_distinct(F.filter(F.transform(found, clean_number), lambda x: x.isNotNull()))


def parse_reference_name(name: Column) -> Column:
    """struct(expected, detected) of a file name E_detected_D_time.png or E_time.png; nulls for others."""
    both = r"\A(\d+)_detected_(\d+)_\d+\.png\z"
    one = r"\A(\d+)_\d+\.png\z"
    part = lambda p, i: F.nullif(F.regexp_extract(name, p, i), F.lit(""))
    return F.struct(F.coalesce(part(both, 1), part(one, 1)).alias("expected"), part(both, 2).alias("detected"))


def leading_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"\A(\d+)", 1), F.lit(""))


def added_prefix(expected: Column, detected: Column) -> Column:
    """What detected has before expected; null if it doesn't end with it or has nothing before."""
    return F.when(detected.endswith(expected) & (F.length(detected) > F.length(expected)), F.substr(detected, F.lit(1), F.length(detected) - F.length(expected)))


def added_suffix(expected: Column, detected: Column) -> Column:
    return F.when(detected.startswith(expected) & (F.length(detected) > F.length(expected)), F.substr(detected, F.length(expected) + 1))


def missing_end(expected: Column, detected: Column) -> Column:
    """Where a shorter detection lacks characters: `end`, `start`, or null."""
    shorter = F.length(detected) < F.length(expected)
    return F.when(shorter & expected.startswith(detected), "end").when(shorter & expected.endswith(detected), "start")


def confusions(expected: Column, detected: Column) -> Column:
    """Places (from 0) of texts of one length where they differ: array of struct(position, expected, detected)."""
    chars = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(c, i, F.lit(1)))
    both = F.transform(F.arrays_zip(chars(expected).alias("e"), chars(detected).alias("d")), lambda x, i: F.struct(i.cast("int").alias("position"), x["e"].alias("expected"), x["d"].alias("detected")))
    empty = F.filter(both, lambda x: F.lit(False))
    same_length = (F.length(expected) == F.length(detected)) & (F.length(expected) > 0)
    return F.when(same_length, F.filter(both, lambda x: x["expected"] != x["detected"])).otherwise(empty)


def apply_rules(value: Column, rules: Column) -> Column:
    """Rules struct(type, pattern) in order: strip_prefix or strip_suffix."""

    def one(v: Column, rule: Column) -> Column:
        size, p = F.length(rule["pattern"]), rule["pattern"]
        cut_front = F.when(v.startswith(p), F.substr(v, size + 1)).otherwise(v)
        cut_back = F.when(v.endswith(p), F.substr(v, F.lit(1), F.length(v) - size)).otherwise(v)
        return F.when(rule["type"] == "strip_prefix", cut_front).when(rule["type"] == "strip_suffix", cut_back).otherwise(v)

    return F.aggregate(rules, value, one)


def substitute(value: Column, rules: Column) -> Column:
    """Rules struct(detected, correction) in order, each replacing all it finds."""
    return F.aggregate(rules, value, lambda v, r: F.replace(v, r["detected"], r["correction"]))


def human_count(n: Column) -> Column:
    """One place after the point, rounded by the binary value as it is, halves to even."""
    one = lambda x, unit: F.concat(F.replace(F.format_number(x, 1), F.lit(","), F.lit("")), F.lit(unit))
    million, thousand = one(n / 1_000_000.0, " M"), one(n / 1_000.0, " k")
    return F.when(n >= 1_000_000, million).when(n >= 1_000, thousand).otherwise(n.cast("string"))


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's 2 M / T of two strings; 1 for two empty ones."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
