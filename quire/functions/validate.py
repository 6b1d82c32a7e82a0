"""Validators: objects that turn a field's column into struct(valid, value, errors, normalized)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import strip

OUTCOME = "struct<valid:boolean,value:string,errors:array<string>,normalized:string>"


def outcome(value: Column, valid: Column, shown: Column, error: Column, normalized: Column | None = None) -> Column:
    """The struct; a null value is invalid for being missing."""
    none = F.lit(None).cast("string")
    error = F.when(value.isNull(), F.array(F.lit("missing value"))).when(valid, F.array().cast("array<string>")).otherwise(F.array(error))
    return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), shown.alias("value"), error.alias("errors"), (none if normalized is None else normalized).alias("normalized"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def luhn(number: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn check."""
    n = F.length(number)

    def of(i: Column) -> Column:
        d = F.substr(number, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), of), F.lit(0), lambda a, x: a + x)
    return (n > 0) & (total % 10 == 0)


def modulus(number: Column, n: int) -> Column:
    """Whether a string of digits, read as a number, is a multiple of n."""
    rest = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), lambda a, i: (a * 10 + F.substr(number, i, F.lit(1)).cast("int")) % n)
    return (F.length(number) > 0) & (rest == 0)


class Validator:
    def check(self, value: Column) -> Column:
        raise NotImplementedError


@dataclass
class Regex(Validator):
    """The stripped value matches the pattern from end to end."""

    pattern: str
    description: str = ""

    def check(self, value: Column) -> Column:
        shown = strip(value)
        return outcome(value, shown.rlike(rf"(?U)\A(?:{self.pattern})\z"), shown, F.lit(f"does not match {self.description or self.pattern}"))


@dataclass
class Length(Validator):
    """Characters, or digits only, from least to most."""

    least: int
    most: int
    digits_only: bool = False

    def check(self, value: Column) -> Column:
        counted = digits(value) if self.digits_only else strip(value)
        n = F.length(counted)
        return outcome(value, n.between(self.least, self.most), strip(value), F.format_string(f"length %d outside [{self.least}, {self.most}]", n), counted if self.digits_only else None)


@dataclass
class Choice(Validator):
    choices: Sequence[str]
    case_insensitive: bool = False

    def check(self, value: Column) -> Column:
        shown = strip(value)
        known = [c.lower() for c in self.choices] if self.case_insensitive else list(self.choices)
        return outcome(value, (F.lower(shown) if self.case_insensitive else shown).isin(known), shown, F.concat(F.lit("'"), value, F.lit("' not in allowed choices")))


@dataclass
class Checksum(Validator):
    """The value's digits, one at least, pass a function of a column: `luhn`, `modulus`, or a pandas UDF."""

    passes: Callable[[Column], Column]
    description: str = "checksum"

    def check(self, value: Column) -> Column:
        d = digits(value)
        return outcome(value, F.when(d == "", False).otherwise(self.passes(d)), strip(value), F.lit(f"failed {self.description}"), d)


@dataclass
class Composite(Validator):
    """All rules, or any of them; errors of the failing ones in order, and the first normalised value that isn't empty."""

    rules: Sequence[Validator]
    require_all: bool = True

    def check(self, value: Column) -> Column:
        results = F.array(*[r.check(value) for r in self.rules]) if self.rules else F.array().cast(f"array<{OUTCOME}>")
        valid = (F.forall if self.require_all else F.exists)(results, lambda r: r["valid"])
        errors = F.flatten(F.transform(F.filter(results, lambda r: ~r["valid"]), lambda r: r["errors"]))
        first = F.try_element_at(F.filter(results, lambda r: F.coalesce(r["normalized"] != "", F.lit(False))), F.lit(1))
        return F.struct(valid.alias("valid"), F.nullif(strip(value), F.lit("")).alias("value"), errors.alias("errors"), first["normalized"].alias("normalized"))


# The rule sets of the sample document types.
RULES: dict[str, Validator] = {
    "id_number": Composite([Regex(r"ID-\d{8}", "ID card number format 'ID-########'"), Length(10, 11)]),
    "invoice_number": Composite([Regex(r"INV-\d{4}-\d{4}", "invoice number format 'INV-YYYY-NNNN'")]),
    "total_amount": Regex(r"\d{1,7}(\.\d{2})?", "amount with two decimal places"),
    "form_code": Composite([Regex(r"FORM-[A-Z0-9]{6}", "form code format 'FORM-XXXXXX'")]),
}


def present(value: Column) -> Column:
    """Valid if neither null nor empty."""
    ok = F.coalesce(value, F.lit("")) != ""
    return F.struct(ok.alias("valid"), value.alias("value"), F.array().cast("array<string>").alias("errors"), F.lit(None).cast("string").alias("normalized"))


def succeeded(validation: Column) -> Column:
    """A document's success: one outcome at least, and all of the map valid."""
    return (F.size(validation) > 0) & F.forall(F.map_values(validation), lambda v: F.coalesce(v["valid"], F.lit(False)))


def overlaid(validation: Column, external: Column) -> Column:
    """The map with the external outcomes in place of its own of the same field; a null map changes nothing."""
    merged = F.map_zip_with(validation, external, lambda _, own, other: F.coalesce(other, own))
    return F.when(external.isNull(), validation).otherwise(merged)


def match_vector(validation: Column, fields: Sequence[str]) -> Column:
    """For each declared field whether it is valid."""
    return F.array(*[F.coalesce(F.try_element_at(validation, F.lit(f))["valid"], F.lit(False)) for f in fields])
