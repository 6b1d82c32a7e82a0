"""Field extractors: named column expressions over a text, each with its validation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import lines, strip
from quire.functions.validate import Regex, Validator, match_vector, overlaid, present, succeeded


@dataclass
class OfLines:
    """A field's expression over the text's lines, which are split once for all such fields."""

    of: Callable[[Column], Column]

    def __call__(self, text: Column) -> Column:
        return self.of(lines(text))


@dataclass
class Extractor:
    """fields: expressions by name; checks: a validator or a function of the column (default: always valid)."""

    document_type: str
    fields: Mapping[str, Callable[[Column], Column]]
    checks: Mapping[str, Validator | Callable[[Column], Column]] = field(default_factory=dict)
    hooks: Sequence[Callable[[DataFrame], DataFrame]] = ()  # see the results as they leave, such as a sink of outcomes

    def extract(self, text: Column, split: Column | None = None) -> Column:
        """map<string,string>; what isn't found is ''. split: the text's lines, where they are known."""
        found = lambda of: of.of(split) if isinstance(of, OfLines) and split is not None else of(text)
        return F.create_map(*[x for name, of in self.fields.items() for x in (F.lit(name), F.coalesce(found(of), F.lit("")))])

    def validate(self, values: Column) -> Column:
        always = lambda c: F.struct(F.lit(True).alias("valid"), c.alias("value"), F.array().cast("array<string>").alias("errors"), F.lit(None).cast("string").alias("normalized"))
        parts = []
        for name in self.fields:
            check, value = self.checks.get(name, always), F.element_at(values, F.lit(name))
            parts += [F.lit(name), check.check(value) if isinstance(check, Validator) else check(value)]
        return F.create_map(*parts)

    def process(self, df: DataFrame, text_col: str = "text", external: Column | None = None) -> DataFrame:
        """df with fields, validation, success and matches."""
        df = df.withColumn("__lines", lines(F.col(text_col)))
        df = df.withColumn("fields", self.extract(F.col(text_col), F.col("__lines"))).drop("__lines")
        df = df.withColumn("validation", self.validate(F.col("fields")))
        if external is not None:
            df = df.withColumn("validation", overlaid(F.col("validation"), external))
        df = df.withColumn("success", succeeded(F.col("validation"))).withColumn("matches", match_vector(F.col("validation"), list(self.fields)))
        for hook in self.hooks:
            df = hook(df)
        return df


def first_match(pattern: str, group: int = 0) -> Callable[[Column], Column]:
    return lambda text: F.regexp_extract(text, rf"(?U){pattern}", group)


def _first(items: Column, at: int = 1) -> Column:
    return F.try_element_at(items, F.lit(at))


# Patterns of the sample documents' fields.
ID_NUMBER, INVOICE_NUMBER, FORM_CODE, PLATE_NUMBER = r"\bID-\d{8}\b", r"\bINV-\d{4}-\d{4}\b", r"\bFORM-[A-Z0-9]{6}\b", r"\bPLT-\d{4}\b"
TOTAL = r"(?:TOTAL|TOTal|Total)[\s:]*\$?\s*(\d{1,7}(?:\.\d{2})?)"


@OfLines
def _id_number(rows: Column) -> Column:
    """From the last line that has one."""
    return F.regexp_extract(F.coalesce(_first(F.filter(rows, lambda x: x.rlike(rf"(?U){ID_NUMBER}")), -1), F.lit("")), rf"(?U){ID_NUMBER}", 0)


@OfLines
def _full_name(rows: Column) -> Column:
    """All other lines."""
    return F.array_join(F.filter(rows, lambda x: ~x.rlike(rf"(?U){ID_NUMBER}")), " ")


@OfLines
def _vendor(rows: Column) -> Column:
    return _first(F.filter(rows, lambda x: F.lower(x).rlike("vendor|supplier")))


def signature(fold_case: bool = False) -> Callable[[Column], Column]:
    """`yes` if three letters follow within 200 characters of the marker, else `no`; only its lower-case form is removed, unless case is folded."""

    def of(text: Column) -> Column:
        at = F.locate("signature", F.lower(text))
        near = F.substr(text, at, F.lit(200))
        rest = F.regexp_replace(near, r"\A(?s)(.*?)" + ("(?i:signature)" if fold_case else "signature"), "$1")
        return F.when((at > 0) & rest.rlike("[A-Za-z]{3}"), "yes").otherwise("no")

    return of


def told(value: Column) -> Column:
    """Valid if it is `yes` or `no`."""
    return F.struct(F.coalesce(value.isin("yes", "no"), F.lit(False)).alias("valid"), value.alias("value"), F.array().cast("array<string>").alias("errors"), F.lit(None).cast("string").alias("normalized"))


@OfLines
def _owner(rows: Column) -> Column:
    """After the colon of the last line that starts with owner."""
    line = _first(F.filter(rows, lambda x: F.lower(x).startswith("owner")), -1)
    return strip(F.regexp_extract(line, r"(?s)\A[^:]*:(.*)\z", 1))


ID_CARD = Extractor("id_card", {"id_number": _id_number, "full_name": _full_name}, {"id_number": Regex(r"ID-\d{8}", "ID card number"), "full_name": present})
INVOICE = Extractor(
    "invoice",
    {"invoice_number": first_match(INVOICE_NUMBER), "total_amount": first_match(TOTAL, 1), "vendor": _vendor},
    {"invoice_number": Regex(r"INV-\d{4}-\d{4}", "invoice number"), "total_amount": Regex(r"\d{1,7}(\.\d{2})?", "amount"), "vendor": present},
)
FORM = Extractor("form", {"form_code": first_match(FORM_CODE), "signature_present": signature()}, {"form_code": Regex(r"FORM-[A-Z0-9]{6}", "form code"), "signature_present": told})
PLATE = Extractor("license_plate", {"plate": first_match(PLATE_NUMBER), "owner": _owner}, {"plate": Regex(r"PLT-\d{4}", "license plate"), "owner": present})
