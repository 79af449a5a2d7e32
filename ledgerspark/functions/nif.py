"""Spanish tax identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control letters, company letters and their kinds of control, placeholders, token patterns.
PERSON_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
COMPANY_LETTERS = "JABCDEFGHI"
COMPANY_KINDS = "ABCDEFGHJNPQRSUVW"
DIGIT_ONLY = "ABEH"
LETTER_ONLY = "PQSNW"
PLACEHOLDERS = ("00000000T", "99999999R")
TOKEN = r"(?i)\b([XYZ]\d{7}[A-Z]|\d{8}[A-Z]|[ABCDEFGHJNPQRSUVW]-?\d{7}[0-9A-J])\b"


def normalize(nif: Column) -> Column:
    """Upper case without white space, dots and hyphens; null becomes empty."""
    return F.upper(F.regexp_replace(F.coalesce(nif, F.lit("")), r"[\s.\-]", ""))


def person_valid(nif: Column) -> Column:
    """Whether the letter of a normalised personal id is the remainder's by 23; X, Y, Z start as 0, 1, 2."""
    digits = F.concat(F.translate(F.substring(nif, 1, 1), "XYZ", "012"), F.substring(nif, 2, 7))
    at = F.expr("1").cast("int") + (digits.try_cast("bigint") % 23).cast("int")
    return F.coalesce(F.substring(F.lit(PERSON_LETTERS), at, F.lit(1)) == F.substring(nif, 9, 1), F.lit(False)) & digits.rlike("^[0-9]{8}$")


def company_valid(nif: Column) -> Column:
    """Whether the control of a normalised company id fits: places 1, 3, 5, 7 doubled and digit-summed."""
    def digit(i: int) -> Column:
        return F.substring(nif, i + 1, 1).try_cast("int")

    total = sum((2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0) for i in (1, 3, 5, 7)), F.lit(0)) + digit(2) + digit(4) + digit(6)
    d = (10 - total % 10) % 10
    letter = F.substring(F.lit(COMPANY_LETTERS), d + 1, F.lit(1))
    last, kind = F.substring(nif, 9, 1), F.substring(nif, 1, 1)
    by_digit, by_letter = last == d.cast("string"), last == letter
    fits = F.when(kind.isin(*DIGIT_ONLY), by_digit).when(kind.isin(*LETTER_ONLY), by_letter).otherwise(by_digit | by_letter)
    return F.coalesce(fits, F.lit(False)) & nif.rlike("^.[0-9]{7}")


def is_valid(nif: Column) -> Column:
    """Whether an id in any spelling is valid; null and other lengths are not."""
    return F.transform(F.array(normalize(nif)), _fits)[0]  # so it is normalised once


def _fits(n: Column) -> Column:
    """Whether a normalised id is valid."""
    return F.when(F.length(n) != 9, F.lit(False)).when(n.rlike("^[XYZ0-9]"), person_valid(n)).when(
        n.rlike(f"^[{COMPANY_KINDS}]"), company_valid(n)).otherwise(F.lit(False))


def is_placeholder(nif: Column) -> Column:
    return normalize(nif).isin(*PLACEHOLDERS)


def find_all(text: Column) -> Column:
    """Valid ids in a text, normalised, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, normalize)), _fits)


def issuer_and_receiver(ids: Column) -> Column:
    """Struct (issuer, receiver): the first company issues; a person, else a second company, receives; without companies the first two ids."""
    companies, persons = F.filter(ids, lambda x: x.rlike("^[A-HJ-NP-SUVW]")), F.filter(ids, lambda x: x.rlike("^[XYZ0-9]"))
    has = F.size(companies) > 0
    first = lambda a, i: F.try_element_at(a, F.lit(i))
    return F.struct(F.when(has, first(companies, 1)).otherwise(first(ids, 1)).alias("emisor"),
                    F.when(has, F.coalesce(first(persons, 1), first(companies, 2))).otherwise(first(ids, 2)).alias("receptor"))
