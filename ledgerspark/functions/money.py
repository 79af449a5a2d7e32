"""Amounts, rates and tolerances as Column expressions. Money is in cents unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HEADER_TOLERANCE, LINE_TOLERANCE, VAT_RATES


def q2(x: Column) -> Column:
    """Two decimals, half away from zero."""
    return F.round(x.cast("decimal(38,6)"), 2)


def format_euro(cents: Column) -> Column:
    """es-ES text with dots between thousands and a comma; a dash for null."""
    text = F.translate(F.format_number((F.abs(cents) / 100).cast("decimal(20,2)"), 2), ",.", ".,")
    return F.when(cents.isNull(), F.lit("—")).otherwise(F.concat(F.when(cents < 0, "-").otherwise(""), text, F.lit(" €")))


def spelled(cents: Column) -> Column:
    """What `format_euro` writes before the sign, for whole numbers of cents; up to a million euros without a number format."""
    div = lambda a, n: F.call_function("div", a, F.lit(n))
    c = F.abs(cents)
    whole = div(c, 100)
    text = (F.when(whole < 1000, whole.cast("string")).when(whole < 1_000_000, F.concat(div(whole, 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0")))
            .otherwise(F.translate(F.format_number(whole, 0), ",", ".")))
    return F.when(cents.isNull(), F.lit("—")).otherwise(F.concat(F.when(cents < 0, "-").otherwise(""), text, F.lit(","), F.lpad((c % 100).cast("string"), 2, "0")))


def parse_amount(text: Column) -> Column:
    """Cents of a spelled amount: 1.234,56 or 1,234.56 or 12,5 or plain; other spellings are null."""
    t = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"€|EUR|\s", "")
    plain = (F.when(t.rlike(r"^-?\d{1,3}(\.\d{3})+,\d{1,2}$"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
             .when(t.rlike(r"^-?\d{1,3}(,\d{3})+\.\d{1,2}$"), F.replace(t, F.lit(","), F.lit("")))
             .when(t.rlike(r"^-?\d+,\d{1,2}$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(t))
    return F.round(plain.try_cast("decimal(20,6)") * 100, 0).cast("bigint")


def all_amounts(text: Column) -> Column:
    """Cents of the amounts with exactly two decimals in a text, in order."""
    # most texts without amounts are told by a simpler pattern that every amount holds
    found = F.regexp_extract_all(F.when(text.rlike(r"\d[.,]\d\d"), text).otherwise(""), F.lit(r"(?<![\d.,])(-?(?:\d{1,3}(?:\.\d{3})+,\d{2}|\d{1,3}(?:,\d{3})+\.\d{2}|\d+[.,]\d{2}))(?![\d.,])"), F.lit(1))
    # two decimals each, so the digits are the cents; 14 digits before them at most, as in parse_amount
    cents = lambda x: F.translate(x, ".,", "").try_cast("bigint")
    return F.transform(found, lambda x: F.when(cents(x).between(1 - 10**16, 10**16 - 1), cents(x)))


def header_adds_up(base: Column, vat: Column, total: Column) -> Column:
    """Whether base and VAT give the total within two cents; null if any is null."""
    return F.abs(base + vat - total) <= HEADER_TOLERANCE


def lines_add_up(lines: Column, total: Column) -> Column:
    return F.abs(lines - total) <= LINE_TOLERANCE


def known_rate(rate: Column) -> Column:
    """Whether a VAT rate is one of the legal ones; null is."""
    return F.coalesce(rate.isin(*VAT_RATES), F.lit(True))


def vat_bucket(rate: Column, rounded: bool = False) -> Column:
    """Report bucket of a rate: exact (or rounded) legal rates, others, none."""
    r = F.round(rate) if rounded else rate
    out = F.when(rate.isNull(), "sin")
    for v in VAT_RATES:
        out = out.when(r == v, str(v))
    return out.otherwise("otros")


def implied_rate(base: Column, vat: Column, within: float = 0.8) -> Column:
    """The legal rate closest to vat/base if one is within `within` points."""
    r = F.try_divide(100.0 * vat, base)
    out = F.lit(None).cast("int")
    for v in VAT_RATES:
        out = F.when(F.abs(r - v) <= within, F.lit(v)).otherwise(out)
    return out


def recompute(driver: Column, base: Column, total: Column, rate: Column) -> Column:
    """Struct (base, vat, total) of a line after an edit: from its base, or from its total."""
    vat = F.round(base * rate / 100.0, 0).cast("bigint")
    net = F.round(total * 100.0 / (100 + rate), 0).cast("bigint")
    return F.when(driver == "base", F.struct(base.alias("base"), vat.alias("vat"), (base + vat).alias("total"))).otherwise(
        F.struct(net.alias("base"), (total - net).alias("vat"), total.alias("total")))


def quantity_text(thousandths: Column) -> Column:
    """Quantity without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", thousandths / 1000.0), "0+$", ""), r"\.$", "")


def axis_label(euros: Column) -> Column:
    """Short label: thousands as k with one decimal."""
    return F.when(F.abs(euros) >= 1000, F.concat(F.translate(F.format_string("%.1f", euros / 1000), ".", ","), F.lit("k"))).otherwise(F.round(euros).cast("bigint").cast("string"))
