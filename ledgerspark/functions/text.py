"""Names, numbers, tokens, dates and bits as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with their plain ones, and legal forms of companies.
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüçñýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑÝ", "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"
LEGAL_FORMS = ["sociedad anonima unipersonal", "sociedad limitada unipersonal", "sociedad anonima laboral", "sociedad limitada laboral", "sociedad anonima", "sociedad limitada",
               "sociedad cooperativa", "s a u", "s l u", "s a", "s l", "sau", "slu", "scp", "scl", "sa", "sl", "sc", "unipersonal", "eirl", "srl",
               "gmbh", "ltd", "limited", "llc", "inc", "corp", "co", "plc", "ag", "bv", "nv", "oy", "ab", "sas", "sarl", "spa"]


def normalize_number(x: Column) -> Column:
    """Invoice number: upper case letters and digits only; empty is null."""
    return F.nullif(F.regexp_replace(F.upper(x), r"[^\p{L}\p{N}]", ""), F.lit(""))


def normalize_issuer(x: Column) -> Column:
    """Issuer key: upper case, single spaces, at most 80 characters; under 6 is null."""
    t = F.trim(F.regexp_replace(F.upper(x), r"\s+", " "))
    return F.when(F.length(t) >= 6, F.substring(t, 1, 80))


def plain(x: Column) -> Column:
    """Lower case without Latin accents, trimmed."""
    return F.trim(F.lower(F.translate(x, ACCENTED, PLAIN)))


def clean_name(x: Column) -> Column:
    """Plain name without id tokens, border punctuation and legal forms at its end (up to two of them)."""
    t = F.regexp_replace(plain(F.coalesce(x, F.lit(""))), r"\b[ab]\d{8}\b", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[.,;:()/]+", " "), r"\s+", " "))
    form = r"\s+(" + "|".join(LEGAL_FORMS) + r")$"
    return F.trim(F.regexp_replace(F.regexp_replace(t, form, ""), form, ""))


def normalize_text(x: Column) -> Column:
    """Upper case without accents, single spaces."""
    return F.trim(F.regexp_replace(F.upper(F.translate(F.coalesce(x, F.lit("")), ACCENTED, PLAIN)), r"\s+", " "))


def compact(x: Column) -> Column:
    """Letters A to Z and digits of the normalised text."""
    return F.regexp_replace(normalize_text(x), "[^A-Z0-9]", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; two empty texts are equal."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / n)


def token_in_text(token: Column, text: Column, least: float = 0.86) -> Column:
    """Struct (hit, fuzzy). Exact: the token or its compact form occurs. Fuzzy, from 6 characters on: a window of the compact text,
    moved by a quarter of its length, is at least `least` similar."""
    nt, ct, n, c = normalize_text(token), compact(token), normalize_text(text), compact(text)
    exact = F.contains(n, nt) | ((ct != "") & F.contains(c, ct))
    size = F.length(ct)
    step = F.greatest((size / 4).cast("int"), F.lit(1))
    starts = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - size + 1), step)).otherwise(F.array().cast("array<int>"))
    close = F.exists(starts, lambda i: similarity(ct, F.substring(c, i, size)) >= least)
    fuzzy = ~exact & (size >= 6) & close
    return F.struct((exact | fuzzy).alias("hit"), fuzzy.alias("fuzzy"))


def label_cut(x: Column, size: int = 32) -> Column:
    return F.when(F.length(x) > size, F.concat(F.substring(x, 1, size - 1), F.lit("…"))).otherwise(x)


def slug(x: Column) -> Column:
    """Account code part: upper case letters and digits without accents."""
    return F.regexp_replace(F.upper(F.translate(x, ACCENTED, PLAIN)), "[^A-Z0-9]+", "")


def iso_week(d: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def parse_date(x: Column) -> Column:
    """Day-first date with slashes or hyphens, four- or two-digit year, from 1990 to 2100; else null."""
    t = F.replace(x, F.lit("-"), F.lit("/"))
    d = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "d/M/yyyy")).when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(t, "d/M/yy"))
    return F.when((F.year(d) >= 1990) & (F.year(d) <= 2100), d)


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal texts of 16 digits; 999 if a length differs or one is null."""
    def long(x):
        return F.conv(x, 16, -10).cast("bigint")

    return F.when((F.length(a) == F.length(b)) & (F.length(a) == 16), hamming64(long(a), long(b))).otherwise(F.lit(999)).cast("int")


def native_text_score(x: Column) -> Column:
    """Quality of a text layer in thousandths: short texts and texts with few letters are poor; invoice words, digits and euro signs add."""
    t = F.trim(F.coalesce(x, F.lit("")))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    score = (F.lit(450) + F.when(F.upper(t).rlike("NIF|CIF|IVA|FACTURA|TOTAL"), 250).otherwise(0)
             + F.when(t.rlike("[0-9]"), 150).otherwise(0) + F.when(F.upper(t).rlike("€|EUR"), 100).otherwise(0))
    return F.when(F.length(t) < 40, 100).when(letters < 0.12 * F.length(t), 200).otherwise(F.least(score, F.lit(990)))
