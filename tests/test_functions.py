"""Scalar functions on known facts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import money, nif, text


def one(spark, col, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("r")).first().r


@pytest.mark.parametrize("value, valid", [("12345678Z", True), ("12345678A", False), ("X1234567L", True), ("B-2881261-0", False), ("A28812618", True), ("a-28812618", True), ("", False), (None, False), ("B1234", False)])
def test_nif(spark, value, valid):
    assert one(spark, nif.is_valid(F.col("x")), x=value) is valid


def test_find_nifs(spark):
    t = "Cliente 12345678z, proveedor A-28812618 y otra vez A28812618; mal 12345678A"
    assert one(spark, nif.find_all(F.col("x")), x=t) == ["12345678Z", "A28812618"]
    got = one(spark, nif.issuer_and_receiver(nif.find_all(F.col("x"))), x=t)
    assert (got.emisor, got.receptor) == ("A28812618", "12345678Z")


@pytest.mark.parametrize("raw, cents", [("1.234,56 €", 123456), ("1,234.56", 123456), ("12,5", 1250), ("12.50 EUR", 1250), ("-45,31", -4531), ("abc", None), (None, None), ("", None)])
def test_parse_amount(spark, raw, cents):
    assert one(spark, money.parse_amount(F.col("x")), x=raw) == cents


def test_format_euro(spark):
    assert one(spark, money.format_euro(F.col("x")), x=-4531) == "-45,31 €"
    assert one(spark, money.format_euro(F.col("x")), x=123456789) == "1.234.567,89 €"
    assert one(spark, money.format_euro(F.col("x").cast("bigint")), x=None) == "—"


def test_rounding(spark):
    assert str(one(spark, money.q2(F.col("x")), x="2.345")) == "2.35" and str(one(spark, money.q2(F.col("x")), x="-2.345")) == "-2.35"


def test_names(spark):
    assert one(spark, text.clean_name(F.col("x")), x="IKEA IBÉRICA S.A., A28812618,") == "ikea iberica"
    assert one(spark, text.normalize_issuer(F.col("x")), x=" ab  c ") is None
    assert one(spark, text.normalize_number(F.col("x")), x="f-2026/000123") == "F2026000123"


def test_dates(spark):
    assert one(spark, text.parse_date(F.col("x")), x="1/2/2026") == datetime.date(2026, 2, 1)
    assert one(spark, text.parse_date(F.col("x")), x="31-12-26") == datetime.date(2026, 12, 31)
    assert one(spark, text.parse_date(F.col("x")), x="31/02/2026") is None
    assert one(spark, text.iso_week(F.to_date("x")), x="2027-01-01") == "2026-W53"


def test_tokens(spark):
    hit = lambda t, x: tuple(one(spark, text.token_in_text(F.col("t"), F.col("x")), t=t, x=x))
    assert hit("B-12345674", "NIF: B12345674") == (True, False)
    assert hit("IBERDROLA", "la IBERDR0LA clientes") == (True, True)
    assert hit("ENDESA", "nada que ver aquí") == (False, False)


def test_hamming(spark):
    assert one(spark, text.hamming_hex(F.col("a"), F.col("b")), a="00000000000000ff", b="8000000000000000") == 9
    assert one(spark, text.hamming_hex(F.col("a"), F.col("b")), a="ff", b="8000000000000000") == 999


def test_amounts_of_a_text_are_the_spelled_ones(spark):
    texts = ["a 1.234,56 b -7,00 c 1,234.56 d 12.50", "00000000000000000012,34", "99999999999999,99 100000000000000,00 -99999999999999.99", "9" * 30 + ",00", "1.2,3 1,2.34 12,345", "", None, "-0,00", "١,٢٣"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    spelled = F.transform(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(r"(?<![\d.,])(-?(?:\d{1,3}(?:\.\d{3})+,\d{2}|\d{1,3}(?:,\d{3})+\.\d{2}|\d+[.,]\d{2}))(?![\d.,])"), F.lit(1)), money.parse_amount)
    assert all(r.a == r.b for r in df.select(money.all_amounts(F.col("t")).alias("a"), spelled.alias("b")).collect())
    # digits alone are cents: no regular expression is left inside the function over a text's amounts
    plan = df.select(money.all_amounts(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" in plan and "regexp_replace" not in plan.lower()


def test_ids_are_normalised_once(spark):
    plan = lambda c: spark.range(1).select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    text = F.concat(F.lit("NIF b-1234567-4 "), F.col("id").cast("string"))
    assert plan(nif.is_valid(text)).lower().count("regexp_replace") == 1 and plan(nif.find_all(text)).lower().count("regexp_replace") == 1


def test_texts_of_two_readers_need_no_votes(spark):
    from ledgerspark.operators import evals
    r = spark.createDataFrame([(1, "a", 5, "x" * 3000), (2, "a", 6, None)], "doc_id long, motor string, ms int, texto string")
    got = evals.dual_texts(r, r.limit(0))  # the compared fields aren't even there
    assert sorted((x.doc_id, x.caracteres, len(x.texto)) for x in got.collect()) == [(1, 3000, evals.SHOWN), (2, 0, 0)]


def test_amounts_spelled_without_a_number_format(spark):
    rng = random.Random(3)
    cents = [None, 0, 1, -1, 99, 100, -100, 99999, 100000, -100001, 99999999, 100000000, -100000000, 10**15] + [rng.choice((1, -1)) * rng.randrange(10 ** rng.randint(1, 15)) for _ in range(3000)]
    df = spark.createDataFrame([(c,) for c in cents], "c long")
    assert df.where(F.concat(money.spelled(F.col("c")), F.lit(" €")) != F.coalesce(money.format_euro(F.col("c")), F.lit("?"))).where("c is not null").count() == 0
    assert df.where("c is null").select(money.spelled(F.col("c"))).first()[0] == "—"
