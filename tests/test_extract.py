"""Header fields and items of invoice texts in many layouts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import extract, items

TEXTS = {
    "long id behind the label, id of a company with hyphen, totals in three steps": (
        "FERRETERIA MERLIN CENTRO\nFACTURA 071-0012-553901\nORIGINAL\nB-84818442\nNumero NIF 12345678Z\nFecha de venta 18/09/2026\nTotal SI (EUR)\n20,00\nTotal IVA/IGIC/IPSI\n4,20\nTotal TII (EUR)\n24,20",
        dict(numero="071-0012-553901", nif_emisor="B84818442", fecha=datetime.date(2026, 9, 18), base_c=2000, iva_c=420, total_c=2420, emisor="FERRETERIA MERLIN CENTRO")),
    "labels that contradict one another: the amounts that add up": (
        "ICATIVA\nIFICATIVA 071-0012-R553901\nB-84818442\n05/09/2026\nTotal SI (EUR)\nTotal 111 (EUR)\n50,00\n10,50\n60,50", dict(numero="071-0012-R553901", base_c=5000, iva_c=1050, total_c=6050, iva_tipo=21.0, fecha=datetime.date(2026, 9, 5))),
    "id of a ticket and its pages, another page mark before": (
        "OBRAMAX\nALMACEN OBRAMA S.L.U\n020-000051-007-3321-nfs: 077123 15/08/2026 13:48 - Venta -\nPag. 1 / 2\nScan 1 / 3\nTotal SI (EUR)\n94,21\nTotal IVA\n19,78\nTotal TTI (EUR)\n113,99",
        dict(numero="020-000051-007-3321-NFS:077123", numero_norm="0200000510073321NFS077123", pagina=1, paginas=2, base_c=9421, iva_c=1978, total_c=11399)),
    "no page mark without its word, none backwards": ("Scan 1 / 3\nPág. 3/2", dict(pagina=None, paginas=None)),
    "page mark without space": ("PÁGINA 2/10", dict(pagina=2, paginas=10)),
    "loose long id": ("Almacen S. L.\n010-0009-220356\nIVA al 10 % 1,00\nTotal 11,00", dict(numero="010-0009-220356", iva_tipo=10.0, iva_c=100, total_c=1100, base_c=1000, emisor="Almacen S. L.")),
    "label alone, the value below with a slash": ("Factura:\nabcd_030_2027 / 0004432\nTotal 5,00", dict(numero="ABCD_030_2027/0004432")),
    "label alone, a date below": ("Factura\n05/09/2026", dict(numero=None)),
    "label alone, an id of a person below": ("Factura\n12345678Z", dict(numero=None)),
    "number of the invoice, spelled out": ("Número de factura: A/2024.17.\nBase imponible: 1.200,00 €\nCuota IVA 252,00\nTotal factura 1.452,00 €", dict(numero="A/2024.17", base_c=120000, iva_c=25200, total_c=145200, iva_tipo=21.0)),
    "sign of the number": ("FACTURA Nº F-99\nn.º de factura X1", dict(numero="F-99")),
    "a word for number alone does not do": ("no 17\nFactura pendiente 18", dict(numero=None)),
    "base and total give the tax": ("Base imponible 100,00\nTOTAL 104,00", dict(base_c=10000, iva_c=400, total_c=10400, iva_tipo=4.0)),
    "two-digit year, first readable date": ("Fecha: 99/99/2024\nEmitida 1-2-24", dict(fecha=datetime.date(2024, 2, 1))),
    "nothing": (None, dict(numero=None, fecha=None, total_c=None, emisor=None, pagina=None, confianza_m=0)),
    "blank": (" \n\t\n", dict(numero=None, total_c=None, emisor=None)),
}


@pytest.fixture(scope="module")
def headers(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in TEXTS.items()], "caso string, texto string")
    return {r["caso"]: r.asDict() for r in extract.header(docs).collect()}


@pytest.mark.parametrize("case", TEXTS)
def test_header_fields(headers, case):
    want = TEXTS[case][1]
    assert {k: headers[case][k] for k in want} == want


def test_header_is_one_projection(spark):
    plan = extract.header(spark.createDataFrame([(1, "a")], "id long, texto string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_articles_may_begin_like_footer_words(spark):
    text = "MESA ROBLE 10,00\nIVAR ESTANTE 20,00\nVISAGRA LATON 1,00\nPAGINADOR 2,00\nIVA 21 % 6,93\nTOTAL 39,93"
    docs = spark.createDataFrame([(1, text)], "doc_id long, texto string")
    assert [r["nombre"] for r in items.trailing_amounts(items.kinds(docs)).orderBy("pos").collect()] == ["MESA ROBLE", "IVAR ESTANTE", "VISAGRA LATON", "PAGINADOR"]
    assert [x[2] for x in extract.item_lines(text)] == ["MESA ROBLE", "IVAR ESTANTE", "VISAGRA LATON", "PAGINADOR"]


def test_items_come_with_base_and_vat(spark):
    docs = spark.createDataFrame([(1, "Tienda SL\nLAMPARA 12,10\nCABLE 1,21\nBase imponible 11,00\nIVA 21 % 2,31\nTotal 13,31"), (2, "Tienda SL\nLAMPARA 10,00\nCABLE 1,00\nBase imponible 11,00\nIVA 21 % 2,31\nTotal 13,31"), (3, "nada"), (4, None)], "doc_id long, texto string")
    headers, found = items.parse(docs)
    got = sorted((r["doc_id"], r["orden"], r["nombre"], r["base_c"], r["iva_c"], r["importe_c"]) for r in found.collect())
    assert got == [(1, 1, "LAMPARA", 1000, 210, 1210), (1, 2, "CABLE", 100, 21, 121), (2, 1, "LAMPARA", 1000, 210, 1210), (2, 2, "CABLE", 100, 21, 121)]
    assert headers.count() == 4


def test_columns_that_touch(spark):
    """Quantities right above prices: the stretch with as many prices as names and the right sum is the column; a footer's own amounts never are."""
    head = "Designacion y Referencia articulo\n"
    text = head + "1\nTaladro percutor\n12345678\n2\nSierra de mano\n23456789\n3\nCinta metrica\n34567890\n2,00\n1,00\n3,00\n60,50\n12,10\n48,40\nTotal TTI (EUR)\n121,00"
    foot = head + "1\nTaladro percutor\n12345678\n2\nSierra de mano\n23456789\n7,00\n100,00\n21,00\n121,00\nTotal"
    docs = spark.createDataFrame([(1, text, 10000, 2100, 12100), (2, foot, 10000, 2100, 12100), (3, None, None, None, None)], "doc_id long, texto string, base_c long, iva_c long, total_c long")
    got = {}
    for r in items.find_items(docs, docs).orderBy("doc_id", "orden").collect():
        got.setdefault(r.doc_id, []).append((r.nombre, r.codigo, r.importe_c, r.origen))
    assert [x[1:] for x in got[1]] == [("12345678", 6050, "columna"), ("23456789", 1210, "columna"), ("34567890", 4840, "columna")]
    assert all(x[3] != "columna" for x in got.get(2, [])) and 3 not in got
    assert [r.importes for r in items.column_prices(items.kinds(docs), docs).where("doc_id = 1").collect()] == [[12100]]  # of whole runs only the total itself fits


def test_stretches_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(d, t, 100 * d, [rng.randint(-3, 5) for _ in range(rng.randint(1, 12))]) for d in range(40) for t in range(2)]
    runs = spark.createDataFrame([(d, t, at, len(x), x) for d, t, at, x in rows], "doc_id long, tramo int, desde int, n int, importes array<long>")
    want_n = [(d, n) for d in range(40) for n in {rng.randint(0, 6), rng.randint(1, 4)}]
    got = sorted((r.doc_id, r.desde, list(r.importes), r.suma_c) for r in items.run_parts(runs, spark.createDataFrame(want_n, "doc_id long, n long")).collect())
    want = sorted((d, at + i, x[i:i + n], sum(x[i:i + n])) for d, t, at, x in rows for e, n in want_n if e == d and 1 < n < len(x) for i in range(len(x) - n + 1))
    assert got == want


def test_all_items_of_a_long_text(spark):
    """A text has as many items as it names, also more than 40."""
    text = "\n".join(f"Articulo {chr(97 + i // 26)}{chr(97 + i % 26)}\n{i + 1},00" for i in range(130))
    df = spark.createDataFrame([(text,)], "t string").select(extract.items(F.col("t")).alias("i"))
    got = [(x.posicion, x.importe_c) for x in df.first().i]
    assert got == [(i + 1, 100 * (i + 1)) for i in range(130)]


def by_windows(docs):
    """`items.find_items` as joins and windows over lines: each way a table of its own."""
    from pyspark.sql import Window
    lines = items.kinds(docs)
    region = items.article_region(lines)
    codes, numbered, blocks = items.reference_pairs(region), items.numbered_lines(region), items.block_prices(lines)
    counted = codes.groupBy("doc_id").count().union(numbered.groupBy("doc_id").count()).toDF("doc_id", "n")
    columns = items.column_prices(lines, docs, counted).select("doc_id", "importes")

    def priced(found, rank):
        n, at = F.count("*").over(Window.partitionBy("doc_id")), F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
        rows = found.join(blocks.select("doc_id", "pos", F.col("importe_c").alias("b")), ["doc_id", "pos"], "left").join(columns, "doc_id", "left").withColumn("n", n).withColumn("at", at)
        rows = rows.withColumn("c", F.when(F.size("importes") == F.col("n"), F.try_element_at("importes", F.col("at"))))
        ways = [F.struct(F.lit(rank + k).alias("rango"), F.lit(o).alias("origen"), c.alias("importe_c")) for k, o, c in ((0, "bloque", F.col("b")), (1, "columna", F.col("c")), (100, "nombre", F.lit(None).cast("bigint")))]
        return rows.select("doc_id", "orden", "codigo", "nombre", F.explode(F.array(*ways)).alias("p")).select("doc_id", "orden", "codigo", "nombre", "p.importe_c", "p.rango", "p.origen")

    beside = items.without_footer(items.trailing_amounts(region), docs).select("doc_id", "orden", "codigo", "nombre", "importe_c", F.lit(50).alias("rango"), F.lit("linea").alias("origen"))
    every = priced(codes, 0).unionByName(priced(numbered, 10)).unionByName(beside).localCheckpoint()
    sums = every.groupBy("doc_id", "rango").agg(F.sum("importe_c").alias("s"), F.count("*").alias("n"), F.count("importe_c").alias("k")).join(docs, "doc_id")
    near = lambda c: F.coalesce(F.abs(F.col("s") - F.col(c)) <= 5, F.lit(False)) & (F.col("k") == F.col("n"))
    merit = F.when(near("total_c"), 0).when(near("base_c"), 1).when(F.col("rango") >= 100, 2)
    best = sums.withColumn("m", merit).where("m is not null").groupBy("doc_id").agg(F.min_by("rango", F.struct("m", "rango")).alias("rango"))
    return every.join(best, ["doc_id", "rango"]).select("doc_id", "orden", "codigo", "nombre", "importe_c", "origen")


def random_text(rng):
    """Lines of all kinds in any order, some with headers that fit a way's sum."""
    word = lambda: rng.choice(["Mesa roble", "Cable", "Pagín ñandú", "Total", "IVA 21 %", "Modos de pago", "UNID.", "Тест линия", "½½½½", "a½b²c", "x1y", "Pagina2", "Razón social", "²³"])
    price = lambda: rng.choice(["1,00", "2,00", "3,00", "21.00", "10,00", "-1,50", "1.234,56", "1,234.56", "12,00 €", "EUR 4,00", "0,00", "7,00\r", "1,2,3", "99999999999999999,00", "٣,٠٠"])
    code = lambda: rng.choice(["1234567", "12345678", "1 1234567", "12. 12345678.", "12345678\r", "1234567 ", "123456789", "٣٣٣٣٣٣٣"])
    kinds = [word, lambda: f"{word()} {price()}", lambda: f"{rng.randint(1, 45)} {word()} {price()}", price, price, price, code, code, lambda: str(rng.randint(0, 45)),
             lambda: rng.choice(["Designacion", "TTI (EUR)", "Total TII", "ti (eur)", "", "  ", "\t", "4.", "40\r"])]
    blocks = [lambda: "\n".join([word(), code(), price(), price()]), lambda: "\n".join([str(rng.randint(1, 41)), word(), code()]), lambda: "TTI (EUR)\n" + "\n".join(price() for _ in range(rng.randint(1, 5)))]
    return "\n".join(rng.choice(kinds if rng.random() < 0.5 else blocks)() for _ in range(rng.randint(0, 14)))


def test_one_pass_gives_the_rows_of_the_windows(spark):
    rng = random.Random(5)
    rows = [(d, random_text(rng), *(rng.choice([None, 0, rng.randint(0, 12) * 100]) for _ in range(3))) for d in range(1500)] + [(None, "Mesa\n1234567\n1,00", 100, 0, 100), (2000, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, texto string, base_c long, iva_c long, total_c long").repartition(4).localCheckpoint()
    got = items.find_items(docs, docs).localCheckpoint()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, by_windows(docs).collect()), key=repr)
    assert {r.origen for r in got.collect()} == {"bloque", "columna", "nombre", "linea"}
    apart = items.find_items(docs.select("doc_id", "texto"), docs.select("doc_id", "base_c", "iva_c", "total_c"))
    assert sorted(map(tuple, apart.collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)
    lines = items.kinds(docs)
    pairs = items.reference_pairs(lines).join(items.block_prices(lines), ["doc_id", "pos"]).select("doc_id", "orden", "codigo", "nombre", "importe_c", "iva_tipo")
    assert sorted(map(tuple, items.priced_codes(docs).collect()), key=repr) == sorted(map(tuple, pairs.collect()), key=repr)


def test_items_in_one_pass_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a", 1, 1, 1)], "doc_id long, texto string, base_c long, iva_c long, total_c long")
    for df in (items.find_items(docs, docs), items.priced_codes(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Window", "Join", "Sort"))


def test_lines_without_labels_are_not_searched(spark):
    """Numbers, pages and rates stand only on lines that hold a part of theirs; the plan of an ingest's items reads one table of texts."""
    noise = "\n".join(f"Linea {i} con 071-001-5 y 3/x" for i in range(30))
    df = spark.createDataFrame([(1, f"{noise}\nFactura 071-0012-553901\npag.\nPág. 1 / 2\nIVA 21 %"), (2, f"{noise}\nFactura nº 12/A\n2/3"), (3, f"{noise}\nx 071-0012-R12345")], "doc_id long, texto string")
    got = [(r.numero, r.pagina, r.paginas, r.iva_tipo) for r in extract.header(df).orderBy("doc_id").collect()]
    assert got == [("071-0012-553901", 1, 2, 21.0), ("12/A", None, None, None), ("071-0012-R12345", None, None, None)]
