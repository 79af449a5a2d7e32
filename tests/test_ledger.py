"""Reports, matching, rules and extraction on small facts, and plans."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark import schema
from ledgerspark.operators import entry as entries_of
from ledgerspark.operators import evals, extract, matching, reports, rules
from ledgerspark.sources import io

COLS = ("id long, actividad_id long, tipo string, cuenta_codigo string, fecha date, ejercicio long, emisor string, nif_emisor string, numero_factura string, base_c long, iva_tipo long, iva_c long, total_c long, "
        "estado string, conf_clase_m long, conf_ocr_m long, validado boolean, factura_id long, duplicado_de_id long, duplicado_nivel int, motivo_rechazo string, inmueble_id long")


def entry(i, **kw):
    base = dict(id=i, actividad_id=1, tipo="gasto", cuenta_codigo=None, fecha=datetime.date(2026, 1, 15), ejercicio=2026, emisor=f"Proveedor {i} S.L.", nif_emisor=None, numero_factura=None, base_c=None, iva_tipo=None,
                iva_c=None, total_c=None, estado="confirmado", conf_clase_m=900, conf_ocr_m=900, validado=False, factura_id=i, duplicado_de_id=None, duplicado_nivel=None, motivo_rechazo=None, inmueble_id=None)
    base.update(kw)
    return tuple(base.values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COLS)


@pytest.fixture(scope="module")
def book(spark):
    return frame(spark, entry(1, total_c=4840, validado=True, cuenta_codigo="CI.GAS.LUZ"), entry(2, tipo="ingreso", total_c=70000, cuenta_codigo="CI.ING.RENTA"), entry(3, tipo="mejora", total_c=145200, cuenta_codigo="CI.MEJ.PVC"),
                 entry(4, total_c=4840, estado="duplicado"), entry(5, total_c=3145, estado="pendiente"))


def test_kpis(book):
    r = reports.kpis(book).first()
    assert (r.gastos_c, r.ingresos_c, r.mejoras_c, r.resultado_c) == (7985, 70000, 145200, 62015)
    assert (r.n_duplicados, r.n_pendientes, r.n_asientos) == (1, 1, 4)


def test_tax_boxes(spark, book):
    r = reports.tax_yield(book, schema.accounts(spark), schema.boxes(spark)).first()
    assert (r.ingresos_c, r.deducibles_c, r.mejoras_c, r.rendimiento_c) == (70000, 7985, 145200, 62015)
    assert reports.tax_boxes(book, schema.accounts(spark), schema.boxes(spark)).count() == 12


def test_quarters(spark):
    rows = frame(spark, entry(1, total_c=10000, iva_c=2100, fecha=datetime.date(2026, 2, 1)), entry(2, tipo="ingreso", total_c=70000, iva_c=0, fecha=datetime.date(2026, 1, 1)), entry(3, total_c=5000, iva_c=1050, fecha=datetime.date(2026, 8, 1)))
    got = {r.periodo: (r.gasto_c, r.ingreso_c, r.mejora_c, r.neto_c, r.iva_c) for r in reports.by_quarter(rows).collect()}
    assert got["T1"] == (10000, 70000, 0, 60000, 2100) and got["T3"] == (5000, 0, 0, -5000, 1050) and got["Año"] == (15000, 70000, 0, 55000, 3150) and got["T2"] == (0, 0, 0, 0, 0)


def test_top_six_and_rest(spark):
    got = reports.supplier_top(frame(spark, *[entry(i, total_c=(21 - i) * 100) for i in range(1, 8)])).orderBy("puesto").collect()
    assert [r.total_c for r in got] == [2000, 1900, 1800, 1700, 1600, 1500, 1400] and got[-1].emisor == "Resto"


def twin(i, **kw):
    return entry(i, **{**dict(nif_emisor="A28812618", numero_factura="F-2026-77", total_c=4840), **kw})


def test_duplicate_levels(spark):
    d = datetime.date(2026, 1, 17)
    rows = frame(spark, twin(1), twin(2), twin(3, numero_factura="OTRA-1", fecha=d), entry(4, emisor="PROVEEDOR  UNO", total_c=999), entry(5, emisor="Proveedor uno", total_c=999, fecha=datetime.date(2026, 1, 16)),
                 twin(6, nif_emisor=None, emisor="Desconocido"), twin(7, actividad_id=2))
    got = {r.id: (r.nivel, r.otro_id) for r in matching.cascade(rows).collect()}
    assert got == {2: (2, 1), 3: (3, 1), 5: (3, 4), 6: (2, 1)}


def test_no_join_compares_all_pairs(spark, book):
    for df in (matching.cascade(book), matching.invoice_pairs(book), matching.twin_candidates(book), matching.er_candidates(book, book)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_reach_the_scan(spark, tmp_path, book):
    io.write_entries(book, str(tmp_path / "asientos"))
    df = spark.read.parquet(str(tmp_path / "asientos")).where("actividad_id = 1 and ejercicio = 2026 and estado = 'pendiente'").select("id", "total_c")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(actividad_id" in plan and "EqualTo(estado,pendiente)" in plan and "nif_emisor" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("a, b, nifs, band", [("ikea iberica", "ikea iberica", ("A1", "A1"), "auto"), ("ikea iberica", "ikea iberica", (None, "A1"), "revisar"), ("ikea iberica", "leroy merlin", ("A1", "B1"), "rechazar"), ("ikea iberica", "leroy merlin", (None, None), "rechazar")])
def test_supplier_bands(spark, a, b, nifs, band):
    df = spark.createDataFrame([(nifs[0], nifs[1], a, b)], "x string, y string, a string, b string")
    s = matching.supplier_score(F.col("x"), F.col("y"), F.lit(matching.jaro_winkler(a, b)))
    assert df.select(s.alias("s")).first().s.banda == band


def test_scorers_differ_where_documented(spark):
    df = spark.range(1).withColumn("n", F.lit(None).cast("string"))
    s = lambda hand: df.select(matching.supplier_score(F.col("n"), F.col("n"), F.lit(0.9), hand).alias("s")).first().s.banda
    assert (s(True), s(False)) == ("revisar", "rechazar")


def test_name_ratio_by_brute_force(spark):
    """The longest common block (first in a, then in b), then the same left and right of it; words as they stand or sorted."""
    def common(a, b):
        n, i, j = max(((n, -i, -b.find(a[i:i + n])) for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i:i + n] in b), default=(0, 0, 0))
        return n + common(a[:-i], b[:-j]) + common(a[-i + n:], b[-j + n:]) if n else 0

    def ratio(a, b):
        ordered = lambda x: " ".join(sorted(x.split(" ")))
        return max(2 * common(x, y) / (len(x) + len(y)) for x, y in ((a, b), (ordered(a), ordered(b)))) if a and b else 0.0

    rng = random.Random(3)
    names = ["", None, "ferreteria lopez", "lopez ferreteria", "ñandú azul", "a"] + ["".join(rng.choice("aab c") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    pairs = [(i, rng.choice(names), rng.choice(names)) for i in range(3000)] + [(-1, "ferreteria lopez", "lopez ferreteria")]
    rows = spark.createDataFrame(pairs, "id long, a string, b string")
    got = {r.id: r.r for r in rows.select("id", matching.name_ratio_column(F.col("a"), F.col("b")).alias("r")).collect()}
    assert got[-1] == 1.0 and all(abs(got[i] - ratio(a, b)) < 1e-12 for i, a, b in pairs)


def test_jaro_winkler():
    assert matching.jaro_winkler("", "") == 0.0 and round(matching.jaro_winkler("martha", "marhta"), 4) == 0.9611


DOCS = "id long, actividad_id long, numero string, nif string, emisor_norm string, total_c long, pagina int"


def test_entity_resolution(spark):
    rows = [(1, 1, "F1", "A1", "UNO SL", 100, 1), (2, 1, "F1", "A1", "UNO SL", 101, 1), (3, 1, "F1", "A1", "UNO SL", None, 2), (4, 1, "F2", None, "DOS SL", 100, 1), (5, 1, "F2", None, "DOS SL", 900, 1), (6, 1, None, "A1", "UNO SL", 100, 1), (7, 2, "F1", "A1", "UNO SL", 100, 1)]
    got = {r.doc_id: (r.factura_id, r.relacion, r.estado_er) for r in matching.cluster(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == (1, "evidencia", "propuesta") and got[2][0] == 1 and got[3] == (1, "continuacion", "propuesta")
    assert got[4][2] == got[5][2] == "conflicto" and got[5][0] == 5 and got[6][0] == 6 and got[7][0] == 7


@pytest.mark.parametrize("blob, own, want", [("iberdrola clientes", True, ("CI.GAS.LUZ", "regla", 900, "gasto")), ("leroy merlin codo pvc", True, ("CI.GAS.HOGAR", "regla", 720, "gasto")), ("leroy merlin ventana", True, ("CI.MEJ.PVC", "regla", 720, "mejora")),
                                             ("albañil", True, (None, "pendiente", 200, "gasto")), ("cuota reta", False, ("AE.GAS.SS", "regla", 800, "gasto")), ("nada", False, (None, "pendiente", 0, "gasto"))])
def test_classification(spark, blob, own, want):
    rows = spark.createDataFrame([(1, 1, "N", blob, own)], "id long, actividad_id long, nif string, blob string, propiedad boolean")
    none = spark.createDataFrame([], "regla_id long, actividad_id long, nif_emisor string, patron string, cuenta_codigo string")
    assert tuple(rules.classify(rows, none, schema.accounts(spark)).first())[1:] == want
    learned = spark.createDataFrame([(1, 1, "N", "", "CI.GAS.AGUA")], "regla_id long, actividad_id long, nif_emisor string, patron string, cuenta_codigo string")
    assert rules.classify(rows, learned, schema.accounts(spark)).first().cuenta == "CI.GAS.AGUA"


BILL = """Iberdrola Clientes S.A.U.
NIF: A95758389
Factura nº: F2026-000123
Fecha factura: 10/03/2026
Base imponible 40,00
IVA 21 % 8,40
TOTAL 48,40 EUR
Pag. 1 / 2"""


def test_header(spark):
    r = extract.header(spark.createDataFrame([(1, BILL), (2, None), (3, "25,99\n5,46\n31,45")], "doc_id long, texto string")).orderBy("doc_id").collect()
    assert (r[0].numero_norm, r[0].fecha, r[0].base_c, r[0].iva_c, r[0].total_c, r[0].iva_tipo) == ("F2026000123", datetime.date(2026, 3, 10), 4000, 840, 4840, 21.0)
    assert (r[0].pagina, r[0].paginas) == (1, 2) and r[0].emisor == "Iberdrola Clientes S.A.U." and r[0].confianza_m >= 750
    assert r[1].total_c is None and r[1].confianza_m == 0
    assert (r[2].base_c, r[2].iva_c, r[2].total_c) == (2599, 546, 3145)


def test_items(spark):
    got = extract.item_lines("1 Tornillo acero\n12345678\n3,50\nTaladro percutor 49,95\nTotal 53,45\nnota al pie")
    assert got == [(1, "12345678", "Tornillo acero", 350), (2, None, "Taladro percutor", 4995)]
    df = spark.createDataFrame([(BILL,), (None,)], "t string").select(extract.coherent(extract.items(F.col("t")), F.lit(4000), F.lit(4840)).alias("i"))
    assert [list(r.i) for r in df.collect()] == [[], []]


def test_consensus(spark):
    cols = "doc_id long, emisor string, nif_emisor string, nif_receptor string, numero string, fecha string, base string, iva_cuota string, total string"
    a = spark.createDataFrame([(1, "Uno", "A28812618", None, "F-1", "2026-01-01", "1.00", None, "5.00")], cols)
    b = spark.createDataFrame([(1, "Uno", "A28812619", None, "F-12", "2026-01-01", "1.00", None, "6.00")], cols)
    got = {r.campo: (r.estado, r.consenso) for r in evals.votes(a, b).collect()}
    assert got["nif_emisor"] == ("conflicto", "A28812618") and got["numero"] == ("acuerdo", "F-12") and got["total"] == ("conflicto", "") and got["nif_receptor"] == ("vacio", "")
    assert evals.recommendation(evals.votes(a, b)).first().recomendacion == "revisar"


def test_changes_make_snapshot_and_audit(spark, book):
    ch = spark.createDataFrame([(1, 5000, None), (5, None, "Nuevo")], "id long, total_c long, emisor string")
    after, audit = rules.apply_changes(book, ch)
    assert {r.id: r.total_c for r in after.collect()}[1] == 5000 and book.where("id = 1").first().total_c == 4840
    assert {(r.asiento_id, r.campo) for r in audit.collect()} == {(1, "total_c"), (5, "emisor"), (5, "validado")}


def test_inbox_and_gold(spark, tmp_path):
    for n in ("a.pdf", "b.PDF", ".c.pdf", "d.txt"):
        (tmp_path / n).write_bytes(b"same")
    assert {r.nombre for r in io.inbox(spark, str(tmp_path)).collect()} == {"a.pdf", "b.PDF"}
    (tmp_path / "gold.json").write_text('{"cases": [{"id": "x", "path": "p", "kind": "pdf", "must_tokens": ["a"], "fields": {"numero": "1"}}]}')
    g = io.gold_suite(spark, str(tmp_path / "gold.json"))
    assert g.first().fields.numero == "1" and io.suite_with_override(g, g).count() == 1


def test_stream_resolution(spark, tmp_path):
    from ledgerspark.streaming import ingest
    docs = spark.createDataFrame([(1, 1, "F1", 100), (2, 1, "F1", 101), (3, 1, "F1", 900)], "doc_id long, actividad_id long, numero string, total_c long")
    docs.write.parquet(str(tmp_path / "in"))
    q = ingest.resolve(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("er").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.doc_id: r.factura_id for r in spark.sql("select * from er").collect()} == {1: 1, 2: 1, 3: 3}


def test_stream_resolution_tells_suppliers_apart(spark, tmp_path):
    from ledgerspark.streaming import ingest
    docs = spark.createDataFrame([(1, 1, "S/N", "A", None, 100), (2, 1, "S/N", "B", None, 100), (3, 1, "S/N", None, "ACME SL", None), (4, 1, "S/N", None, "ACME SL", 700), (5, 1, "S/N", None, "ACME SL", 900)],
                                 "doc_id long, actividad_id long, numero string, nif string, emisor_norm string, total_c long")
    docs.write.parquet(str(tmp_path / "in"))
    q = ingest.resolve(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("er2").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.doc_id: (r.factura_id, r.conflicto) for r in spark.sql("select * from er2").collect()} == {1: (1, False), 2: (2, False), 3: (3, False), 4: (3, False), 5: (5, True)}


def test_line_items_in_columns_and_blocks(spark):
    """Prices of a column with unit prices before line prices; prices in blocks with codes that end in a stop; nothing but a footer."""
    from ledgerspark.operators import items
    column = "Designacion y Referencia articulo\nLAMPARA MESA 40W\n10134110\nENCHUFE DOBLE\n25049368\nContribucion al SCRAP\n: 0,01\nTAPA REGISTRO\n4. 10757292\nImporte\nTTI (EUR)\n6,30\n1,90\nImporte\nTTI (EUR)\n0,70\n1,40\nTotal TTI (EUR)\n9,60"
    block = "Designacion y Referencia articulo\nTUBO RIGIDO 1M\n10110884.\nUNID.\n1,99\n21.00\n2,41\n2,41\n2\nCODO 40MM\n10539431\nUNID.\n0,18\n21.00\n0,22\n0,22\nModos de pago\nTotal TTI (EUR)\n2,63"
    docs = spark.createDataFrame([(1, column), (2, block), (3, "Base 10,00\nTotal 12,10"), (4, None)], "doc_id long, texto string")
    heads = spark.createDataFrame([(1, None, None, 960), (2, 217, 46, 263), (3, 1000, 210, 1210), (4, None, None, None)], "doc_id long, base_c long, iva_c long, total_c long")
    got = sorted((r.doc_id, r.orden, r.codigo, r.nombre, r.importe_c, r.origen) for r in items.find_items(docs, heads).collect())
    assert got == [(1, 1, "10134110", "LAMPARA MESA 40W", 630, "columna"), (1, 2, "25049368", "ENCHUFE DOBLE", 190, "columna"), (1, 3, "10757292", "TAPA REGISTRO", 140, "columna"),
                   (2, 1, "10110884", "TUBO RIGIDO 1M", 241, "bloque"), (2, 2, "10539431", "CODO 40MM", 22, "bloque")]
    rates = items.block_prices(items.kinds(docs.where("doc_id = 2"))).collect()
    assert {r.iva_tipo for r in rates} == {21}


def test_new_codes_are_unique(spark):
    names = spark.createDataFrame([(n, "CI.GAS") for n in ("Piso", "PISO", "Piso 2", "piso  2", "Otro")], "nombre string, prefijo string")
    for existing in ([], ["CI.GAS.PISO2"], ["CI.GAS.PISO", "CI.GAS.PISO3", "CI.GAS.PISO22"]):
        got = [r.codigo for r in rules.new_codes(names, spark.createDataFrame([(c,) for c in existing], "codigo string")).collect()]
        assert len(got) == 5 and len(set(got) | set(existing)) == 5 + len(existing)
    one = rules.new_codes(spark.createDataFrame([("Piso 2", "CI.GAS")], "nombre string, prefijo string"), spark.createDataFrame([("CI.GAS.PISO2",)], "codigo string"))
    assert one.first().codigo == "CI.GAS.PISO22"


def test_names_stay_in_their_case_file(spark):
    rows = spark.createDataFrame([(1, 1, "B1", "ACME"), (2, 1, "B1", "Acme"), (3, 2, "B1", "Acme Norte"), (4, 2, "B1", "ACME NORTE")], "id long, actividad_id long, nif_emisor string, emisor string")
    got = {r.actividad_id: r.canonico for r in matching.canonical_names(rows).collect()}
    assert got == {1: "Acme", 2: "Acme Norte"}
    known = entries_of.known_spelling(rows.select("id", "actividad_id", F.col("nif_emisor").alias("nif"), "emisor"), matching.canonical_names(rows).where("actividad_id = 1"))
    assert {r.id: r.emisor for r in known.collect()} == {1: "Acme", 2: "Acme", 3: "Acme Norte", 4: "ACME NORTE"}


def test_two_warnings(spark):
    w = spark.range(1).select(entries_of.warnings(F.lit(100), F.lit(21), F.lit(200), F.lit(17)).alias("a"), entries_of.warnings(F.lit(100), F.lit(21), F.lit(121), F.lit(21)).alias("b"), entries_of.warnings(F.lit(None).cast("long"), F.lit(21), F.lit(121), F.lit(None).cast("int")).alias("c")).first()
    assert len(w.a) == 2 and "1.21" in w.a[0] and "17" in w.a[1] and w.b == w.c == []


def test_natural_order_of_long_numbers(spark):
    keys = ["a9", "a10", "a999999999999", "a9999999999999", "a12345678901234567890", "b1", "á010x", "a10y"]
    got = [r.k for r in spark.createDataFrame([(k,) for k in reversed(keys)], "k string").orderBy(reports.natural_key(F.col("k")), "k").collect()]
    assert got == ["a9", "a10", "á010x", "a10y", "a999999999999", "a9999999999999", "a12345678901234567890", "b1"]


def test_near_pictures_by_brute_force(spark):
    rng = random.Random(3)
    hashes = [rng.getrandbits(256) for _ in range(40)] + [0, 2**256 - 1]
    for h in list(hashes):
        for bits in (1, 4, 9, 10, 11):
            x = h
            for b in rng.sample(range(256), bits):
                x ^= 1 << b
            hashes.append(x)
    hashes += [hashes[0]] * 5
    rng.shuffle(hashes)
    rows = [(i, f"{h:064x}") for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows + [(900, None), (901, "zz"), (902, "f" * 63)], "id long, h string").repartition(3)
    want = {}
    for i, x in enumerate(hashes):
        near = [j for j in range(i) if (x ^ hashes[j]).bit_count() <= 10]
        if near:
            want[i] = min(near)
    assert {r.id: r.otro_id for r in matching.picture_duplicates(df).collect()} == want
    one = {h: min(j for j, y in enumerate(hashes) if y == h) for h in hashes}
    pairs = {(min(a, b), max(a, b)): (x ^ y).bit_count() for x, a in one.items() for y, b in one.items() if x != y and (x ^ y).bit_count() <= 10}
    got = matching.picture_pairs(df).collect()
    assert {(r.a, r.b): r.distancia for r in got} == pairs and len(got) == len(pairs)
    assert "NestedLoop" not in matching.picture_pairs(df)._jdf.queryExecution().executedPlan().toString()


def test_near_pictures_move_few_bytes(spark):
    """A search moves 24 keys of each different hash, with an id and the rest of a word: not 66 with the whole hash and its chunks."""
    rows = [(i, "ab" * 31 + f"{i:02x}") for i in range(4)]
    found = matching.picture_pairs(spark.createDataFrame(rows, "id long, h string"))
    assert len(found.collect()) == 6
    each = next(e for e in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in e)
    assert each.count("rest") == 24


ER = "id long, actividad_id long, numero string, nif string, emisor_norm string, total_c long, pagina int"


@pytest.mark.parametrize("seed", range(4))
def test_clusters_equal_the_step_in_order(spark, seed):
    """Suppliers with one id, none, or both; issuers with several ids; close totals; totals that are missing, also at first."""
    rng = random.Random(seed)
    suppliers = [("A", "X"), ("A", "Y"), ("B", "X2"), (None, "X2"), (None, "Z"), ("C", "W"), (None, "W"), ("D", "W") if seed % 2 else ("C", "W"), (None, None), ("E", None)]
    rows = [(i, 1 + i % 2, rng.choice(["S/N", "7", None]), *rng.choice(suppliers), rng.choice([None, *range(1000, 1014), 5000, 9000]), rng.choice([1, 2, None])) for i in range(300)]
    df = spark.createDataFrame(rows, ER).repartition(3)
    want = df.where("numero is not null").groupBy("actividad_id", "numero").applyInPandas(matching.in_order, matching.ER_SCHEMA).collect()
    want += [(r[0], r[0], "evidencia", "propuesta") for r in rows if r[2] is None]
    assert sorted(map(tuple, matching.cluster(df).collect())) == sorted(map(tuple, want))
    plain = matching.suppliers(df.where("numero is not null"))
    assert plain.where("clave is not null").count() > 100
    if seed % 2:
        assert {r.emisor_norm for r in plain.where("clave is null").collect()} == {"W"}
    else:
        assert plain.where("clave is null").count() == 0


def test_a_placeholder_number_is_spread_over_tasks(spark):
    """100,000 documents of one number and supplier with 40,000 totals: no task of the grouped step, same result as by hand."""
    df = spark.range(100_000).select("id", F.lit(1).cast("long").alias("actividad_id"), F.lit("SN").alias("numero"), F.lit("A").alias("nif"), F.lit("X").alias("emisor_norm"), (F.col("id") * 7919 % 40_000).alias("total_c"), F.lit(1).alias("pagina"))
    got = matching.cluster(df)
    centre, want = {}, {}
    for i in range(40_000):
        t = i * 7919 % 40_000
        near = [centre[x] for x in range(t - 2, t + 3) if x in centre]
        if not near:
            centre[t] = i
        want[t] = min(near, default=i)
    by = {r.doc_id: r.factura_id for r in got.collect()}
    assert len(by) == 100_000 and all(by[i] == want[i * 7919 % 40_000] for i in range(100_000))
    assert matching.suppliers(df).where("clave is null").count() == 0


@pytest.mark.parametrize("field, gold, text, want", [("fecha", "2024-03-05", "el 5/3/2024", True), ("fecha", "2024-03-05", "05.03.2024", True), ("fecha", "2024-03-05", "05-03-2024", True), ("fecha", "2024-03-05", "17/11/1999", False), ("fecha", "2024-03-05", None, False),
                                                     ("total", "1234.50", "TOTAL 1.234,50 EUR", True), ("total", "12.50", "12,50", True), ("total", "12.50", "13,50", False), ("nif_emisor", "b-1234567 4", "NIF: B12345674", True), ("numero", "F-1/2", "nº F12", True),
                                                     ("numero", "--", "x", False), ("emisor", "Iberdrola Clientes", "IBERDROLA CL1ENTES SAU", True), ("emisor", "Iberdrola", "Endesa", False), ("emisor", None, "Endesa", False)])
def test_field_in_text(spark, field, gold, text, want):
    df = spark.createDataFrame([(field, gold, text)], "f string, g string, t string")
    assert df.select(evals.field_in_text(F.col("f"), F.col("g"), F.col("t")).alias("x")).first().x is want


def test_numbers_of_one_document_need_no_rounds(spark, monkeypatch):
    import pandas as pd
    from ledgerspark.operators import matching
    cols = "id long, actividad_id long, numero string, nif string, emisor_norm string, total_c long, pagina int"
    rows = [(i, 1, f"N{i}", "B1", "ACME SA", 100 + i, 2) for i in range(40)] + [(100, 1, "N3", "B1", "ACME SA", 104, 2), (101, 1, "N4", "B1", "ACME SA", 900, 1), (102, 2, "N5", None, "OTRA SL", None, 1), (103, 2, None, "B1", "ACME SA", 5, 1)]
    seen, old = [], matching.suppliers
    monkeypatch.setattr(matching, "suppliers", lambda docs: seen.append(sorted(r.id for r in docs.collect())) or old(docs))
    got = sorted(map(tuple, matching.cluster(spark.createDataFrame(rows, cols)).collect()))
    frame = pd.DataFrame([r for r in rows if r[2]], columns=["id", "actividad_id", "numero", "nif", "emisor_norm", "total_c", "pagina"]).astype(object)
    frame = frame.where(frame.notna(), None)
    want = [(103, 103, "evidencia", "propuesta")]
    for _, g in frame.groupby(["actividad_id", "numero"]):
        want += [(r.doc_id, r.factura_id, r.relacion, r.estado_er) for r in matching.in_order(g).itertuples()]
    assert seen == [[3, 4, 100, 101]]
    assert got == sorted((int(a), int(b), c, d) for a, b, c, d in want)


def test_cascade_by_brute_force_without_repeating_entries_by_day(spark):
    import random
    from datetime import date, timedelta
    from ledgerspark.operators import matching
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rows = [(i, pick(1, 2), i, pick("pendiente", "rechazado"), None if rng.random() < .1 else date(2024, 2, 25) + timedelta(rng.randrange(12)), pick(100, 200, 300), pick("Acme Uno SA", "Otra Dos SL", None),
             pick("B1", "B-1", "B2", None), pick("F-0001", "F 0002", "F3", None)) for i in rng.sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "id long, actividad_id long, factura_id long, estado string, fecha date, total_c long, emisor string, nif_emisor string, numero_factura string")
    k = {r.id: r for r in matching.keyed(df).collect()}
    want = set()
    for a in k.values():
        found = []
        for b in k.values():
            if b.id >= a.id or a.actividad_id != b.actividad_id or a.total_c != b.total_c or not a.fecha or not b.fecha:
                continue
            same, close, valid = (lambda c: getattr(a, c) is not None and getattr(a, c) == getattr(b, c)), abs((a.fecha - b.fecha).days) <= 3, b.estado != "rechazado" and a.fecha == b.fecha
            found += [(p, b.id) for p, ok in enumerate((valid and same("nif") and same("numero"), valid and same("numero") and len(a.numero) >= 4, close and same("nif"), close and same("emisor_norm"))) if ok]
        if found:
            p, o = min(found)
            want.add((a.id, matching.SEARCHES[p][0], o, matching.SEARCHES[p][1]))
    got = matching.cascade(df)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 60
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "date_add" not in plan and "-3" not in "".join(x for x in plan.split("\n") if "Generate" in x)


def test_patterns_are_looked_for_where_no_id_decides(spark, monkeypatch):
    from ledgerspark import schema
    from ledgerspark.operators import rules
    code = schema.ACCOUNTS[0][0]
    rows = spark.createDataFrame([(1, 1, "B1", "pago f2020-0001 de luz", True), (2, 1, "B9", "pago f2020-0001 de luz", True), (3, 2, "", "pago f2020-0001", True), (4, 1, "", "", True)], "id long, actividad_id long, nif string, blob string, propiedad boolean")
    learned = spark.createDataFrame([(7, 1, "B1", "", code), (8, 1, "", "f2020-0001", code), (9, 1, "", "luz", code)], "regla_id long, actividad_id long, nif_emisor string, patron string, cuenta_codigo string")
    asked, old = [], rules.pattern_hits
    monkeypatch.setattr(rules, "pattern_hits", lambda r, p: asked.append(sorted(x.id for x in r.collect())) or old(r, p))
    got = {r.id: (r.origen, r.confianza_m) for r in rules.classify(rows, learned, schema.accounts(spark)).collect()}
    assert asked == [[2, 3, 4]]
    assert got[1] == ("aprendida", 950) and got[2] == ("aprendida", 850) and got[3][0] != "aprendida" and got[4][0] != "aprendida"


def test_a_vote_passes_only_its_own_fields_test(spark):
    from ledgerspark.operators import evals
    cols = "doc_id long, " + ", ".join(f"{c} string" for c in evals.FIELDS)
    one = spark.createDataFrame([(1, "Acme Sociedad", "B-1", None, "F-1", "2024-01-02", "1.00", "x", "2.00"), (2, "Acme", None, None, "F-1", " a", "1.00", "0.21", "1.21")], cols)
    two = spark.createDataFrame([(1, "acme, sociedad", "b1", "", "A F1", "2024-01-03", "1.01", "x", "3.00"), (3, "Acme", None, None, "F-1", "a", "1.00", "0.21", "1.21")], cols)
    v = evals.votes(one, two)
    got = {(r.doc_id, r.campo): (r.estado, r.consenso) for r in v.collect()}
    assert len(got) == 24
    assert [got[1, c] for c in evals.FIELDS] == [("acuerdo", "acme, sociedad"), ("acuerdo", "B-1"), ("vacio", ""), ("acuerdo", "A F1"), ("conflicto", ""), ("acuerdo", "1.00"), ("conflicto", ""), ("conflicto", "")]
    assert got[2, "fecha"] == ("solo_uno", " a") and got[3, "fecha"] == ("solo_dos", "a")
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan[:plan.index("Generate")]


def test_items_of_null_empty_and_plain_texts(spark):
    from ledgerspark.operators import extract
    rows = [(1, None), (2, ""), (3, "12345678 Mesa roble 1.234,50\n2. Silla\n-3,00\n2.5 x\nTotal 1.231,50"), (4, "a1b2 9,99\n²²² 5,00")]
    got = {r.id: [tuple(x) for x in r.i] for r in spark.createDataFrame(rows, "id long, t string").select("id", extract.items(F.col("t")).alias("i")).collect()}
    assert got == {1: [], 2: [], 3: [(1, "12345678", "Mesa roble", 123450), (2, None, "Silla", -300)], 4: [(1, None, "²²²", 500)]}
