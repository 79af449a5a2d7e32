"""Versions of tables, and batches of files with broken ones, copies, evidence and reruns."""

import pytest
from pyspark.sql import functions as F

from ledgerspark import schema
from ledgerspark.operators import ingest
from ledgerspark.sources.snapshots import Conflict, Snapshots

BILL = "Iberdrola Clientes S.A.U.\nNIF: A95758389\nFactura nº: F2026-{n}\nFecha factura: 10/03/2026\nBase imponible 40,00\nIVA 21 % 8,40\nTOTAL {total} EUR\nPag. {page}"


def test_versions_switch_at_once(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    assert s.version() == 0 and s.read("t") is None
    assert s.commit({"t": spark.range(3), "u": spark.range(1)}, "b1") == 1
    assert s.commit({"t": spark.range(9)}, "b1") == 1 and s.read("t").count() == 3  # the batch is in
    assert s.commit({"t": spark.range(5)}, "b2") == 2
    assert s.read("t").count() == 5 and s.read("u").count() == 1 and s.read("t", 1).count() == 3
    with pytest.raises(Exception):
        s.commit({"t": spark.range(2), "w": spark.range(4).select(F.raise_error(F.lit("broken")))}, "b3")
    assert s.version() == 2 and s.read("t").count() == 5 and "b3" not in s.state()["batches"]
    other = Snapshots(spark, str(tmp_path))
    other.version = lambda: 1  # it hasn't seen version 2
    with pytest.raises(Conflict):
        other.commit({"t": spark.range(7)}, "b4")
    assert s.read("t").count() == 5


def files(spark, *rows):
    return spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in rows], "nombre string, content binary")


def test_a_batch_with_broken_files_takes_in_the_good_ones_once(spark, tmp_path):
    s, acc = Snapshots(spark, str(tmp_path)), schema.accounts(spark)
    one, two, three = (BILL.format(n=n, total=t, page=p).encode() for n, t, p in (("000123", "48,40", "1 / 2"), ("000123", "48,40", "2 / 2"), ("000124", "48,40", "1 / 1")))
    rows = [("b.pdf", one), ("a.pdf", b"\xff\xfe\x00"), ("c.pdf", one), ("d.pdf", two), ("e.pdf", three), ("f.pdf", None)]
    homes = spark.createDataFrame([(9, 1), (4, 1), (2, 2)], "id long, actividad_id long")
    batch = ingest.run(s, files(spark, *rows), 1, acc, properties=homes)
    got = {r["nombre"]: r["resultado"] for r in s.read("resultados").collect()}
    assert got == {"a.pdf": "error", "b.pdf": "asiento", "c.pdf": "copia", "d.pdf": "evidencia", "e.pdf": "asiento", "f.pdf": "error"}
    entries = s.read("asientos").orderBy("id").collect()
    assert [(e["numero_factura"], e["cuenta_codigo"], e["inmueble_id"], e["total_c"]) for e in entries] == [("F2026-000123", "CI.GAS.LUZ", 4, 4840), ("F2026-000124", "CI.GAS.LUZ", 4, 4840)]
    assert entries[0]["estado"] == "confirmado" and (entries[1]["estado"], entries[1]["duplicado_nivel"], entries[1]["duplicado_de_id"]) == ("pendiente", 3, entries[0]["id"])  # equal id and total on one day
    assert sorted((r["destino_id"] == entries[0]["id"], r["tipo"]) for r in s.read("relaciones").collect()) == [(False, "evidencia"), (True, "continuacion"), (True, "evidencia")]
    assert {(r["nombre"], r["etapa"], r["error"]) for r in s.read("errores").collect()} == {("a.pdf", "leer", "no es UTF-8"), ("f.pdf", "leer", "no se puede leer")}
    assert all("archivo/A1/2026/03/gasto/luz/" in r["destino"] for r in s.read("ubicaciones").collect())
    # the same again
    assert ingest.run(s, files(spark, *reversed(rows)), 1, acc) == batch and s.version() == 1
    # some of it again with new ones: copies and what the new ones meet
    four = BILL.format(n="000123", total="99,99", page="1 / 1").encode()
    ingest.run(s, files(spark, ("g.pdf", one), ("h.pdf", four)), 1, acc)
    assert {r["nombre"]: r["resultado"] for r in s.read("resultados").collect()} | {} == got | {"g.pdf": "copia", "h.pdf": "asiento"}
    assert s.read("asientos").count() == 3 and s.version() == 2
    # a quarantined file by its hash's first characters, with a reader that can read it
    bad = s.read("errores").where("nombre = 'a.pdf'").first()
    back = ingest.rescued(s.read("errores"), [bad["sha256"][:12]])
    assert [r["nombre"] for r in back.collect()] == ["a.pdf"] and ingest.rescued(s.read("errores"), []).count() == 0
    ingest.run(s, back.select("nombre", "content"), 1, acc, reader=lambda c: F.struct(F.lit(BILL.format(n="9", total="1,00", page="1/1")).alias("texto"), F.lit(None).cast("string").alias("error")))
    assert {r["nombre"] for r in s.read("errores").collect()} == {"f.pdf"} and s.read("asientos").count() == 4


def test_empty_batch_and_json_of_readings(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    ingest.run(s, files(spark), 1, schema.accounts(spark))
    assert s.version() == 1 and s.read("asientos").count() == 0 and s.read("resultados").count() == 0
    docs = spark.createDataFrame([("F-1", 4840), (None, None)], "numero string, total_c bigint")
    back = docs.select(ingest.from_json(ingest.to_json(docs)).alias("x"), ingest.from_json(F.lit("{broken")).alias("y")).collect()
    assert [(r.x.numero, r.x.total_c) for r in back] == [("F-1", 4840), (None, None)] and back[0].y is None or back[0].y.numero is None
