"""Queries of a batch of files that are made from the entries: unreadable ones, copies under other names, documents of one invoice."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import extract, ingest
from ..session import shared_folder
from ..sources.snapshots import Snapshots
from .registry import query


def _taken_in(l) -> Snapshots:
    made = extract.render(l.asientos)
    name = F.concat(F.lpad(F.col("id").cast("string"), 12, "0"), F.lit(".txt"))
    again = (F.col("id") % 13 == 0) & (F.col("id") % 11 != 0)
    files = made.select(F.explode(F.when(again, F.array(name, F.concat(F.lit("z"), name))).otherwise(F.array(name))).alias("nombre"), F.when(F.col("id") % 11 != 0, F.col("texto").cast("binary")).alias("content"))
    store = Snapshots(l.spark, f"{shared_folder(l.spark)}/ledger-{uuid.uuid4().hex}")
    ingest.run(store, files, 1, l.cuentas)
    return store


#: Files in their order: those whose text came before are copies; those whose number (with its supplier) did are evidence.
FILES = """r as (select * from asientos where numero_factura is not null and fecha is not null and nif_emisor is not null and iva_tipo is not null and base_c + iva_c = total_c),
a as (select lpad(id::varchar, 12, '0') || '.txt' as nombre, * from r), g as (select *, (actividad_id, nif_emisor, numero_factura, fecha, base_c, iva_c, total_c, iva_tipo) as texto from a where id % 11 <> 0),
o as (select *, row_number() over (partition by texto order by nombre) as t from g), u as (select *, row_number() over (partition by numero_factura order by nombre) as k from o where t = 1),
res as (select nombre, 'error' as resultado from a where id % 11 = 0 union all select 'z' || nombre, 'copia' from a where id % 11 <> 0 and id % 13 = 0 union all select nombre, 'copia' from o where t > 1
union all select nombre, case when k = 1 then 'asiento' else 'evidencia' end from u)"""


@query("ingest_results", f"with {FILES} select * from res")
def _(l):
    return _taken_in(l).read("resultados").select("nombre", "resultado")


@query("ingest_entries", f"""with {FILES}, e as (select * from u where k = 1)
select e.nombre, e.numero_factura, e.fecha, e.total_c, case when exists (select 1 from e x where x.nombre < e.nombre and x.actividad_id = e.actividad_id and x.total_c = e.total_c and abs(date_diff('day', x.fecha, e.fecha)) <= 3) then 3 end as duplicado_nivel from e""")
def _(l):
    s = _taken_in(l)
    return s.read("asientos").join(s.read("documentos").select("id", "nombre"), "id").select("nombre", "numero_factura", "fecha", "total_c", "duplicado_nivel")
