"""Queries of an entry's page, its edits and lines, and small lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..operators import entry, reports, rules
from .registry import query
from .reports import LIVE

DEC = lambda c: f"case when {c} is null then '' else (case when {c} < 0 then '-' else '' end) || (abs({c}) // 100)::varchar || '.' || lpad((abs({c}) % 100)::varchar, 2, '0') end"
EURO = lambda c: f"case when {c} is null then '—' else translate(format('{{:,.2f}}', {c} / 100.0), ',.', '.,') || ' €' end"
LOW = "(not validado and (round(conf_ocr_m / 1000.0, 2) < 0.80 or coalesce(round(conf_clase_m / 1000.0, 2) < 0.80, true) or estado = 'pendiente'))"
BOXES = ", ".join(f"'{b[0]}'" for b in schema.BOXES)


@query("kpis_conflicts", f"""select actividad_id, ejercicio, count(*) filter (where {LIVE}) as n_asientos, count(distinct case when factura_id % 9 = 0 then factura_id end) as n_conflictos from asientos where ejercicio is not null group by 1, 2""")
def _(l):
    a = l.asientos
    return reports.kpis(a, a.where("factura_id % 9 = 0").select("factura_id")).select("actividad_id", "ejercicio", "n_asientos", "n_conflictos")


@query("book_totals", "select actividad_id, ejercicio, count(*) as n, sum(base_c)::bigint as base_c, sum(iva_c)::bigint as iva_c, sum(total_c)::bigint as total_c from asientos where estado <> 'duplicado' group by 1, 2")
def _(l):
    return entry.book_totals(l.asientos)


@query("line_gap", "select id, case when s is null then abs(total_c) else abs(s - total_c) end as hueco_c from asientos left join (select asiento_id, sum(base_c + iva_c)::bigint as s from lineas where coalesce(descripcion, '') <> '' or coalesce(codigo, '') <> '' group by 1) on id = asiento_id", "asientos lineas")
def _(l):
    return entry.line_gap(l.lineas.withColumn("importe_c", F.col("base_c") + F.col("iva_c")), l.asientos)


@query("ticket_match", "select id, coalesce(abs(s - total_c) <= 2, false) as coincide from asientos left join (select asiento_id, sum(base_c + iva_c)::bigint as s from lineas where not eliminada group by 1) on id = asiento_id", "asientos lineas")
def _(l):
    return entry.ticket_match(l.asientos, l.lineas)


@query("quality_chip", f"""select id, case when validado then 'ok' when numero_factura is null or {LOW} then 'warn' else 'ok' end as tono, case when validado then 'Validado' when numero_factura is null or {LOW} then 'Revisar' else 'Aceptable' end as texto from asientos""")
def _(l):
    return entry.quality_chip(l.asientos, l.asientos.where("numero_factura is null").select("id"))


@query("first_entry", "select factura_id, arg_min(id, (case when estado = 'duplicado' then 1 else 0 end) * 100000000000 + id) as id from asientos where factura_id is not null group by 1")
def _(l):
    return entry.first_entry(l.asientos)


@query("name_variants", """with v as (select actividad_id, nif_emisor as nif, emisor, count(*) as n, string_agg(id::varchar, ',' order by id) as ids from asientos where nif_emisor is not null and emisor is not null group by all)
select * from v where (actividad_id, nif) in (select (actividad_id, nif) from v group by actividad_id, nif having count(*) > 1)""")
def _(l):
    return entry.name_variants(l.asientos).select("actividad_id", "nif", "emisor", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("box_override", f"""with o as (select codigo, case when length(codigo) % 2 = 0 then 'mejoras' when length(codigo) % 3 = 0 then ' ' when length(codigo) % 5 = 0 then 'nada' end as ob from cuentas)
select c.codigo, case when coalesce(nullif(trim(ob), ''), casilla) in ({BOXES}) then coalesce(nullif(trim(ob), ''), casilla) else 'sin_clasificar' end as casilla from cuentas c join o on c.codigo = o.codigo""", "cuentas")
def _(l):
    n = F.length("codigo")
    own = l.cuentas.select("codigo", F.when(n % 2 == 0, "mejoras").when(n % 3 == 0, " ").when(n % 5 == 0, "nada").alias("casilla"))
    return entry.box_of_account(l.cuentas, own)


@query("account_next_code", "select 'CI.GAS-' || lpad((count(*) filter (where starts_with(codigo, 'CI.GAS')) + 1)::varchar, 3, '0') as codigo from cuentas", "cuentas")
def _(l):
    return entry.next_code(l.cuentas, "CI.GAS")


@query("evidence_documents", "select factura_id, id as documento_id from asientos where id % 3 <> 0", "asientos")
def _(l):
    a = l.asientos
    edges = a.select(F.lit("documento").alias("origen_tipo"), F.col("id").alias("origen_id"), F.lit("factura").alias("destino_tipo"), F.col("factura_id").alias("destino_id"), F.when(F.col("id") % 2 == 0, "evidencia").otherwise("continuacion").alias("tipo"))
    return entry.evidence_documents(edges.union(edges), a.where("id % 3 != 0").select("id"))


@query("replace_lines", """with n as (select asiento_id, row_number() over (partition by asiento_id order by posicion) as posicion, nullif(case when posicion % 3 = 0 then '' else codigo end, '') as codigo, case when posicion % 4 = 0 then '' else descripcion end as descripcion, case when posicion % 6 <> 0 then base_c end as importe_c
from lineas where asiento_id % 2 = 0 and not (posicion % 12 = 0))
select asiento_id, posicion, codigo, descripcion, importe_c from n union all select asiento_id, posicion, codigo, descripcion, base_c from lineas where asiento_id % 2 <> 0""", "lineas")
def _(l):
    p = F.col("posicion")
    old = l.lineas.select("asiento_id", p.cast("bigint").alias("posicion"), "codigo", "descripcion", F.col("base_c").alias("importe_c"))
    new = old.where("asiento_id % 2 = 0").select("asiento_id", p, F.when(p % 3 == 0, " ").otherwise(F.col("codigo")).alias("codigo"), F.when(p % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "descripcion")).alias("descripcion"), F.when(p % 6 != 0, F.col("importe_c")).alias("importe_c"))
    return entry.replace_lines(old, new)


@query("current_lines", "select asiento_id, posicion::bigint as posicion, codigo, descripcion, base_c as importe_c from lineas", "lineas")
def _(l):
    rows = l.lineas.select("asiento_id", "posicion", "codigo", "descripcion", F.col("base_c").alias("importe_c"))
    item = F.struct("posicion", "codigo", "descripcion", F.format_string("%d,%02d", F.floor(F.col("importe_c") / 100).cast("bigint"), F.col("importe_c") % 100).alias("importe"))
    legacy = rows.groupBy("asiento_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("json"))
    return entry.current_lines(rows.where("asiento_id % 3 != 0"), legacy)


@query("grid_rows", f"""with t as (select asiento_id, count(*) filter (where not eliminada) as n, sum(case when not eliminada and descripcion <> '' then cantidad end)::bigint as u from lineas group by 1)
select id, coalesce(strftime(fecha, '%d/%m/%Y'), '') as fecha, coalesce(emisor, '') as emisor, {EURO('total_c')} as total, coalesce(nombre, '') as rubro, estado, coalesce(u, 0) as unidades, coalesce(n, 0) as n_lineas, {LOW} as baja
from asientos left join t on id = asiento_id left join cuentas on cuenta_codigo = codigo""", "asientos lineas cuentas")
def _(l):
    return entry.grid_rows(l.asientos, l.lineas, l.cuentas)


@query("export_rows", f"""select id as "Id", coalesce(strftime(fecha, '%d/%m/%Y'), '') as "Fecha", coalesce(emisor, '') as "Emisor", coalesce(nif_emisor, '') as "NIF", coalesce(numero_factura, '') as "Factura", {DEC('base_c')} as "Base", {DEC('iva_c')} as "IVA", {DEC('total_c')} as "Total", coalesce(nombre, '') as "Rubro", estado as "Estado"
from asientos left join cuentas on cuenta_codigo = codigo""", "asientos cuentas")
def _(l):
    return entry.export_rows(l.asientos, l.cuentas)


@query("entry_body", f"""with i as (select asiento_id, count(*) as n, string_agg({DEC('base_c + iva_c')}, ',' order by posicion) as importes from lineas where not eliminada group by 1)
select id, coalesce(n, 0) as n, importes, {DEC('total_c')} as total from asientos left join i on id = asiento_id""", "asientos lineas")
def _(l):
    body = entry.entry_body(l.asientos, l.lineas, l.cuentas)
    x = F.from_json("cuerpo", "struct<total:string,lineas:array<struct<importe:string>>>")
    return body.select("id", x.alias("x")).select("id", F.size("x.lineas").cast("bigint").alias("n"), F.nullif(F.array_join(F.col("x.lineas.importe"), ","), F.lit("")).alias("importes"), F.col("x.total").alias("total"))


@query("latest_audit", """with a as (select o_orderkey % 97 as asiento_id, o_orderkey as audit_id from orders), r as (select *, row_number() over (partition by asiento_id order by audit_id desc)::int as puesto from a) select * from r where puesto <= 8""", "")
def _(l):
    return entry.latest_audit(l.table("orders").select((F.col("o_orderkey") % 97).alias("asiento_id"), F.col("o_orderkey").alias("audit_id")))


@query("field_texts", f"""select id, case when emisor is not null and numero_factura is not null then emisor || ' · ' || numero_factura when emisor is not null then emisor else 'f' || id || '.pdf' end as descripcion, (case when abs(base_c + iva_c - total_c) > 2 then 1 else 0 end) + (case when id % 9 = 0 then 1 else 0 end) as avisos, fecha, {DEC('-total_c')} as importe,
case when id % 3 = 0 then 800 when id % 50 >= 40 then 750 when id % 50 > 0 then 350 else 50 end as conf_m from asientos""")
def _(l):
    i = F.col("id")
    w = entry.warnings(F.col("base_c"), F.col("iva_c"), F.col("total_c"), F.when(i % 9 == 0, 17).otherwise(F.col("iva_tipo")))
    return l.asientos.select("id", entry.description(F.col("emisor"), F.col("numero_factura"), F.concat(F.lit("f"), i.cast("string"), F.lit(".pdf"))).alias("descripcion"), F.size(w).alias("avisos"),
                             entry.iso_date(F.concat(F.date_format("fecha", "yyyy-MM-dd"), F.lit("T00:00")))["fecha"].alias("fecha"), entry.decimals(-F.col("total_c")).alias("importe"),
                             entry.ocr_confidence(F.when(i % 3 == 0, "modelo").otherwise("rapid"), (i % 50).cast("int")).alias("conf_m"))


@query("quarter_bounds", "select distinct ejercicio, 'T' || q as trimestre, make_date(ejercicio, 3 * q - 2, 1) as desde, (make_date(ejercicio, 3 * q - 2, 1) + interval 3 month - interval 1 day)::date as hasta from asientos, (values (1), (2), (3), (4)) t(q) where ejercicio is not null")
def _(l):
    years = l.asientos.where("ejercicio is not null").select("ejercicio").distinct()
    return years.select("ejercicio", F.explode(entry.quarter_bounds(F.col("ejercicio").cast("int"))).alias("t")).select("ejercicio", "t.*")


@query("account_requests", """with w as (select nombre || case when length(codigo) % 2 = 0 then ' bis' else '' end as nombre, regimen, casilla from cuentas)
select *, case when regimen <> 'CI' then 'régimen' when casilla = 'sin_clasificar' then 'casilla' when lower(nombre) in (select lower(nombre) from cuentas) then 'repetida' end as error from w""".replace("'CI'", f"'{schema.CI}'"), "cuentas")
def _(l):
    c = l.cuentas
    return entry.account_requests(c.select(F.concat("nombre", F.when(F.length("codigo") % 2 == 0, " bis").otherwise("")).alias("nombre"), "regimen", "casilla"), c)


@query("lost_files", "select id, 'd/' || id as ruta from asientos where id % 13 = 0")
def _(l):
    docs = l.asientos.select("id", F.concat(F.lit("d/"), F.col("id").cast("string")).alias("ruta"))
    return entry.lost_files(docs, docs.where("id % 13 != 0").select("ruta"))


@query("placements", """with d as (select id, 'in/' || id as origen, actividad_id || '/' || substr(md5((id // 2)::varchar), 1, 12) || '_f.pdf' as d from asientos), r as (select *, row_number() over (partition by d order by id) as r from d)
select id, origen, case when r = 1 then d else d || '_' || id end as destino from r""")
def _(l):
    docs = l.asientos.select("id", F.concat(F.lit("in/"), F.col("id").cast("string")).alias("origen"), F.col("actividad_id").cast("string").alias("carpeta"), F.lit("f.pdf").alias("nombre"), F.md5(F.floor(F.col("id") / 2).cast("string").cast("binary")).alias("sha"), F.col("id").alias("bytes"))
    return entry.placements(docs)


@query("accounts_refreshed", "select codigo, nombre || case when length(codigo) % 4 = 0 then ' mía' else '' end as nombre, case when length(codigo) % 4 = 0 then 'usuario' else 'sistema' end as origen from cuentas", "cuentas")
def _(l):
    c = l.cuentas
    mine = F.length("codigo") % 4 == 0
    stored = c.where(mine | (F.length("codigo") % 3 == 0)).withColumn("nombre", F.concat("nombre", F.when(mine, " mía").otherwise(" vieja"))).withColumn("origen", F.when(mine, "usuario").otherwise("sistema"))
    return entry.refreshed(c, stored).select("codigo", "nombre", "origen")
