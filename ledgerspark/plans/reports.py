"""Report queries over all case files and years."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import book, reports
from .registry import query

LIVE = "estado not in ('duplicado', 'rechazado')"
LOW = "(not validado and (round(conf_ocr_m / 1000.0, 2) < 0.80 or round(conf_clase_m / 1000.0, 2) < 0.80 or estado = 'pendiente'))"


def s(cond: str, of: str = "total_c") -> str:
    return f"coalesce(sum(case when {cond} then {of} end), 0)::bigint"


KPIS = f"""select actividad_id, ejercicio, {s(f"{LIVE} and tipo = 'gasto'")} as gastos_c, {s(f"{LIVE} and tipo = 'ingreso'")} as ingresos_c, {s(f"{LIVE} and tipo = 'mejora'")} as mejoras_c,
count(*) filter (where {LIVE}) as n_asientos, count(*) filter (where estado = 'duplicado') as n_duplicados, count(*) filter (where estado = 'pendiente') as n_pendientes,
count(*) filter (where {LIVE} and {LOW}) as n_baja, count(*) filter (where validado) as n_validados, count(*) filter (where estado <> 'duplicado' and not validado) as n_sin_validar,
{s(f"{LIVE} and tipo = 'ingreso'")} - {s(f"{LIVE} and tipo = 'gasto'")} as resultado_c from asientos where ejercicio is not null group by all"""


@query("kpis", KPIS)
def _(l):
    return reports.kpis(l.asientos)


@query("by_month", f"""with g as (select actividad_id, ejercicio, month(fecha) as mes, {s("tipo = 'gasto'")} as gasto_c, {s("tipo = 'ingreso'")} as ingreso_c from asientos where {LIVE} and fecha is not null group by all),
d as (select distinct actividad_id, ejercicio, m.mes from g, (select unnest(range(1, 13)) as mes) m)
select d.actividad_id, d.ejercicio, d.mes::int as mes, coalesce(gasto_c, 0) as gasto_c, coalesce(ingreso_c, 0) as ingreso_c from d left join g on d.actividad_id = g.actividad_id and d.ejercicio = g.ejercicio and d.mes = g.mes""")
def _(l):
    return reports.by_month(l.asientos)


QUARTERS = f"""with r as (select *, quarter(fecha) as q from asientos where {LIVE} and fecha is not null),
p as (select *, 'T' || q as periodo from r union all select *, 'Año' as periodo from r),
g as (select actividad_id, ejercicio, periodo, {s("tipo = 'gasto'")} as gasto_c, {s("tipo = 'ingreso'")} as ingreso_c, {s("tipo = 'mejora'")} as mejora_c, {s("tipo in ('gasto', 'mejora')", 'iva_c')} as iva_c from p group by all),
d as (select distinct actividad_id, ejercicio, x.periodo from g, (select unnest(['T1', 'T2', 'T3', 'T4', 'Año']) as periodo) x)
select d.*, coalesce(gasto_c, 0) as gasto_c, coalesce(ingreso_c, 0) as ingreso_c, coalesce(mejora_c, 0) as mejora_c, coalesce(iva_c, 0) as iva_c, coalesce(ingreso_c, 0) - coalesce(gasto_c, 0) as neto_c
from d left join g on d.actividad_id = g.actividad_id and d.ejercicio = g.ejercicio and d.periodo = g.periodo"""


@query("by_quarter_rollup", QUARTERS)
def by_quarter(l):
    return reports.by_quarter(l.asientos)


ACCOUNT = f"""select actividad_id, ejercicio, coalesce(nombre, '(sin rubro)') as rubro, a.tipo, count(*) as n, sum(base_c)::bigint as base_c, sum(iva_c)::bigint as iva_c, sum(total_c)::bigint as total_c
from asientos a left join cuentas c on cuenta_codigo = codigo where {LIVE} and ejercicio is not null group by all"""


@query("by_account", ACCOUNT, "asientos cuentas")
def _(l):
    return reports.by_account(l.asientos, l.cuentas)


@query("by_property", f"""select actividad_id, ejercicio, coalesce('Inmueble ' || inmueble_id::varchar, '(sin inmueble)') as inmueble, tipo, sum(total_c)::bigint as total_c from asientos where {LIVE} and ejercicio is not null group by all""")
def _(l):
    return reports.by_property(l.asientos)


BOX = f"""with r as (select a.*, coalesce(nullif(casilla, ''), 'sin_clasificar') as caja from asientos a left join cuentas c on cuenta_codigo = codigo where {LIVE} and ejercicio is not null),
g as (select actividad_id, ejercicio, caja, count(*) as n, sum(total_c)::bigint as total_c from r group by all),
d as (select * from (select distinct actividad_id, ejercicio from g) x, casillas),
b as (select d.*, coalesce(n, 0) as n, coalesce(total_c, 0) as total_c from d left join g on d.actividad_id = g.actividad_id and d.ejercicio = g.ejercicio and d.casilla = g.caja)
"""


@query("tax_boxes", BOX + "select * from b", "asientos cuentas casillas")
def _(l):
    return reports.tax_boxes(l.asientos, l.cuentas, l.casillas)


@query("tax_boxes_shown", BOX + "select * from b where n > 0 or casilla in ('ingresos', 'mejoras')", "asientos cuentas casillas")
def _(l):
    return reports.tax_boxes(l.asientos, l.cuentas, l.casillas, hide_empty=True)


@query("tax_yield", BOX + f""", y as (select actividad_id, ejercicio, {s("casilla = 'ingresos'")} as ingresos_c, {s("resta and grupo <> 'ingreso'")} as deducibles_c, {s("casilla = 'mejoras'")} as mejoras_c from b group by all)
select *, ingresos_c - deducibles_c as rendimiento_c from y""", "asientos cuentas casillas")
def _(l):
    return reports.tax_yield(l.asientos, l.cuentas, l.casillas)


def vat_sql(rate: str, bucket: str) -> str:
    return f"""select actividad_id, ejercicio, case when {rate} is null then 'sin' when {bucket} = 21 then '21' when {bucket} = 10 then '10' when {bucket} = 4 then '4' when {bucket} = 0 then '0' else 'otros' end as tramo,
count(*) as n, sum(base_c)::bigint as base_c, sum(iva_c)::bigint as iva_c, sum(total_c)::bigint as total_c from asientos where {LIVE} and ejercicio is not null and tipo in ('gasto', 'mejora') group by all"""


@query("vat_exact", vat_sql("iva_tipo", "iva_tipo"))
def _(l):
    return reports.vat(l.asientos)


RATE = "(iva_tipo + (id % 7) * 0.2 - 0.6)"


@query("vat_rounded", vat_sql(RATE, f"round({RATE})"))
def _(l):
    return reports.vat(l.asientos, rounded=True, rate=F.col("iva_tipo") + (F.col("id") % 7) * 0.2 - 0.6)


@query("by_nature", f"""with r as (select a.*, case when c.codigo is null then 'Sin clasificar' when actividad_id < 3 then x.etiqueta else c.nombre end as naturaleza
from asientos a left join cuentas c on cuenta_codigo = c.codigo left join casillas x on coalesce(nullif(c.casilla, ''), 'sin_clasificar') = x.casilla where {LIVE} and ejercicio is not null)
select actividad_id, ejercicio, naturaleza, sum(total_c)::bigint as total_c, arg_min(tipo, id) as tipo from r group by all having sum(total_c) <> 0""", "asientos cuentas casillas")
def _(l):
    return reports.by_nature(l.asientos, l.cuentas, l.casillas)


RANK = f"""with g as (select actividad_id, ejercicio, coalesce(nullif(lower(trim(emisor)), ''), 'sin emisor') as clave, sum(total_c)::bigint as total_c, arg_min(coalesce(nullif(trim(emisor), ''), 'sin emisor'), id) as emisor
from asientos where {LIVE} and tipo = 'gasto' and total_c > 0 and ejercicio is not null group by all),
k as (select *, row_number() over (partition by actividad_id, ejercicio order by total_c desc, clave)::int as puesto from g)
"""


@query("supplier_ranking", RANK + "select * from k")
def _(l):
    return reports.supplier_ranking(l.asientos)


@query("supplier_top6", RANK + """, t as (select actividad_id, ejercicio, least(puesto, 7)::int as puesto, sum(total_c)::bigint as total_c, arg_min(emisor, puesto) as e from k group by actividad_id, ejercicio, least(puesto, 7))
select actividad_id, ejercicio, puesto, case when puesto > 6 then 'Resto' else e end as emisor, total_c,
floor(total_c * 1000 / sum(total_c) over (partition by actividad_id, ejercicio))::bigint as cuota_m, floor(total_c * 1000 / max(total_c) over (partition by actividad_id, ejercicio))::bigint as pico_m from t""")
def _(l):
    return reports.supplier_top(l.asientos)


@query("headline", RANK + f""", top as (select actividad_id, ejercicio, sum(total_c) as gasto_c, max(case when puesto = 1 then total_c end) as top_c, max(case when puesto = 1 then emisor end) as top from k group by all),
m as (select actividad_id, ejercicio, month(fecha) as mes, {s("tipo = 'gasto'")} as gasto_c from asientos where {LIVE} and fecha is not null group by all),
mm as (select actividad_id, ejercicio, min(mes) filter (where gasto_c = pico) as mes_pico, max(gasto_c) as pico_c, sum(gasto_c) as suma_c, max(case when gasto_c > 0 then mes end) as ultimo
  from (select *, max(gasto_c) over (partition by actividad_id, ejercicio) as pico from m) x group by actividad_id, ejercicio),
j as (select mm.*, top, round_even(100.0 * top_c / gasto_c, 0)::int as a, case when suma_c > 0 then round_even(100.0 * pico_c / suma_c, 0)::int end as b from mm left join top on mm.actividad_id = top.actividad_id and mm.ejercicio = top.ejercicio)
select actividad_id, ejercicio, case when a >= 50 then top || ' concentra el ' || a || ' %' when b >= 40 then 'Mes ' || mes_pico || ' concentra el ' || b || ' %' when ultimo is not null then 'Hasta mes ' || ultimo else '' end as frase from j""")
def _(l):
    return reports.headline(l.asientos)


@query("notices", f"""with k as ({KPIS}), c as (select actividad_id, ejercicio, count(distinct factura_id) as nc from asientos where ejercicio is not null and factura_id % 9 = 0 group by all),
u as (select actividad_id, count(*) as sin, string_agg(id::varchar, ',' order by id) filter (where r <= 5) as ids from (select *, row_number() over (partition by actividad_id order by id) as r from asientos where {LIVE} and fecha is null) group by 1)
select k.actividad_id, k.ejercicio, concat_ws('; ', case when n_pendientes = 1 then '1 asiento por revisar' when n_pendientes > 1 then n_pendientes || ' asientos por revisar' end, case when ingresos_c <= 0 then 'ejercicio sin ingresos' end,
case when n_duplicados = 1 then '1 duplicado fuera de los totales' when n_duplicados > 1 then n_duplicados || ' duplicados fuera de los totales' end, case when nc = 1 then '1 conflicto de agrupación' when nc > 1 then nc || ' conflictos de agrupación' end,
case when sin > 0 then sin || ' sin fecha: ' || ids || case when sin > 5 then ' y ' || (sin - 5) || ' más' else '' end end) as aviso from k left join c on k.actividad_id = c.actividad_id and k.ejercicio = c.ejercicio left join u on k.actividad_id = u.actividad_id""")
def _(l):
    return reports.notices(l.asientos, l.asientos.where("factura_id % 9 = 0"))


@query("undated_live", f"select id, actividad_id, emisor, total_c, estado from asientos where {LIVE} and fecha is null")
def _(l):
    return reports.undated(l.asientos)


@query("undated_summary", f"""with u as (select *, row_number() over (partition by actividad_id order by id) as r from asientos where {LIVE} and fecha is null)
select actividad_id, string_agg(id::varchar, ',' order by id) filter (where r <= 8) as ids, count(*) as n from u group by actividad_id""")
def _(l):
    return reports.undated_summary(l.asientos)


@query("state_listing", """select id, fecha, substr(coalesce(emisor, ''), 1, 32) as emisor, total_c, coalesce(nombre, '') as rubro, estado from asientos left join cuentas on cuenta_codigo = codigo where estado in ('pendiente', 'duplicado')""", "asientos cuentas")
def _(l):
    return reports.state_listing(l.asientos, l.cuentas, ("pendiente", "duplicado"))


@query("review_queue", f"""select actividad_id, ejercicio, row_number() over (partition by actividad_id, ejercicio order by case when {LOW} then 0 else 1 end, case when estado = 'pendiente' then 0 else 1 end, least(conf_ocr_m, conf_clase_m), id)::int as puesto,
id, estado, least(conf_ocr_m, conf_clase_m) as conf_min_m from asientos where estado <> 'duplicado' and not validado and ejercicio is not null""")
def _(l):
    return reports.review_queue(l.asientos)


@query("kanban_top12", """with r as (select *, row_number() over (partition by actividad_id, ejercicio, estado order by id)::int as puesto, count(*) over (partition by actividad_id, ejercicio, estado) as n from asientos where ejercicio is not null)
select actividad_id, ejercicio, estado, puesto, id, greatest(n - 12, 0) as mas from r where puesto <= 12""")
def _(l):
    return reports.kanban(l.asientos)


@query("review_funnel", """with g as (select actividad_id, ejercicio, count(*) filter (where estado = 'pendiente') as pendientes, count(*) filter (where estado = 'confirmado') as confirmados, count(*) filter (where estado = 'duplicado') as duplicados,
count(*) filter (where estado = 'rechazado') as rechazados from asientos where ejercicio is not null group by all)
select *, case when pendientes + confirmados + duplicados = 0 then 0 else round_even(100.0 * (confirmados + duplicados) / (pendientes + confirmados + duplicados), 0)::int end as avance from g""")
def _(l):
    return reports.review_funnel(l.asientos)


@query("reject_reasons", "select actividad_id, coalesce(split_part(motivo_rechazo, ' — ', 1), 'sin motivo') as motivo, count(*) as n from asientos where estado = 'rechazado' group by all")
def _(l):
    return reports.reject_reasons(l.asientos)


@query("twins", """select a.id, a.duplicado_nivel, b.id as gemelo_id, b.estado as gemelo_estado, b.total_c as gemelo_total_c from asientos a left join asientos b on a.duplicado_de_id = b.id
where a.estado <> 'duplicado' and a.duplicado_nivel is not null""")
def _(l):
    return reports.twins(l.asientos)


@query("pointed_at", f"select duplicado_de_id as id, min(id) as gemelo_id from asientos where {LIVE} and duplicado_de_id is not null group by 1")
def _(l):
    return reports.pointed_at(l.asientos)


@query("archive_paths", """select id, 'A' || actividad_id || '/' || coalesce(ejercicio::varchar, 'sin_fecha') || '/' || coalesce(lpad(month(fecha)::varchar, 2, '0'), '00') || '/' ||
case when estado in ('duplicado', 'rechazado') then estado when cuenta_codigo is null and estado = 'pendiente' then 'pendiente' else tipo end || '/' ||
case cuenta_codigo when 'CI.MEJ.MO' then 'mano-de-obra' when 'CI.MEJ.OTROS' then 'otras-mejoras' when 'CI.AMO.INMUEBLE' then 'amortizacion' when 'CI.GAS.REPARACION' then 'reparacion' when 'CI.GAS.INTERES' then 'interes'
when 'CI.GAS.ADMIN' then 'administracion' when 'AE.GAS.SS' then 'seguridad-social' when 'AE.INV.BIENES' then 'bienes-inversion' else coalesce(replace(lower(split_part(cuenta_codigo, '.', 3)), '_', '-'), 'sin-cuenta') end as ruta from asientos""")
def _(l):
    return reports.archive_paths(l.asientos)


SHEET = """select id, actividad_id, ejercicio, coalesce(strftime(fecha, '%Y-%m-%d'), '') as fecha, coalesce(emisor, '') as emisor, coalesce(nif_emisor, '') as nif, coalesce(numero_factura, '') as factura, base_c, iva_tipo, iva_c, total_c,
coalesce(nombre, '') as rubro, a.tipo, estado from asientos a left join cuentas on cuenta_codigo = codigo where ejercicio is not null and estado <> 'rechazado' and """
for _sheet, _cond in (("Gastos", "estado <> 'duplicado' and a.tipo = 'gasto'"), ("Ingresos", "estado <> 'duplicado' and a.tipo = 'ingreso'"), ("Mejoras", "estado <> 'duplicado' and a.tipo = 'mejora'"),
                      ("Duplicados", "estado = 'duplicado'"), ("Reclasificar", "estado = 'pendiente'")):
    query(f"sheet_{_sheet.lower()}", SHEET + _cond, "asientos cuentas")(lambda l, n=_sheet: reports.workbook(l.asientos, l.cuentas, l.casillas)[n])

CLASS = f"case when validado then 'validado' when {LOW} then 'baja' else 'ok' end"
BLOB = """lower(concat_ws(' ', id::varchar, strftime(fecha, '%d/%m/%Y'), emisor, nif_emisor, numero_factura, cuenta_codigo, tipo, estado))"""


@query("book_filter_facets", f"""select id, total_c, {CLASS} as clase from asientos where contains({BLOB}, 'customer#00000001') and coalesce(fecha >= date '1996-01-01', false) and coalesce(cuenta_codigo in ('CI.GAS.LUZ', 'CI.MEJ.PVC', 'AE.GAS.SS'), false)
and estado <> 'duplicado' and {CLASS} in ('baja', 'validado')""")
def _(l):
    f = book.Facets(search="Customer#00000001", since="1996-01-01", sets={"cuenta_codigo": ("CI.GAS.LUZ", "CI.MEJ.PVC", "AE.GAS.SS")}, confidence=("baja", "validado"))
    return l.asientos.where(book.matches(f)).select("id", "total_c", book.confidence_class().alias("clase"))


@query("book_filter_range", "select id, fecha, total_c from asientos where coalesce(fecha >= date '1997-04-01', false) and coalesce(fecha <= date '1997-06-30', false) and total_c >= 1000000 and total_c <= 20000000 and (tipo in ('gasto', 'pendiente') or estado in ('gasto', 'pendiente'))")
def _(l):
    f = book.Facets(since="1997-04-01", until="1997-06-30", least_c=1000000, most_c=20000000, states=("gasto", "pendiente"))
    return l.asientos.where(book.matches(f)).select("id", "fecha", "total_c")


@query("line_filter", "select asiento_id, posicion::int as posicion, base_c from lineas where not eliminada and coalesce(base_c >= 100000, true) and coalesce(case when iva_tipo = 0 then null else iva_c end <= 200000, true)", "lineas")
def _(l):
    iva = F.when(F.col("iva_tipo") != 0, F.col("iva_c"))
    return l.lineas.where(~F.col("eliminada") & book.between(F.col("base_c"), 100000, None, True) & book.between(iva, None, 200000, True)).select("asiento_id", "posicion", "base_c")


@query("facet_values", "select distinct faceta, valor from (select 'tipo' as faceta, tipo as valor from asientos union all select 'cuenta_codigo', cuenta_codigo from asientos union all select 'nif_emisor', nif_emisor from asientos) where valor is not null and valor <> '—'")
def _(l):
    return book.choices(l.asientos, ("tipo", "cuenta_codigo", "nif_emisor"))


@query("book_page", "select id, fecha, total_c from asientos order by total_c desc, id limit 15 offset 30")
def _(l):
    return book.page(l.asientos.select("id", "fecha", "total_c"), [F.col("total_c").desc(), F.col("id")], 3)


@query("visible_totals", f"""with r as (select *, (contains({BLOB}, 's.l.') and estado <> 'duplicado' and coalesce(total_c, 0) >= 5000000) as v from asientos where estado <> 'rechazado')
select actividad_id, ejercicio, count(*) filter (where v) as n_visibles, {s("v and estado <> 'duplicado'")} as total_c, {s("v and estado <> 'duplicado'", 'base_c')} as base_c, {s("v and estado <> 'duplicado'", 'iva_c')} as iva_c, {s("estado <> 'duplicado'")} as libro_c from r group by all""")
def _(l):
    return book.visible_totals(l.asientos, book.Facets(search="S.L.", least_c=5000000))


@query("range_kpis", f"""select actividad_id, {s("tipo = 'gasto'")} as gasto_c, {s("tipo = 'ingreso'")} as ingreso_c, {s("tipo = 'mejora'")} as mejora_c from asientos where {LIVE} and fecha between date '1998-01-01' and date '1998-03-31' group by all""")
def _(l):
    one = lambda k, n: F.coalesce(F.sum(F.when(F.col("tipo") == k, F.col("total_c"))), F.lit(0)).alias(n)
    return l.asientos.where(reports.live() & book.in_range("1998-01-01", "1998-03-31")).groupBy("actividad_id").agg(one("gasto", "gasto_c"), one("ingreso", "ingreso_c"), one("mejora", "mejora_c"))


RANGES = """y as (select distinct ejercicio as y from asientos where ejercicio is not null), p as (select y || ' T' || q as rango, make_date(y, 3 * q - 2, 1) as desde, (make_date(y, 3 * q - 2, 1) + interval 3 month - interval 1 day)::date as hasta from y, (values (1), (2), (3), (4)) t(q)
union all select y || ' año', make_date(y, 1, 1), make_date(y, 12, 31) from y union all select 'cruzado ' || y, make_date(y, 11, 15), make_date(y + 1, 2, 14) from y)"""


def _presets(l):
    """Quarters and years of the ledger, and ranges over two years."""
    y = l.asientos.where("ejercicio is not null").select(F.col("ejercicio").cast("int").alias("y")).distinct()
    text = F.col("y").cast("string")
    quarters = [F.struct(F.concat(text, F.lit(f" T{q}")).alias("rango"), F.make_date("y", F.lit(3 * q - 2), F.lit(1)).alias("desde"), F.last_day(F.make_date("y", F.lit(3 * q), F.lit(1))).alias("hasta")) for q in range(1, 5)]
    others = [F.struct(F.concat(text, F.lit(" año")).alias("rango"), F.make_date("y", F.lit(1), F.lit(1)).alias("desde"), F.make_date("y", F.lit(12), F.lit(31)).alias("hasta")),
              F.struct(F.concat(F.lit("cruzado "), text).alias("rango"), F.make_date("y", F.lit(11), F.lit(15)).alias("desde"), F.make_date(F.col("y") + 1, F.lit(2), F.lit(14)).alias("hasta"))]
    return y.select(F.explode(F.array(*quarters, *others)).alias("r")).select("r.*")


IN_RANGE = f"r as (select rango, a.* from asientos a join p on fecha between desde and hasta where {LIVE})"


@query("ranges_kpis", f"""with {RANGES}, {IN_RANGE} select rango, actividad_id, count(*) as n, {s("tipo = 'gasto'")} as gasto_c, {s("tipo = 'ingreso'")} as ingreso_c, {s("tipo = 'mejora'")} as mejora_c, {s("tipo = 'ingreso'")} - {s("tipo = 'gasto'")} as resultado_c from r group by all""")
def _(l):
    return book.range_insights(l.asientos, _presets(l))["kpis"]


@query("ranges_months", f"""with {RANGES}, {IN_RANGE} select rango, actividad_id, year(fecha)::int as ano, month(fecha)::int as mes, {s("tipo = 'gasto'")} as gasto_c, {s("tipo = 'ingreso'")} as ingreso_c from r group by all""")
def _(l):
    return book.range_insights(l.asientos, _presets(l))["meses"]


@query("ranges_suppliers", f"""with {RANGES}, {IN_RANGE}, g as (select rango, actividad_id, coalesce(nullif(lower(trim(emisor)), ''), 'sin emisor') as clave, sum(total_c)::bigint as total_c from r where tipo = 'gasto' and total_c > 0 group by all),
k as (select *, row_number() over (partition by rango, actividad_id order by total_c desc, clave)::int as puesto from g) select * from k where puesto <= 6""")
def _(l):
    return book.range_insights(l.asientos, _presets(l))["proveedores"]


@query("ranges_vat", f"""with {RANGES}, {IN_RANGE} select rango, actividad_id, coalesce(case when iva_tipo in (21, 10, 4, 0) then iva_tipo::varchar when iva_tipo is not null then 'otros' end, 'sin') as tramo, count(*) as n, sum(base_c)::bigint as base_c, sum(iva_c)::bigint as iva_c, sum(total_c)::bigint as total_c
from r where tipo in ('gasto', 'mejora') group by all""")
def _(l):
    return book.range_insights(l.asientos, _presets(l))["iva"]


@query("low_confidence", f"select id, {LOW} as baja, {CLASS} as clase, round_even(least(conf_ocr_m, conf_clase_m) / 10.0, 0)::int as pct from asientos")
def _(l):
    return l.asientos.select("id", reports.low_confidence().alias("baja"), book.confidence_class().alias("clase"), F.bround(F.least("conf_ocr_m", "conf_clase_m") / 10.0).cast("int").alias("pct"))


@query("first_seen_labels", "select trim(descripcion) as etiqueta, min(asiento_id) as primero from lineas where trim(descripcion) <> '' group by 1", "lineas")
def _(l):
    return reports.first_seen_labels(l.lineas, F.col("descripcion"), F.col("asiento_id"))


@query("account_list", "select codigo, nombre, tipo, regimen, casilla from cuentas where regimen = 'capital_inmobiliario'", "cuentas")
def _(l):
    return l.cuentas.where("regimen = 'capital_inmobiliario'")


@query("insight_rows", f"select id, tipo, fecha, coalesce(emisor, '') as emisor, coalesce(total_c, 0) as total_c, coalesce(base_c, 0) as base_c, iva_tipo from asientos where {LIVE} and tipo in ('gasto', 'ingreso', 'mejora')")
def _(l):
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return l.asientos.where(reports.live() & F.col("tipo").isin("gasto", "ingreso", "mejora")).select("id", "tipo", "fecha", F.coalesce("emisor", F.lit("")).alias("emisor"), z("total_c"), z("base_c"), "iva_tipo")
