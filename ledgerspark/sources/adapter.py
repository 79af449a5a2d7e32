"""Ledger views over the star-schema tables.

The mapping is integer arithmetic and plain string functions in SQL that Spark and DuckDB read alike; money
is in cents (columns *_c, long), confidences are in thousandths (columns *_m), rates are whole numbers. The same text serves queries and their checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema
from ..session import ship

_DIGIT = "cast(substr(lpad(cast(k as varchar(20)), 7, '0'), {i}, 1) as bigint)"


def _control() -> str:
    """Control digit of a company id with the seven digits of k: odd places doubled and digit-summed."""
    odd = [_DIGIT.format(i=i) for i in (1, 3, 5, 7)]
    even = [_DIGIT.format(i=i) for i in (2, 4, 6)]
    total = " + ".join([f"(2 * {d} - case when {d} > 4 then 9 else 0 end)" for d in odd] + even)
    return f"(10 - ({total}) % 10) % 10"


def _pick(kind: str, key: str) -> str:
    """SQL that spreads rows of a kind over the accounts of that kind, by regime."""
    out = "case"
    for regime, cond in ((schema.CI, "actividad_id < 3"), (schema.AE, "actividad_id = 3")):
        codes = [a[0] for a in schema.ACCOUNTS if a[2] == kind and a[3] == regime]
        for i, c in enumerate(codes):
            out += f" when {cond} and {key} % {len(codes)} = {i} then '{c}'"
    return out + " end"


#: Entries: the base rows and, for every fiftieth, a twin some days away.
ASIENTOS = f"""
with b0 as (select o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_totalprice, o.o_orderpriority, o.o_orderstatus, c.c_name, c.c_nationkey, o.o_custkey as k
            from {{orders}} o join {{customer}} c on o.o_custkey = c.c_custkey),
b1 as (select b0.*, {_control()} as ctl from b0),
b2 as (
select o_orderkey as id, o_orderkey, 1 + o_custkey % 3 as actividad_id,
  cast(case when c_nationkey % 4 = 0 then null else c_nationkey % 4 end as bigint) as inmueble_id,
  case when o_orderkey % 97 = 0 then null else cast(o_orderdate as date) end as fecha,
  case o_orderkey % 4 when 0 then upper(c_name) when 1 then concat(c_name, ' S.L.') when 2 then concat(c_name, ', S.A.U.') else c_name end as emisor,
  case when o_orderkey % 13 = 0 then null
       else concat('B', lpad(cast(k as varchar(20)), 7, '0'), cast((ctl + case when o_orderkey % 11 = 0 then 1 else 0 end) % 10 as varchar(20))) end as nif_emisor,
  case when o_orderkey % 17 = 0 then null
       else concat('F', cast(year(o_orderdate) as varchar(20)), '-', lpad(cast(o_orderkey as varchar(20)), 8, '0')) end as numero_factura,
  cast(round(o_totalprice * 100) as bigint) as total_c,
  cast(case o_orderkey % 5 when 0 then 21 when 1 then 10 when 2 then 4 when 3 then 0 else null end as bigint) as iva_tipo,
  case o_orderpriority when '1-URGENT' then 'ingreso' when '2-HIGH' then 'mejora' else 'gasto' end as tipo,
  case when o_orderstatus = 'F' then 'confirmado' when o_orderstatus = 'O' then 'pendiente'
       when o_orderkey % 2 = 1 then 'duplicado' when o_orderkey % 6 = 0 then 'rechazado' else 'confirmado' end as estado,
  o_orderkey % 41 as clase_40, o_orderkey % 37 as ocr_36, o_orderkey % 3 = 0 as validado
from b1),
b3 as (
select * from b2
union all
select id + 10000000 as id, o_orderkey, actividad_id, inmueble_id, cast(fecha + cast(o_orderkey % 7 - 3 as int) * interval '1' day as date) as fecha, emisor, nif_emisor,
  case when o_orderkey % 100 = 0 then 'G' || substr(numero_factura, 2) else numero_factura end as numero_factura,
  total_c, iva_tipo, tipo, estado, clase_40, ocr_36, validado from b2 where o_orderkey % 50 = 0),
b4 as (
select b3.*, cast(year(fecha) as bigint) as ejercicio,
  cast(floor(total_c * 100 / (100 + coalesce(iva_tipo, 0))) as bigint) as base0_c,
  case when o_orderkey % 7 = 0 then null when tipo = 'ingreso' then {_pick('ingreso', 'o_orderkey')}
       when tipo = 'mejora' then {_pick('mejora', 'o_orderkey')} else {_pick('gasto', 'o_orderkey')} end as cuenta_codigo
from b3)
select id, actividad_id, inmueble_id, id as documento_id, cast(o_orderkey as bigint) as factura_id, tipo, cuenta_codigo, fecha, ejercicio, emisor, nif_emisor,
  numero_factura, base0_c + case when o_orderkey % 19 = 0 then 7 else 0 end as base_c, iva_tipo, total_c - base0_c as iva_c, total_c, estado,
  clase_40 * 25 as conf_clase_m, ocr_36 * 27 as conf_ocr_m, validado,
  case when estado = 'rechazado' then case o_orderkey % 3 when 0 then 'Calidad de datos' else 'Otro' end end as motivo_rechazo,
  case when id >= 10000000 then o_orderkey end as duplicado_de_id, case when id >= 10000000 then 3 end as duplicado_nivel
from b4
"""

#: Line items of an entry; the position is the row's rank in a total order.
LINEAS = """
select l_orderkey as asiento_id,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) as posicion,
  lpad(cast(l_partkey as varchar(20)), 8, '0') as codigo, concat(l_returnflag, '-', l_linestatus, ' ', cast(l_partkey % 64 as varchar(20))) as descripcion,
  cast(l_quantity as bigint) as cantidad, cast(round(l_extendedprice * 100) as bigint) as base_c,
  cast(floor(cast(round(l_extendedprice * 100) as bigint) * cast(round(l_tax * 100) as bigint) / 100) as bigint) as iva_c,
  cast(round(l_tax * 100) as bigint) as iva_tipo, l_partkey % 23 = 0 as eliminada
from {lineitem}
"""


def ledger_sql(name: str) -> str:
    """A view's text for DuckDB, over the tables' own names."""
    text = {"asientos": ASIENTOS, "lineas": LINEAS}[name]
    return text.format(orders="orders", customer="customer", lineitem="lineitem")


class Ledger:
    """The ledger's tables as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def asientos(self) -> DataFrame:
        return self.spark.sql(ASIENTOS, orders=self.table("orders"), customer=self.table("customer"))

    @property
    def lineas(self) -> DataFrame:
        return self.spark.sql(LINEAS, lineitem=self.table("lineitem"))

    @property
    def cuentas(self) -> DataFrame:
        return schema.accounts(self.spark)

    @property
    def casillas(self) -> DataFrame:
        return schema.boxes(self.spark)
