"""Queries of scalar functions, extraction and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money, nif, text
from ..operators import evals, extract, items
from .matching import CIF_OK, blocks_sql
from .registry import query

_N = "regexp_replace(upper(coalesce(nif_emisor, '')), '[\\s.\\-]', '', 'g')"


@query("nif_validate", f"select id, {_N} as norm, case when nif_emisor is null then false else {CIF_OK} end as valido, {_N} in ('00000000T', '99999999R') as relleno from asientos")
def _(l):
    n = F.col("nif_emisor")
    return l.asientos.select("id", nif.normalize(n).alias("norm"), nif.is_valid(n).alias("valido"), nif.is_placeholder(n).alias("relleno"))


@query("nif_person", """with p as (select c_custkey as id, case c_custkey % 4 when 0 then 'X' when 1 then 'Y' when 2 then 'Z' else substr(lpad(c_custkey::varchar, 8, '3'), 1, 1) end || lpad((c_custkey * 7919 % 10000000)::varchar, 7, '0') as body from customer),
q as (select *, substr('TRWAGMYFPDXBNJZSQVHLCKE', ((translate(substr(body, 1, 1), 'XYZ', '012') || substr(body, 2))::bigint % 23 + 1)::int, 1) as ctl from p)
select id, body || case when id % 5 = 0 then 'A' else ctl end as nif, id % 5 <> 0 or ctl = 'A' as valido from q""", "")
def _(l):
    k = F.col("c_custkey")
    first = F.when(k % 4 == 0, "X").when(k % 4 == 1, "Y").when(k % 4 == 2, "Z").otherwise(F.substring(F.lpad(k.cast("string"), 8, "3"), 1, 1))
    body = F.concat(first, F.lpad((k * 7919 % 10000000).cast("string"), 7, "0"))
    ctl = F.substring(F.lit(nif.PERSON_LETTERS), ((F.concat(F.translate(F.substring(body, 1, 1), "XYZ", "012"), F.substring(body, 2, 7)).cast("bigint") % 23) + 1).cast("int"), F.lit(1))
    rows = l.table("customer").select(k.alias("id"), F.concat(body, F.when(k % 5 == 0, "A").otherwise(ctl)).alias("nif"))
    return rows.select("id", "nif", nif.is_valid(F.col("nif")).alias("valido"))


@query("nif_find_in_text", f"select id, case when nif_emisor is not null and {CIF_OK} then nif_emisor else '' end as encontrados, case when nif_emisor is not null and {CIF_OK} then nif_emisor end as emisor, null::varchar as receptor from asientos")
def _(l):
    t = F.concat_ws(" ", F.lit("Proveedor NIF:"), F.lower("nif_emisor"), F.lit("y otra vez"), F.col("nif_emisor"), F.lit("no B1234567, ni 123"))
    # each step is a column that the next one reads, so that a text is searched once
    found = l.asientos.select("id", nif.find_all(t).alias("ids")).withColumn("ambos", nif.issuer_and_receiver(F.col("ids")))
    return found.select("id", F.array_join("ids", ",").alias("encontrados"), "ambos.emisor", "ambos.receptor")


_EURO = "case when {c} < 0 then '-' else '' end || replace(replace(replace(format('{{:,.2f}}', abs({c}) / 100.0), ',', '_'), '.', ','), '_', '.') || ' €'"


@query("money_format", "select id, " + _EURO.format(c="(total_c - 9000000)") + " as texto, case when abs(total_c / 100.0) >= 1000 then replace(format('{:.1f}', total_c / 100000.0), '.', ',') || 'k' else round(total_c / 100.0)::bigint::varchar end as eje from asientos where total_c % 10000 <> 5000")
def _(l):
    c = F.col("total_c") - 9000000
    return l.asientos.where("total_c % 10000 != 5000").select("id", money.format_euro(c).alias("texto"), money.axis_label(F.col("total_c") / 100.0).alias("eje"))


@query("money_parse", "select id, total_c as a, total_c as b, total_c as c, null::bigint as d from asientos")
def _(l):
    es = money.format_euro(F.col("total_c"))
    us = F.format_number((F.col("total_c") / 100).cast("decimal(20,2)"), 2)
    return l.asientos.select("id", money.parse_amount(es).alias("a"), money.parse_amount(F.concat(us, F.lit(" EUR"))).alias("b"),
                             money.parse_amount(F.format_string("%.2f", (F.col("total_c") / 100).cast("decimal(20,2)").cast("double"))).alias("c"), money.parse_amount(F.concat(F.lit("n/a "), es)).alias("d"))


@query("amounts_in_text", "select id, base_c::varchar || ',' || iva_c::varchar || ',' || total_c::varchar as importes, total_c as ultimo from asientos")
def _(l):
    t = F.concat(F.lit("base "), money.format_euro(F.col("base_c")), F.lit(" iva "), F.format_number((F.col("iva_c") / 100).cast("decimal(20,2)"), 2), F.lit(" 1,5 y 12.345 total "), money.format_euro(F.col("total_c")))
    a = money.all_amounts(t)
    return l.asientos.select("id", F.array_join(F.transform(a, lambda x: x.cast("string")), ",").alias("importes"), F.try_element_at(a, F.lit(-1)).alias("ultimo"))


@query("amount_checks", """select id, abs(base_c + iva_c - total_c) <= 2 as cuadra, coalesce(iva_tipo in (21, 10, 4, 0), true) as tipo_conocido, case when abs(100.0 * iva_c / base_c - 0) <= 0.8 then 0 when abs(100.0 * iva_c / base_c - 4) <= 0.8 then 4
when abs(100.0 * iva_c / base_c - 10) <= 0.8 then 10 when abs(100.0 * iva_c / base_c - 21) <= 0.8 then 21 end as tipo_implicito from asientos where base_c <> 0""")
def _(l):
    return l.asientos.where("base_c != 0").select("id", money.header_adds_up(F.col("base_c"), F.col("iva_c"), F.col("total_c")).alias("cuadra"), money.known_rate(F.col("iva_tipo")).alias("tipo_conocido"),
                                                  money.implied_rate(F.col("base_c"), F.col("iva_c")).alias("tipo_implicito"))


@query("fiscal_keys", """with k as (select id, upper(regexp_replace(coalesce(nif_emisor, ''), '[\\s.\\-]', '', 'g')) as nif, nullif(regexp_replace(upper(numero_factura), '[^\\p{L}\\p{N}]', '', 'g'), '') as num, fecha, total_c from asientos)
select id, case when nif <> '' and num is not null and fecha is not null and total_c is not null then nif || '|' || num || '|' || strftime(fecha, '%Y-%m-%d') || '|' || total_c::varchar end as fiscal,
case when length(num) >= 4 and fecha is not null then num || '|' || strftime(fecha, '%Y-%m-%d') || '|' || total_c::varchar end as numero from k""")
def _(l):
    n, num, d, c = nif.normalize(F.col("nif_emisor")), text.normalize_number(F.col("numero_factura")), F.date_format("fecha", "yyyy-MM-dd"), F.col("total_c").cast("string")
    return l.asientos.select("id", F.when((n != "") & num.isNotNull() & d.isNotNull(), F.concat_ws("|", n, num, d, c)).alias("fiscal"), F.when((F.length(num) >= 4) & d.isNotNull(), F.concat_ws("|", num, d, c)).alias("numero"))


@query("number_normalize", "select id, nullif(regexp_replace(upper(numero_factura), '[^\\p{L}\\p{N}]', '', 'g'), '') as numero from asientos")
def _(l):
    return l.asientos.select("id", text.normalize_number(F.col("numero_factura")).alias("numero"))


@query("issuer_normalize", "select id, case when length(trim(regexp_replace(upper(emisor), '\\s+', ' ', 'g'))) >= 6 then substr(trim(regexp_replace(upper(emisor), '\\s+', ' ', 'g')), 1, 80) end as emisor_norm, case when length(emisor) > 20 then substr(emisor, 1, 19) || '…' else emisor end as corto from asientos")
def _(l):
    return l.asientos.select("id", text.normalize_issuer(F.col("emisor")).alias("emisor_norm"), text.label_cut(F.col("emisor"), 20).alias("corto"))


_ACC = "translate(coalesce(text, ''), '" + text.ACCENTED + "', '" + text.PLAIN + "')"


@query("text_compact", f"select doc_id, length(trim(regexp_replace(upper({_ACC}), '\\s+', ' ', 'g'))) as n_normal, md5(regexp_replace(upper({_ACC}), '[^A-Z0-9]', '', 'g')) as compacto from documents where not contains(text, 'ß')", "")
def _(l):
    t = F.col("text")
    return l.table("documents").where(~F.contains(t, F.lit("ß"))).select("doc_id", F.length(text.normalize_text(t)).cast("bigint").alias("n_normal"), F.md5(text.compact(t).cast("binary")).alias("compacto"))


@query("levenshtein_similarity", "select a.p_partkey as id, round(case when greatest(length(a.p_name), length(b.p_name)) = 0 then 1.0 else 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) end, 6) as similitud from part a join part b on b.p_partkey = a.p_partkey + 1", "")
def _(l):
    p = l.table("part").select("p_partkey", "p_name")
    a, b = p.alias("a"), p.alias("b")
    return a.join(b, F.col("b.p_partkey") == F.col("a.p_partkey") + 1).select(F.col("a.p_partkey").alias("id"), F.round(text.similarity(F.col("a.p_name"), F.col("b.p_name")), 6).alias("similitud"))


@query("name_ratio", f"with u as (select a.p_partkey as id, a.p_name as x, b.p_name as y from part a join part b on b.p_partkey = a.p_partkey + 1), {blocks_sql('u')} select id, round(ratio, 6) as ratio from ratios", "")
def _(l):
    from ..operators.matching import name_ratio_column

    a, b = l.table("part").alias("a"), l.table("part").alias("b")
    return a.join(b, F.col("b.p_partkey") == F.col("a.p_partkey") + 1).select(F.col("a.p_partkey").alias("id"), F.round(name_ratio_column(F.col("a.p_name"), F.col("b.p_name")), 6).alias("ratio"))


@query("jaro_winkler", "select a.p_partkey as id, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) as jw from part a join part b on b.p_partkey = a.p_partkey + 1", "")
def _(l):
    from ..operators.matching import jaro_winkler_column
    p = l.table("part").select("p_partkey", "p_name")
    a, b = p.alias("a"), p.alias("b")
    return a.join(b, F.col("b.p_partkey") == F.col("a.p_partkey") + 1).select(F.col("a.p_partkey").alias("id"), F.round(jaro_winkler_column(F.col("a.p_name"), F.col("b.p_name")), 6).alias("jw"))


@query("iso_week_key", "select id, extract(isoyear from fecha)::varchar || '-W' || lpad(extract(week from fecha)::varchar, 2, '0') as semana, quarter(fecha)::int as trimestre from asientos where fecha is not null")
def _(l):
    return l.asientos.where("fecha is not null").select("id", text.iso_week(F.col("fecha")).alias("semana"), F.quarter("fecha").alias("trimestre"))


@query("date_parse", "select id, fecha as a, fecha as b, null::date as c from asientos where fecha is not null")
def _(l):
    d = F.col("fecha")
    return l.asientos.where("fecha is not null").select("id", text.parse_date(F.date_format(d, "d/M/yyyy")).alias("a"), text.parse_date(F.date_format(d, "dd-MM-yyyy")).alias("b"), text.parse_date(F.concat(F.lit("45/"), F.date_format(d, "MM/yyyy"))).alias("c"))


@query("hamming_bits", "select id, bit_count(xor(id * 7919, id * 104729))::int as d from asientos")
def _(l):
    x = lambda k: F.lower(F.lpad(F.hex(F.col("id") * k), 16, "0"))
    return l.asientos.select("id", text.hamming_hex(x(7919), x(104729)).alias("d"))


@query("line_recalc", """select asiento_id, posicion::int as posicion, case when asiento_id % 2 = 0 then base_c else round((base_c + iva_c) * 100.0::double / (100 + iva_tipo))::bigint end as base, case when asiento_id % 2 = 0 then round(base_c * iva_tipo / 100.0::double)::bigint
else base_c + iva_c - round((base_c + iva_c) * 100.0::double / (100 + iva_tipo))::bigint end as vat from lineas""", "lineas")
def _(l):
    r = money.recompute(F.when(F.col("asiento_id") % 2 == 0, "base").otherwise("total"), F.col("base_c"), F.col("base_c") + F.col("iva_c"), F.col("iva_tipo"))
    return l.lineas.select("asiento_id", "posicion", r["base"].alias("base"), r["vat"].alias("vat"))


@query("quantity_text", "select id, regexp_replace(regexp_replace(format('{:.3f}', (id % 5000) / 1000.0), '0+$', ''), '\\.$', '') as texto from asientos")
def _(l):
    return l.asientos.select("id", money.quantity_text(F.col("id") % 5000).alias("texto"))


@query("parser_confidence", """select id, least(case when nif_emisor is not null then 250 else 0 end + case when fecha is not null then 200 else 0 end + case when numero_factura is not null then 150 else 0 end + 250 + 100 + 50, 990) as confianza_m from asientos""")
def _(l):
    has = lambda c: F.col(c).isNotNull()
    return l.asientos.select("id", extract.confidence(has("nif_emisor"), has("fecha"), has("numero_factura"), has("total_c"), has("base_c"), has("emisor")).alias("confianza_m"))


@query("native_text_score", """select doc_id, case when length(trim(text)) < 40 then 100 when length(regexp_replace(trim(text), '[^\\p{L}]', '', 'g')) < 0.12 * length(trim(text)) then 200 else least(450 + case when regexp_matches(upper(trim(text)), 'NIF|CIF|IVA|FACTURA|TOTAL') then 250 else 0 end
+ case when regexp_matches(text, '[0-9]') then 150 else 0 end + case when regexp_matches(upper(text), '€|EUR') then 100 else 0 end, 990) end as nota_m from documents where text is not null""", "")
def _(l):
    return l.table("documents").where("text is not null").select("doc_id", text.native_text_score(F.col("text")).alias("nota_m"))


@query("render_parse_roundtrip", f"""select id, regexp_replace(numero_factura, '[^A-Z0-9]', '', 'g') as numero_norm, fecha, case when {CIF_OK} then nif_emisor end as nif_emisor, base_c, iva_c, total_c, iva_tipo::double as iva_tipo, 'Suministros ' || actividad_id || ' S.L.' as emisor
from asientos where numero_factura is not null and fecha is not null and nif_emisor is not null and iva_tipo is not null and base_c + iva_c = total_c""")
def _(l):
    return extract.header(extract.render(l.asientos)).select("id", "numero_norm", "fecha", "nif_emisor", "base_c", "iva_c", "total_c", "iva_tipo", "emisor")


@query("vat_triplet", "select id, total_c as total, base_c as base, iva_c as iva, iva_tipo::int as tipo from asientos where iva_tipo in (21, 10, 4) and base_c + iva_c = total_c and base_c > 10000")
def _(l):
    t = extract.triplet(F.array("total_c", F.lit(37).cast("bigint"), "base_c", "iva_c"))
    return l.asientos.where("iva_tipo in (21, 10, 4) and base_c + iva_c = total_c and base_c > 10000").select("id", t.alias("t")).select("id", "t.total", "t.base", "t.iva", "t.tipo")


@query("breakdown_complete", """with x as (select asiento_id, posicion::int as posicion, base_c + iva_c as imp from lineas where not eliminada), b as (select *, round(imp * 100.0::double / 121)::bigint as base, count(*) over w as n, sum(imp) over w as total, row_number() over (partition by asiento_id order by posicion) as r from x window w as (partition by asiento_id)),
t as (select *, round(total * 1.0::double * (100.0::double / 121))::bigint - sum(base) over (partition by asiento_id) as resto from b)
select asiento_id, r::int as linea, base + case when r = n and abs(resto) <= 5 then resto else 0 end as base, imp as importe from t""", "lineas")
def _(l):
    rows = l.lineas.where("not eliminada").groupBy("asiento_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("posicion", (F.col("base_c") + F.col("iva_c")).alias("x")))), lambda s: s["x"]).alias("xs"))
    out = rows.select("asiento_id", F.posexplode(extract.breakdown(F.col("xs"), F.lit(21), F.lit(True))).alias("p", "s"))
    return out.select("asiento_id", (F.col("p") + 1).alias("linea"), F.col("s.base").alias("base"), F.col("s.importe").alias("importe"))


@query("item_lines", """select asiento_id, row_number() over (partition by asiento_id order by posicion)::int as linea, codigo, base_c as importe from lineas""", "lineas")
def _(l):
    line = F.concat(F.col("codigo"), F.lit(" Articulo "), F.translate(F.col("posicion").cast("string"), "0123456789", "abcdefghij"), F.lit("\n"), F.replace(money.format_euro(F.col("base_c")), F.lit(" €"), F.lit("")))
    docs = l.lineas.groupBy("asiento_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("posicion", line.alias("t")))), lambda s: s["t"]), "\n").alias("t"))
    got = docs.select("asiento_id", F.explode(extract.items(F.col("t"))).alias("i"))
    return got.select("asiento_id", F.col("i.posicion").alias("linea"), F.col("i.codigo").alias("codigo"), F.col("i.importe_c").alias("importe"))


NAMED = "select asiento_id as doc_id, posicion::int as orden, codigo, 'Articulo ' || translate(posicion::varchar, '0123456789', 'abcdefghij') as nombre"


@query("reference_pairs", f"{NAMED} from lineas", "lineas")
def _(l):
    return items.reference_pairs(items.article_region(items.kinds(items.render(l.lineas, "blocks")))).select("doc_id", "orden", "codigo", "nombre")


@query("numbered_lines", f"{NAMED} from lineas where posicion <= 40", "lineas")
def _(l):
    return items.numbered_lines(items.article_region(items.kinds(items.render(l.lineas, "columns")))).select("doc_id", "orden", "codigo", "nombre")


@query("block_prices", "select asiento_id as doc_id, posicion::int as orden, base_c + iva_c as importe_c from lineas", "lineas")
def _(l):
    return items.priced_codes(items.render(l.lineas, "blocks")).select("doc_id", "orden", "importe_c")


@query("column_runs", """with x as (select asiento_id as doc_id, count(*)::int as n, sum(base_c + iva_c)::bigint as suma_c, string_agg((base_c + iva_c)::varchar, ',' order by posicion) as importes from lineas group by 1) select * from x""", "lineas")
def _(l):
    # every price is written as one unit price and its double, which count as one line
    twice = items.render(l.lineas.withColumn("base_c", F.col("base_c") + F.col("iva_c")).withColumn("iva_c", F.lit(0).cast("bigint")), "columns")
    price = r"(?<=\n)([\d.]+,\d{2})(?=\n(?!Total TTI))"
    runs = items.column_runs(items.kinds(twice.withColumn("texto", F.regexp_replace("texto", price, "$1\n$1")))).where("con_cabecera")
    return runs.select("doc_id", "n", "suma_c", F.array_join(F.transform("importes", lambda x: x.cast("string")), ",").alias("importes"))


@query("find_items_blocks", f"{NAMED}, base_c + iva_c as importe_c, 'bloque' as origen from lineas", "lineas")
def _(l):
    docs = items.render(l.lineas, "blocks")
    return items.find_items(docs, docs)


@query("find_items_glued", f"{NAMED}, base_c + iva_c as importe_c, case when count(*) over (partition by asiento_id) = 1 then 'bloque' else 'columna' end as origen from lineas", "lineas")
def _(l):
    docs = items.render(l.lineas, "glued")
    return items.find_items(docs, docs)


@query("find_items_beside", """select asiento_id as doc_id, posicion::int as orden, null::varchar as codigo, 'Articulo ' || translate(posicion::varchar, '0123456789', 'abcdefghij') as nombre, base_c + iva_c as importe_c, 'linea' as origen from lineas
where asiento_id in (select asiento_id from lineas group by 1 having count(*) > 1)""", "lineas")
def _(l):
    docs = items.render(l.lineas, "beside")
    return items.find_items(docs, docs)


TOK = "tk as (select item_id as case_id, unnest(string_split(text, ' ')) as token from benchmark), tx as (select doc_id as case_id, upper(text) as t from documents where doc_id < (select count(*) from benchmark))"


@query("token_recall", None)
def _(l):
    tokens = l.table("benchmark").select(F.col("item_id").alias("case_id"), F.explode(F.split("text", " ")).alias("token")).where("token != ''").distinct()
    texts = l.table("benchmark").select(F.col("item_id").alias("case_id"), F.regexp_replace("text", "th", "tb").alias("text"))
    return evals.token_scores(tokens, texts)


RUNS = """rr as (select o_orderkey as case_id, case o_orderkey % 3 when 0 then 'rapid' when 1 then 'vision' else 'native' end as motor, case when o_orderkey % 11 = 0 then 'error' when o_orderkey % 13 = 0 then 'skipped' else 'ok' end as estado,
(o_orderkey % 100) / 100.0::double as campos, (o_orderkey % 50) / 50.0::double as tokens, (o_orderkey % 20) / 20.0::double as parser, o_orderkey % 997 as ms from orders)"""
SUMMARY = f"""{RUNS}, su as (select motor, count(*) filter (where estado = 'ok') as n_ok, count(*) filter (where estado = 'skipped') as n_saltados, count(*) filter (where estado = 'error') as n_error,
round(avg(case when estado = 'ok' then campos when estado = 'error' then 0 end), 4) as campos, round(avg(case when estado = 'ok' then tokens when estado = 'error' then 0 end), 4) as tokens, round(avg(case when estado = 'ok' then parser when estado = 'error' then 0 end), 4) as parser,
trunc(median(case when estado = 'ok' then ms end))::int as ms_mediana, trunc(avg(case when estado = 'ok' then ms end))::int as ms_media from rr group by motor)"""


def _runs(l):
    k = F.col("o_orderkey")
    return l.table("orders").select(k.alias("case_id"), F.element_at(F.array(*map(F.lit, ("rapid", "vision", "native"))), (k % 3 + 1).cast("int")).alias("motor"), F.when(k % 11 == 0, "error").when(k % 13 == 0, "skipped").otherwise("ok").alias("estado"),
                                    ((k % 100) / 100.0).alias("campos"), ((k % 50) / 50.0).alias("tokens"), ((k % 20) / 20.0).alias("parser"), (k % 997).alias("ms"))


@query("engine_summary", f"with {SUMMARY} select * from su", "")
def _(l):
    return evals.engine_summary(_runs(l))


@query("engine_rank", f"with {SUMMARY} select motor, row_number() over (order by campos desc, tokens desc, parser desc, ms_mediana, motor)::int as puesto from su where n_ok + n_error > 0", "")
def _(l):
    return evals.engine_ranking(evals.engine_summary(_runs(l)))


def _text(c):
    return f"({c} // 100)::varchar || '.' || lpad(({c} % 100)::varchar, 2, '0')"


def _reads(l):
    """Two readings of every entry with differences by key."""
    a, i = l.asientos, F.col("id")
    money_ = lambda c: F.format_string("%d.%02d", F.floor(F.col(c) / 100).cast("bigint"), (F.col(c) % 100).cast("int"))
    one = a.select(i.alias("doc_id"), "emisor", "nif_emisor", F.lit(None).cast("string").alias("nif_receptor"), F.col("numero_factura").alias("numero"), "fecha", money_("base_c").alias("base"), money_("iva_c").alias("iva_cuota"), money_("total_c").alias("total"))
    two = one.withColumn("nif_emisor", F.when(F.col("doc_id") % 4 == 0, F.lower("nif_emisor")).when(F.col("doc_id") % 9 == 0, F.lit("B00000001")).otherwise(F.col("nif_emisor"))).withColumn(
        "numero", F.when(F.col("doc_id") % 6 == 0, F.concat("numero", F.lit("X"))).when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("numero"))).withColumn("total", F.when(F.col("doc_id") % 10 == 0, F.lit("1.00")).otherwise(F.col("total")))
    return one, two


VOTES = f"""rd as (select id as doc_id, coalesce(emisor, '') as e, coalesce(nif_emisor, '') as n1, coalesce(case when id % 4 = 0 then lower(nif_emisor) when id % 9 = 0 then 'B00000001' else nif_emisor end, '') as n2, {CIF_OK} as ok,
coalesce(numero_factura, '') as u1, coalesce(case when id % 6 = 0 then numero_factura || 'X' when id % 7 = 0 then null else numero_factura end, '') as u2, coalesce(strftime(fecha, '%Y-%m-%d'), '') as f, {_text('base_c')} as b, {_text('iva_c')} as i, {_text('total_c')} as t1,
case when id % 10 = 0 then '1.00' else {_text('total_c')} end as t2, total_c from asientos),
lv as (select doc_id, 'emisor' as campo, e as uno, e as dos, true as igual, '' as gana from rd union all select doc_id, 'nif_emisor', n1, n2, upper(n1) = upper(n2), case when ok then n1 else '' end from rd union all select doc_id, 'nif_receptor', '', '', false, '' from rd
union all select doc_id, 'numero', u1, u2, true, '' from rd union all select doc_id, 'fecha', f, f, true, '' from rd union all select doc_id, 'base', b, b, true, '' from rd union all select doc_id, 'iva_cuota', i, i, true, '' from rd
union all select doc_id, 'total', t1, t2, t1 = t2 or abs(total_c - 100) <= 1, '' from rd),
lw as (select *, case when uno = '' and dos = '' then 'vacio' when dos = '' then 'solo_uno' when uno = '' then 'solo_dos' when igual then 'acuerdo' else 'conflicto' end as estado from lv),
lc as (select doc_id, campo, uno, dos, estado, case estado when 'acuerdo' then case when length(dos) > length(uno) then dos else uno end when 'solo_uno' then uno when 'solo_dos' then dos when 'conflicto' then gana else '' end as consenso from lw)"""


@query("field_votes", f"with {VOTES} select * from lc")
def _(l):
    return evals.votes(*_reads(l))


RECO = """a as (select *, case when id % 4 = 0 then lower(nif_emisor) when id % 9 = 0 then 'B00000001' else nif_emisor end as nif2, case when id % 6 = 0 then numero_factura || 'X' when id % 7 = 0 then null else numero_factura end as num2 from asientos),
f as (select id, case when nif_emisor is null and nif2 is null then 'h' when nif_emisor is null or nif2 is null then 's' when upper(nif_emisor) = upper(nif2) then 'a' else 'c' end as n, case when numero_factura is null then 'h' when num2 is null then 's' else 'a' end as u, case when fecha is null then 'h' else 'a' end as d,
case when id % 10 = 0 and abs(total_c - 100) > 1 then 'c' else 'a' end as t from a)"""


@query("recommendation", f"""with {RECO} select id as doc_id, (n = 'a')::int + (u = 'a')::int + (d = 'a')::int + (t = 'a')::int + 3 as acuerdos, (n = 'c')::int + (t = 'c')::int as conflictos, (n in ('h', 's'))::int + (u in ('h', 's'))::int + (d = 'h')::int + 1 as huecos,
case when n = 'c' or t = 'c' then 'revisar' when n = 'h' or u = 'h' or d = 'h' then 'revisar_menor' else 'consenso' end as recomendacion from f""")
def _(l):
    out = evals.recommendation(evals.votes(*_reads(l)))
    return out.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("acuerdos", "conflictos", "huecos")], "recomendacion")


@query("votes_wide", f"""with {VOTES} select doc_id, max(consenso) filter (where campo = 'nif_emisor') as nif_emisor, max(consenso) filter (where campo = 'numero') as numero, max(consenso) filter (where campo = 'fecha') as fecha, max(consenso) filter (where campo = 'total') as total
from lc group by 1""")
def _(l):
    return evals.wide(evals.votes(*_reads(l)))


@query("field_scores", """select o_orderkey as case_id, 2 as n, case when o_orderkey % 3 = 0 then 1 else 2 end as correctos, case when o_orderkey % 3 = 0 then 500 else 1000 end as acierto_m from orders""", "")
def _(l):
    k = F.col("o_orderkey")
    o = l.table("orders")
    long = lambda total: o.select(k.alias("case_id"), F.explode(F.array(F.struct(F.lit("numero").alias("campo"), k.cast("string").alias("valor")), F.struct(F.lit("total").alias("campo"), total.alias("valor")))).alias("f")).select("case_id", "f.*")
    t = F.format_string("%.2f", "o_totalprice")
    return evals.field_scores(long(t), long(F.when(k % 3 == 0, F.format_string("%.2f", F.col("o_totalprice") + 5)).otherwise(t))).select("case_id", F.col("n").cast("int").alias("n"), F.col("correctos").cast("int").alias("correctos"), F.col("acierto_m").cast("int").alias("acierto_m"))


@query("daily_events", "select date_trunc('day', ts)::date as dia, event_type, count(*) as n, round(sum(value), 4) as v from events group by all", "")
def _(l):
    return l.table("events").groupBy(F.to_date("ts").alias("dia"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
