"""Queries of duplicate detection, linkage, entity resolution, classification, quality and changes."""

from __future__ import annotations

from math import log2

from pyspark.sql import functions as F

from .. import schema
from ..functions import nif, text
from ..operators import matching, reports, rules
from .registry import query
from .reports import LIVE

_NUM = "nullif(regexp_replace(upper(numero_factura), '[^\\p{L}\\p{N}]', '', 'g'), '')"
_ISS = "case when length(trim(regexp_replace(upper(emisor), '\\s+', ' ', 'g'))) >= 6 then substr(trim(regexp_replace(upper(emisor), '\\s+', ' ', 'g')), 1, 80) end"
K = f"k as (select *, nullif(regexp_replace(upper(coalesce(nif_emisor, '')), '[\\s.\\-]', '', 'g'), '') as nif, {_NUM} as numero, {_ISS} as emisor_norm from asientos)"
PAIR = "select a.id, b.id as otro_id from k a join k b on b.id < a.id and a.actividad_id = b.actividad_id and "
NEAR = "abs(date_diff('day', a.fecha, b.fecha)) <= 3"
FISCAL = PAIR + "a.nif = b.nif and a.numero = b.numero and a.fecha = b.fecha and a.total_c = b.total_c and b.estado <> 'rechazado'"
NUMBER = PAIR + "a.numero = b.numero and a.fecha = b.fecha and a.total_c = b.total_c and b.estado <> 'rechazado' and length(a.numero) >= 4"
IDS = PAIR + f"a.nif = b.nif and a.total_c = b.total_c and {NEAR}"
ISSUER = PAIR + f"a.emisor_norm = b.emisor_norm and a.total_c = b.total_c and {NEAR}"


@query("dup_fiscal", f"with {K} {FISCAL}")
def _(l):
    return matching.fiscal_duplicates(l.asientos)


@query("dup_number", f"with {K} {NUMBER}")
def _(l):
    return matching.number_duplicates(l.asientos)


@query("dup_nif_window", f"with {K} {IDS}")
def _(l):
    return matching.id_window_duplicates(l.asientos)


@query("dup_issuer_window", f"with {K} {ISSUER}")
def _(l):
    return matching.issuer_window_duplicates(l.asientos)


HITS = f"""h as (select id, 1 as p, otro_id, 2 as nivel, 'clave fiscal' as motivo from ({FISCAL}) x union all select id, 2, otro_id, 2, 'número, fecha y total' from ({NUMBER}) x
union all select id, 3, otro_id, 3, 'NIF y total cercanos' from ({IDS}) x union all select id, 4, otro_id, 3, 'emisor y total cercanos' from ({ISSUER}) x),
c as (select * from (select *, row_number() over (partition by id order by p, otro_id) as r from h) where r = 1)"""


@query("dup_cascade", f"with {K}, {HITS} select id, nivel, otro_id, motivo from c")
def _(l):
    return matching.cascade(l.asientos)


@query("dup_state", f"""with {K}, {HITS} select k.id, case when nivel is not null and (numero_factura is null or nivel <= 2) then 'duplicado' when nivel is not null then 'pendiente'
when cuenta_codigo is not null and conf_clase_m >= 800 then 'confirmado' else 'pendiente' end as estado_nuevo, otro_id as apunta_a, nivel from k left join c on k.id = c.id""")
def _(l):
    return matching.state_from_hit(l.asientos, matching.cascade(l.asientos))


@query("twin_candidates", f"""with {K}, u as (select * from k where estado <> 'duplicado'), t as (
select a.id, b.id as otro_id, 1 as p from u a join u b on b.id < a.id and a.actividad_id = b.actividad_id and a.nif = b.nif and a.total_c = b.total_c and {NEAR}
union all select a.id, b.id, 2 from u a join u b on b.id < a.id and a.actividad_id = b.actividad_id and a.emisor_norm = b.emisor_norm and a.total_c = b.total_c and {NEAR})
select id, otro_id, min(p) as prioridad from t group by all""")
def _(l):
    return matching.twin_candidates(l.asientos)


@query("dup_sha", """with r as (select doc_id as id, sha256(text) as sha from documents where text is not null), g as (select sha, min(id) as original_id from r group by sha having count(*) > 1)
select id, original_id from r join g on r.sha = g.sha where id <> original_id""", "")
def _(l):
    return matching.hash_duplicates(l.table("documents"))


#: A stand-in for perceptual hashes: the signs of an embedding's 64 components, as the bits of a long.
def _sign_bits(l):
    bits = F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return l.table("embeddings").select(F.col("vec_id").alias("id"), F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)).alias("h"))


@query("dup_phash_bands", """with e as (select vec_id as id, generate_subscripts(embedding, 1) as i, unnest(embedding) > 0 as b from embeddings)
select a.id, c.id as otro_id, count(*) filter (where a.b <> c.b)::int as distancia from e a join e c on a.i = c.i and c.id < a.id group by all having count(*) filter (where a.b <> c.b) <= 18""", "")
def _(l):
    return matching.perceptual_pairs(_sign_bits(l), most=18, bands=19)


#: Picture hashes: of four entries in a row three are near the first, by their first hexadecimal digits; every seventh hash is the one of an entry far away.
PICTURES = """p as (select id, case when id % 7 = 0 then sha256('copia ' || (id % 1000)) else repeat('f', (id % 4)::int) || substr(sha256((id // 4)::varchar), (id % 4 + 1)::int) end as h, case when id % 7 = 0 then 'c' || (id % 1000) else (id // 4)::varchar end as g from asientos),
d as (select a.id, b.id as otro_id, (select sum(bit_count(xor(('0x' || substr(a.h, i, 8))::bigint, ('0x' || substr(b.h, i, 8))::bigint))) from (values (1), (9), (17), (25), (33), (41), (49), (57)) t(i)) as bits from p a join p b on a.g = b.g and b.id < a.id),
im as (select id, min(otro_id) as otro_id from d where bits <= 10 group by id)"""


def _pictures(l):
    i = F.col("id")
    n = (i % 4).cast("int")
    near = F.concat(F.repeat(F.lit("f"), n), F.substring(F.sha2(F.floor(i / 4).cast("string"), 256), n + 1, F.lit(64)))
    return l.asientos.select("id", F.when(i % 7 == 0, F.sha2(F.concat(F.lit("copia "), (i % 1000).cast("string")), 256)).otherwise(near).alias("h"))


@query("dup_pictures", f"with {PICTURES} select * from im")
def _(l):
    return matching.picture_duplicates(_pictures(l))


@query("dup_cascade_pictures", f"""with {K}, {HITS}, {PICTURES} select id, nivel, otro_id, motivo from c union all select id, 3, otro_id, 'imagen parecida' from im where id not in (select id from c)""")
def _(l):
    return matching.cascade(l.asientos, matching.picture_duplicates(_pictures(l)))


EDGES = """e as (select id as edge_id, case when id % 10 = 0 then 'otro' else 'documento' end as origen_tipo, case when id % 101 = 0 then -id else id end as origen_id, 'factura' as destino_tipo,
case when id % 103 = 0 then -factura_id - 1 else factura_id end as destino_id, case when id % 5 = 0 then 'continuacion' when id % 7 = 0 then 'conflicto' else 'evidencia' end as tipo from asientos)"""


def _edges(l):
    i = F.col("id")
    return l.asientos.select(i.alias("edge_id"), F.when(i % 10 == 0, "otro").otherwise("documento").alias("origen_tipo"), F.when(i % 101 == 0, -i).otherwise(i).alias("origen_id"), F.lit("factura").alias("destino_tipo"),
                             F.when(i % 103 == 0, -F.col("factura_id") - 1).otherwise(F.col("factura_id")).alias("destino_id"), F.when(i % 5 == 0, "continuacion").when(i % 7 == 0, "conflicto").otherwise("evidencia").alias("tipo"))


@query("evidence_counts", f"with {EDGES} select destino_id as factura_id, count(*) as n from e where tipo in ('evidencia', 'continuacion') and origen_tipo = 'documento' group by all")
def _(l):
    return reports.evidence_counts(_edges(l))


@query("orphan_edges", f"""with {EDGES} select edge_id from e where not (origen_tipo = 'documento' and exists (select 1 from asientos a where a.id = origen_id)) or not exists (select 1 from asientos a where a.factura_id = destino_id)""")
def _(l):
    a = l.asientos
    return matching.orphan_edges(_edges(l), a.select("id"), a.select(F.col("factura_id").alias("id")).distinct())


def _bits_sql(levels, conditions, null):
    w = [log2(m / u) for m, u in levels]
    return f"case when {null} then 0.0::double " + " ".join(f"when {c} then {x!r}::double" for c, x in zip(conditions, w)) + f" else {w[-1]!r}::double end"


_PB = log2(schema.PAIR_PRIOR / (1 - schema.PAIR_PRIOR))
_FORMS = "|".join(text.LEGAL_FORMS)
CLEAN = (f"trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(emisor, '')), '\\b[ab]\\d{{8}}\\b', ' ', 'g'), '[.,;:()/]+', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+({_FORMS})$', ''), '\\s+({_FORMS})$', ''))")


PAIRS = f"""r as (select *, nullif({CLEAN}, '') as nombre, extract(isoyear from fecha)::varchar || '-W' || lpad(extract(week from fecha)::varchar, 2, '0') as semana from k where {LIVE}),
p as (select l.id as a, r.id as b from r l join r on l.actividad_id = r.actividad_id and l.nif = r.nif and l.id < r.id union select l.id, r.id from r l join r on l.actividad_id = r.actividad_id and l.numero = r.numero and l.id < r.id
  union select l.id, r.id from r l join r on l.actividad_id = r.actividad_id and l.total_c = r.total_c and l.id < r.id),
w as (select l.id as id_a, r.id as id_b, {_PB!r}::double + {_bits_sql(schema.PAIR_LEVELS['nif'], ['l.nif = r.nif'], 'l.nif is null or r.nif is null')} + {_bits_sql(schema.PAIR_LEVELS['numero'], ['l.numero = r.numero'], 'l.numero is null or r.numero is null')}
 + {_bits_sql(schema.PAIR_LEVELS['fecha'], ['l.fecha = r.fecha', 'l.semana = r.semana'], 'l.fecha is null or r.fecha is null')} + {_bits_sql(schema.PAIR_LEVELS['importe'], ['l.total_c = r.total_c'], 'l.total_c is null or r.total_c is null')}
 + {_bits_sql(schema.PAIR_LEVELS['nombre'], ['jaro_winkler_similarity(l.nombre, r.nombre) >= 0.95', 'jaro_winkler_similarity(l.nombre, r.nombre) >= 0.85'], 'l.nombre is null or r.nombre is null')} as peso
 from p join r l on p.a = l.id join r r on p.b = r.id)"""


@query("invoice_pairs", f"""with {K}, {PAIRS} select id_a, id_b, round(peso, 6) as peso, round(1 / (1 + pow(2.0, -peso)), 6) as probabilidad from w where 1 / (1 + pow(2.0, -peso)) >= 0.9""")
def _(l):
    # twins are given invoices of their own here, so that there is something to find
    return matching.invoice_pairs(l.asientos.withColumn("factura_id", F.col("id"))).select("id_a", "id_b", F.round("peso", 6).alias("peso"), F.round("probabilidad", 6).alias("probabilidad"))


def blocks_sql(pairs: str) -> str:
    """Common table expressions up to `ratios` (id, ratio) for names x, y of a table of pairs: the longest common block is looked for in all parts, step by step."""
    best = """list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda n: case when contains(b, substr(a, i, n)) then {'n': n, 'i': -i} end))))"""
    return f"""names as (select distinct x, y from {pairs}), jobs as (select row_number() over () as job, x, y from names),
ways as (select job, 0 as way, x as a, y as b from jobs union all select job, 1, array_to_string(list_sort(string_split(x, ' ')), ' '), array_to_string(list_sort(string_split(y, ' ')), ' ') from jobs),
parts as (with recursive parts as (select job, way, a, b, 0 as n from ways
 union all select job, way, e.a, e.b, e.n from (select job, way, unnest([{{'a': substr(a, 1, -m.i - 1), 'b': substr(b, 1, strpos(b, substr(a, -m.i, m.n)) - 1), 'n': m.n}},
  {{'a': substr(a, -m.i + m.n), 'b': substr(b, strpos(b, substr(a, -m.i, m.n)) + m.n), 'n': 0}}]) as e
  from (select job, way, a, b, {best} as m from parts where a <> '' and b <> '') where m is not null)) select * from parts),
sums as (select job, way, sum(n) as n from parts group by all),
ratios as (select u.id, max(2.0 * sums.n / (length(u.x) + length(u.y)))::double as ratio from {pairs} u join jobs on u.x = jobs.x and u.y = jobs.y join sums using (job) group by u.id)"""


_SB = log2(schema.SUPPLIER_PRIOR / (1 - schema.SUPPLIER_PRIOR))
SUPPLIERS = f"""s as (select nif, {CLEAN} as nombre, min(id) as id from k where {CLEAN} <> '' group by all), p as (select a.id as id_a, b.id as id_b from s a join s b on a.nif = b.nif and a.id < b.id
union select a.id, b.id from s a join s b on split_part(a.nombre, ' ', 1) = split_part(b.nombre, ' ', 1) and a.id < b.id),
t as (select id_a, id_b, a.nif as nif_a, b.nif as nif_b, jaro_winkler_similarity(a.nombre, b.nombre) as jw from p join s a on id_a = a.id join s b on id_b = b.id)"""


def _scored(l, by_hand, similar=matching.jaro_winkler_column):
    d = matching.supplier_pairs(l.asientos, similar).withColumn("s", matching.supplier_score(F.col("nif_a"), F.col("nif_b"), F.col("jw"), by_hand))
    return d.select("id_a", "id_b", F.round("s.peso", 6).alias("peso"), F.round("s.probabilidad", 6).alias("probabilidad"), "s.banda")


_BAND = "select id_a, id_b, round(peso, 6) as peso, round(1 / (1 + pow(2.0, -peso)), 6) as probabilidad, case when 1 / (1 + pow(2.0, -peso)) >= 0.9 then 'auto' when 1 / (1 + pow(2.0, -peso)) >= 0.5 then 'revisar' else 'rechazar' end as banda from w"


@query("supplier_score_lib", f"with {K}, {SUPPLIERS}, w as (select id_a, id_b, {_SB!r}::double + {_bits_sql(schema.SUPPLIER_LEVELS['nif'], ['nif_a = nif_b'], 'nif_a is null or nif_b is null')} + {_bits_sql(schema.SUPPLIER_LEVELS['nombre'], ['jw >= 0.95', 'jw >= 0.85', 'jw >= 0.70'], 'jw is null')} as peso from t) {_BAND}")
def _(l):
    return _scored(l, False)


@query("supplier_score_hand", f"""with {K}, {SUPPLIERS}, w as (select id_a, id_b, (-8.0 + case when nif_a is null or nif_b is null then 0 when nif_a = nif_b then 18 else -18 end + case when jw >= 0.95 then 10 when jw >= 0.85 then 8 when jw >= 0.70 then 5 else -8 end)::double as peso from t) {_BAND}""")
def _(l):
    return _scored(l, True)


@query("supplier_score_ratio", f"""with {K}, {SUPPLIERS}, u as (select id_a * 1000000000 + id_b as id, id_a, id_b, a.nif as nif_a, b.nif as nif_b, a.nombre as x, b.nombre as y from p join s a on id_a = a.id join s b on id_b = b.id),
{blocks_sql('u')}, w as (select id_a, id_b, (-8.0 + case when nif_a is null or nif_b is null then 0 when nif_a = nif_b then 18 else -18 end
 + case when ratio >= 0.95 then 10 when ratio >= 0.85 then 8 when ratio >= 0.70 then 5 else -8 end)::double as peso from u join ratios using (id)) {_BAND}""")
def _(l):
    return _scored(l, True, matching.name_ratio_column)


@query("scan_applied", f"""with {K}, {PAIRS}, q as (select * from w where 1 / (1 + pow(2.0, -peso)) >= 0.9), s as (select id_a as id, id_b as o, peso from q union all select id_b, id_a, peso from q),
t as (select id, o, row_number() over (partition by id order by 1 / (1 + pow(2.0, -peso)) desc, o) as n from s) select t.id, o as apunta_a from t join asientos a on t.id = a.id where n = 1 and estado <> 'duplicado' and not validado""")
def _(l):
    a = l.asientos
    return matching.apply_scan(a, matching.invoice_pairs(a.withColumn("factura_id", F.col("id"))))


@query("canonical_names", f"""with {K}, d as (select distinct actividad_id, nif, emisor, {CLEAN} as limpio from k where nif is not null and emisor is not null),
g as (select actividad_id, nif, limpio, count(*) as n from d group by all), o as (select d.*, g.n, row_number() over (partition by d.actividad_id, d.nif order by g.n desc, d.limpio, length(regexp_replace(emisor, '[^\\p{{Ll}}]', '', 'g')) desc, length(emisor), emisor) as r,
count(*) over (partition by d.actividad_id, d.nif) as n_formas from d join g on d.actividad_id = g.actividad_id and d.nif = g.nif and d.limpio = g.limpio)
select actividad_id, nif, emisor as canonico, n_formas from o where r = 1 and n_formas > 1""")
def _(l):
    return matching.canonical_names(l.asientos)


@query("er_candidates", f"""with {K} select d.id as doc_id, f.id as factura_id from k d join k f on f.id < d.id and d.actividad_id = f.actividad_id and d.numero = f.numero
where case when d.nif is not null and f.nif is not null then d.nif = f.nif else d.emisor_norm = f.emisor_norm end""")
def _(l):
    return matching.er_candidates(l.asientos, l.asientos)


@query("er_compatible_clusters", f"""with {K}, c as (select id, case when numero is not null then concat_ws('|', actividad_id::varchar, numero, coalesce(nif, emisor_norm)) else '#' || id::varchar end as clave from k)
select id as doc_id, min(id) over (partition by clave) as factura_id, count(*) over (partition by clave) as n_documentos from c""")
def _(l):
    return matching.cluster_compatible(l.asientos)


@query("er_clusters", None)
def _(l):
    a = matching.keyed(l.asientos)
    return matching.cluster(a.select("id", "actividad_id", "numero", "nif", "emisor_norm", F.when(F.col("id") % 9 != 0, F.col("total_c")).alias("total_c"), (1 + F.col("id") % 2).cast("int").alias("pagina")))


@query("er_enrich", """with d as (select factura_id, arg_min(numero_factura, id) as n, arg_min(fecha, id) as f from asientos where id >= 10000000 group by 1)
select a.id, coalesce(a.numero_factura, d.n) as numero_factura, coalesce(a.fecha, d.f) as fecha from asientos a left join d on a.id = d.factura_id where a.id < 10000000""")
def _(l):
    a = l.asientos
    return matching.enrich(a.where("id < 10000000").select("id", "numero_factura", "fecha"), a.where("id >= 10000000").select("id", "factura_id", "numero_factura", "fecha"), ["numero_factura", "fecha"])


# Classification. Texts are made from part names, issuers and a few words by key, so every rule fires somewhere.
_WORDS = ["iberdrola factura", "canal de isabel", "movistar fibra", "comunidad de propietarios", "mapfre hogar", "recibo ibi anual", "indemnización", "renta de alquiler", "ventana climalit", "tarima flotante",
          "alicatado", "leroy merlin codo pvc", "leroy merlin ventana", "mano de obra tarima", "albañil", "averia caldera", "reforma averia", "cuota reta", "seguridad social", "otros"]
TEXTS = f"""x as (select a.id, actividad_id, coalesce(nif_emisor, '') as nif, lower(coalesce(emisor, '') || ' ' || coalesce(numero_factura, '') || ' ' || (case a.id % {len(_WORDS)} {' '.join(f"when {i} then '{w}'" for i, w in enumerate(_WORDS))} end)) as blob, actividad_id < 3 as propiedad from asientos a)"""


def _texts(l):
    pick = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("id") % len(_WORDS) + 1).cast("int"))
    z = lambda c: F.coalesce(F.col(c), F.lit(""))
    return l.asientos.select("id", "actividad_id", z("nif_emisor").alias("nif"), rules.blob(z("emisor"), z("numero_factura"), pick).alias("blob"), (F.col("actividad_id") < 3).alias("propiedad"))


def _any(words):
    return "(" + " or ".join(f"contains(blob, '{w}')" for w in words) + ")"


_KW = f"case when propiedad and {_any(schema.DIY)} and not {_any(schema.WORKS)} then 'CI.GAS.HOGAR|regla|720|gasto' " + " ".join(
    f"when propiedad and {_any(w)} then '{c}|regla|{round(x * 1000)}|{rules._kind(c)}'" for w, c, x in schema.KEYWORDS) + (
    f" when propiedad and {_any(schema.LABOUR)} and {_any(schema.LABOUR_WORKS)} then 'CI.MEJ.MO|regla|700|mejora' when propiedad and {_any(schema.LABOUR)} then '|pendiente|200|gasto'"
    f" when propiedad and {_any(schema.REPAIR)} and not {_any(schema.IMPROVEMENT)} then 'CI.GAS.REPARACION|regla|650|gasto' when not propiedad and {_any(schema.SOCIAL_SECURITY)} then 'AE.GAS.SS|regla|800|gasto' else '|pendiente|0|gasto' end")
_SPLIT = "nullif(split_part(c, '|', 1), '') as cuenta, split_part(c, '|', 2) as origen, split_part(c, '|', 3)::int as confianza_m, split_part(c, '|', 4) as tipo"


@query("classify_keywords", f"with {TEXTS}, y as (select id, {_KW} as c from x) select id, {_SPLIT} from y")
def _(l):
    none = l.spark.createDataFrame([], "regla_id long, actividad_id long, nif_emisor string, patron string, cuenta_codigo string")
    return rules.classify(_texts(l), none, l.cuentas)


LEARNED = """ru as (select id as regla_id, actividad_id, coalesce(nif_emisor, '') as nif_emisor, case when nif_emisor is null then lower(coalesce(numero_factura, '')) else '' end as patron, cuenta_codigo
from asientos where validado and cuenta_codigo is not null)"""


def _learned(l):
    """Rules learned from every validated entry: by its id, or by its number where it has none."""
    no_id = F.col("nif_emisor").isNull()
    return l.asientos.where("validado and cuenta_codigo is not null").select(
        F.col("id").alias("regla_id"), "actividad_id", F.coalesce("nif_emisor", F.lit("")).alias("nif_emisor"),
        F.when(no_id, F.lower(F.coalesce("numero_factura", F.lit("")))).otherwise("").alias("patron"), "cuenta_codigo")


@query("classify_learned", f"""with {TEXTS}, {LEARNED}, rc as (select ru.*, c.tipo as tc from ru join cuentas c on cuenta_codigo = codigo),
n as (select x.id, arg_min(cuenta_codigo || '|aprendida|950|' || tc, regla_id) as c from x join rc on x.actividad_id = rc.actividad_id and x.nif = rc.nif_emisor and rc.nif_emisor <> '' group by x.id),
p as (select x.id, arg_min(cuenta_codigo || '|aprendida|850|' || tc, regla_id) as c from x join rc on x.actividad_id = rc.actividad_id and rc.patron <> '' and contains(blob, rc.patron) group by x.id),
y as (select x.id, coalesce(n.c, p.c, {_KW}) as c from x left join n on x.id = n.id left join p on x.id = p.id) select id, {_SPLIT} from y""", "asientos cuentas")
def _(l):
    return rules.classify(_texts(l), _learned(l), l.cuentas)


@query("state_transition", """with a as (select *, case id % 4 when 0 then 'validar' when 1 then 'reabrir' when 2 then 'rechazar' else 'nada' end as accion from asientos)
select id, case when accion = 'validar' then case when estado = 'duplicado' then estado else 'confirmado' end when accion = 'reabrir' then 'pendiente' when accion = 'rechazar' then 'rechazado' else estado end as estado_nuevo,
case when estado = 'duplicado' then estado when conf_clase_m >= 800 then 'confirmado' else 'pendiente' end as por_cuenta from a""")
def _(l):
    action = F.element_at(F.array(*map(F.lit, ("validar", "reabrir", "rechazar", "nada"))), (F.col("id") % 4 + 1).cast("int"))
    return l.asientos.select("id", rules.transition(F.col("estado"), action).alias("estado_nuevo"), rules.state_after_account(F.col("estado"), F.col("conf_clase_m")).alias("por_cuenta"))


@query("propagate_rule", f"""with {K}, r as (select actividad_id, nif, min(cuenta_codigo) as cuenta_nueva from k where validado and nif is not null and cuenta_codigo is not null group by all)
select id, cuenta_codigo as antes, cuenta_nueva as despues, 900 as confianza_m, 'aprendida' as origen from k join r on k.actividad_id = r.actividad_id and k.nif = r.nif where estado = 'pendiente' and not validado""")
def _(l):
    rows = l.asientos.withColumn("nif", F.nullif(nif.normalize(F.col("nif_emisor")), F.lit("")))
    learned = rows.where("validado and nif is not null and cuenta_codigo is not null").groupBy("actividad_id", "nif").agg(F.min("cuenta_codigo").alias("cuenta_nueva"))
    return rules.propagate(l.asientos, learned)


LT = """lt as (select asiento_id, count(*) filter (where not eliminada) as n_lineas, (sum(case when not eliminada then base_c end))::bigint as base_l, (sum(case when not eliminada then iva_c end))::bigint as iva_l,
(sum(case when not eliminada then base_c + iva_c end))::bigint as importe_l, sum(base_c + iva_c)::bigint as importe_todas, coalesce(sum(case when not eliminada and descripcion <> '' then case when cantidad is null or cantidad < 0 then 1 else cantidad end end), 0)::bigint as unidades,
count(*) filter (where not eliminada and coalesce(codigo, '') = '') as sin_codigo, count(*) filter (where not eliminada and coalesce(descripcion, '') = '') as sin_concepto from lineas group by 1)"""


@query("line_totals", f"with {LT} select * from lt", "lineas")
def _(l):
    return rules.line_totals(l.lineas)


@query("header_from_lines", f"""with {LT}, j as (select id, coalesce(base_l, base_c) as base_c, coalesce(iva_l, iva_c) as iva_c, coalesce(importe_l, total_c) as total_c from asientos left join lt on id = asiento_id)
select *, case when base_c <> 0 then round(10000.0::double * iva_c / base_c)::bigint end as tipo_cent from j""", "asientos lineas")
def _(l):
    return rules.header_from_lines(l.asientos, l.lineas)


@query("doctor_arithmetic", f"""with d as (select id, coalesce(abs(base_c + iva_c - total_c) > 2, false) as descuadre, not coalesce(iva_tipo in (21, 10, 4, 0), true) as tipo_raro from asientos where {LIVE}) select * from d where descuadre or tipo_raro""")
def _(l):
    return rules.doctor_header(l.asientos)


@query("doctor_lines", f"with {LT} select id, importe_l, total_c from asientos join lt on id = asiento_id where {LIVE} and importe_l is not null and abs(importe_l - total_c) > 5 and abs(importe_l - base_c) > 5", "asientos lineas")
def _(l):
    return rules.doctor_lines(l.asientos, l.lineas)


@query("lines_match_api", f"with {LT} select id, coalesce(abs(importe_todas - total_c) <= 2 or abs(importe_todas - base_c) <= 2, false) as coincide from asientos left join lt on id = asiento_id", "asientos lineas")
def _(l):
    return rules.lines_match_api(l.asientos, l.lineas)


_D = [f"substr(nif_emisor, {i + 1}, 1)::int" for i in range(1, 8)]
CIF_OK = ("coalesce(substr(nif_emisor, 9, 1) = ((10 - (" + " + ".join([f"2 * {d} - case when {d} > 4 then 9 else 0 end" for d in _D[::2]] + _D[1::2]) + ") % 10) % 10)::varchar, false)")
CHECKS = f"""c as (select id, [numero_factura is not null, fecha is not null, coalesce(trim(emisor) <> '', false), {CIF_OK}, base_c is not null, iva_c is not null, total_c is not null, cuenta_codigo is not null, abs(base_c + iva_c - total_c) <= 2]
 || case when coalesce(n_lineas, 0) > 0 then [sin_codigo = 0, sin_concepto = 0, importe_l is not null, coalesce(abs(importe_l - total_c) <= 2, false)] else [false] end as v,
 ['numero', 'fecha', 'emisor', 'nif', 'base', 'iva', 'total', 'rubro', 'desglose'] || case when coalesce(n_lineas, 0) > 0 then ['ids', 'conceptos', 'importes', 'suma'] else ['lineas'] end as k from asientos left join lt on id = asiento_id),
u as (select id, unnest(v) as ok, unnest(k) as k, generate_subscripts(k, 1) as i from c)"""


@query("quality_checks", f"""with {LT}, {CHECKS}, g as (select id, count(*)::int as n_controles, (count(*) filter (where ok))::int as n_ok, coalesce(string_agg(k, ',' order by i) filter (where not ok), '') as fallos from u group by id)
select id, n_controles, n_ok, round_even(100.0 * n_ok / n_controles, 0)::int as pct, case when n_ok = n_controles then 'lista' when round_even(100.0 * n_ok / n_controles, 0) >= 80 then 'aviso' else 'mal' end as tono, fallos from g""", "asientos lineas")
def _(l):
    return rules.quality(l.asientos, l.lineas)


@query("snapshot_diff_audit", """with b as (select id, coalesce(emisor, '') as emisor, coalesce(total_c::varchar, '') as total_c from asientos), a as (select id, case when id % 5 = 0 then trim(upper(coalesce(emisor, ''))) else coalesce(emisor, '') end as emisor,
coalesce((case when id % 7 = 0 then total_c + 1 else total_c end)::varchar, '') as total_c from asientos), u as (select b.id as asiento_id, 'emisor' as campo, b.emisor as antes, a.emisor as despues from b join a on a.id = b.id union all select b.id, 'total_c', b.total_c, a.total_c from b join a on a.id = b.id)
select *, 'prueba' as fuente from u where antes <> despues""")
def _(l):
    a = l.asientos
    after = a.withColumn("emisor", F.when(F.col("id") % 5 == 0, F.trim(F.upper("emisor"))).otherwise(F.col("emisor"))).withColumn("total_c", F.when(F.col("id") % 7 == 0, F.col("total_c") + 1).otherwise(F.col("total_c")))
    return rules.snapshot_diff(a, after, ["emisor", "total_c"], "prueba")


@query("apply_changes", """with ch as (select id as i, case when id % 6 = 0 then base_c + 100 end as b, case when id % 4 = 0 then 'Corregido' end as e from asientos where id % 2 = 0)
select id, coalesce(b, base_c) as base_c, coalesce(e, emisor) as emisor, case when i is not null and coalesce(b, base_c) <> 0 then round(100.0::double * iva_c / coalesce(b, base_c))::bigint else iva_tipo end as iva_tipo, i is not null or validado as validado from asientos left join ch on id = i""")
def _(l):
    a = l.asientos
    ch = a.where("id % 2 = 0").select("id", F.when(F.col("id") % 6 == 0, F.col("base_c") + 100).alias("base_c"), F.when(F.col("id") % 4 == 0, F.lit("Corregido")).alias("emisor"))
    return rules.apply_changes(a, ch)[0].select("id", "base_c", "emisor", "iva_tipo", "validado")


@query("merge_duplicates", """with m as (select id as i, id - id % 10 as o from asientos where id % 3 = 0), v as (select i, min(o) as o from m join asientos a on a.id = m.o and a.estado <> 'duplicado' where i <> m.o group by i)
select id, case when i is not null then 'duplicado' else estado end as estado, coalesce(o, duplicado_de_id) as duplicado_de_id, case when i is not null then 2 else duplicado_nivel end as duplicado_nivel from asientos left join v on id = i""")
def _(l):
    a = l.asientos
    return rules.mark_duplicates(a, a.where("id % 3 = 0").select("id", (F.col("id") - F.col("id") % 10).alias("original_id"))).select("id", "estado", "duplicado_de_id", "duplicado_nivel")


@query("account_upsert", """with us as (select codigo, 'Mi ' || nombre as nombre, tipo, regimen, casilla from cuentas where codigo like 'CI.GAS.%') select * from us union all select * from cuentas where codigo not in (select codigo from us)""", "cuentas")
def _(l):
    mine = l.cuentas.where("codigo like 'CI.GAS.%'").withColumn("nombre", F.concat(F.lit("Mi "), F.col("nombre")))
    return rules.upsert_accounts(l.cuentas, mine)


@query("slug_codes", """with recursive n as (select distinct p_name as nombre from part), b as (select nombre, 'CI.GAS.' || substr(regexp_replace(upper(nombre), '[^A-Z0-9]+', '', 'g'), 1, 4) as b from n),
e as (select distinct b as codigo from b where ascii(substr(b, 9, 1)) % 3 = 0 union select distinct b || '3' from b where ascii(substr(b, 9, 1)) % 3 <> 2),
w as (select *, row_number() over (partition by b order by nombre) as r from b), m as (select b, max(r) + 2 as k from w group by b),
f as (select b, n, case when n = 1 then b else b || n end as codigo from m, unnest(range(1, k + 1)) t(n)), g as (select *, row_number() over (partition by b order by n) as r from f where codigo not in (select codigo from e))
select w.nombre, g.codigo from w join g on w.b = g.b and w.r = g.r""", "")
def _(l):
    names = l.table("part").select(F.col("p_name").alias("nombre")).distinct().withColumn("prefijo", F.lit("CI.GAS"))
    base = names.select(F.concat(F.lit("CI.GAS."), F.substring(rules.slug(F.col("nombre")), 1, 4)).alias("b")).distinct()
    c = F.ascii(F.substring("b", 9, 1)) % 3
    existing = base.where(c == 0).select(F.col("b").alias("codigo")).union(base.where(c != 2).select(F.concat("b", F.lit("3"))))
    return rules.new_codes(names, existing, size=4)
