"""Classification, state changes, quality checks and audits of entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..session import checkpoint
from ..functions import money, nif
from ..functions.text import slug


def any_of(blob: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(blob, F.lit(w)) for w in words])


def blob(*parts: Column) -> Column:
    """Lower-cased text that rules look at."""
    return F.lower(F.concat_ws(" ", *parts))


def _result(code: str | None, origin: str, m: int, kind: str) -> Column:
    return F.struct(F.lit(code).cast("string").alias("cuenta"), F.lit(origin).alias("origen"), F.lit(m).alias("confianza_m"), F.lit(kind).alias("tipo"))


def _kind(code: str) -> str:
    return "mejora" if code.startswith("CI.MEJ") else "ingreso" if code.startswith("CI.ING") else "gasto"


def by_keywords(b: Column) -> Column:
    """Account by the first rule whose words occur; a do-it-yourself shop without clear works is household."""
    out = F.when(any_of(b, schema.DIY) & ~any_of(b, schema.WORKS), _result("CI.GAS.HOGAR", "regla", 720, "gasto"))
    for words, code, conf in schema.KEYWORDS:
        out = out.when(any_of(b, words), _result(code, "regla", round(conf * 1000), _kind(code)))
    return out


def by_works(b: Column) -> Column:
    """Labour with works improves; labour alone stays pending (and ends the search); repair hints without improvement ones repair."""
    return (F.when(any_of(b, schema.LABOUR) & any_of(b, schema.LABOUR_WORKS), _result("CI.MEJ.MO", "regla", 700, "mejora"))
            .when(any_of(b, schema.LABOUR), _result(None, "pendiente", 200, "gasto"))
            .when(any_of(b, schema.REPAIR) & ~any_of(b, schema.IMPROVEMENT), _result("CI.GAS.REPARACION", "regla", 650, "gasto")))


def by_default(b: Column) -> Column:
    return F.when(any_of(b, schema.SOCIAL_SECURITY), _result("AE.GAS.SS", "regla", 800, "gasto"))


#: Characters at the end of a pattern by which texts find it.
TAIL = 6


def pattern_hits(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, por_patron) of rows (id, actividad_id, blob): their case file's first pattern (smallest rule id) that occurs in the text.

    patterns has (regla_id, actividad_id, patron, cuenta_codigo, tipo_cuenta). Texts and patterns meet in an equi-join by the
    pattern's last TAIL characters, or the whole of a shorter one; so the list of patterns may be of any size. Parts of texts
    go without their text; it comes back by id for those that meet a pattern.
    """
    known = patterns.select(F.col("actividad_id").alias("pa"), "patron", F.least(F.length("patron"), F.lit(TAIL)).alias("n"), F.struct("regla_id", "cuenta_codigo", "tipo_cuenta").alias("s"))
    known = known.groupBy("pa", "patron", "n").agg(F.min("s").alias("s")).withColumn("cola", F.expr("right(patron, n)"))
    sizes = sorted(r.n for r in known.select("n").distinct().collect())  # TAIL numbers at most

    def parts(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("blob") - (n - 1))), lambda i: F.substring(F.col("blob"), i, F.lit(n)))

    grams = F.flatten(F.array(*map(parts, sizes))) if sizes else F.array(F.lit(""))
    spread = rows.select("id", "actividad_id", F.explode(F.array_distinct(grams)).alias("cola"))
    met = spread.join(known.drop("n"), (F.col("actividad_id") == F.col("pa")) & (spread["cola"] == known["cola"])).select("id", "patron", "s")
    hits = met.join(rows.select("id", "blob"), "id").where(F.contains("blob", "patron"))
    return hits.groupBy("id").agg(F.min("s").alias("por_patron"))


def classify(rows: DataFrame, rules: DataFrame, accounts: DataFrame) -> DataFrame:
    """(id, cuenta, origen, confianza_m, tipo) of rows (id, actividad_id, nif, blob, propiedad boolean).

    A learned rule for the id wins, then the first learned pattern (smallest rule id) that occurs, then the fixed rules of
    the regime. rules has (regla_id, actividad_id, nif_emisor, patron, cuenta_codigo) with empty text for unused parts; both kinds
    are equi-joins. Patterns are looked for only where no id decides.
    """
    known = rules.join(F.broadcast(accounts.select("codigo", F.col("tipo").alias("tipo_cuenta"))), F.col("cuenta_codigo") == F.col("codigo"))
    ids = known.where("nif_emisor != ''").groupBy(F.col("actividad_id").alias("ia"), F.col("nif_emisor").alias("in")).agg(
        F.min(F.struct("regla_id", "cuenta_codigo", "tipo_cuenta")).alias("por_nif"))
    by_id = rows.join(ids, (F.col("actividad_id") == F.col("ia")) & (F.col("nif") == F.col("in")), "left")
    hits = pattern_hits(by_id.where("por_nif is null").select("id", "actividad_id", "blob"), known.where("patron != ''"))
    j = by_id.join(hits.withColumnRenamed("id", "hid"), F.col("id") == F.col("hid"), "left")

    def learned(c: str, m: int) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.cuenta_codigo").alias("cuenta"), F.lit("aprendida").alias("origen"), F.lit(m).alias("confianza_m"), F.col(f"{c}.tipo_cuenta").alias("tipo")))

    b = F.col("blob")
    fixed = F.when(F.col("propiedad"), F.coalesce(by_keywords(b), by_works(b))).otherwise(by_default(b))
    found = F.coalesce(learned("por_nif", 950), learned("por_patron", 850), fixed, _result(None, "pendiente", 0, "gasto"))
    return j.select("id", found.alias("c")).select("id", "c.*")


def state_after_account(state: Column, confidence_m: Column) -> Column:
    """A merged entry stays; others are confirmed from 0.800 on."""
    return F.when(state == "duplicado", state).when(confidence_m >= 800, "confirmado").otherwise("pendiente")


def transition(state: Column, action: Column) -> Column:
    """State after validating, reopening or rejecting."""
    return F.when(action == "validar", F.when(state == "duplicado", state).otherwise("confirmado")).when(action == "reabrir", "pendiente").when(action == "rechazar", "rechazado").otherwise(state)


def propagate(entries: DataFrame, learned: DataFrame) -> DataFrame:
    """Pending entries of a learned id get its account with confidence 0.900; learned has (actividad_id, nif, cuenta_nueva), one row an id."""
    rows = entries.where("estado = 'pendiente' and not validado").withColumn("nif", nif.normalize(F.col("nif_emisor")))
    return rows.join(learned, ["actividad_id", "nif"]).select("id", F.col("cuenta_codigo").alias("antes"), F.col("cuenta_nueva").alias("despues"), F.lit(900).alias("confianza_m"), F.lit("aprendida").alias("origen"))


def line_totals(lines: DataFrame) -> DataFrame:
    """Per entry: active lines, their base, VAT and amount, the amount of all lines, and units (no or negative quantity: one)."""
    on = ~F.col("eliminada")
    s = lambda c: F.sum(F.when(on, c))
    qty = F.when(F.col("cantidad").isNull() | (F.col("cantidad") < 0), F.lit(1)).otherwise(F.col("cantidad"))
    return lines.groupBy("asiento_id").agg(F.count_if(on).alias("n_lineas"), s(F.col("base_c")).alias("base_l"), s(F.col("iva_c")).alias("iva_l"), s(F.col("base_c") + F.col("iva_c")).alias("importe_l"),
                                           F.sum(F.col("base_c") + F.col("iva_c")).alias("importe_todas"), F.coalesce(s(F.when(F.col("descripcion") != "", qty)), F.lit(0)).alias("unidades"),
                                           F.count_if(on & (F.coalesce("codigo", F.lit("")) == "")).alias("sin_codigo"), F.count_if(on & (F.coalesce("descripcion", F.lit("")) == "")).alias("sin_concepto"))


def header_from_lines(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Header amounts taken from active lines where there are some, and the rate they imply in hundredths."""
    t = line_totals(lines)
    j = entries.join(t, F.col("id") == F.col("asiento_id"), "left")
    base, vat_c, total = F.coalesce("base_l", "base_c"), F.coalesce("iva_l", "iva_c"), F.coalesce("importe_l", "total_c")
    return j.select("id", base.alias("base_c"), vat_c.alias("iva_c"), total.alias("total_c"), F.when(base != 0, F.round(F.lit(10000.0) * vat_c / base, 0)).cast("bigint").alias("tipo_cent"))


def checks(entries: DataFrame, lines: DataFrame, owner_nif: str = "") -> DataFrame:
    """(id, controles): an array of (id, ok) of an entry's checks.

    Always eight; the header's sum only if all its amounts are there; then one that lines are missing, or four on its lines."""
    j = entries.join(line_totals(lines), F.col("id") == F.col("asiento_id"), "left")
    n = nif.normalize(F.col("nif_emisor"))
    owner_ok = F.lit(True) if not owner_nif else (n != owner_nif) | nif.is_placeholder(n)
    c = lambda name, ok: F.struct(F.lit(name).alias("control"), F.coalesce(ok, F.lit(False)).alias("ok"))
    sums = F.col("base_c").isNotNull() & F.col("iva_c").isNotNull() & F.col("total_c").isNotNull()
    some = F.coalesce(F.col("n_lineas") > 0, F.lit(False))
    all_checks = F.array(
        c("numero", F.col("numero_factura").isNotNull()), c("fecha", F.col("fecha").isNotNull()), c("emisor", F.trim("emisor") != ""), c("nif", nif.is_valid(F.col("nif_emisor")) & owner_ok),
        c("base", F.col("base_c").isNotNull()), c("iva", F.col("iva_c").isNotNull()), c("total", F.col("total_c").isNotNull()), c("rubro", F.col("cuenta_codigo").isNotNull()),
        F.when(sums, c("desglose", money.header_adds_up(F.col("base_c"), F.col("iva_c"), F.col("total_c")))), F.when(~some, c("lineas", F.lit(False))),
        F.when(some, c("ids", F.col("sin_codigo") == 0)), F.when(some, c("conceptos", F.col("sin_concepto") == 0)), F.when(some, c("importes", F.col("importe_l").isNotNull())),
        F.when(some, c("suma", F.abs(F.col("importe_l") - F.col("total_c")) <= schema.HEADER_TOLERANCE)))
    return j.select("id", F.filter(all_checks, lambda x: x.isNotNull()).alias("controles"))


def quality(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, n_controles, n_ok, pct, tono, fallos): the share of passed checks, its tone and the names of those that fail."""
    rows = checks(entries, lines)
    ok, n = F.size(F.filter("controles", lambda x: x["ok"])), F.size("controles")
    pct = F.bround(100.0 * ok / n).cast("int")
    return rows.select("id", n.alias("n_controles"), ok.alias("n_ok"), pct.alias("pct"), F.when(ok == n, "lista").when(pct >= 80, "aviso").otherwise("mal").alias("tono"),
                       F.array_join(F.transform(F.filter("controles", lambda x: ~x["ok"]), lambda x: x["control"]), ",").alias("fallos"))


def doctor_header(entries: DataFrame) -> DataFrame:
    """Live entries whose header doesn't add up or whose rate isn't a legal one."""
    rows = entries.where(~F.col("estado").isin(*schema.LIVE_EXCLUDES))
    sums = ~F.coalesce(money.header_adds_up(F.col("base_c"), F.col("iva_c"), F.col("total_c")), F.lit(True))
    return rows.select("id", sums.alias("descuadre"), (~money.known_rate(F.col("iva_tipo"))).alias("tipo_raro")).where("descuadre or tipo_raro")


def doctor_lines(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Live entries whose active lines sum to neither total nor base (5 cents); without a total there is no finding."""
    rows = entries.where(~F.col("estado").isin(*schema.LIVE_EXCLUDES)).join(line_totals(lines), F.col("id") == F.col("asiento_id"))
    miss = lambda c: ~F.coalesce(money.lines_add_up(F.col("importe_l"), F.col(c)), F.lit(False))
    return rows.where(F.col("total_c").isNotNull() & F.col("importe_l").isNotNull() & miss("total_c") & miss("base_c")).select("id", "importe_l", "total_c")


def lines_match_api(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, coincide): whether all lines, deleted ones too, sum to base or total within 2 cents."""
    j = entries.join(line_totals(lines).select("asiento_id", "importe_todas"), F.col("id") == F.col("asiento_id"), "left")
    close = lambda c: F.abs(F.col("importe_todas") - F.col(c)) <= schema.HEADER_TOLERANCE
    return j.select("id", F.coalesce(close("total_c") | close("base_c"), F.lit(False)).alias("coincide"))


# Changes: never in place. A set of changes makes a new snapshot and its audit rows.

def snapshot_diff(before: DataFrame, after: DataFrame, columns: list[str], source: str) -> DataFrame:
    """(asiento_id, campo, antes, despues, fuente) of fields whose texts differ; null is empty text."""
    def canonical(df: DataFrame, side: str) -> DataFrame:
        fields = F.array(*[F.struct(F.lit(c).alias("campo"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")) for c in columns])
        return df.select("id", F.explode(fields).alias("f")).select("id", "f.campo", F.col("f.v").alias(side))

    j = canonical(before, "antes").join(canonical(after, "despues"), ["id", "campo"]).where("antes != despues")
    return j.select(F.col("id").alias("asiento_id"), "campo", "antes", "despues", F.lit(source).alias("fuente"))


def apply_changes(entries: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, audit). changes has id and any of the entries' columns; a null changes nothing. One row an id.

    The rate follows base and VAT, and a changed entry counts as validated."""
    fields = [c for c in changes.columns if c != "id" and c in entries.columns]
    ch = changes.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in fields])
    j = entries.join(ch, F.col("id") == F.col("_id"), "left")
    values = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}
    touched = F.col("_id").isNotNull()
    base, vat_c = values.get("base_c", F.col("base_c")), values.get("iva_c", F.col("iva_c"))
    if {"base_c", "iva_c"} & set(fields):
        values["iva_tipo"] = F.when(touched & (base != 0), F.round(100.0 * vat_c / base).cast("bigint")).otherwise(F.col("iva_tipo"))
    values["validado"] = touched | F.col("validado")
    after = j.select(*[values[c].alias(c) if c in values else F.col(c) for c in entries.columns])
    return after, snapshot_diff(entries, after, [c for c in values], "panel")


def mark_duplicates(entries: DataFrame, merges: DataFrame) -> DataFrame:
    """Snapshot after merges (id, original_id): merged entries are level 2 duplicates. A merge into itself, into a duplicate or
    into an unknown entry is not done."""
    valid = (merges.where("id != original_id").join(entries.where("estado != 'duplicado'").select(F.col("id").alias("original_id")), "original_id")
             .groupBy(F.col("id").alias("_id")).agg(F.min("original_id").alias("_o")))
    j = entries.join(valid, F.col("id") == F.col("_id"), "left")
    new = {"estado": F.when(F.col("_id").isNotNull(), "duplicado").otherwise(F.col("estado")), "duplicado_de_id": F.coalesce("_o", "duplicado_de_id"),
           "duplicado_nivel": F.when(F.col("_id").isNotNull(), 2).otherwise(F.col("duplicado_nivel"))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in entries.columns])


def upsert_accounts(system: DataFrame, user: DataFrame) -> DataFrame:
    """Accounts after seeding: a user's rows stay as they are, missing system rows are added."""
    return user.unionByName(system.join(user, "codigo", "left_anti").select(*user.columns))


def new_codes(names: DataFrame, existing: DataFrame, size: int = 24) -> DataFrame:
    """(nombre, codigo) of internal account codes, all different and none in `existing` (codigo).

    A code is the name's base; where that is taken, by an existing code or an earlier name, the base and the smallest free number from 2 on.
    Each round gives the names of a base its free numbers in order of names, and of names that met at one code (of bases that are each other's
    numbered form) the first keeps it; the others go on to the next round.
    """
    base = F.concat(F.col("prefijo"), F.lit("."), F.substring(slug(F.col("nombre")), 1, size))
    left = checkpoint(names.select("nombre", base.alias("b")).distinct())
    taken, done = checkpoint(existing.select("codigo").distinct()), None
    while left.limit(1).count():
        want = left.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("nombre")))
        stem = lambda c: F.regexp_replace(c, "[0-9]+$", "")
        used = taken.groupBy(stem("codigo").alias("s")).agg(F.count("*").alias("t"))
        many = left.groupBy("b").agg(F.count("*").alias("k")).join(used, stem("b") == F.col("s"), "left")
        free = many.select("b", F.explode(F.sequence(F.lit(1), (F.col("k") + F.coalesce("t", F.lit(0))).cast("int"))).alias("n"))
        free = free.select("b", "n", F.when(F.col("n") == 1, F.col("b")).otherwise(F.concat("b", F.col("n").cast("string"))).alias("codigo")).join(taken, "codigo", "left_anti")
        free = free.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("n")))
        got = want.join(free, ["b", "r"]).groupBy("codigo").agg(F.min(F.struct("n", "nombre")).alias("x")).select(F.col("x.nombre").alias("nombre"), "codigo")
        got = checkpoint(got)
        done = got if done is None else done.union(got)
        taken = checkpoint(taken.union(got.select("codigo")))
        left = checkpoint(left.join(got.select("nombre"), "nombre", "left_anti"))
    return names.select("nombre", F.lit("").alias("codigo")).limit(0) if done is None else done


def without_lines(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Entries that have no line yet, whose lines a backfill has to make."""
    return entries.join(lines, F.col("id") == F.col("asiento_id"), "left_anti").select("id")


def diverged(entries: DataFrame, invoices: DataFrame, columns: list[str]) -> DataFrame:
    """(id, campos): names of the fields in which an entry differs from its invoice (null differs from a value)."""
    f = invoices.select(F.col("id").alias("_f"), *[F.col(c).alias(f"_{c}") for c in columns])
    names = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return entries.join(f, F.col("factura_id") == F.col("_f")).select("id", F.array_join(names, ",").alias("campos")).where("campos != ''")


def vat_label(lines: DataFrame) -> DataFrame:
    """(asiento_id, etiqueta) of the VAT column's head: with the rate if all active lines have one."""
    rates = lines.where("not eliminada").groupBy("asiento_id").agg(F.min("iva_tipo").alias("a"), F.max("iva_tipo").alias("b"))
    return rates.select("asiento_id", F.when(F.col("a") == F.col("b"), F.concat(F.lit("IVA ("), F.col("a").cast("string"), F.lit(" %)"))).otherwise("IVA").alias("etiqueta"))


def box_kind(boxes: DataFrame) -> DataFrame:
    """Kind of entry that a tax box holds, and the code prefix of its accounts."""
    kind = F.when(F.col("casilla") == "ingresos", "ingreso").when(F.col("casilla") == "mejoras", "mejora").when(F.col("casilla") == "amortizacion", "amortizacion").otherwise("gasto")
    prefix = F.when(kind == "ingreso", "CI.ING").when(kind == "mejora", "CI.MEJ").when(kind == "amortizacion", "CI.AMO").otherwise("CI.GAS")
    return boxes.select("casilla", kind.alias("tipo"), prefix.alias("prefijo"))
