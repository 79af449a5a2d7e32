"""Ledger reports. Each takes entries (and dimensions) and returns a DataFrame for all case files and years at once.

Grouping keys come first, so every report is a partial aggregation and one shuffle of its groups. Dimensions
have at most a few hundred rows. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import money, text

SLICE = ["actividad_id", "ejercicio"]


def live() -> Column:
    """Entries that count in totals."""
    return ~F.col("estado").isin(*schema.LIVE_EXCLUDES)


def low_confidence() -> Column:
    """Not validated, and pending or with a confidence under 0.80 (rounded to cents first) or none."""
    q = lambda c: F.round(F.col(c) / 1000.0, 2)
    return ~F.col("validado") & ((q("conf_ocr_m") < 0.80) | F.coalesce(q("conf_clase_m") < 0.80, F.lit(True)) | (F.col("estado") == "pendiente"))


def _sum(cond: Column, of: str = "total_c") -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(of))), F.lit(0))


def _kind(k: str) -> Column:
    return F.col("tipo") == k


def kpis(entries: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """Totals and counts of a year; improvements do not lower the result, and rejected entries count as not validated.

    With conflicts (factura_id), n_conflictos counts the different invoices in conflict among all rows of the year."""
    out = entries.where("ejercicio is not null").groupBy(*SLICE).agg(
        _sum(live() & _kind("gasto")).alias("gastos_c"), _sum(live() & _kind("ingreso")).alias("ingresos_c"), _sum(live() & _kind("mejora")).alias("mejoras_c"),
        F.count_if(live()).alias("n_asientos"), F.count_if(F.col("estado") == "duplicado").alias("n_duplicados"),
        F.count_if(live() & (F.col("estado") == "pendiente")).alias("n_pendientes"), F.count_if(live() & low_confidence()).alias("n_baja"),
        F.count_if("validado").alias("n_validados"), F.count_if((F.col("estado") != "duplicado") & ~F.col("validado")).alias("n_sin_validar"))
    out = out.withColumn("resultado_c", F.col("ingresos_c") - F.col("gastos_c"))
    if conflicts is None:
        return out
    hit = entries.where("ejercicio is not null").join(conflicts.select("factura_id").distinct(), "factura_id", "left_semi").groupBy(*SLICE).agg(F.countDistinct("factura_id").alias("n_conflictos"))
    return out.join(hit, SLICE, "left").na.fill(0, ["n_conflictos"])


def by_month(entries: DataFrame) -> DataFrame:
    """Expense and income of all twelve months of each year; undated entries don't count."""
    rows = entries.where(live() & F.col("fecha").isNotNull())
    got = rows.groupBy(*SLICE, F.month("fecha").alias("mes")).agg(_sum(_kind("gasto")).alias("gasto_c"), _sum(_kind("ingreso")).alias("ingreso_c"))
    dense = got.select(*SLICE).distinct().select(*SLICE, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("mes"))
    return dense.join(got, [*SLICE, "mes"], "left").na.fill(0, ["gasto_c", "ingreso_c"])


def by_quarter(entries: DataFrame) -> DataFrame:
    """T1 to T4 and the year: expense, income, improvement, net, and VAT of expense and improvement; duplicates and rejected entries don't count."""
    rows = entries.where(live() & F.col("fecha").isNotNull()).withColumn("periodo", F.concat(F.lit("T"), F.quarter("fecha")))
    sets = rows.groupingSets([[*map(F.col, SLICE), F.col("periodo")], [*map(F.col, SLICE)]], *SLICE, "periodo")
    got = sets.agg(
        _sum(_kind("gasto")).alias("gasto_c"), _sum(_kind("ingreso")).alias("ingreso_c"), _sum(_kind("mejora")).alias("mejora_c"),
        _sum(F.col("tipo").isin("gasto", "mejora"), "iva_c").alias("iva_c")).na.fill("Año", ["periodo"])
    dense = got.select(*SLICE).distinct().select(*SLICE, F.explode(F.array(*map(F.lit, ("T1", "T2", "T3", "T4", "Año")))).alias("periodo"))
    out = dense.join(got, [*SLICE, "periodo"], "left").na.fill(0)
    return out.withColumn("neto_c", F.col("ingreso_c") - F.col("gasto_c"))


def by_account(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Count, base, VAT and total by account name and kind."""
    return (entries.where(live() & F.col("ejercicio").isNotNull()).join(F.broadcast(accounts.select("codigo", "nombre")), F.col("cuenta_codigo") == F.col("codigo"), "left")
            .groupBy(*SLICE, F.coalesce("nombre", F.lit("(sin rubro)")).alias("rubro"), "tipo")
            .agg(F.count("*").alias("n"), F.sum("base_c").alias("base_c"), F.sum("iva_c").alias("iva_c"), F.sum("total_c").alias("total_c")))


def by_property(entries: DataFrame) -> DataFrame:
    alias = F.coalesce(F.concat(F.lit("Inmueble "), F.col("inmueble_id").cast("string")), F.lit("(sin inmueble)"))
    return entries.where(live() & F.col("ejercicio").isNotNull()).groupBy(*SLICE, alias.alias("inmueble"), "tipo").agg(F.sum("total_c").alias("total_c"))


def box_of(accounts: DataFrame) -> Column:
    """Box of a joined account; none or an empty one is unclassified."""
    return F.coalesce(F.nullif(F.col("casilla"), F.lit("")), F.lit("sin_clasificar"))


def tax_boxes(entries: DataFrame, accounts: DataFrame, boxes: DataFrame, hide_empty: bool = False) -> DataFrame:
    """Count and total of all twelve boxes in report order. hide_empty leaves out boxes without entries but for income and improvements."""
    rows = entries.where(live() & F.col("ejercicio").isNotNull()).join(F.broadcast(accounts.select("codigo", "casilla")), F.col("cuenta_codigo") == F.col("codigo"), "left")
    got = rows.groupBy(*SLICE, box_of(accounts).alias("casilla")).agg(F.count("*").alias("n"), F.sum("total_c").alias("total_c"))
    dense = got.select(*SLICE).distinct().crossJoin(F.broadcast(boxes))
    out = dense.join(got, [*SLICE, "casilla"], "left").na.fill(0, ["n", "total_c"])
    return out.where((F.col("n") > 0) | F.col("casilla").isin("ingresos", "mejoras")) if hide_empty else out


def tax_yield(entries: DataFrame, accounts: DataFrame, boxes: DataFrame) -> DataFrame:
    """Income, deductible expense (every lowering box that isn't income, unclassified ones of any kind too) and their difference."""
    cut = F.col("resta") & (F.col("grupo") != "ingreso")
    out = tax_boxes(entries, accounts, boxes).groupBy(*SLICE).agg(_sum(F.col("casilla") == "ingresos").alias("ingresos_c"), _sum(cut).alias("deducibles_c"), _sum(F.col("casilla") == "mejoras").alias("mejoras_c"))
    return out.withColumn("rendimiento_c", F.col("ingresos_c") - F.col("deducibles_c"))


def vat(entries: DataFrame, rounded: bool = False, rate: Column | None = None) -> DataFrame:
    """Supported VAT by rate bucket: base, VAT and total of expense and improvement."""
    r = F.col("iva_tipo") if rate is None else rate
    return (entries.where(live() & F.col("ejercicio").isNotNull() & F.col("tipo").isin("gasto", "mejora")).groupBy(*SLICE, money.vat_bucket(r, rounded).alias("tramo"))
            .agg(F.count("*").alias("n"), F.sum("base_c").alias("base_c"), F.sum("iva_c").alias("iva_c"), F.sum("total_c").alias("total_c")))


def by_nature(entries: DataFrame, accounts: DataFrame, boxes: DataFrame) -> DataFrame:
    """Total by box label (property income) or account name (business); zero sums are left out; the kind is that of the lowest id."""
    rows = (entries.where(live() & F.col("ejercicio").isNotNull()).join(F.broadcast(accounts.select("codigo", "nombre", "casilla")), F.col("cuenta_codigo") == F.col("codigo"), "left")
            .join(F.broadcast(boxes.select(F.col("casilla").alias("clave"), "etiqueta")), box_of(accounts) == F.col("clave"), "left"))
    label = F.when(F.col("codigo").isNull(), F.lit("Sin clasificar")).when(F.col("actividad_id") < 3, F.col("etiqueta")).otherwise(F.col("nombre"))
    return (rows.groupBy(*SLICE, label.alias("naturaleza")).agg(F.sum("total_c").alias("total_c"), F.min_by("tipo", "id").alias("tipo")).where("total_c != 0"))


def supplier_ranking(entries: DataFrame) -> DataFrame:
    """Suppliers of live expense over zero: total, the first spelling, and rank by total then name."""
    key = F.coalesce(F.nullif(F.lower(F.trim("emisor")), F.lit("")), F.lit("sin emisor"))
    got = (entries.where(live() & _kind("gasto") & (F.col("total_c") > 0) & F.col("ejercicio").isNotNull()).groupBy(*SLICE, key.alias("clave"))
           .agg(F.sum("total_c").alias("total_c"), F.min_by(F.coalesce(F.nullif(F.trim("emisor"), F.lit("")), F.lit("sin emisor")), "id").alias("emisor")))
    by = Window.partitionBy(*SLICE).orderBy(F.col("total_c").desc(), "clave")
    return got.withColumn("puesto", F.row_number().over(by))


def supplier_top(entries: DataFrame, k: int = 6) -> DataFrame:
    """The k largest suppliers and one row for the rest, if any, with shares of the total and of the largest in thousandths."""
    ranked = supplier_ranking(entries).withColumn("p", F.least("puesto", F.lit(k + 1)))
    got = ranked.groupBy(*SLICE, F.col("p").alias("puesto")).agg(F.sum("total_c").alias("total_c"), F.min_by("emisor", "puesto").alias("first"))
    got = got.withColumn("emisor", F.when(F.col("puesto") > k, F.lit("Resto")).otherwise(F.col("first")))
    w = Window.partitionBy(*SLICE)
    return got.select(*SLICE, "puesto", "emisor", "total_c", F.floor(F.col("total_c") * 1000 / F.sum("total_c").over(w)).cast("bigint").alias("cuota_m"),
                      F.floor(F.col("total_c") * 1000 / F.max("total_c").over(w)).cast("bigint").alias("pico_m"))


def headline(entries: DataFrame) -> DataFrame:
    """One sentence a year: a supplier with half the expense, else a month with 40 %, else the last month with expense.

    A share is rounded half to even as on the server."""
    top = supplier_ranking(entries).groupBy(*SLICE).agg(F.sum("total_c").alias("gasto_c"), F.max(F.when(F.col("puesto") == 1, F.col("total_c"))).alias("top_c"), F.max(F.when(F.col("puesto") == 1, F.col("emisor"))).alias("top"))
    months = by_month(entries).groupBy(*SLICE).agg(F.max_by("mes", F.struct("gasto_c", -F.col("mes"))).alias("mes_pico"), F.max("gasto_c").alias("pico_c"),
                                                   F.sum("gasto_c").alias("suma_c"), F.max(F.when(F.col("gasto_c") > 0, F.col("mes"))).alias("ultimo"))
    j = months.join(top, SLICE, "left")
    a, b = F.bround(F.try_divide(100.0 * F.col("top_c"), F.col("gasto_c"))).cast("int"), F.bround(F.try_divide(100.0 * F.col("pico_c"), F.col("suma_c"))).cast("int")
    return j.select(*SLICE, F.when(a >= 50, F.concat(F.col("top"), F.lit(" concentra el "), a.cast("string"), F.lit(" %")))
                    .when(b >= 40, F.concat(F.lit("Mes "), F.col("mes_pico").cast("string"), F.lit(" concentra el "), b.cast("string"), F.lit(" %")))
                    .when(F.col("ultimo").isNotNull(), F.concat(F.lit("Hasta mes "), F.col("ultimo").cast("string"))).otherwise(F.lit("")).alias("frase"))


def notices(entries: DataFrame, conflicts: DataFrame | None = None, shown: int = 5) -> DataFrame:
    """What a year's report has to say first: pending, no income, duplicates, invoices in conflict (factura_id), and the case file's undated entries by their first ids."""
    k = kpis(entries, conflicts)
    n = lambda c, one, many: F.when(F.col(c) == 1, F.lit(f"1 {one}")).when(F.col(c) > 1, F.concat(F.col(c).cast("string"), F.lit(f" {many}")))
    told = [n("n_pendientes", "asiento por revisar", "asientos por revisar"), F.when(F.col("ingresos_c") <= 0, F.lit("ejercicio sin ingresos")), n("n_duplicados", "duplicado fuera de los totales", "duplicados fuera de los totales")]
    if conflicts is not None:
        told.append(n("n_conflictos", "conflicto de agrupación", "conflictos de agrupación"))
    rest = F.col("sin") - shown
    told.append(F.when(F.col("sin") > 0, F.concat(F.col("sin").cast("string"), F.lit(" sin fecha: "), "primeros", F.when(rest > 0, F.concat(F.lit(" y "), rest.cast("string"), F.lit(" más"))).otherwise(""))))
    first = undated_summary(entries, shown).select("actividad_id", F.col("n").alias("sin"), F.col("ids").alias("primeros"))
    return k.join(first, "actividad_id", "left").select(*SLICE, F.array_join(F.filter(F.array(*told), lambda x: x.isNotNull()), "; ").alias("aviso"))


def undated(entries: DataFrame) -> DataFrame:
    """Live entries without a date, of all years."""
    return entries.where(live() & F.col("fecha").isNull()).select("id", "actividad_id", "emisor", "total_c", "estado")


def undated_summary(entries: DataFrame, k: int = 8) -> DataFrame:
    """Count of the undated live entries of each case file and its k smallest ids. Ranks are limited before they meet."""
    rows = undated(entries)
    first = (rows.withColumn("r", F.row_number().over(Window.partitionBy("actividad_id").orderBy("id"))).where(F.col("r") <= k)
             .groupBy("actividad_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids")))
    return rows.groupBy("actividad_id").agg(F.count("*").alias("n")).join(first, "actividad_id")


def state_listing(entries: DataFrame, accounts: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """Entries in some states with their account's name."""
    return (entries.where(F.col("estado").isin(*states)).join(F.broadcast(accounts.select("codigo", "nombre")), F.col("cuenta_codigo") == F.col("codigo"), "left")
            .select("id", "fecha", F.substring(F.coalesce("emisor", F.lit("")), 1, 32).alias("emisor"), "total_c", F.coalesce("nombre", F.lit("")).alias("rubro"), "estado"))


def review_queue(entries: DataFrame, k: int | None = None) -> DataFrame:
    """Entries to check, in order: low confidence, then pending, then the smallest confidence (none first), then id."""
    rows = entries.where((F.col("estado") != "duplicado") & ~F.col("validado") & F.col("ejercicio").isNotNull())
    least = F.coalesce(F.least("conf_ocr_m", "conf_clase_m"), F.lit(-1))
    by = Window.partitionBy(*SLICE).orderBy(F.when(low_confidence(), 0).otherwise(1), F.when(F.col("estado") == "pendiente", 0).otherwise(1), least, "id")
    out = rows.withColumn("puesto", F.row_number().over(by)).select(*SLICE, "puesto", "id", "estado", least.alias("conf_min_m"))
    return out if k is None else out.where(F.col("puesto") <= k)


def kanban(entries: DataFrame, k: int = 12) -> DataFrame:
    """Up to k cards of each state and how many more there are."""
    rows = entries.where("ejercicio is not null")
    by = Window.partitionBy(*SLICE, "estado").orderBy("id")
    cards = rows.withColumn("puesto", F.row_number().over(by)).where(F.col("puesto") <= k).select(*SLICE, "estado", "puesto", "id")
    more = rows.groupBy(*SLICE, "estado").agg(F.greatest(F.count("*") - k, F.lit(0)).alias("mas"))
    return cards.join(more, [*SLICE, "estado"])


def review_funnel(entries: DataFrame) -> DataFrame:
    """Counts by state and the progress in per cent, half to even."""
    n = lambda s: F.count_if(F.col("estado") == s)
    out = entries.where("ejercicio is not null").groupBy(*SLICE).agg(n("pendiente").alias("pendientes"), n("confirmado").alias("confirmados"), n("duplicado").alias("duplicados"), n("rechazado").alias("rechazados"))
    total = F.col("pendientes") + F.col("confirmados") + F.col("duplicados")
    return out.withColumn("avance", F.coalesce(F.bround(F.try_divide(100.0 * (total - F.col("pendientes")), total)), F.lit(0)).cast("int"))


def reject_reasons(entries: DataFrame) -> DataFrame:
    """Rejected entries by reason (up to a dash)."""
    reason = F.coalesce(F.split(F.col("motivo_rechazo"), " — ")[0], F.lit("sin motivo"))
    return entries.where("estado = 'rechazado'").groupBy("actividad_id", reason.alias("motivo")).agg(F.count("*").alias("n"))


def evidence_counts(edges: DataFrame) -> DataFrame:
    """Documents behind each invoice: evidence and continuation edges."""
    return edges.where(F.col("tipo").isin("evidencia", "continuacion") & (F.col("origen_tipo") == "documento")).groupBy(F.col("destino_id").alias("factura_id")).agg(F.count("*").alias("n"))


def twins(entries: DataFrame) -> DataFrame:
    """Suspicious entries (a level, but not merged) with the entry they point to."""
    other = entries.select(F.col("id").alias("gemelo_id"), F.col("estado").alias("gemelo_estado"), F.col("total_c").alias("gemelo_total_c"))
    return (entries.where("estado != 'duplicado' and duplicado_nivel is not null").join(other, F.col("duplicado_de_id") == F.col("gemelo_id"), "left")
            .select("id", "duplicado_nivel", "gemelo_id", "gemelo_estado", "gemelo_total_c"))


def pointed_at(entries: DataFrame) -> DataFrame:
    """For each entry the first live entry that points to it."""
    return entries.where(live() & F.col("duplicado_de_id").isNotNull()).groupBy(F.col("duplicado_de_id").alias("id")).agg(F.min("id").alias("gemelo_id"))


def archive_paths(entries: DataFrame) -> DataFrame:
    """Folder of each entry's document: case file, year, month, kind, account."""
    kind = (F.when(F.col("estado").isin("duplicado", "rechazado"), F.col("estado"))
            .when(F.col("cuenta_codigo").isNull() & (F.col("estado") == "pendiente"), "pendiente").otherwise(F.col("tipo")))
    slug = F.when(F.col("cuenta_codigo").isNull(), F.lit("sin-cuenta"))
    for code, name in schema.FOLDERS.items():
        slug = slug.when(F.col("cuenta_codigo") == code, name)
    slug = slug.otherwise(F.replace(F.lower(F.element_at(F.split("cuenta_codigo", r"\."), -1)), F.lit("_"), F.lit("-")))
    year = F.coalesce(F.col("ejercicio").cast("string"), F.lit("sin_fecha"))
    month = F.coalesce(F.lpad(F.month("fecha").cast("string"), 2, "0"), F.lit("00"))
    return entries.select("id", F.concat_ws("/", F.concat(F.lit("A"), F.col("actividad_id").cast("string")), year, month, kind, slug).alias("ruta"))


def workbook(entries: DataFrame, accounts: DataFrame, boxes: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a year's workbook by name; the sink writes one file for each."""
    book = entries.where((F.col("estado") != "rechazado") & F.col("ejercicio").isNotNull()).join(
        F.broadcast(accounts.select("codigo", F.col("nombre").alias("rubro"))), F.col("cuenta_codigo") == F.col("codigo"), "left")
    rows = book.select("id", *SLICE, F.coalesce(F.date_format("fecha", "yyyy-MM-dd"), F.lit("")).alias("fecha"), F.coalesce("emisor", F.lit("")).alias("emisor"),
                       F.coalesce("nif_emisor", F.lit("")).alias("nif"), F.coalesce("numero_factura", F.lit("")).alias("factura"), "base_c", "iva_tipo", "iva_c", "total_c",
                       F.coalesce("rubro", F.lit("")).alias("rubro"), "tipo", "estado")
    ok = F.col("estado") != "duplicado"
    return {"Gastos": rows.where(ok & _kind("gasto")), "Ingresos": rows.where(ok & _kind("ingreso")), "Mejoras": rows.where(ok & _kind("mejora")), "Duplicados": rows.where(~ok),
            "Reclasificar": rows.where(F.col("estado") == "pendiente"), "Trimestres": by_quarter(entries), "Resumen_rubro": by_account(entries, accounts),
            "Resumen_inmueble": by_property(entries), "Casillas_IRPF": tax_boxes(entries.where("actividad_id < 3"), accounts, boxes, hide_empty=True)}


def first_seen_labels(rows: DataFrame, label: Column, position: Column) -> DataFrame:
    """Different labels, trimmed and not empty, with the first position of each."""
    return rows.select(F.trim(label).alias("etiqueta"), position.alias("p")).where("etiqueta != ''").groupBy("etiqueta").agg(F.min("p").alias("primero"))


def natural_key(x: Column) -> Column:
    """Sort key without case and accents in which numbers compare by value: a run of digits is its length without leading zeros, in four places, and then itself."""
    parts = F.regexp_extract_all(text.plain(x), F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda p: F.concat(F.lpad(F.length(F.ltrim(p, F.lit("0"))).cast("string"), 4, "0"), F.ltrim(p, F.lit("0")))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), number(p)).otherwise(p)), "")
