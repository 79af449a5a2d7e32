"""The interactive book as relational operators: facets, ranges, search, pages, visible totals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money
from .reports import live, low_confidence


@dataclass(frozen=True)
class Facets:
    """Conditions, all of which must hold. An absent facet doesn't filter; an empty one lets nothing through."""

    search: str = ""
    since: str | None = None
    until: str | None = None
    sets: dict[str, tuple[str, ...]] = field(default_factory=dict)
    states: tuple[str, ...] | None = None
    confidence: tuple[str, ...] | None = None
    least_c: int | None = None
    most_c: int | None = None


def confidence_class() -> Column:
    return F.when(F.col("validado"), "validado").when(low_confidence(), "baja").otherwise("ok")


def search_blob() -> Column:
    """What free text is looked for in: id, date, issuer, id number, invoice number, account, kind, state."""
    return F.lower(F.concat_ws(" ", F.col("id").cast("string"), F.date_format("fecha", "dd/MM/yyyy"), "emisor", "nif_emisor", "numero_factura", "cuenta_codigo", "tipo", "estado"))


def in_range(since: str | None, until: str | None, date: Column | None = None) -> Column:
    """Inclusive dates; without bounds everything, with any bound no undated rows."""
    d = F.col("fecha") if date is None else date
    out = F.lit(True)
    if since:
        out = out & F.coalesce(d >= F.to_date(F.lit(since)), F.lit(False))
    if until:
        out = out & F.coalesce(d <= F.to_date(F.lit(until)), F.lit(False))
    return out


def between(value: Column, least: int | None, most: int | None, null_passes: bool) -> Column:
    """Numeric range. A missing value passes (line items) or counts as zero (other tables)."""
    v = value if null_passes else F.coalesce(value, F.lit(0))
    out = F.lit(True)
    if least is not None:
        out = out & F.coalesce(v >= least, F.lit(null_passes))
    if most is not None:
        out = out & F.coalesce(v <= most, F.lit(null_passes))
    return out


def matches(f: Facets) -> Column:
    """Predicate of a set of facets. The state facet looks at kind and state, and hides duplicates while it isn't used."""
    out = in_range(f.since, f.until) & between(F.col("total_c"), f.least_c, f.most_c, False)
    if f.search:
        out = out & F.contains(search_blob(), F.lit(f.search.lower()))
    for name, values in f.sets.items():
        out = out & F.coalesce(F.col(name).isin(*values), F.lit(False))
    out = out & (F.col("estado") != "duplicado" if f.states is None else F.col("tipo").isin(*f.states) | F.col("estado").isin(*f.states))
    return out & confidence_class().isin(*f.confidence) if f.confidence is not None else out


def choices(entries: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Different values of each facet, without the placeholder."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("faceta"), F.col(c).cast("string").alias("valor")) for c in columns]))
    return entries.select(pairs.alias("p")).select("p.faceta", "p.valor").where("valor is not null and valor != '—'").distinct()


def page(entries: DataFrame, order: list[Column], number: int, size: int = 15) -> DataFrame:
    """One page of the sorted rows (page 1 and up). The limit is the feature."""
    return entries.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def visible_totals(entries: DataFrame, f: Facets) -> DataFrame:
    """Visible rows and their sums without duplicates, and the sum of the whole book without duplicates."""
    rows = entries.where(live() | (F.col("estado") == "duplicado"))
    shown, single = matches(f), F.col("estado") != "duplicado"
    s = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    return rows.groupBy("actividad_id", "ejercicio").agg(F.count_if(shown).alias("n_visibles"), s(shown & single, "total_c").alias("total_c"), s(shown & single, "base_c").alias("base_c"),
                                                         s(shown & single, "iva_c").alias("iva_c"), s(single, "total_c").alias("libro_c"))


def range_insights(entries: DataFrame, ranges: DataFrame, k: int = 6) -> dict[str, DataFrame]:
    """Insights of every named range (rango, desde, hasta, both inclusive) and case file at once: kpis, meses, proveedores (the k largest), iva.

    Entries become daily sums first; a range becomes its days, and both meet by an equi-join on the date, so no range is compared with
    entries outside it and a new range reads nothing anew. Undated entries are in no range; a range without entries has no rows.
    """
    days = ranges.select("rango", F.explode(F.sequence("desde", "hasta")).alias("fecha")).distinct()
    rows = entries.where(live() & F.col("fecha").isNotNull())
    kind = lambda name, alias: F.coalesce(F.sum(F.when(F.col("tipo") == name, F.col("total_c"))), F.lit(0)).alias(alias)
    add = lambda *cs: [F.sum(c).alias(c) for c in cs]
    daily = rows.groupBy("actividad_id", "fecha").agg(F.count("*").alias("n"), kind("gasto", "gasto_c"), kind("ingreso", "ingreso_c"), kind("mejora", "mejora_c")).join(days, "fecha")
    kpis = daily.groupBy("rango", "actividad_id").agg(*add("n", "gasto_c", "ingreso_c", "mejora_c")).withColumn("resultado_c", F.col("ingreso_c") - F.col("gasto_c"))
    months = daily.groupBy("rango", "actividad_id", F.year("fecha").alias("ano"), F.month("fecha").alias("mes")).agg(*add("gasto_c", "ingreso_c"))
    key = F.coalesce(F.nullif(F.lower(F.trim("emisor")), F.lit("")), F.lit("sin emisor"))
    bought = rows.where("tipo = 'gasto' and total_c > 0").groupBy("actividad_id", "fecha", key.alias("clave")).agg(*add("total_c")).join(days, "fecha").groupBy("rango", "actividad_id", "clave").agg(*add("total_c"))
    top = bought.withColumn("puesto", F.row_number().over(Window.partitionBy("rango", "actividad_id").orderBy(F.col("total_c").desc(), "clave"))).where(F.col("puesto") <= k)
    taxed = rows.where(F.col("tipo").isin("gasto", "mejora")).groupBy("actividad_id", "fecha", money.vat_bucket(F.col("iva_tipo")).alias("tramo")).agg(F.count("*").alias("n"), *add("base_c", "iva_c", "total_c"))
    vat = taxed.join(days, "fecha").groupBy("rango", "actividad_id", "tramo").agg(*add("n", "base_c", "iva_c", "total_c"))
    return {"kpis": kpis, "meses": months, "proveedores": top, "iva": vat}
