"""One entry's page, edits and lines as DataFrames over all entries: view rows, JSON bodies, change sets, line replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import money, text
from . import reports, rules

#: What an empty field looks like.
BLANKS = ("", "—", "-")
#: Characters of a line's description and of a title that are kept.
LONGEST = 200


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).isin(*BLANKS)


def short_list(items: Column, most: int = 3) -> Column:
    """The first few of a list, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" y "), more.cast("string"), F.lit(" más"))).otherwise(""))


def title(c: Column) -> Column:
    """White space collapsed, cut at LONGEST."""
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, LONGEST)


def money_field(c: Column) -> Column:
    """Cents of a typed amount; empty fields are null."""
    return F.when(blank(c), F.lit(None).cast("bigint")).otherwise(money.parse_amount(c))


def iso_date(c: Column) -> Column:
    """Struct (fecha, error) of a typed date: its first ten characters as an ISO date; empty is null without error."""
    got = F.substring(c, 1, 10).try_cast("date")
    fine = F.substring(c, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.struct(F.when(fine, got).alias("fecha"), (~blank(c) & (F.when(fine, got).isNull())).alias("error"))


def decimals(cents: Column) -> Column:
    """Cents as text with two decimals and a point; empty for null."""
    whole = F.floor(F.abs(cents) / 100).cast("bigint").cast("string")
    return F.when(cents.isNull(), F.lit("")).otherwise(F.concat(F.when(cents < 0, "-").otherwise(""), whole, F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0")))


def warnings(base: Column, vat: Column, total: Column, rate: Column) -> Column:
    """Up to two warnings: base and VAT don't give the total; the rate isn't a legal one."""
    head = F.when(~F.coalesce(money.header_adds_up(base, vat, total), F.lit(True)), F.concat(F.lit("Base e IVA ("), decimals(base + vat), F.lit(") no dan el total ("), decimals(total), F.lit(")")))
    odd = F.when(~money.known_rate(rate), F.concat(F.lit("IVA "), rate.cast("string"), F.lit(" % no es un tipo legal")))
    return F.filter(F.array(head, odd), lambda w: w.isNotNull())


def line_rate(stored: Column, base: Column, vat: Column) -> Column:
    """Rate shown for a line: its own, else the legal one that its amounts imply, else the implied one with two decimals, else 21."""
    exact = F.round((F.lit(100.0) * vat / base).cast("decimal(20,6)"), 2)
    implied = F.when(base != 0, F.coalesce(money.implied_rate(base, vat).cast("string"), F.regexp_replace(F.regexp_replace(exact.cast("string"), "0+$", ""), r"\.$", "")))
    return F.coalesce(stored.cast("string"), implied, F.lit("21"))


def ocr_confidence(kind: Column, length: Column) -> Column:
    """Thousandths by an engine and the length of its text; model engines have a constant."""
    by = {"rapid": (750, 350, 50), "vision": (800, 400, 50), "tesseract": (700, 300, 50)}
    out = None
    for name, (long, some, none) in by.items():
        tier = F.when(length >= 40, long).when(length > 0, some).otherwise(none)
        out = F.when(kind == name, tier) if out is None else out.when(kind == name, tier)
    return out.otherwise(800)


def description(issuer: Column, number: Column, file: Column) -> Column:
    """Issuer and number, else what there is of them, else the file's name."""
    return F.when(~blank(issuer) & ~blank(number), F.concat_ws(" · ", issuer, number)).when(~blank(issuer), issuer).otherwise(file)


def engines(names: Column, aliases: dict[str, str]) -> Column:
    """Struct (motores, desconocidos) of a list of names: lower case, aliases resolved, each once in its first place; unknown ones apart."""
    pairs = [x for k, v in sorted({**aliases, **{v: v for v in aliases.values()}}.items()) for x in (F.lit(k), F.lit(v))]
    known = F.create_map(*pairs)
    clean = F.transform(names, lambda n: F.lower(F.trim(n)))
    return F.struct(F.array_distinct(F.filter(F.transform(clean, lambda n: known[n]), lambda n: n.isNotNull())).alias("motores"),
                    F.filter(clean, lambda n: known[n].isNull()).alias("desconocidos"))


def needles_found(haystack: Column, needles: Column) -> Column:
    """Whether all needles occur in a name, spaces and case aside; null without needles."""
    return F.when(F.size(needles) > 0, F.forall(needles, lambda n: F.contains(text.compact(haystack), text.compact(n))))


def quarter_bounds(year: Column) -> Column:
    """Array of (trimestre, desde, hasta) of a fiscal year."""
    return F.array(*[F.struct(F.lit(f"T{q}").alias("trimestre"), F.make_date(year, F.lit(3 * q - 2), F.lit(1)).alias("desde"), F.last_day(F.make_date(year, F.lit(3 * q), F.lit(1))).alias("hasta")) for q in range(1, 5)])


# Lines.

def current_lines(rows: DataFrame, legacy: DataFrame) -> DataFrame:
    """(asiento_id, posicion, codigo, descripcion, importe_c): an entry's line rows, or the lines of its old JSON where it has no rows.

    legacy has (asiento_id, json), an array of objects with codigo, descripcion, importe (text). Both meet by an anti-join.
    """
    old = legacy.join(rows.select("asiento_id").distinct(), "asiento_id", "left_anti").select(
        "asiento_id", F.posexplode(F.from_json("json", "array<struct<codigo:string,descripcion:string,importe:string>>")).alias("p", "x"))
    old = old.select("asiento_id", (F.col("p") + 1).cast("bigint").alias("posicion"), "x.codigo", "x.descripcion", money_field(F.col("x.importe")).alias("importe_c"))
    return rows.select("asiento_id", F.col("posicion").cast("bigint").alias("posicion"), "codigo", "descripcion", "importe_c").unionByName(wire_lines(old))


def wire_lines(lines: DataFrame) -> DataFrame:
    """Lines as they are kept: description trimmed and cut, blank codes null, fully empty lines dropped, missing positions their place."""
    name, code = F.substring(F.trim(F.coalesce("descripcion", F.lit(""))), 1, LONGEST), F.nullif(F.trim("codigo"), F.lit(""))
    kept = lines.withColumn("descripcion", name).withColumn("codigo", code).where("descripcion != '' or codigo is not null or importe_c is not null")
    place = F.row_number().over(Window.partitionBy("asiento_id").orderBy(F.col("posicion").asc_nulls_last(), "descripcion", "codigo"))
    return kept.withColumn("posicion", F.coalesce("posicion", place.cast("bigint")))


def replace_lines(lines: DataFrame, new: DataFrame) -> DataFrame:
    """The lines after entries in `new` got other ones: theirs go, the new ones come as `wire_lines` keeps them, numbered anew."""
    fresh = wire_lines(new)
    fresh = fresh.withColumn("posicion", F.row_number().over(Window.partitionBy("asiento_id").orderBy("posicion")).cast("bigint"))
    return lines.join(new.select("asiento_id").distinct(), "asiento_id", "left_anti").unionByName(fresh.select(*lines.columns))


def line_gap(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, hueco_c): how far the amounts of lines with a description or code are from the total; the total without amounts; null without total."""
    named = lines.where("coalesce(descripcion, '') != '' or coalesce(codigo, '') != ''").groupBy("asiento_id").agg(F.sum("importe_c").alias("s"))
    j = entries.select("id", "total_c").join(named, F.col("id") == F.col("asiento_id"), "left")
    return j.select("id", F.when(F.col("s").isNull(), F.abs("total_c")).otherwise(F.abs(F.col("s") - F.col("total_c"))).alias("hueco_c"))


# Audit and evidence. Edits and merges are in `edits`.

def latest_audit(audit: DataFrame, most: int = 8) -> DataFrame:
    """The newest few audit rows of each entry, newest (largest audit id) first."""
    return audit.withColumn("puesto", F.row_number().over(Window.partitionBy("asiento_id").orderBy(F.col("audit_id").desc()))).where(F.col("puesto") <= most)


def name_audit(renamed: DataFrame) -> DataFrame:
    """Audit rows of entries whose issuer's spelling was changed by the model."""
    return renamed.select(F.col("id").alias("asiento_id"), F.lit("emisor").alias("campo"), "antes", "despues", F.lit("modelo").alias("fuente"))


def evidence_documents(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """(factura_id, documento_id) of the documents that exist among an invoice's evidence."""
    own = edges.where("origen_tipo = 'documento' and tipo in ('evidencia', 'continuacion')").select(F.col("destino_id").alias("factura_id"), F.col("origen_id").alias("documento_id")).distinct()
    return own.join(documents.select(F.col("id").alias("documento_id")), "documento_id", "left_semi").select("factura_id", "documento_id")


def first_entry(entries: DataFrame) -> DataFrame:
    """(factura_id, id) of an invoice's first entry that isn't a duplicate, else its first."""
    return entries.where("factura_id is not null").groupBy("factura_id").agg(F.min(F.struct((F.col("estado") == "duplicado").alias("d"), "id")).alias("s")).select("factura_id", "s.id")


# Views.

def quality_chip(entries: DataFrame, failing: DataFrame) -> DataFrame:
    """(id, tono, texto): validated; else to be checked if a check fails or confidence is low; else acceptable. failing has the ids with failed checks."""
    j = entries.join(failing.select(F.col("id").alias("f")).distinct(), F.col("id") == F.col("f"), "left")
    warn = F.col("f").isNotNull() | reports.low_confidence()
    return j.select("id", F.when(F.col("validado"), "ok").when(warn, "warn").otherwise("ok").alias("tono"), F.when(F.col("validado"), "Validado").when(warn, "Revisar").otherwise("Aceptable").alias("texto"))


def book_totals(entries: DataFrame) -> DataFrame:
    """Per case file and year: rows that aren't duplicates (rejected ones count), and their sums."""
    return entries.where("estado != 'duplicado'").groupBy("actividad_id", "ejercicio").agg(F.count("*").alias("n"), F.sum("base_c").alias("base_c"), F.sum("iva_c").alias("iva_c"), F.sum("total_c").alias("total_c"))


def ticket_match(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, coincide): the lines' amounts and the total differ by two cents at most; false if either is missing."""
    t = rules.line_totals(lines).select("asiento_id", "importe_l")
    return entries.join(t, F.col("id") == F.col("asiento_id"), "left").select("id", F.coalesce(F.abs(F.col("importe_l") - F.col("total_c")) <= 2, F.lit(False)).alias("coincide"))


def entry_body(entries: DataFrame, lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """(id, cuerpo): an entry's page as JSON: fields as text, the account's name, whether the lines match, and its active lines in order."""
    item = F.struct("posicion", "codigo", "descripcion", decimals(F.col("base_c") + F.col("iva_c")).alias("importe"))
    own = lines.where("not eliminada").groupBy("asiento_id").agg(F.sort_array(F.collect_list(item)).alias("lineas"))
    names = accounts.select(F.col("codigo").alias("cc"), "nombre")
    j = entries.join(own, F.col("id") == F.col("asiento_id"), "left").join(F.broadcast(names), F.col("cuenta_codigo") == F.col("cc"), "left").join(ticket_match(entries, lines).withColumnRenamed("id", "tid"), F.col("id") == F.col("tid"))
    body = F.to_json(F.struct("id", F.date_format("fecha", "yyyy-MM-dd").alias("fecha"), "emisor", "numero_factura", decimals(F.col("total_c")).alias("total"), F.coalesce("nombre", F.lit("")).alias("rubro"), "coincide",
                              F.coalesce("lineas", F.array().cast("array<struct<posicion:bigint,codigo:string,descripcion:string,importe:string>>")).alias("lineas")))
    return j.select("id", body.alias("cuerpo"))


def grid_rows(entries: DataFrame, lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """A row of the book's grid for each entry: texts as shown, account, units of its lines, and whether its confidence is low."""
    t = rules.line_totals(lines).select("asiento_id", "unidades", "n_lineas")
    names = accounts.select(F.col("codigo").alias("cc"), "nombre")
    j = entries.join(t, F.col("id") == F.col("asiento_id"), "left").join(F.broadcast(names), F.col("cuenta_codigo") == F.col("cc"), "left")
    return j.select("id", F.coalesce(F.date_format("fecha", "dd/MM/yyyy"), F.lit("")).alias("fecha"), F.coalesce("emisor", F.lit("")).alias("emisor"), money.format_euro(F.col("total_c")).alias("total"), F.coalesce("nombre", F.lit("")).alias("rubro"),
                    "estado", F.coalesce("unidades", F.lit(0)).cast("bigint").alias("unidades"), F.coalesce("n_lineas", F.lit(0)).cast("bigint").alias("n_lineas"), reports.low_confidence().alias("baja"))


def export_rows(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """The ten columns of the visible rows' CSV file."""
    names = accounts.select(F.col("codigo").alias("cc"), "nombre")
    z = lambda c: F.coalesce(F.col(c), F.lit(""))
    return entries.join(F.broadcast(names), F.col("cuenta_codigo") == F.col("cc"), "left").select(
        F.col("id").alias("Id"), F.coalesce(F.date_format("fecha", "dd/MM/yyyy"), F.lit("")).alias("Fecha"), z("emisor").alias("Emisor"), z("nif_emisor").alias("NIF"), z("numero_factura").alias("Factura"),
        decimals(F.col("base_c")).alias("Base"), decimals(F.col("iva_c")).alias("IVA"), decimals(F.col("total_c")).alias("Total"), z("nombre").alias("Rubro"), F.col("estado").alias("Estado"))


def name_variants(entries: DataFrame) -> DataFrame:
    """(actividad_id, nif, emisor, n, ids) of a case file's tax ids with two spellings or more; ids are the entries of a spelling."""
    rows = entries.where("nif_emisor is not null and emisor is not null").groupBy("actividad_id", F.col("nif_emisor").alias("nif"), "emisor").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
    many = rows.groupBy("actividad_id", "nif").agg(F.count("*").alias("formas")).where("formas > 1").select("actividad_id", "nif")
    return rows.join(many, ["actividad_id", "nif"])


def next_code(names: DataFrame, prefix: str) -> DataFrame:
    """(codigo): the next code of a prefix, counted from the codes that have it; names has (codigo)."""
    return names.agg((F.count_if(F.startswith("codigo", F.lit(prefix))) + 1).alias("n")).select(F.format_string(prefix + "-%03d", "n").alias("codigo"))


def box_of_account(accounts: DataFrame, own: DataFrame) -> DataFrame:
    """(codigo, casilla): a user's box before the catalogue's; empty or unknown boxes are unclassified. own has (codigo, casilla)."""
    mine = own.select(F.col("codigo").alias("oc"), F.nullif(F.trim("casilla"), F.lit("")).alias("ob"))
    known = F.coalesce("ob", "casilla").isin(*[b[0] for b in schema.BOXES])
    return accounts.join(mine, F.col("codigo") == F.col("oc"), "left").select("codigo", F.when(known, F.coalesce("ob", "casilla")).otherwise("sin_clasificar").alias("casilla"))


def account_requests(wanted: DataFrame, accounts: DataFrame) -> DataFrame:
    """(nombre, regimen, casilla, error): an account is made only for rented property, in a box that exists and is a real one, under a name nobody has (case aside)."""
    taken = accounts.select(F.lower("nombre").alias("n_")).distinct()
    j = wanted.join(F.broadcast(taken), F.lower(F.trim("nombre")) == F.col("n_"), "left")
    boxes = [b[0] for b in schema.BOXES if b[0] != "sin_clasificar"]
    error = (F.when(blank(F.col("nombre")), "sin nombre").when(F.col("regimen") != schema.CI, "régimen").when(~F.coalesce(F.col("casilla").isin(*boxes), F.lit(False)), "casilla").when(F.col("n_").isNotNull(), "repetida"))
    return j.select("nombre", "regimen", "casilla", error.alias("error"))


def lost_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose file isn't there; documents has (id, ruta), files has (ruta)."""
    return documents.join(files.select("ruta").distinct(), "ruta", "left_anti").select("id", "ruta")


def placements(documents: DataFrame) -> DataFrame:
    """(id, origen, destino) of files that have to move; documents has (id, origen, carpeta, nombre, sha, bytes).

    The leaf is the hash's first twelve characters and the name. Where several files would take one place, all but the first (by id) get their size as a suffix.
    """
    leaf = F.concat_ws("/", "carpeta", F.concat_ws("_", F.substring("sha", 1, 12), "nombre"))
    place = documents.withColumn("d", leaf).withColumn("r", F.row_number().over(Window.partitionBy("d").orderBy("id")))
    return place.select("id", "origen", F.when(F.col("r") == 1, F.col("d")).otherwise(F.concat_ws("_", "d", F.col("bytes").cast("string"))).alias("destino")).where("origen is null or origen != destino")


def known_spelling(incoming: DataFrame, canonical: DataFrame) -> DataFrame:
    """(id, emisor): the case file's canonical spelling of the tax id where there is one that is surely the same supplier, else the text's own. canonical has (actividad_id, nif, canonico)."""
    from .matching import jaro_winkler_column, supplier_score
    j = incoming.join(canonical.select(F.col("actividad_id").alias("ca"), F.col("nif").alias("cn"), "canonico"), (F.col("nif") == F.col("cn")) & (F.col("actividad_id") == F.col("ca")), "left")
    jw = jaro_winkler_column(text.clean_name(F.col("emisor")), text.clean_name(F.col("canonico")))
    sure = F.coalesce(supplier_score(F.col("nif"), F.col("cn"), jw)["probabilidad"] >= schema.MENTION, F.lit(False))
    return j.select("id", F.when(F.col("canonico").isNotNull() & sure, F.col("canonico")).otherwise(F.col("emisor")).alias("emisor"))


def refreshed(catalogue: DataFrame, stored: DataFrame) -> DataFrame:
    """Accounts after seeding: missing ones come, rows of the system's are those of the catalogue, a user's stay. stored also has (origen)."""
    columns = catalogue.columns
    users = stored.where("origen = 'usuario'").select(*columns, "origen")
    system = catalogue.join(users.select("codigo"), "codigo", "left_anti").select(*columns, F.lit("sistema").alias("origen"))
    return users.unionByName(system)
