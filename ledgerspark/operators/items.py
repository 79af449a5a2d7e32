"""Line items of invoice texts, relationally: a row for each line of text, its kind, and windows over a document's lines.

Where all ways are tried, the same is done a document at a time by `itemtext`, in one pass; a test holds that both agree.
A document's lines are one window partition; their number follows the document, not the corpus. Amounts are cents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money
from ..schema import LINE_TOLERANCE, VAT_RATES
from ..session import ship

# Words of lines that are no articles, and of the head over a column of prices or of articles.
FOOTER_WORDS = ("total", "base", "iva", "igic", "ipsi", "nif", "cif", "fecha", "factura", "cliente", "pag", "pág", "pagina", "página", "original", "ticket", "cuota", "cambio", "visa",
                "mastercard", "efectivo", "importe", "duplicado", "ejemplar", "observacion", "observaciones", "modos", "unid", "scrap", "razon", "razón", "precio")
PRICE_HEADS = ("tti", "tii", "ti (eur)")
ARTICLE_HEADS = ("designacion", "designación", "referencia art")

THREE_LETTERS = r"\p{L}[^\p{L}]*\p{L}[^\p{L}]*\p{L}"

#: Lines below a name on which its code is looked for.
LOOK_AHEAD = 3
#: The largest number of pieces that a unit price and a line price next to each other are tried with.
PIECES = 40


def _doc():
    return Window.partitionBy("doc_id").orderBy("pos")


def _starts(line: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [F.startswith(line, F.lit(w)) for w in words])


def _first_word(line: Column, words: tuple[str, ...]) -> Column:
    """Whether a line begins with one of the words, and the word ends there."""
    return line.rlike(rf"^(?:{'|'.join(words)})(?![\p{{L}}0-9])")


def _holds(line: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(line, F.lit(w)) for w in words])


def kinds(docs: DataFrame, text_col: str = "texto") -> DataFrame:
    """(doc_id, pos, linea, clase, importe_c, codigo, nombre) of every line that isn't blank.

    clase is precio (an amount alone), codigo (7 or 8 digits, an index before or a stop after them), indice (1 to 40 alone),
    cabecera (head of a column of prices), articulos (head of the articles), pie (words of totals and the like), nombre (a
    name, its amount at its end or none) or otra.
    """
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "raw")).select("doc_id", "pos", F.trim("raw").alias("linea")).where("linea != ''")
    line, low, amounts, name = F.col("linea"), F.col("_bajo"), F.col("_importes"), F.col("_nombre")
    bare = F.trim(F.regexp_replace(line, r"[-\d.,€]+|EUR", ""))
    named = F.trim(F.regexp_replace(F.regexp_replace(line, r"\s+-?[\d.]*\d[.,]\d{2}\s*(?:€|EUR)?$", ""), r"^\d{1,2}[.)]?\s+(?=\D{3})", ""))
    # columns of their own, so that each is worked out once a line, and only where the line can have one
    rows = rows.withColumns({"_bajo": F.lower("linea"), "_importes": F.when(line.rlike(r"\d[.,]\d{2}"), money.all_amounts(line)), "_nombre": F.when(line.rlike(THREE_LETTERS), named)})
    kind = (F.when((F.size(amounts) == 1) & (bare == ""), "precio").when(line.rlike(r"^(?:\d{1,2}\.?\s+)?\d{7,8}[.,:;]?$"), "codigo")
            .when(line.rlike(r"^(?:[1-9]|[1-3]\d|40)$"), "indice").when(_starts(low, ARTICLE_HEADS), "articulos")
            .when(_holds(low, PRICE_HEADS) & ~F.contains(low, F.lit("total")), "cabecera").when(_first_word(low, FOOTER_WORDS), "pie")
            .when(name.rlike(THREE_LETTERS), "nombre").otherwise("otra"))
    out = rows.withColumn("clase", kind)
    return out.select("doc_id", "pos", "linea", "clase", F.when(F.col("clase").isin("precio", "nombre"), F.try_element_at(amounts, F.lit(-1))).alias("importe_c"),
                      F.when(F.col("clase") == "codigo", F.regexp_extract(line, r"(\d{7,8})[.,:;]?$", 1)).alias("codigo"), F.when(F.col("clase") == "nombre", name).alias("nombre"))


def article_region(lines: DataFrame) -> DataFrame:
    """The lines below the first head of articles; all lines of documents that have no such head."""
    head = F.min(F.when(F.col("clase") == "articulos", F.col("pos"))).over(Window.partitionBy("doc_id"))
    return lines.withColumn("desde", F.coalesce(head, F.lit(-1))).where("pos > desde").drop("desde")


def reference_pairs(lines: DataFrame) -> DataFrame:
    """(doc_id, orden, codigo, nombre, pos) of names and the codes on one of the LOOK_AHEAD lines below them; a name takes its first code, a code the name nearest above."""
    place = F.last(F.when(F.col("clase") == "nombre", F.col("pos")), ignorenulls=True).over(_doc().rowsBetween(-LOOK_AHEAD, -1))
    name = F.last("nombre", ignorenulls=True).over(_doc().rowsBetween(-LOOK_AHEAD, -1))
    found = lines.withColumn("sitio", place).withColumn("nombre", name).where("clase = 'codigo' and sitio is not null")
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "sitio").orderBy("pos"))).where("r = 1")
    return first.select("doc_id", F.row_number().over(_doc()).alias("orden"), "codigo", "nombre", "pos")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, orden, codigo, nombre, pos) of names below an index of their own; the code may stand below the name."""
    rows = lines.withColumn("antes", F.lag("clase").over(_doc())).withColumn("indice", F.lag("linea").over(_doc()))
    for k in (1, 2):
        rows = rows.withColumn(f"c{k}", F.lead("codigo", k).over(_doc())).withColumn(f"n{k}", F.lead("clase", k).over(_doc()))
    code = F.coalesce("c1", F.when(~F.col("n1").isin("nombre", "indice"), F.col("c2")))
    return rows.where("clase = 'nombre' and antes = 'indice'").select("doc_id", F.col("indice").cast("int").alias("orden"), code.alias("codigo"), "nombre", "pos")


def column_runs(lines: DataFrame) -> DataFrame:
    """(doc_id, tramo, desde, n, suma_c, importes, con_cabecera) of the runs of lines that are prices alone.

    con_cabecera: the head of a column of prices stands above. In such a run a unit price followed by its multiple (up to
    PIECES) is one line's price, so only the second counts.
    """
    marked = lines.withColumn("cabecera", F.lag("clase").over(_doc()) == "cabecera").withColumn("fila", F.row_number().over(_doc())).where("clase = 'precio'")
    runs = (marked.withColumn("tramo", F.col("fila") - F.row_number().over(_doc())).groupBy("doc_id", "tramo")
            .agg(F.min("pos").alias("desde"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "importe_c"))), lambda x: x["importe_c"]).alias("todos"),
                 F.max(F.coalesce("cabecera", F.lit(False))).alias("con_cabecera")))
    times = lambda x, y: F.round(y / x)
    paired = lambda x, y: (x > 0) & (times(x, y).between(1, PIECES)) & (F.abs(y / x - times(x, y)) <= 0.03)

    def step(acc: Column, x: Column) -> Column:
        """An open unit price waits for its line price; whatever else comes closes it as a price of its own."""
        opened, out = acc["abierto"], acc["precios"]
        done = F.coalesce(paired(opened, x), F.lit(False))
        return F.struct(F.when(done, F.lit(None).cast("bigint")).otherwise(x).alias("abierto"),
                        F.when(done, F.concat(out, F.array(x))).when(opened.isNotNull(), F.concat(out, F.array(opened))).otherwise(out).alias("precios"))

    start = F.struct(F.lit(None).cast("bigint").alias("abierto"), F.array().cast("array<bigint>").alias("precios"))
    folded = F.aggregate("todos", start, step, lambda acc: F.when(acc["abierto"].isNotNull(), F.concat(acc["precios"], F.array(acc["abierto"]))).otherwise(acc["precios"]))
    out = runs.withColumn("importes", F.when(F.col("con_cabecera"), folded).otherwise(F.col("todos")))
    return out.select("doc_id", "tramo", "desde", F.size("importes").alias("n"), F.aggregate("importes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("suma_c"), "importes", "con_cabecera")


def run_parts(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, importes, suma_c, desde) of the stretches of runs that are as long as wanted, which has (doc_id, n), and shorter than the run.

    A stretch's sum is the difference of two prefix sums, which meet by their places, so the work is linear in the prices.
    """
    longer = runs.join(wanted.select("doc_id", F.col("n").cast("int").alias("largo")).distinct(), "doc_id").where("largo > 1 and largo < n")
    place = ["doc_id", "tramo", "largo"]
    up_to = F.sum("importe_c").over(Window.partitionBy(*place).orderBy("i"))
    sums = longer.select(*place, "desde", F.posexplode("importes").alias("i", "importe_c")).select(*place, "desde", "i", "importe_c", up_to.alias("hasta"))
    start = sums.select(*place, (F.col("i") + F.col("largo") - 1).alias("i"), F.col("i").alias("primero"), (F.col("hasta") - F.col("importe_c")).alias("antes"))
    parts = sums.select(*place, "desde", "i", "hasta").join(start, [*place, "i"]).join(longer.select(*place, "importes"), place)
    return parts.select("doc_id", F.slice("importes", F.col("primero") + 1, F.col("largo")).alias("importes"), (F.col("hasta") - F.col("antes")).alias("suma_c"),
                        (F.col("desde") + F.col("primero")).cast("bigint").alias("desde"))


def column_prices(lines: DataFrame, headers: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, importes, suma_c) of the prices that stand in columns; headers has (doc_id, base_c, total_c).

    All runs below a price head together if they add up to the total; else the single run that adds up to the total, or to
    the base, the longest first. wanted has (doc_id, n), numbers of prices looked for: columns of such a length come first, and they
    may be a stretch of a run, where no line sets two columns apart, unless its amounts are all the header's own.
    """
    runs = column_runs(lines)
    joined = (runs.where("con_cabecera").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("desde", "importes"))).alias("partes"), F.sum("suma_c").alias("suma_c"))
              .select("doc_id", F.flatten(F.transform("partes", lambda x: x["importes"])).alias("importes"), "suma_c", F.lit(0).cast("bigint").alias("desde")))
    every = joined.unionByName(runs.select("doc_id", "importes", "suma_c", "desde")).withColumn("parte", F.lit(False))
    if wanted is not None:
        every = every.unionByName(run_parts(runs, wanted).withColumn("parte", F.lit(True)))
    every = every.join(headers.select("doc_id", "base_c", "total_c"), "doc_id")
    own = F.forall("importes", lambda x: F.coalesce(x.isin(F.col("base_c"), F.col("total_c")) | (x == F.col("total_c") - F.col("base_c")), F.lit(False)))
    every = every.where(~(F.col("parte") & own))
    if wanted is None:
        every = every.withColumn("querido", F.lit(False))
    else:
        lengths = wanted.select("doc_id", F.col("n").cast("int").alias("largo")).groupBy("doc_id").agg(F.collect_set("largo").alias("largos"))
        every = every.join(lengths, "doc_id", "left").withColumn("querido", F.coalesce(F.array_contains("largos", F.size("importes")), F.lit(False)))
    rank = F.when(F.abs(F.col("suma_c") - F.col("total_c")) <= LINE_TOLERANCE, 0).when(F.abs(F.col("suma_c") - F.col("base_c")) <= LINE_TOLERANCE, 1)
    best = Window.partitionBy("doc_id").orderBy(F.col("querido").desc(), "rango", F.size("importes").desc(), "parte", "desde")
    return every.withColumn("rango", rank).where("rango is not null").withColumn("r", F.row_number().over(best)).where("r = 1").select("doc_id", "importes", "suma_c")


def block_prices(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, importe_c, iva_tipo) for each code: the last amount before the next code or the totals, and the block's legal rate if one of its amounts is one."""
    stops = F.lower("linea").startswith("total") | F.lower("linea").startswith("modos")
    anchor = F.last(F.when(F.col("clase") == "codigo", F.col("pos")), ignorenulls=True).over(_doc().rowsBetween(Window.unboundedPreceding, 0))
    name_after = F.max(F.when(stops, F.lit(1)).otherwise(0)).over(Window.partitionBy("doc_id", "ancla").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("ancla", anchor).where("ancla is not null").withColumn("fuera", name_after).where("clase = 'precio' and fuera = 0")
    legal = F.when(F.col("importe_c").isin(*[100 * r for r in VAT_RATES if r]), (F.col("importe_c") / 100).cast("int"))
    return rows.groupBy("doc_id", F.col("ancla").alias("pos")).agg(F.max_by("importe_c", "pos").alias("importe_c"), F.min(legal).alias("iva_tipo"))


def trailing_amounts(lines: DataFrame) -> DataFrame:
    """(doc_id, orden, codigo, nombre, importe_c, pos) of names with an amount on their own line, or on the next one alone; equal names with equal amounts count once."""
    rows = lines.withColumn("debajo", F.when(F.lead("clase").over(_doc()) == "precio", F.lead("importe_c").over(_doc()))).where("clase = 'nombre'")
    rows = rows.withColumn("importe_c", F.coalesce("importe_c", "debajo")).where("importe_c is not null")
    once = rows.groupBy("doc_id", "nombre", "importe_c").agg(F.min("pos").alias("pos"))
    return once.select("doc_id", F.row_number().over(_doc()).alias("orden"), F.lit(None).cast("string").alias("codigo"), "nombre", "importe_c", "pos")


def without_footer(items: DataFrame, headers: DataFrame) -> DataFrame:
    """The items of documents whose amounts aren't all the header's own (base, VAT or total)."""
    joined = items.join(headers.select("doc_id", "base_c", "iva_c", "total_c"), "doc_id", "left")
    own = F.coalesce(F.col("importe_c").isin(F.col("base_c"), F.col("iva_c"), F.col("total_c")), F.lit(False)) & (F.col("importe_c") != 0)
    other = F.max(F.when(own, 0).otherwise(1)).over(Window.partitionBy("doc_id"))
    return joined.withColumn("otro", other).where("otro = 1").select(*items.columns)


def find_items(docs: DataFrame, headers: DataFrame, text_col: str = "texto") -> DataFrame:
    """(doc_id, orden, codigo, nombre, importe_c, origen) of each document's items, by the first way that adds up.

    docs has (doc_id, text), headers (doc_id, base_c, iva_c, total_c). Ways, in order: names with codes priced by their blocks or
    by a column of as many prices (the one whose sum is the total, else the base; it may touch another column); names with an index of their own likewise;
    names with amounts beside or below them, without those that are only the header's. Where no sum fits, names with codes
    or an index come without amounts. Documents without any have no rows; null texts are empty. A document is worked off whole, in one pass
    over its lines (`itemtext`); texts and headers in one table (the same DataFrame for both) need no join.
    """
    from . import itemtext
    ship(docs.sparkSession)
    if headers is not docs:
        docs = docs.select("doc_id", text_col).join(headers.select("doc_id", "base_c", "iva_c", "total_c"), "doc_id", "left")
    found = itemtext.found_items(F.col(text_col), F.col("base_c"), F.col("iva_c"), F.col("total_c"))
    return docs.where("doc_id is not null").select("doc_id", F.explode(found).alias("i")).select("doc_id", "i.*")


def priced_codes(docs: DataFrame, text_col: str = "texto") -> DataFrame:
    """(doc_id, orden, codigo, nombre, importe_c, iva_tipo): `reference_pairs` and `block_prices` of all lines of the texts, in one pass."""
    from . import itemtext
    ship(docs.sparkSession)
    return docs.where("doc_id is not null").select("doc_id", F.explode(itemtext.block_items(F.col(text_col))).alias("i")).select("doc_id", "i.*")


def with_base_and_vat(found: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc_id, orden, codigo, nombre, base_c, iva_c, importe_c, origen) of `find_items`: amounts hold VAT unless they sum to the header's base.

    headers also has iva_tipo; without one, or for items without amounts, base and VAT are null. What rounding leaves over goes to a document's last item.
    """
    from .extract import breakdown
    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("orden", "codigo", "nombre", "importe_c", "origen"))).alias("x"), F.sum("importe_c").alias("s"), F.count_if(F.col("importe_c").isNull()).alias("sin"))
    j = rows.join(headers.select("doc_id", "base_c", "total_c", "iva_tipo"), "doc_id", "left")
    included = F.coalesce(F.abs(F.col("s") - F.col("total_c")) <= LINE_TOLERANCE, F.lit(True))
    parts = F.when((F.col("sin") == 0) & F.col("iva_tipo").isNotNull(), breakdown(F.transform("x", lambda i: i["importe_c"]), F.col("iva_tipo"), included))
    return (j.select("doc_id", F.posexplode("x").alias("p", "i"), parts.alias("b")).select("doc_id", "i.*", F.get("b", F.col("p")).alias("y"))
            .select("doc_id", "orden", "codigo", "nombre", F.col("y.base").alias("base_c"), F.col("y.iva").alias("iva_c"), F.coalesce("y.importe", "importe_c").alias("importe_c"), "origen"))


def parse(docs: DataFrame, text_col: str = "texto") -> tuple[DataFrame, DataFrame]:
    """(headers, items) of texts (doc_id, text): the header's fields, and its items with base and VAT."""
    from .extract import header
    headers = header(docs, text_col)
    return headers, with_base_and_vat(find_items(docs, headers, text_col), headers)


def render(lineas: DataFrame, layout: str) -> DataFrame:
    """Texts of the items of each entry, in one of four layouts: blocks (name, code, prices), columns (names and codes, then a column of prices), glued (the same with a column of quantities right above the prices and no head) or beside (name and price on a line)."""
    euro = money.spelled
    name = F.concat(F.lit("Articulo "), F.translate(F.col("posicion").cast("string"), "0123456789", "abcdefghij"))
    total = F.col("base_c") + F.col("iva_c")
    part = {"blocks": F.concat_ws("\n", name, "codigo", F.lit("UNID."), euro(F.col("base_c")), euro(total)),
            "columns": F.concat_ws("\n", F.col("posicion").cast("string"), name, "codigo"), "glued": F.concat_ws("\n", F.col("posicion").cast("string"), name, "codigo"), "beside": F.concat(name, F.lit("   "), euro(total))}[layout]
    own = [euro(total).alias("e")] if layout in ("columns", "glued") else []
    docs = (lineas.groupBy("asiento_id").agg(F.sort_array(F.collect_list(F.struct("posicion", part.alias("t"), *own))).alias("x"), F.sum(total).alias("total_c"), F.sum("base_c").alias("base_c")))
    foot = F.concat(F.lit("Total SI (EUR)\n"), euro(F.col("base_c")), F.lit("\nTotal TTI (EUR)\n"), euro(F.col("total_c")))
    body = F.array_join(F.transform("x", lambda y: y["t"]), "\n")
    prices = F.concat(F.lit("\nImporte\nTTI (EUR)\n"), F.array_join(F.transform("x", lambda y: y["e"]), "\n")) if layout == "columns" else F.lit("")
    if layout == "glued":
        prices = F.concat(F.lit("\n"), F.array_join(F.concat(F.transform("x", lambda y: F.lit("1,00")), F.transform("x", lambda y: y["e"])), "\n"))
    return docs.select(F.col("asiento_id").alias("doc_id"), F.concat(F.lit("Designacion y Referencia articulo\n"), body, prices, F.lit("\n"), foot).alias("texto"), "base_c", (F.col("total_c") - F.col("base_c")).alias("iva_c"), "total_c")
