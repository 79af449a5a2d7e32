"""Evaluation of text readers and consensus of two of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, nif, text
from ..session import checkpoint

FIELDS = ("emisor", "nif_emisor", "nif_receptor", "numero", "fecha", "base", "iva_cuota", "total")
MONEY = ("base", "iva_cuota", "total")
CRITICAL = ("nif_emisor", "numero", "fecha", "total")


def token_scores(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """(case_id, n, hits, exact, recall_m): how many of a case's tokens its text has, also by similarity. A case without tokens scores 1."""
    j = texts.join(tokens, "case_id", "left").withColumn("s", F.when(F.col("token").isNotNull(), text.token_in_text(F.col("token"), F.col("text"))))
    got = j.groupBy("case_id").agg(F.count("token").alias("n"), F.count_if("s.hit").alias("hits"), F.count_if(F.col("s.hit") & ~F.col("s.fuzzy")).alias("exact"))
    return got.withColumn("recall_m", F.when(F.col("n") == 0, F.lit(1000)).otherwise(F.floor(F.col("hits") * 1000 / F.col("n"))).cast("bigint"))


def _agree(field: str, a: Column, b: Column) -> Column:
    """Whether two readings of the named field agree: amounts to a cent, ids normalised, numbers equal or one in the other, issuers by similarity of at least 0.72."""
    if field in MONEY or field == "iva_tipo":
        fits = F.abs(a.try_cast("double") - b.try_cast("double")) <= 0.0100001
    elif field in ("nif_emisor", "nif_receptor"):
        fits = (a == b) | (nif.normalize(a) == nif.normalize(b))
    elif field == "numero":
        na, nb = text.normalize_number(a), text.normalize_number(b)
        fits = (na == nb) | F.contains(na, nb) | F.contains(nb, na)
    elif field == "emisor":
        fits = (a == b) | (text.similarity(text.compact(a), text.compact(b)) >= 0.72)
    else:
        fits = F.trim(a) == F.trim(b)
    return F.coalesce(fits, F.lit(False))


def field_equal(field: Column, a: Column, b: Column) -> Column:
    """Whether two readings of a field agree, by the field's kind."""
    return (F.when(field.isin(*MONEY, "iva_tipo"), _agree("total", a, b)).when(field.isin("nif_emisor", "nif_receptor"), _agree("nif_emisor", a, b))
            .when(field == "numero", _agree("numero", a, b)).when(field == "emisor", _agree("emisor", a, b)).otherwise(_agree("fecha", a, b)))


def field_scores(gold: DataFrame, read: DataFrame) -> DataFrame:
    """(case_id, n, correctos, acierto_m) of parsed fields against gold ones, both long (case_id, campo, valor). Without gold fields 1."""
    j = gold.select("case_id", "campo", F.col("valor").alias("g")).join(read.select("case_id", "campo", F.col("valor").alias("r")), ["case_id", "campo"], "left")
    ok = field_equal(F.col("campo"), F.col("g"), F.col("r"))
    out = j.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("correctos"))
    return out.withColumn("acierto_m", F.floor(F.col("correctos") * 1000 / F.col("n")).cast("bigint"))


def engine_summary(runs: DataFrame) -> DataFrame:
    """Per engine: runs by status, mean scores over good runs and zeros for errors, and mean and median time of good runs."""
    ok, counted = F.col("estado") == "ok", F.col("estado").isin("ok", "error")
    mean = lambda c: F.round(F.avg(F.when(counted, F.when(ok, F.col(c)).otherwise(0.0))), 4)
    return runs.groupBy("motor").agg(F.count_if(ok).alias("n_ok"), F.count_if(F.col("estado") == "skipped").alias("n_saltados"), F.count_if(F.col("estado") == "error").alias("n_error"),
                                     mean("campos").alias("campos"), mean("tokens").alias("tokens"), mean("parser").alias("parser"),
                                     F.median(F.when(ok, F.col("ms"))).cast("int").alias("ms_mediana"), F.avg(F.when(ok, F.col("ms"))).cast("int").alias("ms_media"))


def engine_ranking(summary: DataFrame) -> DataFrame:
    """Engines with counted runs, best first: fields, tokens, parser, then the shorter median time. One row an engine."""
    rows = summary.where(F.col("n_ok") + F.col("n_error") > 0)
    by = Window.orderBy(F.col("campos").desc(), F.col("tokens").desc(), F.col("parser").desc(), F.col("ms_mediana").asc_nulls_last(), "motor")
    return rows.withColumn("puesto", F.row_number().over(by)).select("motor", "puesto")


def run_matrix(cases: DataFrame, engines: DataFrame, runs: DataFrame) -> DataFrame:
    """Every case with every engine (a fixed list of a few): unavailable, skipped (a text-layer reader on pictures), error, or ok."""
    j = cases.crossJoin(F.broadcast(engines)).join(runs, ["case_id", "motor"], "left")
    status = (F.when(~F.col("disponible"), "unavailable").when((F.col("motor") == "native") & F.col("kind").isin("photo", "raster"), "skipped").when(F.col("texto").isNull(), "error").otherwise("ok"))
    return j.withColumn("estado", status)


def unpivot(reads: DataFrame) -> DataFrame:
    """Long form (doc_id, campo, valor) of the compared fields."""
    return reads.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("valor")) for c in FIELDS])).alias("f")).select("doc_id", "f.*")


def votes(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, campo, uno, dos, estado, consenso): two readers' fields met. Agreement takes the longer spelling (a tie the first); a conflict is not
    averaged but decided where it can be: the valid id, the longer number, or the amount that stands in both readers' texts (column texto, where
    both have it) if the other doesn't; else it stays open.

    The readings meet once, a row a document; only then do fields become rows."""
    told = "texto" in first.columns and "texto" in second.columns
    keep = ["doc_id", *FIELDS, *([money.all_amounts(F.coalesce("texto", F.lit(""))).alias("en_texto")] if told else [])]
    one, two = first.select(*keep).alias("x"), second.select(*keep).alias("y")
    met = one.join(two, F.col("x.doc_id") == F.col("y.doc_id"), "full_outer")
    of = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit(""))
    here = lambda v: F.coalesce(F.array_contains("en_x", money.parse_amount(v)) & F.array_contains("en_y", money.parse_amount(v)), F.lit(False))

    def state(c: str) -> Column:
        x, y = F.col(f"{c}_x"), F.col(f"{c}_y")
        return F.when((x == "") & (y == ""), "vacio").when(y == "", "solo_uno").when(x == "", "solo_dos").when(_agree(c, x, y), "acuerdo").otherwise("conflicto")

    def tie(c: str, x: Column, y: Column) -> Column:
        if c in ("nif_emisor", "nif_receptor"):
            return F.when(nif.is_valid(x) & ~nif.is_valid(y), x).when(nif.is_valid(y) & ~nif.is_valid(x), y).otherwise("")
        if c == "numero":
            nx, ny = F.length(text.compact(x)), F.length(text.compact(y))
            return F.when(nx > ny, x).when(ny > nx, y).otherwise("")
        return F.when(here(x) & ~here(y), x).when(here(y) & ~here(x), y).otherwise("") if told and c in MONEY else F.lit("")

    def field(c: str) -> Column:
        x, y, s = F.col(f"{c}_x"), F.col(f"{c}_y"), F.col(f"{c}_s")
        out = F.when(s == "acuerdo", F.when(F.length(y) > F.length(x), y).otherwise(x)).when(s == "solo_uno", x).when(s == "solo_dos", y).when(s == "conflicto", tie(c, x, y)).otherwise("")
        return F.struct(F.lit(c).alias("campo"), x.alias("uno"), y.alias("dos"), s.alias("estado"), out.alias("consenso"))

    # a field's test is its own, so no row passes those of the others
    j = met.select(F.coalesce("x.doc_id", "y.doc_id").alias("doc_id"), *([F.col(f"{t}.en_texto").alias(f"en_{t}") for t in "xy"] if told else []), *[of(t, c).alias(f"{c}_{t}") for c in FIELDS for t in "xy"])
    j = j.withColumns({f"{c}_s": state(c) for c in FIELDS})
    return j.select("doc_id", F.explode(F.array(*map(field, FIELDS))).alias("f")).select("doc_id", "f.*")


def _recommended() -> list[Column]:
    n = lambda *s: F.count_if(F.col("estado").isin(*s))
    open_ = F.col("estado") == "conflicto"
    crit = F.col("campo").isin(*CRITICAL)
    return [n("acuerdo").alias("acuerdos"), n("conflicto").alias("conflictos"), n("vacio", "solo_uno", "solo_dos").alias("huecos"),
            F.when(F.bool_or(crit & open_), "revisar").when(F.bool_or(open_ | (crit & (F.col("estado") == "vacio"))), "revisar_menor").otherwise("consenso").alias("recomendacion")]


def recommendation(v: DataFrame) -> DataFrame:
    """Per document: to be checked if a critical field is open, checked lightly if another is, else the consensus; and the counts of states."""
    return v.groupBy("doc_id").agg(*_recommended())


def wide(v: DataFrame) -> DataFrame:
    """Consensus of the critical fields, one row a document."""
    return v.groupBy("doc_id").pivot("campo", list(CRITICAL)).agg(F.max("consenso"))


def field_in_text(field: Column, gold: Column, read: Column) -> Column:
    """Whether a reader's raw text holds a gold field: ids and numbers without signs between their characters; dates (ISO) in any of five
    spellings, amounts with a comma or a point, others as tokens. Null gold is not held, null text holds nothing."""
    squeezed = F.contains(text.compact(read), text.compact(gold)) & (text.compact(gold) != "")
    y, m, d = (F.get(F.split(gold, "-"), F.lit(i)) for i in range(3))
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    dates = [F.concat_ws("/", d, m, y), F.concat_ws("/", bare(d), bare(m), y), F.concat_ws("-", d, m, y), F.concat_ws(".", d, m, y), gold]
    amounts = [F.replace(gold, F.lit("."), F.lit(",")), F.replace(gold, F.lit(","), F.lit("."))]
    held = lambda spellings: reduce(lambda a, b: a | b, [text.token_in_text(x, read)["hit"] for x in spellings])
    found = F.when(F.startswith(field, F.lit("nif_")) | (field == "numero"), squeezed).when(field == "fecha", held(dates)).when(field.isin(*MONEY), held(amounts)).otherwise(text.token_in_text(gold, read)["hit"])
    return F.when(gold.isNull(), F.lit(False)).otherwise(F.coalesce(found, F.lit(False)))


def raw_recall(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """(case_id, n, leidos, recall_m): how many of a case's gold fields (case_id, campo, valor) its raw text (case_id, text) holds. A case without text has none."""
    j = gold.join(texts.select("case_id", "text"), "case_id", "left").withColumn("ok", field_in_text(F.col("campo"), F.col("valor"), F.col("text")))
    out = j.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("leidos"))
    return out.withColumn("recall_m", F.floor(F.col("leidos") * 1000 / F.col("n")).cast("bigint"))


def engine_status(runs: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """(motor, disponible, motivo) of all known engines, by their runs (motor, estado, motivo): an engine without runs, or with none but unavailable ones, isn't there."""
    names = runs.sparkSession.createDataFrame([(k,) for k in known], "motor string")
    got = runs.groupBy(F.col("motor").alias("m")).agg(F.bool_or(F.col("estado") != "unavailable").alias("d"), F.min(F.when(F.col("estado") == "unavailable", F.col("motivo"))).alias("r"))
    j = names.join(got, F.col("motor") == F.col("m"), "left")
    ok = F.coalesce("d", F.lit(False))
    return j.select("motor", ok.alias("disponible"), F.when(~ok, F.coalesce("r", F.lit("sin ejecuciones"))).alias("motivo"))


#: Characters of a reading's text that its sheet shows.
SHOWN = 2500


def dual_summary(v: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Recommendation, counts, consensus of the critical fields and times of each document of the votes, in one aggregation."""
    time = lambda df, name: df.select(F.col("doc_id").alias(f"{name}_d"), F.col("ms").alias(f"{name}_ms"), F.col("texto").isNotNull().alias(f"{name}_ok"))
    critical = [F.max(F.when(F.col("campo") == c, F.col("consenso"))).alias(c) for c in CRITICAL]
    top = v.where("doc_id is not null").groupBy("doc_id").agg(*_recommended(), *critical)
    return top.join(time(first, "uno"), F.col("doc_id") == F.col("uno_d"), "left").join(time(second, "dos"), F.col("doc_id") == F.col("dos_d"), "left").drop("uno_d", "dos_d")


def dual_differences(v: DataFrame) -> DataFrame:
    return v.where("estado != 'acuerdo'")


def dual_texts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both readings, cut for show."""
    read = first.select("doc_id", "motor", "ms", "texto").unionByName(second.select("doc_id", "motor", "ms", "texto"))
    return read.select("doc_id", "motor", "ms", F.length(F.coalesce("texto", F.lit(""))).alias("caracteres"), F.substring(F.coalesce("texto", F.lit("")), 1, SHOWN).alias("texto"))


def dual_sheets(first: DataFrame, second: DataFrame) -> dict[str, DataFrame]:
    """The sheets of an audit of two readers, by name; both have (doc_id, the compared fields, texto, motor, ms).

    Resumen: recommendation, counts, consensus of the critical fields, times. Campos: all votes. Discrepancias: those that aren't agreed on.
    Textos_OCR: both readings, cut for show.
    """
    v = checkpoint(votes(first, second))
    return {"Resumen": dual_summary(v, first, second), "Campos": v, "Discrepancias": dual_differences(v), "Textos_OCR": dual_texts(first, second)}
