"""A batch of files, stage by stage, into a versioned ledger: every file ends as an entry, as evidence of one, as a copy, or as an error with its stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import nif, text
from ..session import checkpoint, numbered
from ..sources.snapshots import Snapshots
from . import entry, extract, items, matching, reports, rules

#: Fields of a reading, as kept in JSON beside the document.
EXTRACT = "numero string, numero_norm string, fecha date, emisor string, nif_emisor string, nif_receptor string, base_c bigint, iva_c bigint, total_c bigint, iva_tipo double, pagina int, paginas int, confianza_m int"
_FIELDS = [f.split()[0] for f in EXTRACT.split(", ")]
_ENTRY = ("id bigint, actividad_id bigint, inmueble_id bigint, documento_id bigint, factura_id bigint, tipo string, cuenta_codigo string, fecha date, ejercicio bigint, emisor string, nif_emisor string, numero_factura string, descripcion string, base_c bigint, iva_tipo double, iva_c bigint, "
          "total_c bigint, estado string, conf_clase_m bigint, conf_ocr_m bigint, validado boolean, motivo_rechazo string, duplicado_de_id bigint, duplicado_nivel bigint")


def to_json(df: DataFrame) -> Column:
    """The reading of a row as JSON; empty fields are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in _FIELDS if c in df.columns]))


def from_json(c: Column) -> Column:
    """The reading in a JSON text; a text that isn't one gives empty fields."""
    return F.from_json(c, EXTRACT)


def plain_text(content: Column) -> Column:
    """Struct (texto, error) of a file's bytes as UTF-8 text. The simplest reader; others have the same result."""
    t = F.try_validate_utf8(content.cast("string"))
    return F.struct(t.alias("texto"), F.when(content.isNull(), "no se puede leer").when(t.isNull(), "no es UTF-8").alias("error"))


def default_property(properties: DataFrame) -> DataFrame:
    """(actividad_id, inmueble_id): the first property of each case file by id; properties has (id, actividad_id)."""
    return properties.groupBy("actividad_id").agg(F.min("id").alias("inmueble_id"))


def rescued(errors: DataFrame, prefixes: list[str]) -> DataFrame:
    """(nombre, sha256, content) of quarantined files whose hash begins with one of the prefixes, for another batch."""
    hit = F.exists(F.array(*[F.lit(p.lower()) for p in prefixes]), lambda p: F.startswith("sha256", p)) if prefixes else F.lit(False)
    return errors.where(hit).groupBy("sha256").agg(F.min_by("nombre", "lote").alias("nombre"), F.first("content").alias("content")).select("nombre", "sha256", "content")


def _old(store: Snapshots, version: int, name: str, columns: str) -> DataFrame:
    known = store.read(name, version)
    return store.spark.createDataFrame([], columns) if known is None else known


def run(store: Snapshots, files: DataFrame, actividad_id: int, accounts: DataFrame, regime: str = schema.CI, learned: DataFrame | None = None, properties: DataFrame | None = None, reader: Callable[[Column], Column] = plain_text) -> str:
    """Take in a batch of files (nombre, content), in order of names, and return the batch's name, which follows from its files.

    Stages: hash (a file that is there already, or earlier in the batch, is a copy), read, parse, resolve (a document of an invoice with an entry
    is its evidence; one with only incompatible totals is a conflict), search for duplicates, classify, keep. What fails to be read goes to `errores` with
    its stage and bytes, and the rest is taken in all the same; a file that failed before may come again. All tables change in one commit. The
    same batch again, also after a commit whose answer was lost, changes nothing.

    Tables: documentos, extracciones, asientos, lineas, relaciones, errores, ubicaciones (where each file belongs), resultados (a row for each file).
    """
    spark, version = store.spark, store.version()
    named = checkpoint(files.select("nombre", "content", F.sha2(F.coalesce("content", F.lit("").cast("binary")), 256).alias("sha256")))
    batch = named.agg(F.count("*").alias("n"), F.sum(F.crc32(F.concat("nombre", "sha256").cast("binary"))).alias("c"), F.bit_xor(F.xxhash64("nombre", "sha256")).alias("x")).first()
    batch = f"{actividad_id}-{batch['n']}-{batch['c'] or 0:x}-{(batch['x'] or 0) % 2**64:016x}"
    if batch in store.state(version)["batches"]:
        return batch
    docs0 = _old(store, version, "documentos", "id bigint, sha256 string, nombre string, texto string, json string, confianza_m int, actividad_id bigint")
    read0 = _old(store, version, "extracciones", f"documento_id bigint, actividad_id bigint, {EXTRACT}, emisor_norm string")
    entries0 = _old(store, version, "asientos", _ENTRY)
    edges0 = _old(store, version, "relaciones", "origen_tipo string, origen_id bigint, destino_tipo string, destino_id bigint, tipo string")

    # hash and read
    first = named.groupBy("sha256").agg(F.min("nombre").alias("primero")).join(docs0.select("sha256", F.col("id").alias("ya")), "sha256", "left")
    f = named.join(first, "sha256").withColumn("l", reader(F.col("content")))
    f = f.withColumn("copia", F.col("ya").isNotNull() | (F.col("nombre") != F.col("primero"))).select("nombre", "sha256", "content", "copia", "l.texto", "l.error")
    f = checkpoint(f)
    bad = f.where("error is not null").select("sha256", "nombre", F.lit("leer").alias("etapa"), "error", "content", F.lit(batch).alias("lote"))
    top = max(docs0.agg(F.max("id")).first()[0] or 0, entries0.agg(F.max("id")).first()[0] or 0)
    good = numbered(f.where("error is null and not copia").select("nombre", "sha256", "texto"), "n", "nombre", "sha256").withColumn("id", F.col("n") + top).drop("n")

    # parse
    parsed = checkpoint(extract.header(good).withColumn("actividad_id", F.lit(actividad_id).cast("bigint")).withColumn("emisor_norm", text.normalize_issuer(F.col("emisor"))).withColumn("confianza_m", F.col("confianza_m").cast("int")))
    docs = parsed.select("id", "sha256", "nombre", "texto", to_json(parsed).alias("json"), "confianza_m", "actividad_id")
    read = parsed.select(F.col("id").alias("documento_id"), "actividad_id", *_FIELDS, "emisor_norm")

    # resolve, with the earlier documents of the same numbers before the new ones
    seen = read0.join(read.select("actividad_id", "numero_norm").where("numero_norm is not null").distinct(), ["actividad_id", "numero_norm"], "left_semi")
    to_doc = lambda df: df.select(F.col("documento_id").alias("id"), "actividad_id", F.col("numero_norm").alias("numero"), F.nullif(nif.normalize(F.col("nif_emisor")), F.lit("")).alias("nif"), "emisor_norm", "total_c", "pagina")
    found = matching.cluster(to_doc(seen).unionByName(to_doc(read)))
    found = checkpoint(found.join(read.select(F.col("documento_id").alias("doc_id")), "doc_id", "left_semi"))
    fresh = parsed.join(found.where("doc_id = factura_id").select(F.col("doc_id").alias("id"), "estado_er"), "id")
    edges = found.select(F.lit("documento").alias("origen_tipo"), F.col("doc_id").alias("origen_id"), F.lit("factura").alias("destino_tipo"), F.col("factura_id").alias("destino_id"), F.col("relacion").alias("tipo"))

    # classify, search for duplicates, state
    blob = F.lower(F.concat_ws(" ", "emisor", "numero", "texto"))
    none = spark.createDataFrame([], "regla_id long, actividad_id long, nif_emisor string, patron string, cuenta_codigo string")
    kind = rules.classify(fresh.select("id", "actividad_id", F.nullif(nif.normalize(F.col("nif_emisor")), F.lit("")).alias("nif"), blob.alias("blob"), F.lit(regime == schema.CI).alias("propiedad")), none if learned is None else learned, accounts)
    homes = default_property(spark.createDataFrame([], "id bigint, actividad_id bigint") if properties is None else properties)
    fresh = checkpoint(fresh.join(kind.select("id", "cuenta", F.col("confianza_m").alias("conf_clase_m"), "tipo"), "id").join(homes, "actividad_id", "left"))
    new = fresh.select("id", "actividad_id", "inmueble_id", F.col("id").alias("documento_id"), F.col("id").alias("factura_id"), "tipo", F.col("cuenta").alias("cuenta_codigo"), "fecha", F.year("fecha").cast("bigint").alias("ejercicio"), "emisor", "nif_emisor",
                       F.col("numero").alias("numero_factura"), entry.description(F.col("emisor"), F.col("numero"), F.col("nombre")).alias("descripcion"), "base_c", "iva_tipo", "iva_c", "total_c", F.lit("pendiente").alias("estado"), F.col("conf_clase_m").cast("bigint").alias("conf_clase_m"),
                       F.col("confianza_m").cast("bigint").alias("conf_ocr_m"), F.lit(False).alias("validado"), F.lit(None).cast("string").alias("motivo_rechazo"), F.lit(None).cast("bigint").alias("duplicado_de_id"), F.lit(None).cast("bigint").alias("duplicado_nivel"))
    hits = matching.cascade(entries0.unionByName(new)).join(new.select("id"), "id", "left_semi")
    state = matching.state_from_hit(new, hits).join(fresh.select("id", "estado_er"), "id")
    apart = F.col("estado_er") == "conflicto"
    state = state.select(F.col("id").alias("sid"), F.when(apart, "pendiente").otherwise(F.col("estado_nuevo")).alias("e_"), F.when(~apart, F.col("apunta_a")).alias("d_"), F.when(~apart, F.col("nivel")).alias("n_"))
    new = new.join(state, F.col("id") == F.col("sid")).withColumns({"estado": F.col("e_"), "duplicado_de_id": F.col("d_"), "duplicado_nivel": F.col("n_").cast("bigint")}).drop("sid", "e_", "d_", "n_")
    new = checkpoint(new)
    texts = parsed.join(new.select("id"), "id", "left_semi").withColumnRenamed("id", "doc_id")
    lines = items.with_base_and_vat(items.find_items(texts, texts), texts)
    lines = lines.select(F.col("doc_id").alias("asiento_id"), F.col("orden").cast("bigint").alias("posicion"), "codigo", F.col("nombre").alias("descripcion"), "base_c", "iva_c", "importe_c")

    # where files belong, and what became of each
    places = reports.archive_paths(new).join(good.select("id", "nombre", "sha256"), "id").select("sha256", "nombre", F.concat_ws("/", F.lit("archivo"), "ruta", F.concat_ws("_", F.substring("sha256", 1, 12), "nombre")).alias("destino"))
    results = (f.where("error is not null").select("nombre", "sha256", F.lit("error").alias("resultado"), F.lit(None).cast("bigint").alias("id"))
               .union(f.where("error is null and copia").select("nombre", "sha256", F.lit("copia"), F.lit(None).cast("bigint")))
               .union(good.join(found.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") == F.col("factura_id"), "asiento").otherwise("evidencia").alias("resultado")), "id").select("nombre", "sha256", "resultado", "id")))
    grow = lambda name, df, columns: _old(store, version, name, columns).unionByName(df) if store.state(version)["tables"].get(name) else df
    mended = good.select("sha256")
    errors = grow("errores", bad, "")
    tables = {"documentos": grow("documentos", docs, ""), "extracciones": grow("extracciones", read, ""), "asientos": grow("asientos", new, ""), "lineas": grow("lineas", lines, ""), "relaciones": edges0.unionByName(edges),
              "errores": errors.join(mended, "sha256", "left_anti"), "ubicaciones": grow("ubicaciones", places, ""), "resultados": grow("resultados", results.withColumn("lote", F.lit(batch)), "")}
    if store.version() != version:
        raise RuntimeError("the ledger changed meanwhile; run the batch again")
    store.commit(tables, batch)
    return batch
