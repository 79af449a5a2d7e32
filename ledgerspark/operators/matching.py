"""Duplicate detection, record linkage and entity resolution over entries.

Every search is an equi-join (or a union of them) on keys, with what remains as a residual condition; an OR of
keys is never written as one join, since that would compare all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce
from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import nif, text
from ..session import checkpoint, stored


def keyed(entries: DataFrame) -> DataFrame:
    """Entries with the keys that searches join on. Cents of the fiscal key are exact, ids are compared normalised."""
    return entries.select("id", "actividad_id", "factura_id", "estado", "fecha", "total_c", "emisor", F.nullif(nif.normalize(F.col("nif_emisor")), F.lit("")).alias("nif"),
                          text.normalize_number(F.col("numero_factura")).alias("numero"), text.normalize_issuer(F.col("emisor")).alias("emisor_norm"))


def _pairs(rows: DataFrame, keys: list[str], residual: Column | None = None, earlier_state: Column | None = None) -> DataFrame:
    """(id, otro_id) of entries that share all keys (no null), the other one being earlier.

    Keys of many rows (say a placeholder number) spread by AQE's skew handling; the residual is checked inside the join."""
    known = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    a, b = known.alias("a"), (known if earlier_state is None else known.where(earlier_state)).alias("b")
    cond = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]) & (F.col("b.id") < F.col("a.id"))
    if residual is not None:
        cond = cond & residual
    return a.join(b, cond).select(F.col("a.id").alias("id"), F.col("b.id").alias("otro_id"))


def near(days: int = 3) -> Column:
    return F.abs(F.datediff("a.fecha", "b.fecha")) <= days


def with_blocks(rows: DataFrame, days: int = 3) -> DataFrame:
    """Rows with a block of days+1 dates, so that an interval match is an equi-join on neighbouring blocks."""
    return rows.withColumn("bloque", F.floor(F.datediff("fecha", F.lit("1970-01-01").cast("date")) / (days + 1)).cast("int"))


def interval_pairs(rows: DataFrame, keys: list[str], days: int = 3, earlier_state: Column | None = None) -> DataFrame:
    """(id, otro_id) of entries that share all keys with dates at most `days` apart. One side is repeated for the neighbouring blocks."""
    known = with_blocks(rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, "fecha"]])), days)
    a = known.withColumn("bloque", F.explode(F.array(F.col("bloque") - 1, F.col("bloque"), F.col("bloque") + 1))).alias("a")
    b = (known if earlier_state is None else known.where(earlier_state)).alias("b")
    cond = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "bloque"]]) & (F.col("b.id") < F.col("a.id")) & near(days)
    return a.join(b, cond).select(F.col("a.id").alias("id"), F.col("b.id").alias("otro_id"))


def fiscal_duplicates(entries: DataFrame) -> DataFrame:
    """Level 2: same case file, id, number, date and total; rejected entries are no originals."""
    return _pairs(keyed(entries), ["actividad_id", "nif", "numero", "fecha", "total_c"], F.col("b.estado") != "rechazado")


def number_duplicates(entries: DataFrame) -> DataFrame:
    """Level 2: same number of at least 4 characters, date and total."""
    return _pairs(keyed(entries), ["actividad_id", "numero", "fecha", "total_c"], (F.col("b.estado") != "rechazado") & (F.length("a.numero") >= 4))


def id_window_duplicates(entries: DataFrame, days: int = 3) -> DataFrame:
    """Level 3: same id and total some days apart, in any state."""
    return interval_pairs(keyed(entries), ["actividad_id", "nif", "total_c"], days)


def issuer_window_duplicates(entries: DataFrame, days: int = 3) -> DataFrame:
    """Level 3: same issuer key and total some days apart, in any state."""
    return interval_pairs(keyed(entries), ["actividad_id", "emisor_norm", "total_c"], days)


def perceptual_pairs(hashes: DataFrame, most: int = 10, bits: int = 64, bands: int = 11) -> DataFrame:
    """(id, otro_id, distancia) of 64-bit hashes at most `most` bits apart; hashes has (id, h).

    With one band more than differing bits allowed, at least one band is equal: an equi-join on bands finds all pairs. A
    band's bucket is only as large as its bits are common, so equal hashes should be collapsed before."""
    edges = [round(i * bits / bands) for i in range(bands + 1)]
    keys = []
    for i, (x, y) in enumerate(zip(edges, edges[1:])):
        mask = ((1 << (y - x)) - 1) << x
        keys.append(F.struct(F.lit(i).alias("banda"), F.col("h").bitwiseAND(F.lit(mask - 2**64 if mask >= 2**63 else mask)).alias("v")))
    rows = hashes.select("id", "h", F.explode(F.array(*keys)).alias("k"))
    a, b = rows.alias("a"), rows.alias("b")
    d = text.hamming64(F.col("a.h"), F.col("b.h"))
    return (a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("b.id") < F.col("a.id")) & (d <= most))
            .select(F.col("a.id").alias("id"), F.col("b.id").alias("otro_id"), d.alias("distancia")).distinct())


#: Differing bits of 256 that a search for pictures allows at most; then one of the four words differs in two bits at most.
MOST_BITS = 10

#: Pairs of the four chunks of a word, each of every fourth bit, so that bits that are often alike side by side fall into different ones.
CHUNK_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def _picture_words(hashes: DataFrame) -> DataFrame:
    """(id, w0, w1, w2, w3) of the rows with a hash, 64 hexadecimal digits, as four longs; stored, so each hash is computed and read once."""
    known = hashes.select("id", "h").where(F.col("h").rlike("^[0-9a-fA-F]{64}$"))
    return stored(known.select("id", *[F.conv(F.substring("h", 16 * i + 1, 16), 16, -10).cast("bigint").alias(f"w{i}") for i in range(4)]), "hashes")


def _picture_groups(words: DataFrame) -> DataFrame:
    """(g, w0, w1, w2, w3): a row for each different hash, g being the smallest id that has it."""
    return stored(words.groupBy("w0", "w1", "w2", "w3").agg(F.min("id").alias("g")), "pictures")


def _near_groups(groups: DataFrame, most: int) -> DataFrame:
    """(a, b, distancia) of different hashes at most `most` bits apart, by their smallest ids.

    One of the four words differs in two bits at most, so two of its four chunks are equal: hashes meet by 24 keys of 32 bits. A row of the
    join is key, id and the word's other two chunks, which tell whether the word is that near, and whether these are its first equal chunks, so a
    pair comes once a word at most. Only pairs that pass fetch their whole hashes.
    """
    if most > MOST_BITS:
        raise ValueError("so many bits may differ in all pairs of chunks")

    masks = [0x1111111111111111 << c for c in range(4)]
    signed = lambda m: F.lit(m - 2**64 if m >= 2**63 else m)
    keys = []
    for k, (word, (i, j)) in enumerate((w, p) for w in range(4) for p in CHUNK_PAIRS):
        w, mask = F.col(f"w{word}"), masks[i] | masks[j]
        keys.append(F.struct(F.lit(k).alias("k"), w.bitwiseAND(signed(mask)).alias("v"), w.bitwiseAND(signed(mask ^ (2**64 - 1))).alias("rest")))
    each = groups.select("g", F.explode(F.array(*keys)).alias("e")).select("g", "e.*")
    a, b = each.alias("a"), each.alias("b")
    x = F.col("a.rest").bitwiseXOR(F.col("b.rest"))
    # a chunk that isn't in the pair and stands before its second one must differ
    first, pair = F.lit(False), F.least("a.k", "b.k") % len(CHUNK_PAIRS)  # of both sides, so that no filter on one of them keeps the exchange from serving both
    for n, (i, j) in enumerate(CHUNK_PAIRS):
        first = first | reduce(lambda p, c: p & (x.bitwiseAND(signed(masks[c])) != 0), [c for c in range(j) if c != i], pair == n)
    met = (a.join(b, (F.col("a.v") == F.col("b.v")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.g") < F.col("b.g")) & (F.bit_count(x) <= most // 4) & first)
           .select(F.col("a.g").alias("a"), F.col("b.g").alias("b")).distinct())
    own = lambda side: groups.select(F.col("g").alias(side), *[F.col(f"w{i}").alias(f"{side}{i}") for i in range(4)])
    d = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(4)])
    return met.join(own("a"), "a").join(own("b"), "b").select("a", "b", d.alias("distancia")).where(F.col("distancia") <= most)


def picture_pairs(hashes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(a, b, distancia) of different 256-bit hashes at most `most` (10 or less) bits apart, a and b being the smallest ids that have them; hashes has (id, h), h hexadecimal."""
    return _near_groups(_picture_groups(_picture_words(hashes)), most)


def picture_duplicates(hashes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(id, otro_id) of each id whose picture hash is at most `most` bits from an earlier id's: the smallest such id. All ids of equal hashes have one answer, so they are met once."""
    known = _picture_words(hashes)
    groups = _picture_groups(known)
    lowest = _near_groups(groups, most).groupBy(F.col("b").alias("g")).agg(F.min("a").alias("o"))  # a < b: the smaller representative
    best = groups.join(lowest, "g", "left").withColumn("otro_id", F.least("g", F.coalesce("o", "g"))).drop("g", "o")
    return known.join(best, ["w0", "w1", "w2", "w3"]).where("otro_id < id").select("id", "otro_id")


#: The searches of the cascade in their order: level, motive, and the days around a date in which an original is looked for.
SEARCHES = ((2, "clave fiscal", 0), (2, "número, fecha y total", 0), (3, "NIF y total cercanos", 3), (3, "emisor y total cercanos", 3))


def cascade(entries: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """(id, nivel, otro_id, motivo): the first of the searches that finds an original, with the smallest id.

    Only the smallest id of a key (and date) can be an original, so each key and date is one row of an aggregation, which takes the smallest
    id of the dates around; entries look up those that are an original for any: no key gives pairs of its rows. hashes has (id, otro_id) of
    documents whose pictures are alike; that search comes last.
    """
    rows = stored(keyed(entries).select("id", "actividad_id", "estado", "fecha", "total_c", "nif", "numero", "emisor_norm"), "keys")

    def key(p: int, first: str, second: str | None, ok: Column) -> Column:
        """One search's key of an entry and whether the entry can be its original; null if a part is missing."""
        whole = F.struct(F.lit(p).alias("p"), "actividad_id", F.col(first).alias("k1"), (F.col(second) if second else F.lit("")).alias("k2"), "total_c")
        known = reduce(lambda a, c: a & c, [F.col(c).isNotNull() for c in ("actividad_id", first, *([second] if second else []), "fecha", "total_c")])
        return F.when(known, F.struct(whole.alias("k"), F.unix_date("fecha").alias("dia"), F.coalesce(ok, F.lit(False)).alias("ok")))

    valid = F.col("estado") != "rechazado"
    keys = [key(0, "nif", "numero", valid), key(1, "numero", None, valid & (F.length("numero") >= 4)), key(2, "nif", None, F.lit(True)), key(3, "emisor_norm", None, F.lit(True))]
    each = rows.select("id", F.explode(F.filter(F.array(*keys), lambda x: x.isNotNull())).alias("s")).select("id", "s.*")
    days = each.groupBy("k", "dia").agg(F.min(F.when(F.col("ok"), F.col("id"))).alias("primero"), F.max("id").alias("ultimo"))
    around = F.min("primero").over(Window.partitionBy("k").orderBy("dia").rangeBetween(-SEARCHES[2][2], SEARCHES[2][2]))  # over days, so a frame has seven rows at most
    first = days.withColumn("otro_id", F.when(F.col("k.p") < 2, F.col("primero")).otherwise(around)).where("otro_id < ultimo").select("k", "dia", "otro_id")
    hit = each.select("id", "k", "dia").join(first, ["k", "dia"]).where("otro_id < id").select("id", F.struct(F.col("k.p").alias("p"), "otro_id").alias("h"))
    if hashes is not None:
        hit = hit.union(hashes.where("otro_id < id").select("id", F.struct(F.lit(len(SEARCHES)).alias("p"), "otro_id").alias("h")))
    best = hit.groupBy("id").agg(F.min("h").alias("h"))
    names = [*SEARCHES, (3, "imagen parecida", 0)]
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in names]), F.col("h.p") + 1)
    return best.select("id", pick(0).alias("nivel"), "h.otro_id", pick(1).alias("motivo"))


def state_from_hit(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """State of an entry after the search: merged, suspicious, or by its account and confidence."""
    j = entries.join(hits.select(F.col("id").alias("h"), "nivel", "otro_id"), F.col("id") == F.col("h"), "left")
    has = F.col("nivel").isNotNull()
    state = (F.when(has & (F.col("numero_factura").isNull() | (F.col("nivel") <= 2)), "duplicado").when(has, "pendiente")
             .when(F.col("cuenta_codigo").isNotNull() & (F.col("conf_clase_m") >= 800), "confirmado").otherwise("pendiente"))
    return j.select("id", state.alias("estado_nuevo"), F.col("otro_id").alias("apunta_a"), F.col("nivel").cast("int").alias("nivel"))


def twin_candidates(entries: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """(id, otro_id, prioridad) of entries a user may merge: equal total within 3 days and equal id (1), else equal issuer key (2), else pictures alike (3).

    hashes has (id, otro_id) of `picture_duplicates`."""
    rows = keyed(entries).where("estado != 'duplicado'")
    both = interval_pairs(rows, ["actividad_id", "nif", "total_c"]).withColumn("p", F.lit(1)).unionByName(
        interval_pairs(rows, ["actividad_id", "emisor_norm", "total_c"]).withColumn("p", F.lit(2)))
    if hashes is not None:
        free = rows.select("id")
        both = both.unionByName(hashes.join(free, "id").join(free.withColumnRenamed("id", "otro_id"), "otro_id").select("id", "otro_id", F.lit(3).alias("p")))
    return both.groupBy("id", "otro_id").agg(F.min("p").alias("prioridad"))


def hash_duplicates(docs: DataFrame, id_col: str = "doc_id", content: str = "text") -> DataFrame:
    """(id, original_id) of documents whose content has a smaller id; null content is none's copy. Groups meet as partial sums."""
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.col(content).cast("binary"), 256).alias("sha")).where("sha is not null")
    first = rows.groupBy("sha").agg(F.min("id").alias("original_id"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, "sha").where("id != original_id").select("id", "original_id")


# Similarity of names. There is no such function among the built-in ones; batches cross by Arrow.

def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by the common prefix (up to 4) only where it is over 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, first = [False] * len(b), []
    for i, ch in enumerate(a):
        at = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == ch), None)
        if at is not None:
            taken[at] = True
            first.append(ch)
    m = len(first)
    if not m:
        return 0.0
    second = [ch for ch, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(first, second)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler_column(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(p or "", q or "") for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())(a, b)


def block_ratio(a: str, b: str) -> float:
    """Share of two texts' characters that lie in common blocks: the longest one, then those left and right of it."""
    return SequenceMatcher(None, a, b).ratio()


def name_ratio_column(a: Column, b: Column) -> Column:
    """Similarity of clean names by `block_ratio`, as they stand or with their words sorted, whichever is more; null and empty names are like nothing.

    A pair of names that a batch has again is compared once.
    """
    def run(x: pd.Series, y: pd.Series, x_sorted: pd.Series, y_sorted: pd.Series) -> pd.Series:
        known: dict = {}
        for key in zip(x, y, x_sorted, y_sorted):
            if key not in known:
                known[key] = max(block_ratio(key[0], key[1]), block_ratio(key[2], key[3])) if key[0] and key[1] else 0.0
        return pd.Series([known[key] for key in zip(x, y, x_sorted, y_sorted)], dtype="float64")

    def words(c: Column) -> Column:
        return F.array_join(F.array_sort(F.split(c, " ")), " ")

    return F.pandas_udf(run, T.DoubleType())(a, b, words(a), words(b))


def bits(levels: list[tuple[float, float]], conditions: list[Column], null: Column) -> Column:
    """Weight in bits of the first condition that holds, else of the last level; null values weigh nothing."""
    out = F.when(null, F.lit(0.0))
    for (m, u), c in zip(levels, conditions):
        out = out.when(c, F.lit(log2(m / u)))
    return out.otherwise(F.lit(log2(levels[-1][0] / levels[-1][1])))


def probability(weight: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(2.0), -weight))


def band(p: Column) -> Column:
    return F.when(p >= schema.MENTION, "auto").when(p >= schema.REVIEW, "revisar").otherwise("rechazar")


def supplier_score(nif_a: Column, nif_b: Column, similarity: Column, by_hand: bool = False) -> Column:
    """Struct (peso, probabilidad, banda) of two suppliers being one. similarity is that of the clean names.

    by_hand takes round weights instead of those of the level table; both are kept since they differ between 0.70 and 0.95."""
    null = nif_a.isNull() | nif_b.isNull()
    tiers = [similarity >= 0.95, similarity >= 0.85, similarity >= 0.70]
    if by_hand:
        w = (F.lit(-8.0) + F.when(null, 0.0).when(nif_a == nif_b, 18.0).otherwise(-18.0)
             + F.when(tiers[0], 10.0).when(tiers[1], 8.0).when(tiers[2], 5.0).otherwise(-8.0))
    else:
        prior = schema.SUPPLIER_PRIOR
        w = (F.lit(log2(prior / (1 - prior))) + bits(schema.SUPPLIER_LEVELS["nif"], [nif_a == nif_b], null)
             + bits(schema.SUPPLIER_LEVELS["nombre"], tiers, similarity.isNull()))
    p = probability(w)
    return F.struct(w.alias("peso"), p.alias("probabilidad"), band(p).alias("banda"))


def block_pairs(rows: DataFrame, rules: list) -> DataFrame:
    """(a, b) ids, a < b, of rows that agree on all keys of any rule: one equi-join a rule, each pair once.

    A rule is a list of keys, or (keys, condition): then one row of the pair must meet the condition."""
    def pairs(rule):
        keys, only = rule if isinstance(rule, tuple) else (rule, None)
        known = rows.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys]))
        l, r = (known if only is None else known.where(only)).alias("l"), known.alias("r")
        same = reduce(lambda x, y: x & y, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys])
        order = F.col("l.id") < F.col("r.id") if only is None else F.col("l.id") != F.col("r.id")
        return l.join(r, same & order).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))

    return reduce(DataFrame.union, [pairs(k) for k in rules]).distinct()


def supplier_pairs(entries: DataFrame, similar: Callable[[Column, Column], Column] = jaro_winkler_column) -> DataFrame:
    """(id_a, id_b, nif_a, nif_b, jw), jw being the similarity of the names, of different suppliers (tax id and clean name, named by their first entry) that share the id or
    the name's first word."""
    rows = keyed(entries).select("id", "nif", text.clean_name(F.col("emisor")).alias("nombre")).where("nombre != ''")
    known = rows.groupBy("nif", "nombre").agg(F.min("id").alias("id")).withColumn("palabra", F.split("nombre", " ")[0])
    l, r = known.alias("l"), known.alias("r")
    both = block_pairs(known, [["nif"], ["palabra"]]).join(l, F.col("a") == F.col("l.id")).join(r, F.col("b") == F.col("r.id"))
    return both.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.col("l.nif").alias("nif_a"), F.col("r.nif").alias("nif_b"), similar(F.col("l.nombre"), F.col("r.nombre")).alias("jw"))


def invoice_pairs(entries: DataFrame, least: float = schema.MENTION, scope: str | None = "actividad_id", linked: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b, peso, probabilidad, desglose) of live entries that are probably one purchase.

    With the weights of schema.PAIR_LEVELS a pair that shares the id needs its number or its total too, or lacks one of
    them and shares the date or week; without an id or a number in common it needs total and date. So candidates share
    such pairs of keys, or a number. Pairs of one invoice, and those in `linked` (a, b), are left out. Names are compared
    only where the rest leaves the result open."""
    live = entries.where(~F.col("estado").isin(*schema.LIVE_EXCLUDES))
    rows = keyed(live).select("id", "actividad_id", "factura_id", "nif", "numero", "fecha", F.col("total_c").alias("importe"),
                              F.nullif(text.clean_name(F.col("emisor")), F.lit("")).alias("nombre"), text.iso_week(F.col("fecha")).alias("semana"))
    own = [scope] if scope else []
    no_total = F.col("importe").isNull()
    pairs = block_pairs(rows, [[*own, "numero"], [*own, "nif", "importe"], [*own, "importe", "fecha"], ([*own, "nif", "fecha"], no_total | F.col("numero").isNull()),
                               ([*own, "nif"], no_total)])
    if linked is not None:
        pairs = pairs.join(linked, ["a", "b"], "left_anti")
    l, r = rows.alias("l"), rows.alias("r")
    both = pairs.join(l, F.col("a") == F.col("l.id")).join(r, F.col("b") == F.col("r.id")).where(~F.col("l.factura_id").eqNullSafe(F.col("r.factura_id")) | F.col("l.factura_id").isNull())
    same = lambda c: F.col(f"l.{c}") == F.col(f"r.{c}")
    null = lambda c: F.col(f"l.{c}").isNull() | F.col(f"r.{c}").isNull()
    conditions = {"nif": [same("nif")], "numero": [same("numero")], "fecha": [same("fecha"), same("semana")], "importe": [same("importe")]}
    base = log2(schema.PAIR_PRIOR / (1 - schema.PAIR_PRIOR))
    rest = reduce(lambda x, y: x + y, [bits(schema.PAIR_LEVELS[c], cond, null(c)) for c, cond in conditions.items()])
    names = max(log2(m / u) for m, u in schema.PAIR_LEVELS["nombre"])
    both = both.where(probability(F.lit(base + max(names, 0.0)) + rest) >= least)
    both = both.withColumn("jw", jaro_winkler_column(F.col("l.nombre"), F.col("r.nombre")))
    conditions["nombre"] = [F.col("jw") >= 0.95, F.col("jw") >= 0.85]
    parts = {c: bits(schema.PAIR_LEVELS[c], cond, null(c)) for c, cond in conditions.items()}
    both = both.select("a", "b", *[w.alias(c) for c, w in parts.items()])
    w = F.lit(base) + reduce(lambda x, y: x + y, [F.col(c) for c in parts])
    why = F.array(F.struct(F.lit("base").alias("concepto"), F.lit(base).alias("bits")), *[F.struct(F.lit(c).alias("concepto"), F.col(c).alias("bits")) for c in parts])
    return both.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), w.alias("peso"), probability(w).alias("probabilidad"), why.alias("desglose")).where(F.col("probabilidad") >= least)


def apply_scan(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, apunta_a): both sides of each pair get a pointer to the other; the most probable pair decides, then the smallest id."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col("id_a").alias("id"), F.col("id_b").alias("o")), F.struct(F.col("id_b").alias("id"), F.col("id_a").alias("o")))).alias("s"), "probabilidad")
    best = sides.groupBy(F.col("s.id").alias("id")).agg(F.max_by("s.o", F.struct("probabilidad", -F.col("s.o"))).alias("apunta_a"))
    return best.join(entries.where("estado != 'duplicado' and not validado").select("id"), "id")


def canonical_names(entries: DataFrame) -> DataFrame:
    """(actividad_id, nif, canonico, n_formas) of a case file's tax ids spelled in at least two ways: the spelling of the most frequent clean name with
    most lower case letters, then the shortest, then the first by order. One case file's spellings say nothing about another's."""
    rows = entries.where("nif_emisor is not null and emisor is not null").select("actividad_id", nif.normalize(F.col("nif_emisor")).alias("nif"), "emisor").distinct()
    rows = rows.withColumn("limpio", text.clean_name(F.col("emisor")))
    groups = rows.groupBy("actividad_id", "nif", "limpio").agg(F.count("*").alias("n"), F.min(F.struct(-F.length(F.regexp_replace("emisor", r"[^\p{Ll}]", "")), F.length("emisor"), "emisor")).alias("mejor"))
    best = groups.groupBy("actividad_id", "nif").agg(F.min(F.struct(-F.col("n"), "limpio", F.col("mejor.emisor").alias("e"))).alias("g"), F.sum("n").alias("n_formas"))
    return best.where("n_formas > 1").select("actividad_id", "nif", F.col("g.e").alias("canonico"), "n_formas")


# Entity resolution: documents become canonical invoices.

def er_candidates(docs: DataFrame, invoices: DataFrame) -> DataFrame:
    """(doc_id, factura_id) of invoices with the document's case file and number, and its id if both have one, else its issuer key."""
    d, f = keyed(docs).alias("d"), keyed(invoices).alias("f")
    same = F.when(F.col("d.nif").isNotNull() & F.col("f.nif").isNotNull(), F.col("d.nif") == F.col("f.nif")).otherwise(F.col("d.emisor_norm") == F.col("f.emisor_norm"))
    on = (F.col("d.actividad_id") == F.col("f.actividad_id")) & (F.col("d.numero") == F.col("f.numero")) & (F.col("f.id") < F.col("d.id")) & same
    return d.join(f, on).select(F.col("d.id").alias("doc_id"), F.col("f.id").alias("factura_id"))


def totals_compatible(a: Column, b: Column) -> Column:
    """Null is compatible with anything."""
    return F.coalesce(F.abs(a - b) <= schema.HEADER_TOLERANCE, F.lit(True))


ER_SCHEMA = "doc_id long, factura_id long, relacion string, estado_er string"


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """The step itself, document after document: joins the first invoice of its supplier with a compatible total, those not in conflict
    first; with only incompatible ones it opens an invoice and all are in conflict; else it opens one."""
    invoices: list[dict] = []
    out = []
    for r in rows.sort_values("id").to_dict("records"):
        blank = lambda x: x is None or x != x
        mine = [i for i in invoices if (i["nif"] == r["nif"] if not blank(i["nif"]) and not blank(r["nif"]) else i["emisor"] == r["emisor_norm"])]
        fits = [i for i in mine if blank(i["total"]) or blank(r["total_c"]) or abs(i["total"] - r["total_c"]) <= schema.HEADER_TOLERANCE]
        fits.sort(key=lambda i: (i["estado"] == "conflicto", i["id"]))
        if fits:
            hit = fits[0]
            for k, c in (("nif", "nif"), ("total", "total_c")):
                if blank(hit[k]):
                    hit[k] = r[c]
            out.append((r["id"], hit, "continuacion" if (r["pagina"] or 1) > 1 else "evidencia"))
            continue
        new = {"id": r["id"], "nif": r["nif"], "emisor": r["emisor_norm"], "total": r["total_c"], "estado": "propuesta"}
        if mine:
            new["estado"] = "conflicto"
            for i in mine:
                i["estado"] = "conflicto"
        invoices.append(new)
        out.append((r["id"], new, "evidencia"))
    return pd.DataFrame([(d, i["id"], k, i["estado"]) for d, i, k in out], columns=["doc_id", "factura_id", "relacion", "estado_er"])



def suppliers(docs: DataFrame) -> DataFrame:
    """docs with `clave`: one supplier's documents of a number, where every two of them are of one supplier; null where that isn't so.

    Two documents are of one supplier if their ids are equal, or, where one has none, their issuer keys. A key is the id where no document
    without id has one of its issuers; the issuer where none of its documents has an id, or all have the same or none and that id has no other issuer.
    """
    n = ["actividad_id", "numero"]
    e = F.coalesce("emisor_norm", F.lit(""))
    rows = docs.withColumn("_e", e)
    issuers = rows.groupBy(*n, "_e").agg(F.count_if(F.col("nif").isNull()).alias("sin"), F.min("nif").alias("n1"), F.max("nif").alias("n2"))
    pairs = rows.where("nif is not null").select(*n, "nif", "_e").distinct().join(issuers, [*n, "_e"])
    ids = pairs.groupBy(*n, "nif").agg(F.max("sin").alias("sueltos"), F.count("*").alias("emisores"), F.max(F.when(F.col("n1") == F.col("n2"), 0).otherwise(1)).alias("otros"))
    apart = F.col("sueltos") == 0
    alone = (F.col("emisores") == 1) & (F.col("otros") == 0)
    by_id = ids.select(*n, "nif", apart.alias("apart"), alone.alias("alone"))
    # issuers of documents without id: free of ids, or with the one id that is theirs alone
    by_issuer = issuers.join(by_id.select(*n, F.col("nif").alias("n1"), F.col("alone").alias("suyo")), [*n, "n1"], "left").select(*n, "_e", (F.col("n1").isNull() | F.coalesce("suyo", F.lit(False))).alias("fine"))
    j = rows.join(by_id, [*n, "nif"], "left").join(by_issuer, [*n, "_e"])
    key = F.when(F.col("nif").isNotNull() & F.col("apart"), F.concat(F.lit("n"), "nif")).when(F.coalesce("alone", F.col("nif").isNull()) & F.col("fine"), F.concat(F.lit("e"), "_e"))
    return j.select(*docs.columns, key.alias("clave"))


def total_centres(totals: DataFrame) -> DataFrame:
    """(clave, total_c, centro) for (clave, total_c, primero): the total of the invoice that a total's documents join.

    In order of `primero` a total joins the first earlier centre within the tolerance, else becomes one. Each round makes centres of
    the totals that come first among the open ones around them and closes all around those, so rounds are few, and a supplier's totals are spread over tasks.
    """
    around = F.explode(F.sequence(F.lit(-schema.HEADER_TOLERANCE), F.lit(schema.HEADER_TOLERANCE)))
    near = lambda df, name: df.select("clave", (F.col("total_c") + F.col("d")).alias("total_c"), F.col("primero").alias(name), F.col("total_c").alias("de"))
    left, centres = checkpoint(totals.select("clave", "total_c", "primero")), None
    while left.limit(1).count():
        lowest = near(left.withColumn("d", around), "p").groupBy("clave", "total_c").agg(F.min("p").alias("p"))
        new = checkpoint(left.join(lowest, ["clave", "total_c"]).where("p = primero").select("clave", "total_c", "primero"))
        centres = new if centres is None else checkpoint(centres.union(new))
        left = checkpoint(left.join(near(new.withColumn("d", around), "p").select("clave", "total_c").distinct(), ["clave", "total_c"], "left_anti"))
    if centres is None:
        return totals.select("clave", "total_c", F.col("total_c").alias("centro"))
    best = near(centres.withColumn("d", around), "p").groupBy("clave", "total_c").agg(F.min_by("de", "p").alias("centro"))
    return totals.select("clave", "total_c").join(best, ["clave", "total_c"])


def cluster(docs: DataFrame) -> DataFrame:
    """(doc_id, factura_id, relacion, estado_er) as `in_order` gives them in order of arrival (id) within a case file's number.

    docs has (id, actividad_id, numero, nif, emisor_norm, total_c, pagina). Documents without number always open an invoice.

    Where all documents of a number and supplier are of one supplier with each other (`suppliers`), nothing is worked off in order: documents of one total
    share an invoice, invoices are the centres of totals, those without total join the supplier's first invoice, and more than one are in conflict. So a
    placeholder number of millions of documents makes joins and aggregations by total. The others, where a document without id stands between ids,
    depend on order in more than totals; they are worked off by number, one after the other. A number of one document opens its invoice without any of this.
    """
    number = ["actividad_id", "numero"]
    known = stored(docs.where("numero is not null"), "documents")
    counts = known.groupBy(*number).agg(F.count("*").alias("_n"), F.min("id").alias("id"))
    several = known.where("actividad_id is null").unionByName(known.join(stored(counts.where("_n > 1").select(*number), "numbers"), number, "left_semi"))
    rows = checkpoint(suppliers(several).withColumn("clave", F.when(F.col("clave").isNotNull(), F.struct("actividad_id", "numero", "clave"))))
    plain = rows.where("clave is not null")
    mixed = rows.where("clave is null").drop("clave").groupBy("actividad_id", "numero").applyInPandas(in_order, ER_SCHEMA)
    totals = checkpoint(plain.where("total_c is not null").groupBy("clave", "total_c").agg(F.min("id").alias("primero")))
    joined = checkpoint(total_centres(totals))
    opened = joined.where("total_c = centro").join(totals, ["clave", "total_c"]).select("clave", "centro", "primero")
    first = plain.groupBy("clave").agg(F.min("id").alias("antes")).join(opened.groupBy("clave").agg(F.count("*").alias("n"), F.min("primero").alias("uno")), "clave", "left")
    first = checkpoint(first)
    of_total = joined.join(opened, ["clave", "centro"]).join(first.select("clave", "antes", "uno"), "clave").select("clave", "total_c", F.when(F.col("primero") == F.col("uno"), F.col("antes")).otherwise(F.col("primero")).alias("f_"))
    done = plain.join(first.select("clave", "antes", "n"), "clave").join(of_total, ["clave", "total_c"], "left")
    invoice = F.coalesce("f_", "antes")
    done = done.select(F.col("id").alias("doc_id"), invoice.alias("factura_id"), F.when((invoice != F.col("id")) & (F.coalesce("pagina", F.lit(1)) > 1), "continuacion").otherwise("evidencia").alias("relacion"),
                       F.when(F.coalesce("n", F.lit(1)) > 1, "conflicto").otherwise("propuesta").alias("estado_er"))
    single = docs.where("numero is null").select("id").unionByName(counts.where("_n = 1 and actividad_id is not null").select("id"))
    alone = single.select(F.col("id").alias("doc_id"), F.col("id").alias("factura_id"), F.lit("evidencia").alias("relacion"), F.lit("propuesta").alias("estado_er"))
    return mixed.unionByName(done).unionByName(alone)


def cluster_compatible(entries: DataFrame) -> DataFrame:
    """The same for entries whose totals are all compatible: an invoice is the first document of a key. A built-in aggregation."""
    rows = keyed(entries).drop("factura_id").withColumn("clave", F.when(F.col("numero").isNotNull(), F.concat_ws("|", "actividad_id", "numero", F.coalesce("nif", "emisor_norm"))).otherwise(F.concat(F.lit("#"), F.col("id").cast("string"))))
    first = rows.groupBy("clave").agg(F.min("id").alias("factura_id"), F.count("*").alias("n_documentos"))
    return rows.join(first, "clave").select(F.col("id").alias("doc_id"), F.col("factura_id"), "n_documentos")


def enrich(invoices: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Invoices whose empty columns are filled from their first document that has a value; docs has factura_id and id."""
    first = docs.groupBy("factura_id").agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"_{c}") for c in columns])
    j = invoices.join(first.withColumnRenamed("factura_id", "_f"), F.col("id") == F.col("_f"), "left")
    return j.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in invoices.columns])


def invoice_states(invoices: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, estado_er) of the wanted (id) invoices that exist; each once."""
    return invoices.select("id", "estado_er").join(wanted.select("id").distinct(), "id", "left_semi")


def orphan_edges(edges: DataFrame, documents: DataFrame, invoices: DataFrame) -> DataFrame:
    """Edges with an endpoint that doesn't exist. edges has (edge_id, origen_tipo, origen_id, destino_tipo, destino_id)."""
    ends = edges.select("edge_id", F.explode(F.array(F.struct(F.col("origen_tipo").alias("t"), F.col("origen_id").alias("i")), F.struct(F.col("destino_tipo").alias("t"), F.col("destino_id").alias("i")))).alias("e"))
    known = documents.select(F.lit("documento").alias("t"), F.col("id").alias("i")).union(invoices.select(F.lit("factura").alias("t"), F.col("id").alias("i")))
    return ends.select("edge_id", "e.t", "e.i").join(known, ["t", "i"], "left_anti").select("edge_id").distinct()


def sync_names(entries: DataFrame) -> DataFrame:
    """(id, antes, despues) of entries whose spelling is not their id's canonical one and is surely the same supplier."""
    names = canonical_names(entries)
    rows = entries.where("emisor is not null and nif_emisor is not null").select("id", "actividad_id", "emisor", nif.normalize(F.col("nif_emisor")).alias("nif")).join(names, ["actividad_id", "nif"]).where("emisor != canonico")
    same = jaro_winkler_column(text.clean_name(F.col("emisor")), text.clean_name(F.col("canonico")))
    return rows.withColumn("s", supplier_score(F.col("nif"), F.col("nif"), same)).where(F.col("s.probabilidad") >= schema.MENTION).select("id", F.col("emisor").alias("antes"), F.col("canonico").alias("despues"))


def backfill(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(invoices, edges) for entries without an invoice: one each, and its document as evidence."""
    bare = entries.where("factura_id is null")
    invoices = bare.select("id", "actividad_id", "nif_emisor", "emisor", text.normalize_issuer(F.col("emisor")).alias("emisor_norm"), text.normalize_number(F.col("numero_factura")).alias("numero_norm"), "total_c")
    edges = bare.select(F.lit("documento").alias("origen_tipo"), F.col("documento_id").alias("origen_id"), F.lit("factura").alias("destino_tipo"), F.col("id").alias("destino_id"), F.lit("evidencia").alias("tipo"))
    return invoices, edges


def correct_numbers(entries: DataFrame, corrections: DataFrame) -> DataFrame:
    """(id, resultado, otro_id) of corrected numbers (id, numero_nuevo): 'libre' if no other entry has the number with its id or issuer, 'fusion' with the
    first one of a compatible total, else 'conflicto' with the first."""
    rows = keyed(entries)
    new = rows.join(corrections.select("id", text.normalize_number(F.col("numero_nuevo")).alias("n")), "id").alias("d")
    f = rows.alias("f")
    same = F.when(F.col("d.nif").isNotNull() & F.col("f.nif").isNotNull(), F.col("d.nif") == F.col("f.nif")).otherwise(F.col("d.emisor_norm") == F.col("f.emisor_norm"))
    hits = new.join(f, (F.col("d.actividad_id") == F.col("f.actividad_id")) & (F.col("d.n") == F.col("f.numero")) & (F.col("f.id") != F.col("d.id")) & same)
    best = hits.groupBy(F.col("d.id").alias("h")).agg(F.min(F.struct((~totals_compatible(F.col("d.total_c"), F.col("f.total_c"))).alias("no"), F.col("f.id").alias("o"))).alias("b"))
    return corrections.select("id").join(best, F.col("id") == F.col("h"), "left").select("id", F.when(F.col("b").isNull(), "libre").when(F.col("b.no"), "conflicto").otherwise("fusion").alias("resultado"), F.col("b.o").alias("otro_id"))
