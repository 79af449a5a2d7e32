"""Streaming ingest: new documents without copies, entity resolution and the search for duplicates with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.matching import SEARCHES, keyed
from ..schema import HEADER_TOLERANCE


def first_seen(docs: DataFrame, time_col: str = "ts", delay: str = "7 days") -> DataFrame:
    """Documents whose content hash wasn't seen within the delay; the state is bounded by the watermark."""
    return docs.withWatermark(time_col, delay).withColumn("sha", F.sha2(F.col("content").cast("binary"), 256)).dropDuplicatesWithinWatermark(["sha"])


def daily_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events and their value by day and kind."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
            .select(F.col("w.start").alias("dia"), "event_type", "n", "v"))


#: Stands for the case file of documents without case file or number.
LOOSE = -1
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Keep streaming state by key on disk; maps and values with a time to live need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _ttl(keep: str | None) -> int | None:
    return int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None


def _known(x) -> bool:
    return x is not None and x == x


class SupplierInvoices(StatefulProcessor):
    """Open invoices of a number and supplier: a map from totals to invoices, so a document looks up the totals within the tolerance only."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.by_total = handle.getMapState("por_total", "total long", "factura long", ttlDurationMs=self.ttl)
        # the first invoice, whether it has a total, and how many there are
        self.first = handle.getValueState("primera", "factura long, con_total boolean, n long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == LOOSE:
            for batch in rows:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "factura_id": batch["doc_id"], "conflicto": False})
            return
        first, valued, n = self.first.get() if self.first.exists() else (None, False, 0)
        out = []
        for batch in rows:
            batch = batch.sort_values("doc_id")
            for doc, total in zip(batch["doc_id"].tolist(), batch["total_c"].tolist()):
                total = int(total) if _known(total) else None
                if first is None:
                    hit, first, n = doc, doc, 1
                elif total is None or not valued:
                    hit = first
                else:
                    near = [(t,) for t in range(total - HEADER_TOLERANCE, total + HEADER_TOLERANCE + 1)]
                    found = [self.by_total.getValue(t)[0] for t in near if self.by_total.containsKey(t)]
                    hit = min(found, default=doc)
                    n += not found
                if total is not None and (hit == doc or hit == first and not valued):
                    self.by_total.updateValue((total,), (hit,))
                    valued = valued or hit == first
                out.append((doc, hit, n > 1))
        self.first.update((first, valued, n))
        yield pd.DataFrame(out, columns=["doc_id", "factura_id", "conflicto"])

    def close(self) -> None:
        pass


def resolve(docs: DataFrame, keep: str | None = None) -> DataFrame:
    """(doc_id, factura_id, conflicto) as documents (doc_id, actividad_id, numero, total_c and, if there, nif and emisor_norm) arrive.

    The state is the open invoices of a number and its supplier (tax id, else issuer key). With `keep` ("400 days") what wasn't touched for so
    long in processing time goes, which a stream that runs for ever should be given. A missing total is compatible with any, and the
    first known one is the first invoice's. conflicto: the supplier's number has several invoices by then. Documents without case file or number open an invoice each.
    """
    keyed_state(docs.sparkSession)
    who = F.coalesce(*[F.col(c).cast("string") for c in ("nif", "emisor_norm") if c in docs.columns], F.lit(""))
    known = F.col("actividad_id").isNotNull() & F.col("numero").isNotNull()
    # those without are dealt by id, and leave no state
    rows = docs.withColumns({"_a": F.when(known, F.col("actividad_id")).otherwise(LOOSE), "_n": F.when(known, F.col("numero")).otherwise(""), "quien": F.when(known, who).otherwise(F.pmod("doc_id", F.lit(1024)).cast("string"))})
    return rows.groupBy("_a", "_n", "quien").transformWithStateInPandas(
        SupplierInvoices(_ttl(keep)), "doc_id long, factura_id long, conflicto boolean", "Append", "ProcessingTime" if keep else "None")


class FirstOfKey(StatefulProcessor):
    """The smallest entry of each date under one search key, in a map from dates; a snapshot's may be there from the start."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("dias", "dia int", "id long", ttlDurationMs=self.ttl)

    def _put(self, day: int, entry: int) -> None:
        if not self.days.containsKey((day,)) or self.days.getValue((day,))[0] > entry:
            self.days.updateValue((day,), (entry,))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for day, entry in zip(initialState["dia"].tolist(), initialState["id"].tolist()):
            self._put(int(day), int(entry))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        search, around, out = int(key[0]), SEARCHES[int(key[0])][2], []
        for batch in rows:
            for entry, day, original in batch.sort_values("id")[["id", "dia", "original"]].itertuples(index=False):
                near = [(d,) for d in range(day - around, day + around + 1)]
                found = min((self.days.getValue(d)[0] for d in near if self.days.containsKey(d)), default=entry)
                if found < entry:
                    out.append((entry, search, found))
                if original:
                    self._put(day, entry)
        yield pd.DataFrame(out, columns=["id", "p", "otro_id"])

    def close(self) -> None:
        pass


def _search_rows(entries: DataFrame) -> DataFrame:
    """A row for each search that an entry takes part in: its key, its date as a number, and whether it may be an original."""
    rows, none = keyed(entries), F.lit("")
    parts = [("nif", F.col("numero")), ("numero", none), ("nif", none), ("emisor_norm", none)]
    each = []
    for p, (first, second) in enumerate(parts):
        fine = F.col(first).isNotNull() & second.isNotNull() & (F.length("numero") >= 4 if p == 1 else F.lit(True))
        each.append(F.when(fine, F.struct(F.lit(p).alias("p"), F.col(first).alias("k1"), second.alias("k2"), (F.lit(p > 1) | (F.col("estado") != "rechazado")).alias("original"))))
    known = rows.where("actividad_id is not null and fecha is not null and total_c is not null")
    spread = known.select("id", "actividad_id", "total_c", F.unix_date("fecha").alias("dia"), F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("s"))
    return spread.select("s.p", "actividad_id", "s.k1", "s.k2", "total_c", "id", "dia", "s.original")


KEY = ["p", "actividad_id", "k1", "k2", "total_c"]


def duplicate_hits(entries: DataFrame, snapshot: DataFrame | None = None, keep: str | None = None) -> DataFrame:
    """(id, p, otro_id) as entries arrive in order of ids: each search of the cascade that finds an earlier one, with the smallest.

    snapshot: entries of a ledger before the stream, which are originals from the start. `first_hits` takes the first search's hit of
    each entry out of a micro-batch. With `keep` dates untouched for so long go.
    """
    keyed_state(entries.sparkSession)
    before = None
    if snapshot is not None:
        before = _search_rows(snapshot).where("original").groupBy(*KEY, "dia").agg(F.min("id").alias("id")).groupBy(*KEY)
    return _search_rows(entries).groupBy(*KEY).transformWithStateInPandas(FirstOfKey(_ttl(keep)), "id long, p int, otro_id long", "Append", "ProcessingTime" if keep else "None", initialState=before)


def first_hits(hits: DataFrame) -> DataFrame:
    """(id, nivel, otro_id, motivo) of the hits of a micro-batch (an entry's hits are all in the one it came with): for foreachBatch."""
    best = hits.groupBy("id").agg(F.min(F.struct("p", "otro_id")).alias("h"))
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in SEARCHES]), F.col("h.p") + 1)
    return best.select("id", pick(0).alias("nivel"), "h.otro_id", pick(1).alias("motivo"))
