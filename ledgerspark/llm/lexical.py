"""Ranked lexical search over an index in tiers of impact."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, checkpoint_folder, ship, sized, stored

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@dataclass(frozen=True)
class Settings:
    """first, second: postings of a term in the highest tier, and in the two highest, at most; level: width of an impact level.

    A query that needs no lower tier reads at most `first` postings a term, however many rows there are.
    """

    first: int = 1000
    second: int = 20_000
    level: int = 1 << 14
    #: Rows of a table of terms or documents (about 100 bytes each) that is broadcast at most.
    broadcast: int = 200_000


def terms_of(text: str | None) -> Counter:
    """How often each term occurs: runs of digits, letters and other characters from U+0080, A-Z in lower case."""
    return Counter(_TERM.findall((text or "").encode("utf-8", "surrogatepass").lower()))  # on bytes this changes ASCII only


def analysed(rows: DataFrame, asked: frozenset[bytes] | None = None) -> DataFrame:
    """(row, name, n, terms, tf) of rows (row, name, t) with a term: n terms in all, its different terms (of `asked`, if given) and their numbers."""
    def run(batches):
        for b in batches:
            out = []
            for row, name, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = terms_of(t)
                if found:
                    some = [(w, n) for w, n in found.items() if asked is None or w in asked]
                    out.append((row, name, found.total(), [w.decode("utf-8", "surrogatepass") for w, _ in some], [n for _, n in some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())))], ["row", "name", "n", "terms", "tf"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, "row long, name long, n long, terms array<string>, tf array<long>")


def _numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("name"), F.col(text_col).cast("string").alias("t"))


@dataclass
class Index:
    """postings (tier, term, row, name, impact) in folders by tier; terms (term, w, rest0, rest1, rest2): weight, and bounds of the impacts below each tier."""

    postings: DataFrame
    terms: DataFrame
    settings: Settings


TIERS = 3


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", asked: DataFrame | None = None, settings: Settings | None = None) -> Index:
    """Index of all rows; with `asked` (term), of these terms only, by the same numbers.

    A posting's impact is 10^9 tf div (1000 tf + 12 m). Impacts of a term are counted by level; levels from the top make a tier as
    long as they fit its bound, so the postings are never sorted by impact, and a level of ties goes down as a whole.
    """
    s = settings or Settings()
    few = asked.limit(s.broadcast + 1).collect() if asked is not None else []
    known = frozenset(r["term"].encode("utf-8", "surrogatepass") for r in few) if asked is not None and len(few) <= s.broadcast else None
    made = stored(analysed(_numbered(docs, id_col, text_col), known), "terms")
    every, length = made.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.lit(75) + F.expr(f"(25 * n * {every}L) div {max(1, length)}L")
    pairs = made.select("row", "name", "n", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select("row", "name", F.col("p.terms").alias("term"), F.col("p.tf").alias("tf"), m.alias("m"))
    if asked is not None and known is None:
        pairs = pairs.join(asked.distinct(), "term", "left_semi")
    pairs = pairs.select("row", "name", "term", F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)").alias("impact"))
    level = F.expr(f"impact div {s.level}")
    levels = pairs.groupBy("term", level.alias("level")).agg(F.count("*").alias("n"), F.max("impact").alias("most"))
    down = Window.partitionBy("term").orderBy(F.col("level").desc())
    levels = levels.withColumn("sum", F.sum("n").over(down))
    levels = checkpoint(levels.withColumn("tier", F.when(F.col("sum") <= s.first, 0).when(F.col("sum") <= s.second, 1).otherwise(2)))
    df = F.sum("n").cast("double")
    rest = [F.coalesce(F.max(F.when(F.col("tier") > k, F.col("most"))), F.lit(0)).alias(f"rest{k}") for k in range(TIERS)]
    terms = checkpoint(levels.groupBy("term").agg(F.floor(1000 * F.log(F.lit(2.0 * every + 2) / (2 * df + 1))).alias("w"), *rest))
    # the levels of tier 0 and 1 end at a bound of impact for each term
    ends = checkpoint(levels.groupBy("term").agg(*[F.min(F.when(F.col("tier") <= k, F.col("level") * s.level)).alias(f"from{k}") for k in (0, 1)]))
    tier = F.when(F.col("impact") >= F.col("from0"), 0).when(F.col("impact") >= F.col("from1"), 1).otherwise(2)
    tiers = pairs.join(sized(ends, s.broadcast), "term").select(tier.alias("tier"), "term", "row", "name", "impact")
    return Index(_by_tier(tiers), terms, s)


def _by_tier(tiers: DataFrame) -> DataFrame:
    spark, path = tiers.sparkSession, f"{checkpoint_folder(tiers.sparkSession)}/index-{uuid.uuid4().hex}"
    tiers.sortWithinPartitions("tier", "term").write.partitionBy("tier").option("compression", "zstd").parquet(path)
    return spark.read.schema("term string, row long, name long, impact long, tier int").parquet(path)


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of each item, exact.

    items has (row, name, n, terms, tf), as `analysed` gives them. In a tier, a document's known score is what its postings in this and higher
    tiers give, and its bound adds the rest of those terms that it wasn't seen with. The k-th largest known score is the item's bar. If what
    documents never seen can reach is under the bar, the item is proven up to those whose bound is not: these are resolved by their
    postings in lower tiers. All other items fall through to the next tier. In the last one nothing is left, so every item is proven.
    """
    s = index.settings
    asked = items.select(F.col("row").alias("item"), F.col("name").alias("item_id"), F.explode(F.arrays_zip("terms", "tf")).alias("p"))
    asked = (asked.select("item", "item_id", F.col("p.terms").alias("term"), F.col("p.tf").alias("c")).join(index.terms, "term")
             .select("item", "item_id", "term", (F.col("c") * F.col("w")).alias("w"), *[f"rest{t}" for t in range(TIERS)]).where("w > 0"))
    asked, found = checkpoint(asked), None
    open_items = checkpoint(asked.select("item").distinct())
    for tier in range(TIERS):
        if not open_items.limit(1).count():
            break
        q = checkpoint(asked.join(sized(open_items, s.broadcast), "item", "left_semi").withColumn("rest", F.col("w") * F.col(f"rest{tier}")))
        hits = stored(index.postings.where(F.col("tier") <= tier).join(sized(q, s.broadcast), "term").groupBy("item", "row", "name")
                      .agg(F.sum(F.col("w") * F.col("impact")).alias("known"), F.sum("rest").alias("seen")), "hits")
        best = hits.withColumn("at", F.row_number().over(Window.partitionBy("item").orderBy(F.col("known").desc()))).where(F.col("at") <= k)
        bars = best.groupBy("item").agg(F.when(F.count("*") >= k, F.min("known")).otherwise(1).alias("bar"))
        state = checkpoint(q.groupBy("item").agg(F.sum("rest").alias("rest")).join(bars, "item", "left").withColumn("proven", (F.col("rest") < F.coalesce("bar", F.lit(1)))))
        fine = state.where("proven").select("item", "rest", "bar")
        left = checkpoint(hits.join(sized(fine, s.broadcast), "item").where(F.col("known") + F.col("rest") - F.col("seen") >= F.col("bar")).select("item", "row", "name", "known"))
        exact = left
        if tier < TIERS - 1:
            pairs = index.postings.where(F.col("tier") > tier).join(sized(left.select("item", "row"), s.broadcast), "row")
            more = pairs.join(sized(q.select("item", "term", "w"), s.broadcast), ["item", "term"]).groupBy("item", "row").agg(F.sum(F.col("w") * F.col("impact")).alias("more"))
            exact = left.join(more, ["item", "row"], "left").select("item", "row", "name", (F.col("known") + F.coalesce("more", F.lit(0))).alias("known"))
        found = exact if found is None else found.union(exact)
        open_items = checkpoint(state.where("not proven").select("item"))
    names = items.select(F.col("row").alias("item"), F.col("name").alias("item_id"))
    if found is None:
        return names.select("item_id", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    order = Window.partitionBy("item").orderBy(F.col("known").desc(), F.col("name").asc_nulls_last(), "row")
    top = found.where("known > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(sized(names, s.broadcast), "item").select("item_id", "rank", F.col("name").alias("doc_id"), F.col("known").alias("score"))


def rank(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", settings: Settings | None = None) -> DataFrame:
    """The k best rows of docs for each row of queries: index of the terms that they ask for, and search.

    Null and empty texts have no terms: as documents they aren't counted, as items they have no result. Rows that repeat an id are
    documents, or items, each. Rows without id are documents too, last among ties; equal scores go by ascending id, then by a fixed order.
    Texts of any length are read whole. Empty tables give an empty result; other columns are ignored, whatever their names. N, L and document
    frequencies are of all rows.
    """
    items = stored(analysed(_numbered(queries, item_col, item_text)), "items")
    asked = checkpoint(items.select(F.explode("terms").alias("term")).distinct())
    return search(build(docs, id_col, text_col, asked, settings), items, k)
