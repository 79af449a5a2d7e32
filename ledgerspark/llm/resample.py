"""Target-distribution importance resampling on hashed word n-grams. DuckDB counts in tasks, Spark merges and scores."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship, stored

#: Characters of the texts that DuckDB works off at once (at least one text); their words take about 100 bytes each.
_AT_ONCE = 4_000_000


@dataclass(frozen=True)
class Settings:
    """Features are runs of `least` to `most` words; `buckets` hash buckets; documents of `words` words at least are drawn, `percent` of them."""

    least: int = 1
    most: int = 1
    buckets: int = 10_000
    words: int = 20
    percent: int = 10
    seed: str = "2024"


#: Words of a text in lower case (A-Z only).
WORDS = r"regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def features_sql(s: Settings) -> str:
    """SQL over texts(i, t): for each text with words (i, n_words, n_features, buckets, counts); buckets are its different ones, ascending."""
    runs = []
    for n in range(s.least, s.most + 1):
        joined = " || ' ' || ".join(["w", *(f"lead(w, {k}) over (partition by i order by pos)" for k in range(1, n))])
        runs.append(f"select i, {joined} as f from words")
    return f"""
    with lists as (select i, {WORDS} as l from texts),
    words as (select i, unnest(l) as w, generate_subscripts(l, 1) as pos from lists),
    runs as ({' union all '.join(runs)}),
    known as (select f, crc32(f) % {s.buckets} as b from (select distinct f from runs where f is not null)),
    counted as (select i, b, count(*) as n from runs join known using (f) group by i, b),
    hashed as (select i, sum(n)::bigint as n_features, list(b::integer order by b) as buckets, list(n order by b) as counts from counted group by i)
    select i, len(l)::bigint as n_words, coalesce(n_features, 0) as n_features, coalesce(buckets, []) as buckets, coalesce(counts, []) as counts
    from lists left join hashed using (i) where len(l) > 0"""


def _crc32(words: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words.to_pylist()], pa.int64())


def _engine() -> duckdb.DuckDBPyConnection:
    """DuckDB in memory with one thread (a task has one core), without files of its own, and with zlib's CRC-32."""
    db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
    db.create_function("crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
    return db


_SPILL = "kept boolean, doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"


def spilled(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """Rows of every document (kept), and for each task its sum over them (not kept), as Parquet in the shared folder."""
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [x.split()[0] for x in _SPILL.split(", ")]

    def run(batches):
        db, sql, total = _engine(), features_sql(s), np.zeros(s.buckets, np.int64)
        for b in batches:
            sizes, at = np.cumsum([len(t or "") for t in b.column(1).to_pylist()]), 0
            while at < b.num_rows:
                before = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + _AT_ONCE, "right")))
                part = b.slice(at, end - at)
                db.register("texts", pa.table({"i": pa.array(range(part.num_rows), pa.int32()), "t": part.column(1)}))
                got = db.execute(sql).to_arrow_table().combine_chunks()
                db.unregister("texts")
                place, n = np.asarray(got["i"]), part.num_rows
                if got.num_rows:
                    np.add.at(total, np.asarray(got["buckets"].chunk(0).flatten()), np.asarray(got["counts"].chunk(0).flatten()))
                of = np.full(n, -1)
                of[place] = np.arange(len(place))
                take = pa.array(of, pa.int64(), mask=of < 0)
                found = got.take(take)
                zero = pa.scalar(0, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([True] * n), part.column(0), *(pc.fill_null(found[c].combine_chunks(), zero).cast(pa.int64()) for c in ("n_words", "n_features")),
                                                  found["buckets"].combine_chunks().cast(kinds[4]), found["counts"].combine_chunks().cast(kinds[5])], names)
                at = end
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([[False], [None], [0], [0], [seen.tolist()], [total[seen].tolist()]], kinds)], names)

    ship(docs.sparkSession)
    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, _SPILL), "buckets")


def merged(spill: DataFrame) -> DataFrame:
    """(bucket, n) over all rows, from the tasks' sums."""
    pairs = spill.where("not kept").select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias("n"))


def gains(source: DataFrame, target: DataFrame, s: Settings) -> list[int]:
    """Gain of each bucket in thousandths of a natural logarithm; source and target are (bucket, n). One row a bucket reaches the driver."""
    every = source.sparkSession.range(s.buckets).select(F.col("id").cast("int").alias("bucket"))
    both = (every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
            .select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t"))))
    whole = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    value = F.floor(1000 * F.log((F.col("t") + 1) * (whole["s"] + s.buckets) / ((F.col("s") + 1) * (whole["t"] + s.buckets))))
    return [r["g"] for r in both.select("bucket", value.alias("g")).orderBy("bucket").collect()]


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, fixed by seed and id (a missing id counts as an empty one)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank is null unless drawn.

    A document's weight is the floored mean of its features' gains, by how much more often a bucket occurs in target than in
    docs. Its score adds Gumbel noise, so the highest scores are a sample by these weights without replacement. Of the documents of
    enough words the given percentage is drawn; equal scores go by ascending doc_id, rows without id last, rows with one id in
    a fixed order.

    Null and empty texts have no features and weight 0. Texts of any length are worked off whole. Rows that repeat an id are documents
    each, with equal noise. Without any target text, gains only tell rare buckets from frequent ones. An empty table gives an empty
    result. Other columns are ignored, whatever their names.

    Texts are read once. Ranks come from a sort by ranges, of which the driver sees one count each.
    """
    s, spark = settings or Settings(), docs.sparkSession
    spill = spilled(docs, s, id_col, text_col)
    wanted = spilled(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), s, "id", "text")
    table = F.from_json(F.lit(str(gains(merged(spill), merged(wanted), s))), "array<bigint>")
    total = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: F.get(table, b) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0).cast("long")
    scored = (spill.where("kept").select("doc_id", "n_words", "n_features", total.alias("total")).withColumn("weight", weight)
              .select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), s.seed)).alias("score"), (F.col("n_words") >= s.words).alias("fit"), F.monotonically_increasing_id().alias("row")))
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = checkpoint(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    counts = sorted(ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.count_if("fit").alias("fit")).collect(), key=lambda r: r["part"])
    drawn, shift, before = s.percent * sum(r["fit"] for r in counts) // 100, [], 0
    for r in counts:
        shift.append((r["part"], before + 1 - r["first"]))
        before += r["n"]
    shifts = F.broadcast(spark.createDataFrame(shift, "part int, shift long"))  # a row for each range
    rank = F.col("at") + F.col("shift")
    return ranged.join(shifts, "part").select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= drawn), rank).alias("rank"))
