"""Exact deduplication by composable polynomial fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, ship

#: Two primes under 2**31 and their bases: terms stay under 2**39, so a sum of 2**16 of them fits 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Bytes of a piece. Longer texts are cut into pieces that are hashed by tasks of their own.
PIECE = 65536

_powers: dict[tuple[int, int], np.ndarray] = {}


def _table(base: int, prime: int) -> np.ndarray:
    """Descending powers base**(PIECE-1) ... base**0."""
    if (base, prime) not in _powers:
        p = np.ones(1, np.uint64)
        while len(p) < PIECE:  # each step doubles the table
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), prime)) % np.uint64(prime)])
        _powers[base, prime] = p[:PIECE][::-1].copy()
    return _powers[base, prime]


def piece_hash(data: bytes, base: int, prime: int) -> int:
    """sum of (byte + 1) * base**(bytes after it) modulo prime."""
    if not data:
        return 0
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return int((x * _table(base, prime)[PIECE - len(x):]).sum() % np.uint64(prime))


def combine(left: int, right: int, right_len: int, base: int, prime: int) -> int:
    """Hash of the concatenation of two byte strings from the hashes of both and the length of the right one."""
    return (left * pow(base, right_len, prime) + right) % prime


@F.pandas_udf(T.StructType([T.StructField("h0", T.LongType()), T.StructField("h1", T.LongType())]))
def _shifted(data: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Hash of a piece, shifted by the bytes that come after it in its text."""
    out = [[combine(piece_hash(d, b, p), 0, int(n), b, p) for b, p in zip(BASES, PRIMES)] for d, n in zip(data, after)]
    return pd.DataFrame(out, columns=["h0", "h1"], dtype="int64")


def normalise(text):
    """Runs of [\\x20\\x09-\\x0D] become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(id, sha, size, h0, h1, copies): one row for each different (id, text), with the rows that hold it.

    Texts of up to `piece` bytes are hashed as they are read. The pieces of longer ones are spread over the
    cluster and their hashes, shifted by the bytes after them, are summed.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalise(F.col(text_col)).alias("t"))
    rows = rows.select("id", F.col("t").cast("binary").alias("b")).select("id", "b", F.length("b").alias("size"))
    short = (rows.where(F.col("size") <= piece).select("id", F.sha2("b", 256).alias("sha"), "size", _shifted("b", F.lit(0)).alias("h"))
             .select("id", "sha", "size", "h.h0", "h.h1"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / piece).cast("int")), lambda i: F.struct(
        i.alias("no"), F.substring(F.col("b"), i * piece + 1, F.lit(piece)).alias("data"),
        F.greatest(F.lit(0), F.col("size") - (i + 1) * piece).alias("after")))
    pieces = (rows.where(F.col("size") > piece).select("id", F.sha2("b", 256).alias("sha"), "size", F.explode(cut).alias("p"))
              .repartition("sha", "p.no", "id"))
    long = (pieces.select("id", "sha", "size", F.col("p.no").alias("no"), _shifted("p.data", "p.after").alias("h"))
            .groupBy("id", "sha", "size", "no").agg(F.count("*").alias("copies"), F.first("h.h0").alias("h0"), F.first("h.h1").alias("h1"))
            .groupBy("id", "sha", "size").agg((F.sum("h0") % PRIMES[0]).alias("h0"), (F.sum("h1") % PRIMES[1]).alias("h1"), F.min("copies").alias("copies")))
    short = short.groupBy("id", "sha", "size", "h0", "h1").agg(F.count("*").alias("copies"))
    return short.unionByName(long)


def differing(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, piece: int = PIECE, salt_rows: int = 64) -> DataFrame:
    """(h0, h1, size, sha) of texts that share a fingerprint with their group's first text but are not equal to it.

    texts has a row for each different text of a group of several rows. Every row of such a group is read
    again and met with the group's first text piece by piece. That first text is repeated once for every
    `salt_rows` rows, so a group of any size is spread over many tasks and no task holds a group.
    """
    few = texts.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalise(F.col(text_col)).cast("binary").alias("b"))
    rows = rows.select("id", "b", F.sha2("b", 256).alias("sha")).join(F.broadcast(texts) if few else texts, "sha")
    key = ["h0", "h1", "size", "salt", "no"]
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.col("size") - 1) / piece).cast("int")),
                      lambda i: F.struct(i.alias("no"), F.substring(F.col("b"), i * piece + 1, F.lit(piece)).alias("data")))
    salts = F.ceil(F.col("rows") / salt_rows).cast("int")
    cut_up = rows.select("h0", "h1", "size", "sha", "id", "keep_id", "keep_sha", salts.alias("salts"), F.explode(cut).alias("p")).select(
        "*", F.col("p.no").alias("no"), F.col("p.data").alias("data")).drop("p")
    members = cut_up.withColumn("salt", F.pmod(F.xxhash64("id", "no"), F.col("salts")).cast("int"))
    first = (cut_up.where("id <=> keep_id and sha = keep_sha").dropDuplicates(["h0", "h1", "size", "no"])
             .select("h0", "h1", "size", "no", F.col("data").alias("first_data"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    return members.join(first, key).where("data != first_data").select("h0", "h1", "size", "sha").distinct()


#: Texts (about 200 bytes each) whose list is broadcast at most; longer lists are joined by a shuffle.
BROADCAST_TEXTS = 100_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal when they are after `normalise`. Of equal texts the row with the smallest id stays. A
    repeated row (same id, equal text) counts in group_size, and only one of the repeats stays. Rows without
    id stay only if no row of their group has one. Null and empty texts are equal. An empty table gives an
    empty result. Other columns are ignored.
    """
    ship(docs.sparkSession)
    fps = checkpoint(fingerprints(docs, id_col, text_col))
    fp = ["h0", "h1", "size"]
    low = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha"))  # nulls last
    texts = fps.groupBy(*fp, "sha").agg(F.sum("copies").alias("n"), low.alias("low"))
    groups = texts.groupBy(*fp).agg(F.sum("n").alias("rows"), F.min("low").alias("low")).where("rows > 1").select(
        *fp, "rows", F.col("low.id").alias("keep_id"), F.col("low.sha").alias("keep_sha"))
    several = checkpoint(texts.join(groups, fp).select("sha", *fp, "rows", "keep_id", "keep_sha"))
    other = checkpoint(differing(docs, several, id_col, text_col))
    other = other.withColumn("own", F.col("sha"))
    known = checkpoint(texts.join(other, [*fp, "sha"], "left").select(*fp, "sha", "n", "low", F.coalesce("own", F.lit("")).alias("own")))
    classes = known.groupBy(*fp, "own").agg(F.sum("n").alias("group_size"), F.min("low").alias("low")).select(
        *fp, "own", "group_size", F.col("low.id").alias("keep_id"))
    named = known.select(*fp, "own", "sha").join(classes, [*fp, "own"]).select("sha", "keep_id", "group_size")
    return (fps.join(named, "sha").select("id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("no"))
            .select(F.col("id").alias("doc_id"), "keep_id", "group_size",
                    (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("no") == 1)).alias("kept"), F.col("sha").alias("text_sha256")))
