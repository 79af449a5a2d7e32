"""Helpers that the operators share: shipping the package, cutting lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session

#: Rows of one Arrow batch that reach Python; a batch of ordinary documents is then a few MB.
ARROW_ROWS = 2000

def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, in small batches."""
    session.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; only a session on one machine without one gets a local folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as compressed Parquet into the checkpoint folder, and read from there."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows, else to be joined by a shuffle. df should be cheap to read again."""
    return F.broadcast(df) if df.count() <= rows else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars.

    edges has columns a, b of one orderable type. Returns (node, root) for every node that has an edge
    to another one, root being the smallest node of its component; roots themselves are not listed.
    Every round is one distributed step and is checkpointed; no component is ever gathered in one place.
    """
    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()

    edges = checkpoint(edges.where("a is not null and b is not null and a != b")
                       .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = mark(edges)
    for _ in range(max_rounds):
        if last[0] == 0:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low"))
        large = (both.join(low, F.col("a") == F.col("n")).where("b > a")
                 .select(F.col("b").alias("a"), F.least("n", "low").alias("b")).where("a != b").distinct())
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low"))
        small = (large.join(low, F.col("a") == F.col("n"))
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                                           F.struct(F.col("n").alias("a"), F.col("low").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a != b").distinct())
        edges = checkpoint(small)
        now = mark(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


Near = Callable[[Column], Column]

#: Members of a bucket that are all paired with each other.
SMALL = 16

#: Members of a band up to which those of different components are all compared.
MIDDLE = 64

#: Members of a larger band whose shingles tell what is frequent in it.
SAMPLE = 16


def _split(banded: DataFrame, broadcast: int, near: Near) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the members of buckets (band, k1, sketch), and the ends (band, low, high) of the buckets that give only a part of theirs.

    Buckets of up to SMALL members give all pairs; in a larger one each member is paired with the smallest and the largest
    key. Buckets of two need no members again. Pairs whose sketches aren't near are left out.
    """
    ends = checkpoint(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("k1").alias("low"), F.max("k1").alias("high"), F.bit_xor("sketch").alias("apart")).where("low < high"))
    two = ends.where((F.col("n") == 2) & near(F.col("apart"))).select(F.col("low").alias("a"), F.col("high").alias("b"))
    members = (banded.join(sized(ends.where(f"n between 3 and {SMALL}").select("band"), broadcast), "band")
               .groupBy("band").agg(F.array_sort(F.collect_set(F.struct("k1", "sketch"))).alias("m")))
    some = (members.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, SMALL), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p"))
            .where(near(F.col("p.x.sketch").bitwiseXOR(F.col("p.y.sketch")))).select(F.col("p.x.k1").alias("a"), F.col("p.y.k1").alias("b")))
    large = ends.where(f"n > {SMALL}").select("band", "low", "high")
    inside = banded.join(sized(large, broadcast), "band")
    tips = inside.where("k1 = low or k1 = high").select("band", F.col("k1").alias("tip"), F.col("sketch").alias("tip_sketch")).distinct()
    star = (inside.join(sized(checkpoint(tips), broadcast), "band").where("k1 != tip").where(near(F.col("sketch").bitwiseXOR(F.col("tip_sketch"))))
            .select(F.least("k1", "tip").alias("a"), F.greatest("k1", "tip").alias("b")))
    return two.union(some).union(star), large


def links(banded: DataFrame, shingles: Callable[[DataFrame], DataFrame], alike: Callable[[DataFrame], DataFrame], similarity: float, broadcast: int, near: Near,
          hashes: Callable[[Column], Column] = lambda raw: raw) -> DataFrame:
    """Edges (a, b) that connect any two keys that share a band, have near sketches and are alike.

    banded has (k1, band, sketch); shingles(keys) gives the different shingles of the listed keys, as rows (k1, h) or as (k1, raw), of which
    hashes(raw) makes the array; alike(pairs) keeps the pairs with a Jaccard similarity of at least `similarity`. near(bits in which
    two 64-bit sketches differ) tells the pairs that are to be compared.

    In a band of more than SMALL members these first meet its two ends only. Where that leaves several components, the members of a band of
    up to MIDDLE are compared with those of other components. In a larger one they meet by shingles that are not frequent in the
    band. Two similar sets share at least similarity * size of their shingles; what the frequent ones can't make up of that,
    `need`, must come from the others. So, in any order that the band has in common, they share one of the first (number of the others) - need + 1;
    those seen in no sampled member come first. Which shingles are called frequent changes the work, not the links. Only pairs that frequent shingles alone can
    make similar (the lesser number of these is similarity / (1 + similarity) of both sizes) need none of the others: of these
    sets, those outside the main component of a band that still holds several are compared with the band's members of other components.
    """
    pairs, large = _split(banded, broadcast, near)
    found = checkpoint(alike(checkpoint(pairs.distinct())))
    if not large.limit(1).count():
        return found

    def mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
        """Members of the bands that hold several components, with their root, and the band's main one (that of most members) and number of members."""
        members = checkpoint(members.join(sized(roots, broadcast), F.col("k1") == F.col("node"), "left").withColumn("root", F.coalesce("root", "k1")).drop("node"))
        several = (members.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("root", "n").alias("main"), F.count("*").alias("roots"), F.sum("n").alias("members"))
                   .where("roots > 1").drop("roots"))
        return checkpoint(members.join(sized(checkpoint(several), broadcast), "band"))

    left = mixed(banded.join(sized(large.select("band"), broadcast), "band", "left_semi"), components(found))
    raw = shingles(checkpoint(left.select("k1").distinct()))
    if "h" in raw.columns:
        raw = checkpoint(raw.groupBy("k1").agg(F.collect_list("h").alias("raw")))

    def laid(rows: DataFrame) -> DataFrame:
        """rows with their sets, which are made where the band's members are."""
        return rows.join(raw, "k1").repartition("band").withColumn("hashes", hashes(F.col("raw"))).drop("raw").withColumn("size", F.size("hashes"))

    def meet(rows: DataFrame, also: Column) -> DataFrame:
        """Similar pairs of rows of a band that are of different components, one of them not the main one."""
        a, b = rows.where("root != main").alias("a"), rows.alias("b")
        both = F.col("a.size") + F.col("b.size")
        return (a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.main")) | (F.col("a.k1") < F.col("b.k1")))
                       & (F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size") - 1e-6) & also & near(F.col("a.sketch").bitwiseXOR(F.col("b.sketch")))
                       & (F.size(F.array_intersect("a.hashes", "b.hashes")) * (1 + similarity) >= similarity * both - 1e-6))
                .select(F.least("a.k1", "b.k1").alias("a"), F.greatest("a.k1", "b.k1").alias("b")).distinct())

    found = checkpoint(found.union(meet(laid(left.where(F.col("members") <= MIDDLE)), F.lit(True))))
    left = checkpoint(left.where(F.col("members") > MIDDLE))
    if not left.limit(1).count():
        return found
    some = left.select("band", "k1", F.row_number().over(Window.partitionBy("band").orderBy("k1")).alias("at")).where(F.col("at") <= SAMPLE)
    seen = laid(some).select("band", F.explode("hashes").alias("h")).groupBy("band", "h").agg(F.count("*").alias("n"))
    often = F.col("n") * 4 >= SAMPLE
    seen = checkpoint(seen.groupBy("band").agg(F.collect_list(F.when(often, F.col("h"))).alias("often"), F.collect_list(F.when(~often, F.col("h"))).alias("seldom")))
    rare = laid(left).join(seen, "band").withColumn("others", F.array_except("hashes", "often")).withColumn("hot", F.col("size") - F.size("others"))
    # a little is taken off before rounding so that 0.8 * 5 is 4, and the prefix never too short
    rare = rare.withColumn("need", (F.ceil(similarity * F.col("size") - 1e-6) - F.col("hot")).cast("int"))
    first = F.slice(F.concat(F.sort_array(F.array_except("others", "seldom")), F.sort_array(F.array_intersect("others", "seldom"))), F.lit(1), F.size("others") - F.greatest("need", F.lit(1)) + 1)
    rare = checkpoint(rare.select("band", "k1", "sketch", "root", "size", "hot", "need", F.size("others").alias("tails"), first.alias("first")))
    # tail: how many of the others are left from a token on; the first one that two sets share must leave enough
    token = rare.select("band", "k1", "sketch", "root", "size", "hot", "tails", F.posexplode("first").alias("at", "h"))
    token = token.select(F.xxhash64("band", "h").alias("token"), "k1", "sketch", "root", "size", "hot", (F.col("tails") - F.col("at")).alias("tail"))
    a, b = token.alias("a"), token.alias("b")
    more = (a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.k1") < F.col("b.k1")) & (F.col("a.root") != F.col("b.root"))
                   & (F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size") - 1e-6)
                   & (F.least("a.hot", "b.hot") + F.least("a.tail", "b.tail") >= similarity / (1 + similarity) * (F.col("a.size") + F.col("b.size")) - 1e-6)
                   & near(F.col("a.sketch").bitwiseXOR(F.col("b.sketch"))))
            .select(F.col("a.k1").alias("a"), F.col("b.k1").alias("b")).distinct())
    found = checkpoint(found.union(alike(checkpoint(more))))
    frequent = rare.where("need <= 0").select("band", "k1", "sketch", "hot")
    if not frequent.limit(1).count():
        return found
    rest = laid(mixed(frequent, components(found)))
    return found.union(checkpoint(meet(rest, F.least("a.hot", "b.hot") >= similarity / (1 + similarity) * (F.col("a.size") + F.col("b.size")) - 1e-6)))
