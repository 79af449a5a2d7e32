"""SimHash near-duplicates, searched with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, links, ship, sized

#: Reference fingerprints of the distance table: 16 values of a fixed multiplicative sequence.
PIVOTS = np.array([(k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64 for k in range(1, 17)], dtype=np.uint64)
_BITS = 64


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 hashes (seed 42) of all word shingles, repeats included, a block at a time; a text of fewer words is one shingle, none without words.

    A-Z is lower-cased; words are split at [\\x20\\x09-\\x0D].
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes these change ASCII only
    if not w:
        return
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(w) - words + 1)
    last = ends[words - 1:] if len(w) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):  # memory doesn't follow the text
        yield np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:min(at + 65536, n)].tolist(), last[at:at + 65536].tolist())], dtype="<u8")


def simhash(blocks: Iterable[np.ndarray]) -> int:
    """64-bit SimHash of hashes: a bit is 1 if it is set in more than half of them; 0 without any."""
    tally, n = np.zeros(_BITS, np.int64), 0
    for h in blocks:
        tally += np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return sum(1 << i for i in np.flatnonzero(tally * 2 > n).tolist())


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of all word shingles of a text."""
    return simhash(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed 64-bit long."""
    def run(batches):
        for b in batches:
            fp = [fingerprint(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def masks(max_bits: int = 2) -> list[int]:
    """Bit masks such that two fingerprints at most max_bits apart agree under one of them.

    The 64 bits are cut into max_bits + 4 blocks and all ways of leaving out max_bits blocks are taken, so
    the differing bits always fall into blocks that some mask leaves out.
    """
    k = max_bits + 4
    edges = [round(i * _BITS / k) for i in range(k + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [(1 << _BITS) - 1 - sum(blocks[i] for i in out) for out in combinations(range(k), max_bits)]


def tables(fp: Column) -> Column:
    """Row of the pivot distance table: the fingerprint's Hamming distance to each reference."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(int(p) - (2**64 if p >= 2**63 else 0)))).cast("byte") for p in PIVOTS])


#: Fingerprints of a block over which its links are looked up bit by bit instead of compared.
CROWDED = 20_000


def crowded(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (node, smallest node of its component) of a large block: each value with up to max_bits of the block's varying bits flipped is looked up.

    A block leaves few bits open, so the work is linear in its size.
    """
    order = np.argsort(fps)
    known = fps[order]
    open_bits = int(np.bitwise_or.reduce(known ^ known[0]))
    bits = [np.uint64(1 << i) for i in range(_BITS) if open_bits >> i & 1]
    flips = [np.bitwise_xor.reduce(c) for k in range(1, max_bits + 1) for c in map(list, combinations(bits, k))]
    low, before = np.arange(len(known)), None
    while before is None or (low != before).any():
        before = low.copy()
        for flip in flips:
            other = known ^ flip
            at = np.minimum(np.searchsorted(known, other), len(known) - 1)
            hit = known[at] == other
            low[hit] = np.minimum(low[hit], low[at[hit]])
        while (low[low] != low).any():
            low = low[low]
    return [(int(order[i]), int(order[low[i]])) for i in np.flatnonzero(low != np.arange(len(low)))]


def forest(fps: np.ndarray, max_bits: int, table: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest (as index pairs) of the links within one block of distinct fingerprints.

    table holds their distances to the pivots. From each fingerprint reached, those not
    yet reached are compared: a difference over max_bits in any coordinate rules a pair out, and only
    survivors have their bits compared.
    """
    if len(fps) > CROWDED:
        return crowded(fps, max_bits)
    if table is None:
        table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    left, found = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            survivors = left[np.abs(table[left, 0] - table[i, 0]) <= max_bits]
            if len(survivors):
                survivors = survivors[(np.abs(table[survivors] - table[i]) <= max_bits).all(axis=1)]
                hit = survivors[np.bitwise_count(fps[survivors] ^ fps[i]) <= max_bits]
                if len(hit):
                    found += [(int(j), int(i)) for j in hit]
                    queue += hit.tolist()
                    left = left[~np.isin(left, hit, assume_unique=True)]
    return found


def link(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) between the ids of distinct fingerprints (fp, id, pivots) at most max_bits apart; pivots is their row of the distance table.

    Fingerprints that agree under a mask form a block. A block holds at most 2**(bits left out), for two
    bits 2**22, different values, 64 MB, whatever the corpus, so one task can always hold it. A block of two is settled by
    the table and the bits at once; a larger one yields a spanning forest of its links, not all its pairs: the components
    are the same.
    """
    keys = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m)).alias("v"))
            for k, m in enumerate(masks(max_bits))]
    blocks = (distinct.where("id is not null").select("fp", "id", "pivots", F.explode(F.array(*keys)).alias("key"))
              .groupBy("key").agg(F.collect_list(F.struct("fp", "id", "pivots")).alias("m")).where(F.size("m") > 1))
    x, y = F.col("m")[0], F.col("m")[1]
    widest = F.greatest(*[F.abs(x["pivots"][i].cast("int") - y["pivots"][i].cast("int")) for i in range(len(PIVOTS))])
    open_ = (F.size("m") > 2) | ((widest <= max_bits) & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= max_bits))
    blocks = blocks.where(open_).select(F.col("m.fp").alias("fps"), F.col("m.id").alias("ids"), F.flatten("m.pivots").alias("table"))

    def run(batches):
        for pdf in batches:
            a, b = [], []
            for fps, ids, table in zip(pdf["fps"], pdf["ids"], pdf["table"]):
                for i, j in forest(np.asarray(fps, np.int64).view(np.uint64), max_bits, np.asarray(table, np.int8).reshape(len(fps), len(PIVOTS))):
                    a.append(int(ids[i]))
                    b.append(int(ids[j]))
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return blocks.mapInPandas(run, "a long, b long").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are returned
    each. Rows that share an id are one document. A row without id gets the component of the documents
    with its fingerprint, else null. An empty table gives an empty result; other columns are ignored.

    Copies collapse before the search (partial aggregation on the fingerprint); linear work besides.
    """
    ship(docs.sparkSession)
    fps = checkpoint(fingerprints(docs, id_col, text_col, words))
    distinct = checkpoint(fps.groupBy("fp").agg(F.min("id").alias("id")).withColumn("pivots", tables(F.col("fp"))))
    roots = components(link(distinct, max_bits))
    named = (distinct.join(roots, F.col("id") == F.col("node"), "left")
             .select("fp", F.coalesce("root", "id").alias("component_id")))
    return (fps.join(named, "fp")
            .select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


#: Blocks of the search by similarity: bands of ROWS minima. A pair at similarity 0.8 shares one with probability 1 - (1 - 0.8**4)**20 = 0.99997.
BANDS, ROWS = 20, 4
#: Fingerprints of texts of similarity 0.8 differ in 10 bits or so; in more than this many with a probability of 1e-5.
RADIUS = 24
_SALTS = np.array([(k * 0x9E3779B97F4A7C15 ^ 0x2545F4914F6CDD1D) % 2**64 for k in range(1, BANDS * ROWS + 1)], dtype=np.uint64)
#: Rows of a list of ids or keys (8 bytes each) that is broadcast at most; longer lists are joined by a shuffle.
BROADCAST = 1_000_000


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted different hashes of a text's word shingles."""
    found = [np.unique(h) for h in shingle_hashes(text, words)]
    return np.unique(np.concatenate(found)) if found else np.array([], np.uint64)


def key(hashes: np.ndarray) -> int:
    """64-bit key of a set of hashes, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def bands(hashes: np.ndarray) -> list[int]:
    """Band keys of a set of hashes, as signed longs; none for an empty set."""
    if not len(hashes):
        return []
    low = np.full(len(_SALTS), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[at:at + 4096, None] ^ _SALTS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(low[i * ROWS:(i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def signatures(rows: DataFrame, words: int) -> DataFrame:
    """(id, k1, fp, bands) of rows (id, t); fp is the SimHash of the different shingles."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([key(h) for h in sets], pa.int64()), pa.array(np.array([simhash([h]) for h in sets], np.uint64).view(np.int64)),
                     pa.array([bands(h) for h in sets], pa.list_(pa.int64()))], ["id", "k1", "fp", "bands"])

    return rows.mapInArrow(run, "id long, k1 long, fp long, bands array<long>")


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """(k1, hashes) of rows (id, t)."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                sets = [shingles(t, words) for t in b.column(1).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([key(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["k1", "hashes"])

    return rows.mapInArrow(run, "k1 long, hashes array<long>")


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row with an id: documents are linked if their shingle sets have at least that Jaccard similarity.

    Fingerprints of such documents are up to RADIUS bits apart, where no bit masks separate them any more; so blocks are
    bands of shingle minima. In a block, the table of distances to the pivots discards pairs by their largest coordinate
    difference, then the fingerprints' distance does, and the shingle sets of survivors decide.

    Equal sets collapse first; texts without words are equal. Rows that share an id are one document, null texts are empty, very
    long texts are taken whole. component_id is the component's smallest id. An empty table gives an empty result; other
    columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    signed = checkpoint(signatures(rows, words))
    distinct = checkpoint(signed.groupBy("k1").agg(F.min("id").alias("id"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
                          .withColumn("pivots", tables(F.col("fp"))))

    def sets(keys: DataFrame) -> DataFrame:
        wanted = checkpoint(distinct.select("k1", "id").join(sized(keys, BROADCAST), "k1", "left_semi"))
        texts = rows.join(sized(wanted.select("id").distinct(), BROADCAST), "id", "left_semi")
        return checkpoint(shingle_sets(texts, words).join(sized(wanted.select("k1"), BROADCAST), "k1", "left_semi").dropDuplicates(["k1"]))

    def survivors(pairs: DataFrame) -> DataFrame:
        table = distinct.select("k1", "pivots", "fp")
        both = (pairs.join(table.select(F.col("k1").alias("a"), F.col("pivots").alias("pa"), F.col("fp").alias("fa")), "a")
                .join(table.select(F.col("k1").alias("b"), F.col("pivots").alias("pb"), F.col("fp").alias("fb")), "b"))
        widest = F.greatest(*[F.abs(F.col("pa")[i].cast("int") - F.col("pb")[i].cast("int")) for i in range(len(PIVOTS))])
        return checkpoint(both.where(widest <= RADIUS).where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= RADIUS).select("a", "b"))

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = survivors(pairs)
        s = sets(checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct()))
        both = (pairs.join(s.select(F.col("k1").alias("a"), F.col("hashes").alias("sa")), "a")
                .join(s.select(F.col("k1").alias("b"), F.col("hashes").alias("sb")), "b"))
        sizes = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
        return sizes.where(F.col("shared") >= similarity * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")

    found = links(distinct.select("k1", F.col("fp").alias("sketch"), F.explode("bands").alias("band")),
                  lambda keys: sets(keys).select("k1", F.col("hashes").alias("raw")), alike, similarity, BROADCAST, lambda x: F.bit_count(x) <= RADIUS)
    shared = signed.groupBy("id").agg(F.min("k1").alias("a"), F.collect_set("k1").alias("ks")).where(F.size("ks") > 1).select("a", F.explode("ks").alias("b"))
    roots = components(found.union(shared))
    named = distinct.select("k1", "id").join(roots, F.col("k1") == F.col("node"), "left").withColumn("root", F.coalesce("root", "k1"))
    firsts = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return (signed.select("id", "k1").join(named.select("k1", "root"), "k1").join(firsts, "root")
            .select(F.col("id").alias("doc_id"), "component_id"))
