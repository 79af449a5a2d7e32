"""Best-fit packing of tokenised documents, in bulk-synchronous rounds over sizes."""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import checkpoint, ship

#: Words whose ids a worker remembers, about 200 bytes each (40 MB, for every core of an executor); forgotten when full.
REMEMBERED = 200_000
#: Characters of a word that is remembered at most; a text with a longer one goes to the tokenizer whole.
WORD = 64
_RUN = re.compile(r" (?:\s|$)")
_loaded: dict[str, "Ids"] = {}


class Ids:
    """Token ids of texts by a tokenizers file, with a memory of words.

    With a byte-level pre-tokenizer a word always starts at a space that isn't followed by white space. Texts
    where all spaces are such are cut there, and only words not met before go to the tokenizer, many in one
    text; the ids of each start where a token starts with a space. Other texts go to it whole. The ids are the
    same either way.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        made = json.loads(self.tokenizer.to_str())
        pre = made["pre_tokenizer"] or {}
        self.by_words = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not made["normalizer"]
        self.memory: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how byte-level vocabularies spell a space

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words, which have no space in them, as they are after a space."""
        for at in range(0, len(words), 500):
            part = words[at:at + 500]
            ids = self._run([" " + " ".join(part)])[0]
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(part):
                raise ValueError("the vocabulary spells spaces in another way")
            data, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
            self.memory.update(zip(part, [data[a:b] for a, b in zip((4 * starts).tolist(), ends)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        memory, cut, new, whole = self.memory, [], set(), []
        for t in texts:
            if self.by_words and not _RUN.search(t) and max(map(len, t.split(" "))) <= WORD:
                head, *words = t.split(" ")
                new.update([w for w in words if w not in memory])
                cut.append(words)
                whole.append(head)
            else:
                whole.append(t)
                cut.append(())
        self._learn(list(new))
        look = memory.__getitem__
        return [b"".join([first.tobytes(), *map(look, words)]) for first, words in zip(self._run(whole), cut)]


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and end_id, cut only if over capacity.

    Then the first piece takes what is over full pieces, so that all others are full.
    """
    def run(batches):
        if path not in _loaded:
            _loaded[path] = Ids(path)
        ids, end = _loaded[path], np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, rows = b.slice(at, 64), []
                for i, got in zip(part.column(0).to_pylist(), ids.encode([t or "" for t in part.column(1).to_pylist()])):
                    got, start, k = got + end, 0, 0
                    n = len(got) // 4
                    while start < n:
                        size = (n - start) % capacity or capacity
                        rows.append((i, k, start, size, zlib.crc32(got[4 * start:4 * (start + size)])))
                        start, k = start + size, k + 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing by rounds: (size, first rank, count, first sequence, offset) of runs of equal pieces.

    sizes has the number of pieces of each size; there are at most `capacity` sizes, however many pieces.
    A round takes the largest size not yet placed. Gaps lie sorted by size as runs of sequences with the same gap. A sweep
    finds the smallest gap that the size fits; its sequences and the pieces are matched by rank. A sequence is filled as
    often as the size goes into its gap before the next one is begun, since what is left of a gap is the smallest that
    fits. The gaps shrink and are sorted in anew; and so on until pieces or fitting gaps run out. Pieces left over open
    sequences. The number of sequences is that of one-by-one best fit.
    """
    runs, gaps, opened = [], [], 0  # gaps: sorted (gap, first sequence, count)
    for size in sorted(sizes, reverse=True):
        left, rank = sizes[size], 0
        while left:
            k = bisect_left(gaps, (size, -1, -1))
            if k < len(gaps):
                gap, first, count = gaps.pop(k)
            else:
                gap, first, count = capacity, opened, -(-left // (capacity // size))
                opened += count
            times = gap // size
            full = min(count, left // times)
            for j in range(times if full else 0):
                runs.append((size, rank + j * full, full, first, capacity - gap + j * size))
            rank, left = rank + full * times, left - full * times
            if full and gap > size * times:
                insort(gaps, (gap - size * times, first, full))
            if full < count and left < times:  # one more sequence takes the rest
                for j in range(left):
                    runs.append((size, rank + j, 1, first + full, capacity - gap + j * size))
                if left and gap > size * left:
                    insort(gaps, (gap - size * left, first + full, 1))
                full, left = full + (left > 0), 0
            if full < count:
                insort(gaps, (gap, first + full, count - full))
    return runs


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    Null and empty texts are the end id alone. Repeated rows are packed each. Rows without id are packed
    like others. An empty table gives an empty result.

    Pieces are ranged by (length, doc_id, piece) over the cluster and ranked by a sum over the ranges
    before; counts by size (at most `capacity` numbers) are all that the driver sees of them.
    """
    made = checkpoint(pieces(docs, path, id_col, text_col, capacity, end_id))
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = (made.withColumn("tie", F.xxhash64("doc_id", "piece", "ids_crc32")).repartitionByRange(parts, "length", "doc_id", "piece", "tie")
              .sortWithinPartitions("length", "doc_id", "piece", "tie").withColumn("part", F.spark_partition_id()))
    ranged = checkpoint(ranged.withColumn("at", F.monotonically_increasing_id()).drop("tie"))
    counts = ranged.groupBy("part", "length").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = checkpoint(counts.withColumn("before", F.coalesce(before, F.lit(0))))
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(sizes, capacity)
    table = spark.createDataFrame([(s, r, r + n, q - r, o) for s, r, n, q, o in runs], "size long, low long, high long, shift long, offset long")
    ranked = (ranged.join(counts.select(F.col("part").alias("p"), F.col("length").alias("l"), "first", "before"),
                          (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")))
              .withColumn("rank", F.col("at") - F.col("first") + F.col("before")))
    return (ranked.join(F.broadcast(table), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
            .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset"))
