"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding, control bytes apart from data bytes.

A folder holds `ranks` (the ids, most frequent first) and `blocks` (files of blocks). All numbers are little-endian. A block is

    magic "TIDB", then as unsigned 64-bit numbers: documents, ids, ids of all documents before the block, bytes of control, bytes of data
    for each document: doc_id (signed 64 bits), 1 if it has none (one byte), number of ids (unsigned 64 bits), each as a column
    control bytes, data bytes, one line feed

An id is stored as its rank, in as few whole bytes (1 to 4) as it needs. A control byte has these lengths, less one, of four ids, first
id in the lowest bits; every document begins a control byte. Blocks may lie in files in any order: each knows where it begins.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import checkpoint_folder, ship, stored

MAGIC = b"TIDB"
_HEAD = struct.Struct("<4s5Q")
#: Ids after which a block is full (a longer document is a block alone), and blocks of a file.
BLOCK, BLOCKS_A_FILE = 1_000_000, 8
#: Words whose ids a worker remembers, about 200 bytes each; forgotten when full. Longer words aren't remembered.
REMEMBERED, WORD = 1_000_000, 64
#: Texts with one of these go to the tokenizer whole: control characters that only Python takes for white space, a capital that
#: becomes two characters, and all from U+02B0 on, as combining marks and other scripts.
_FAR = re.compile("[\x1c-\x1f\u0130\u02b0-\U0010ffff]")

#: For each control byte, which of 16 bytes (four ids of 4 bytes) are stored; and how many.
STORED = np.array([[j <= (c >> 2 * i & 3) for i in range(4) for j in range(4)] for c in range(256)])
STORED_BYTES = STORED.sum(axis=1)


class WordIds(dict):
    """Ids of texts by a tokenizers file, with a memory of words (from words in lower case to bytes of ids).

    A tokenizer that drops white space, and normalises and joins nothing across it, treats each word alone. So texts of Latin
    letters are put in lower case and split; words met before are looked up, new ones are cut by the file's own pattern and given to
    its model. Texts with other characters or with a special token's spelling, and texts for any other
    tokenizer, go to the library whole. The ids are the same.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_padding()
        self.library.no_truncation()
        made = json.loads(self.library.to_str())
        self.size = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        self.kind = width(self.size)
        every = np.arange(self.size).astype(self.kind)
        self.id_bytes = [x.tobytes() for x in every]
        self.model = self.library.model
        self.spellings = [a["content"] for a in made["added_tokens"]]
        normal, pre = (self._parts(made[k], name) for k, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normal]
        cut = [(x["type"], x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in pre]
        pattern = pre[0].get("pattern", {}).get("Regex", "") if pre else ""
        self.by_words = (steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
                         and cut == [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)]
                         and " " not in pattern and pattern.replace(r"[^\s", "[^").find(r"\s") < 0)
        self.pattern = regex.compile(pattern) if self.by_words else None
        self.letters = r"[\p{L}]+" in pattern
        # how byte-level vocabularies spell bytes: printable Latin-1 characters as themselves, others from U+0100 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        self.spelt = {b: 256 + i for i, b in enumerate(others)}

    @staticmethod
    def _parts(x: dict | None, name: str) -> list[dict]:
        return x.get(name, [x]) if x else []

    def __missing__(self, word: str) -> bytes:
        if self.letters and word.isalpha():
            parts = [word]
        elif self.letters and word[:-1].isalpha() and not word[-1].isalnum():  # one sign behind letters
            parts = [word[:-1], word[-1]]
        else:
            parts = self.pattern.findall(word)
        if parts == [word]:
            text = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.spelt)
            spell = self.id_bytes
            ids = b"".join([spell[t.id] for t in self.model.tokenize(text)])
        else:
            ids = b"".join([self[p] for p in parts])
        if len(word) <= WORD:
            self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian numbers of the vocabulary's width."""
        if len(self) > REMEMBERED:
            self.clear()
        look = self.__getitem__
        return [b"".join(map(look, t.lower().split())) if self.by_words and not _FAR.search(t) and not any(s in t for s in self.spellings)
                else np.array(self.library.encode(t, add_special_tokens=False).ids, self.kind).tobytes() for t in texts]


def width(size: int) -> str:
    """The kind of number that holds any id below size."""
    return "<u2" if size <= 65536 else "<u4"


def pack(docs: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """Control and data bytes of each document's ranks; the documents are worked off together."""
    of = np.concatenate(([0], np.cumsum([-(-len(d) // 4) for d in docs]))).astype(np.int64)
    r = np.zeros(4 * int(of[-1]), "<u4")
    for d, at in zip(docs, (4 * of).tolist()):
        r[at:at + len(d)] = d
    codes = ((r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)).reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 16)[STORED[control]].tobytes()
    ends, of, control = np.concatenate(([0], np.cumsum(STORED_BYTES[control])))[of].tolist(), of.tolist(), control.tobytes()
    return [(control[of[i]:of[i + 1]], data[ends[i]:ends[i + 1]]) for i in range(len(docs))]


def unpack(control: np.ndarray, data: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Ranks from control and data bytes by table lookup, four for each control byte, in windows of `step` control bytes."""
    out, at = np.zeros((len(control), 16), np.uint8), 0
    for i in range(0, len(control), step):
        c = control[i:i + step]
        n = int(STORED_BYTES[c].sum())
        out[i:i + step][STORED[c]] = data[at:at + n]
        at += n
    return out.view("<u4").reshape(-1)


def block(docs: list[tuple[int | None, int, bytes, bytes]], start: int) -> bytes:
    """A block of (doc_id, ids, control, data), documents in order; start: ids before it."""
    n = np.array([d[1] for d in docs], "<u8")
    control, data = b"".join(d[2] for d in docs), b"".join(d[3] for d in docs)
    ids, none = np.array([d[0] or 0 for d in docs], "<i8"), np.array([d[0] is None for d in docs], np.uint8)
    return b"".join([_HEAD.pack(MAGIC, len(docs), int(n.sum()), start, len(control), len(data)), ids.tobytes(), none.tobytes(), n.tobytes(), control, data])


def documents(content: bytes, by_rank: np.ndarray) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of every document of a file of blocks."""
    at, content = 0, memoryview(content)
    while at < len(content):
        magic, docs, ids, start, controls, size = _HEAD.unpack_from(content, at)
        ends = np.cumsum([_HEAD.size, 8 * docs, docs, 8 * docs, controls, size]) + at
        if magic != MAGIC or ends[-1] >= len(content) or content[ends[-1]] != 10:
            raise ValueError("not a file of token id blocks, or cut short")
        names, none, n = (np.frombuffer(content[ends[i]:ends[i + 1]], kind) for i, kind in enumerate(("<i8", np.uint8, "<u8")))
        control, data = (np.frombuffer(content[ends[i]:ends[i + 1]], np.uint8) for i in (3, 4))
        of, sizes = np.concatenate(([0], np.cumsum(-(-n.astype(np.int64) // 4)))), n.astype(np.int64).tolist()
        bytes_at = np.concatenate(([0], np.cumsum(STORED_BYTES[control])))
        first = 0
        while first < docs:  # some documents at a time: their ids take 20 times the bytes of control
            last = max(first + 1, int(np.searchsorted(of, of[first] + (1 << 16), "right")) - 1)
            found = by_rank[unpack(control[of[first]:of[last]], data[bytes_at[of[first]]:bytes_at[of[last]]])]
            for d in range(first, last):
                begin = 4 * int(of[d] - of[first])
                yield None if none[d] else int(names[d]), start, found[begin:begin + sizes[d]]
                start += sizes[d]
            first = last
        at = int(ends[-1]) + 1


_loaded: dict[str, WordIds] = {}


def tokenised(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(doc_id, row, n, ids) of every row, end_id included; ids as bytes of the tokenizer's width. Written, so row is fixed."""
    def run(batches):
        if tokenizer not in _loaded:
            _loaded[tokenizer] = WordIds(tokenizer)
        ids = _loaded[tokenizer]
        end = np.array([end_id], ids.kind).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                got = [x + end for x in ids.encode([t or "" for t in part.column(2).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) // len(end) for x in got], pa.int64()), pa.array(got, pa.binary())], ["doc_id", "row", "n", "ids"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("t"))
    return stored(rows.mapInArrow(run, "doc_id long, row long, n long, ids binary"), "tokens")


def frequency_ranks(made: DataFrame, size: int) -> np.ndarray:
    """All ids of the vocabulary, most frequent first, ties by id: counts over all rows, of which at most `size` reach the driver."""
    kind = width(size)

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                total += np.bincount(np.frombuffer(b"".join(b.column(0).slice(at, 256).to_pylist()), kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in made.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return np.lexsort((np.arange(size), -counts)).astype("<u4")


_LAST = 2**63 - 1


def _ranges(bounds: np.ndarray, ids: pa.Array, rows: pa.Array) -> np.ndarray:
    """Range of each row. An id that is more than one bound has several ranges; its rows are dealt among them by row number."""
    key = np.asarray(ids.fill_null(_LAST))
    low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
    share = (np.asarray(rows).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
    return low + (share * (high - low + 1) >> 24)


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> None:
    """Write every row's token ids, then end_id, into a new folder `path` (any file system of Spark), in ascending order of id.

    Null and empty texts are end_id alone. Rows without id come last. Rows that share an id are documents each, next to one another
    in a fixed order. A text of any length is one document (its ids are held by one task). An empty table gives a folder without documents. Other columns
    are ignored, whatever their names.

    Rows are cut into ranges of ids at quantiles. What lies before a range is summed over all rows; the driver sees one
    number for each range. Blocks are written by Spark's text writer, so a lost task's files never count.
    """
    spark, size = docs.sparkSession, WordIds(tokenizer).size
    kind = width(size)
    made = tokenised(docs, tokenizer, id_col, text_col, end_id)
    by_rank = frequency_ranks(made, max(size, end_id + 1))
    rank_of = np.empty_like(by_rank)
    rank_of[by_rank] = np.arange(len(by_rank), dtype="<u4")
    tokens = made.agg(F.sum("n")).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // (BLOCKS_A_FILE * BLOCK)))
    key = F.coalesce("doc_id", F.lit(_LAST))
    found = made.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts))).first()[0]
    bounds = np.array(found[:parts - 1] if found else [], np.int64)

    def sums(batches):
        total = np.zeros(parts, np.int64)
        for b in batches:
            np.add.at(total, _ranges(bounds, b.column(0), b.column(1)), np.asarray(b.column(2)))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0], pa.int64())], ["range", "n"])

    total = np.zeros(parts + 1, np.int64)
    for r in made.select("doc_id", "row", "n").mapInArrow(sums, "range int, n long").groupBy("range").agg(F.sum("n").alias("n")).collect():
        total[r["range"] + 1] = r["n"]
    starts = np.cumsum(total)

    def encode(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                packed = pack([rank_of[np.frombuffer(x, kind)] for x in part.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(_ranges(bounds, part.column(0), part.column(1)), pa.int32()), *(part.column(i) for i in range(3)), *(pa.array([p[i] for p in packed], pa.binary()) for i in range(2))],
                                                 ["range", "doc_id", "row", "n", "control", "data"])

    def blocks(batches):
        held, full, at, now = [], 0, 0, None
        for b in batches:
            for r, d, _, n, control, data in zip(*(c.to_pylist() for c in b.columns)):
                if held and (r != now or full + n > BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([block(held, at)], pa.binary())], ["b"])
                    held, full, at = [], 0, at + full
                if r != now:
                    now, at = r, int(starts[r])
                held.append((d, n, control, data))
                full += n
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([block(held, at)], pa.binary())], ["b"])

    coded = made.mapInArrow(encode, "range int, doc_id long, row long, n long, control binary, data binary")
    ordered = coded.repartitionById(parts, F.col("range")).sortWithinPartitions("range", F.col("doc_id").asc_nulls_last(), "row")
    _as_files(ordered.mapInArrow(blocks, "b binary"), f"{path}/blocks", BLOCKS_A_FILE)
    _as_files(spark.createDataFrame([(bytearray(by_rank.tobytes()),)], "b binary").coalesce(1), f"{path}/ranks", 1)


def _as_files(df: DataFrame, path: str, rows: int) -> None:
    """Bytes as they are, a line feed after each row."""
    df.select(F.col("b").cast("string").alias("value")).write.option("maxRecordsPerFile", rows).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of every document in the folder; ids and their CRC-32 as little-endian unsigned 32-bit numbers.

    start counts the ids of all documents before it. Every file is read by one task, a few documents at a time.
    """
    ship(spark)
    table = _files(spark, f"{path}/ranks").first()[0]
    by_rank = np.frombuffer(bytes(table)[:-1], "<u4")

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for d, start, ids in documents(content.as_buffer(), by_rank):
                    data = ids.tobytes()
                    rows.append((d, start, len(ids), data, zlib.crc32(data)))
                    held += len(data)
                    if held > 1 << 22:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return _files(spark, f"{path}/blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])


def new_folder(spark: SparkSession) -> str:
    """A folder name of its own in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/token-ids-{uuid.uuid4().hex}"
