"""Token id files, tiered lexical search and importance resampling: brute force, round trips and hard rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerspark.llm import lexical, queries, resample, tokenids

from test_operators import HARD, SCHEMA, SF, _row

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "   ", "Don't STOP now \x1c a\x1fb \x85 c", "<|startoftext|> x <|endoftext|>", "é ́x İSTANBUL ΣΑΣ Σ ", "a" * 500 + " b", "12 345,6.7'll we're", "\U0001f600\U0001f600 中文 字　x", "tab\tnew\r\nline\x0bv\x0cf"]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


# 11

def test_word_ids_are_the_library_s():
    rng, t = random.Random(4), library()
    parts = ODD + ["the", "They're", "l'été", " ", "  ", "\n", " ", "ẍ", "̈", "ﬁ", "K", "<|startoftext|>", "'S", "9"]
    texts = ODD + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    ids = tokenids.WordIds(WORDS)
    assert ids.by_words and not tokenids.WordIds(public_tokenizers.path("byte_bpe_50k.json")).by_words
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in ids.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_coding_round_trip_by_hand_and_by_chance():
    (control, data), *rest = tokenids.pack([np.array([5, 256, 70000, 2**24, 0], "<u4"), np.array([], "<u4"), np.array([300], "<u4")])
    assert rest == [(b"", b""), (b"\x01", b"\x2c\x01\0\0\0")] and tokenids.pack([]) == []
    assert control == bytes([0b11100100, 0]) and data == bytes([5, 0, 1, 0x70, 0x11, 1, 0, 0, 0, 1, 0, 0, 0, 0])
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000, 70001):
        r = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
        c, d = (np.frombuffer(x, np.uint8) for x in tokenids.pack([r])[0])
        for step in (3, 1 << 16):
            assert (tokenids.unpack(c, d, step)[:n] == r).all()


def test_blocks_tell_when_they_are_cut():
    order = np.arange(10, dtype="<u4")
    b = tokenids.block([(3, 2, *tokenids.pack([np.array([1, 2])])[0]), (None, 0, b"", b"")], 7) + b"\n"
    assert [(d, s, x.tolist()) for d, s, x in tokenids.documents(b + b, order)] == [(3, 7, [1, 2]), (None, 9, [])] * 2
    for bad in (b[:-1], b[1:], b[:60]):
        with pytest.raises(Exception):
            list(tokenids.documents(bad, order))


def expected_files(rows):
    t, at, out = library(), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((i, len(ids), zlib.crc32(ids.tobytes())))
    return out


def in_order(got):
    got = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    return [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got]


def test_files_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert in_order(queries.op11_tokenids(spark, SF).collect()) == expected_files(docs.select("doc_id", "text").collect())


def test_files_of_hard_rows_and_of_one_id_in_most_rows(spark, hard, empty, monkeypatch):
    monkeypatch.setattr(tokenids, "BLOCK", 40)
    path = tokenids.new_folder(spark)
    tokenids.write(hard, path, WORDS)
    got = in_order(tokenids.read(spark, path).collect())
    want = expected_files((r[0], r[1]) for r in HARD)
    assert [r[0] for r in got] == [r[0] for r in want] and Counter(got) == Counter(want)
    path = tokenids.new_folder(spark)
    tokenids.write(empty, path, WORDS)
    assert tokenids.read(spark, path).collect() == []
    many = spark.createDataFrame([(7 if i % 10 else i, f"word {i % 3}") for i in range(400)], "doc_id long, text string").repartition(5)
    path = tokenids.new_folder(spark)
    tokenids.write(many, path, WORDS)
    got = in_order(tokenids.read(spark, path).collect())
    assert [r[0] for r in got] == sorted(r[0] for r in got) and len(got) == 400
    assert spark.read.format("binaryFile").load(path + "/blocks").where("length > 0").count() >= 3  # the frequent id lies in several ranges


def test_frequent_ids_have_the_first_ranks(spark):
    docs = spark.createDataFrame([(1, "the the the cat"), (2, "the cat zebra")], "doc_id long, text string")
    t = library()
    by_rank = tokenids.frequency_ranks(tokenids.tokenised(docs, WORDS, "doc_id", "text", 1), 49408)
    one = lambda w: t.encode(w, add_special_tokens=False).ids[0]
    assert by_rank[0] == one("the") and set(by_rank[1:3].tolist()) == {one("cat"), 1} and sorted(by_rank.tolist()) == list(range(49408))


# 12

def best_by_hand(docs, items, k=20):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_all, length = len(held), sum(x[2] for x in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, t in items:
        scores = []
        for i, c, n in held:
            m = 75 + (25 * n * n_all) // length
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in terms(t) if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_search_by_brute_force_at_every_tier(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10_000 + i, docs[3][1]) for i in range(40)]  # ties beyond k
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items + [(900, docs[3][1][:400]), (901, "zzzz qqqq"), (902, None)], "item_id long, text string")
    want = best_by_hand(docs, items + [(900, docs[3][1][:400])])
    for s in (lexical.Settings(), lexical.Settings(first=2, second=6, level=1), lexical.Settings(first=20, second=60, level=1 << 12, broadcast=1), lexical.Settings(first=0, second=0)):
        assert sorted(map(tuple, lexical.rank(d, q, settings=s).collect()), key=str) == want, s


def test_rare_terms_are_proven_in_the_first_tier(spark):
    """A frequent word's lower postings aren't joined with the item when rare words decide."""
    docs = spark.createDataFrame([(i, "common " * (1 + i % 7) + (f"rare{i // 25} other{i // 25} third{i // 25}" if i < 50 else "filler words")) for i in range(600)], "doc_id long, text string")
    items = lexical.analysed(lexical._numbered(spark.createDataFrame([(1, "common rare0 other0 third0")], "item_id long, text string"), "item_id", "text"))
    index = lexical.build(docs, settings=lexical.Settings(first=30, second=100))
    sizes = {r["tier"]: r["count"] for r in index.postings.where("term = 'common'").groupBy("tier").count().collect()}
    assert sizes.get(2, 0) > 300
    bars = lexical.search(index, items, 20).collect()
    assert [r["doc_id"] for r in bars][0] is not None and {r["doc_id"] for r in bars} <= set(range(25)) and len(bars) == 20


def test_search_on_hard_rows(spark, hard, empty):
    items = spark.createDataFrame([(1, "the SAME text", "x"), (1, "the SAME text", "y"), (2, None, "z"), (3, "", "z"), (None, "ligne palabra", "z"), (4, "!!", "z")], "item_id long, text string, row string")
    got = sorted(map(tuple, lexical.rank(hard, items).collect()), key=str)
    assert got == best_by_hand([(r[0], r[1]) for r in HARD], [(1, "the SAME text"), (1, "the SAME text"), (None, "ligne palabra")])
    assert lexical.rank(empty, items).collect() == [] and lexical.rank(hard, items.limit(0)).collect() == []


# 13

def drawn_by_hand(docs, target, s=resample.Settings()):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def feats(t):
        w = words(t)
        return Counter(zlib.crc32(" ".join(w[i:i + n]).encode()) % s.buckets for n in range(s.least, s.most + 1) for i in range(len(w) - n + 1))
    src, tgt = Counter(), Counter()
    for _, t in docs:
        src.update(feats(t))
    for t in target:
        tgt.update(feats(t))
    S, T = src.total(), tgt.total()
    gain = lambda b: math.floor(1000 * math.log((tgt[b] + 1) * (S + s.buckets) / ((src[b] + 1) * (T + s.buckets))))
    out = []
    for i, t in docs:
        f = feats(t)
        n = f.total()
        w = sum(gain(b) * c for b, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(t)) >= s.words))
    k = s.percent * sum(o[4] for o in out) // 100
    order = sorted((o for o in out if o[4]), key=lambda o: (-o[3], o[0] is None, o[0] or 0))[:k]
    return out, order


@pytest.mark.parametrize("settings", [resample.Settings(), resample.Settings(least=1, most=3, buckets=977, words=4, percent=30), resample.Settings(least=2, most=2)])
def test_resampling_by_brute_force(spark, monkeypatch, settings):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + [(5000, None), (5001, "one"), (5002, "!")]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    monkeypatch.setattr(resample, "_AT_ONCE", 5000)
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(t,) for t in target], "text string"), settings).collect()
    every, order = drawn_by_hand(docs, target, settings)
    assert sorted((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == sorted(o[:4] for o in every)
    assert [r["doc_id"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [o[0] for o in order]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(order) + 1))


def test_resampling_of_hard_rows(spark, hard, empty):
    docs = hard.unionByName(spark.createDataFrame([_row(20, "w " * 30)] * 7 + [_row(None, "v\x00 " * 25 + "É")] * 5, SCHEMA))
    target = spark.createDataFrame([("w palabra", 1), (None, 2)], "text string, doc_id int")
    s = resample.Settings(percent=50)
    got = resample.resample(docs, target, s).collect()
    every, order = drawn_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], ["w palabra", None], s)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(o[:4] for o in every)
    assert [r["doc_id"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [o[0] for o in order] and len(order) == 7
    assert resample.resample(empty, target).collect() == []
    none = resample.resample(docs, target.limit(0), s).collect()
    assert Counter((r["doc_id"], r["weight"]) for r in none) == Counter((o[0], o[2]) for o in drawn_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], [], s)[0])


def test_packing_remembers_a_bounded_number_of_words():
    import public_tokenizers
    from tokenizers import Tokenizer
    from ledgerspark.llm import packing
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, plain = packing.Ids(path), Tokenizer.from_file(path)
    texts = [" ".join(f"{k:x}q{i:x}" for i in range(2000)) for k in range(150)]
    for k, t in enumerate(texts):
        got = ids.encode([t])[0]
        assert len(ids.memory) <= 202_000  # 40 MB a core
        if k % 30 == 0 or k in (100, 101):
            assert got == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
