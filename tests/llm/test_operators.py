"""The ten operators against brute force, and on hard rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import html as entities
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerspark.llm import bpe, common, exact, html, langid, licences, lines, packing, quality, queries, simhash, topk

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, fp long, host string, sha string, band long, size long, length long, p double"
RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
LONG = "Licensed under the Apache License, Version 2.0.\n" + "palabra nueva otra vez  con   espacios\t" * 9000


def _row(i, text, lang="en", source="s1"):
    return (i, text, lang, source, None, 1, "x", 2, "h", "s", 3, 4, 5, 0.5)


HARD = [_row(1, None), _row(2, ""), _row(3, "   \t "), _row(4, "the same text here"), _row(5, "the  same\ttext here"), _row(5, "the  same\ttext here"), _row(6, "the same text here", None, None),
        _row(None, "the same text here"), _row(None, None, None, None), _row(7, LONG), _row(8, LONG + "x"), _row(9, "12 34 !!"), _row(10, "é\U0001f600 <|endoftext|> a  b \n c d"), _row(11, "une ligne\nthe same text here\n\n", "fr")]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def spread(x):
    return re.sub("[\x20\x09-\x0d]+", " ", x or "")


# 1

def test_quality_keeps_clean_documents(spark):
    got = queries.op1_quality(spark, "/root/testdata/sf0.01").select("doc_id", "keep", "quality").toPandas().merge(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("good")).toPandas(), on="doc_id")
    assert got[got.good == 1].keep.mean() > 0.99
    assert (~got[got.good == 0].keep).mean() > 0.8


def test_quality_posteriors_by_brute_force(spark, docs):
    """Every posterior and decision from the documents' scores, with plain loops."""
    s = quality.Settings()
    got = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"), host=F.col("source"), path=F.concat_ws("/", "source", "lang")).toPandas().merge(
        docs.select("doc_id", "source", "lang").toPandas(), on="doc_id")
    site = lambda r: (r.source, r.source + ("/" + r.lang if isinstance(r.lang, str) else "") if isinstance(r.source, str) else r.lang)
    rows = [(*site(r), r.document_score) for r in got.itertuples()]

    def strength(level):
        by = defaultdict(list)
        for r in rows:
            by[r[:1] if level == 0 else r[:2]].append(r[2])
        parents = defaultdict(list)
        for key, x in by.items():
            parents[key[:level]].append(x)
        noise = sum(p * (1 - p) for r in rows for p in (r[2],)) / len(rows)
        spread = sum(len(x) * (np.mean(x) - np.mean(sum(xs, []))) ** 2 for xs in parents.values() for x in xs)
        scale = sum(sum(map(len, xs)) - sum(len(x) ** 2 for x in xs) / sum(map(len, xs)) for xs in parents.values())
        free = len(by) - len(parents)
        between = (spread - free * noise) / max(scale, 1e-9)
        return by, float(np.clip(noise / between if between > 0 else s.strength[1], *s.strength)) if free else s.strength[1]

    (hosts, a), (paths, b) = strength(0), strength(1)
    rate, odds = np.mean([r[2] for r in rows]), lambda x: np.log(np.clip(x, 1e-4, 1 - 1e-4) / (1 - np.clip(x, 1e-4, 1 - 1e-4)))
    for r, (h, q, p) in zip(got.itertuples(), rows):
        host = (sum(hosts[(h,)]) - p + a * rate) / (len(hosts[(h,)]) - 1 + a)
        path = (sum(paths[h, q]) - p + b * host) / (len(paths[h, q]) - 1 + b)
        good = 1 / (1 + np.exp(-(odds(p) + s.weight * (odds(path) - np.log(rate / (1 - rate))))))
        assert np.allclose((r.host_posterior, r.path_posterior, r.quality), (host, path, good), rtol=1e-6) and r.keep == (good >= s.threshold)


def test_quality_paths_are_measured_against_their_host(spark):
    """Ten hosts that differ, each with ten paths of exactly its rate: hosts are believed, paths shrunk as far as may be."""
    own = quality.Settings()
    rate = lambda h: 0.05 + 0.1 * h
    paths = spark.createDataFrame([(f"h{h}", f"p{q}", 50.0, 50 * rate(h), 50 * rate(h) * (1 - rate(h))) for h in range(10) for q in range(10)], "host string, path string, n double, s double, v double")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("v").alias("v"))
    assert quality.strength(quality._moments(paths, "host"), own) == own.strength[1]
    assert quality.strength(quality._moments(hosts), own) < 5
    lone = paths.where("path = 'p0'")
    assert quality.strength(quality._moments(lone, "host"), own) == own.strength[1]  # no host tells anything about its paths


def test_quality_fit_takes_its_sample_by_hash(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    twice = docs.union(docs)
    s = quality.Settings(sample=20)
    one, two = (sorted(map(tuple, quality.classify(d, x, settings=s).select("doc_id", F.round("document_score", 9)).distinct().collect())) for d, x in ((docs, labels), (twice, labels.union(labels).repartition(5))))
    assert one == two


def test_quality_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(4, 1), (4, 1), (9, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    assert quality.classify(hard, labels, host=F.col("source")).count() == len(HARD)
    assert quality.classify(hard, labels.limit(0), host=F.col("source")).count() == len(HARD)
    assert quality.classify(empty, labels).count() == 0


# 2

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))


def test_language_hard_rows(hard, empty):
    got = langid.identify(hard).collect()
    assert len(got) == len(HARD)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 9)} == {"und"}
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(hard.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_grams_of_long_texts_and_clashing_columns(spark, hard, monkeypatch):
    s = langid.Settings()
    text = "Árbol 12 naïve Straße " * 40
    whole = langid._counts(text, s)
    monkeypatch.setattr(langid, "BLOCK", 7)
    cut = langid._counts(text, s)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and whole[1].sum() == 3 * len(text) - 3
    model = langid.train(hard)
    docs = hard.withColumn("score", F.lit(7.0)).withColumn("lang_pred", F.lit("x")).withColumn("found", F.lit("y")).withColumn("_text", F.lit("z"))
    got = langid.accepted(docs, model, 0.0)
    assert got.columns == docs.columns and {(r.score, r.lang_pred, r.found) for r in got.collect()} == {(7.0, "x", "y")}


def test_language_training_by_brute_force():
    """FTRL with a plain loop over classes and features."""
    s = langid.Settings(buckets=16, epochs=2)
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(16, 4, replace=False)), rng.random(4), int(rng.integers(3))) for _ in range(30)]
    got_w, got_b = langid.ftrl(rows, 3, s)
    z, n = np.zeros((17, 3)), np.zeros((17, 3))

    def weight(i, c):
        return 0.0 if abs(z[i, c]) <= s.l1 else -(z[i, c] - np.sign(z[i, c]) * s.l1) / ((s.beta + np.sqrt(n[i, c])) / s.alpha + s.l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for r in order.permutation(30):
            at, x, y = rows[r]
            full = [*zip(at.tolist(), x.tolist()), (16, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in full for c in range(3)}
            e = np.exp([sum(v * w[i, c] for i, v in full) for c in range(3)])
            for i, v in full:
                for c in range(3):
                    g = v * (e[c] / e.sum() - (c == y))
                    z[i, c] += g - (np.sqrt(n[i, c] + g * g) - np.sqrt(n[i, c])) / s.alpha * w[i, c]
                    n[i, c] += g * g
    want = np.array([[weight(i, c) for c in range(3)] for i in range(17)])
    assert np.allclose(got_w, want[:16]) and np.allclose(got_b, want[16])


# 3

def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[spread(t)].append(i)
    return groups


def test_exact_hard_rows(hard, empty):
    got = exact.exact_dedup(hard).collect()
    groups = brute_exact([(r[0], r[1]) for r in HARD])
    by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(got) == len(HARD)
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    for sha in by:
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
    assert exact.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("cut", [0, 1, 70_000, 131_072])
def test_fingerprints_compose(cut):
    data = bytes(range(256)) * 600
    for b, p in zip(exact.BASES, exact.PRIMES):
        def whole(d):
            h = 0
            for at in range(0, len(d), exact.PIECE):
                h = exact.combine(h, exact.piece_hash(d[at:at + exact.PIECE], b, p), len(d[at:at + exact.PIECE]), b, p)
            return h
        assert exact.combine(whole(data[:cut]), whole(data[cut:]), len(data) - cut, b, p) == whole(data)


def test_equal_fingerprints_are_compared(spark, hard, monkeypatch):
    monkeypatch.setattr(exact, "fingerprints", lambda d, i, t: d.select(F.col(i).alias("id"), exact.normalise(F.col(t)).cast("binary").alias("b")).groupBy(
        "id", F.sha2("b", 256).alias("sha"), F.lit(0).alias("size"), F.lit(1).cast("long").alias("h0"), F.lit(1).cast("long").alias("h1")).agg(F.count("*").alias("copies")))
    got = exact.exact_dedup(hard.where("doc_id is not null and doc_id not in (7, 8)")).collect()
    assert {r.doc_id: r.group_size for r in got if r.doc_id in (1, 2, 4, 9)} == {1: 2, 2: 2, 4: 4, 9: 1}


# 4

def reference_encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes(hard, docs, empty):
    ref = reference_encoder()
    for df in (hard, docs):
        for r in bpe.encode(df.where("doc_id is not null").dropDuplicates(["doc_id"]), RANKS, public_tokenizers.PATTERN).join(
                df.where("doc_id is not null").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("k"), "text"), F.col("id") == F.col("k")).collect():
            assert list(r.ids) == ref.encode_ordinary(r.text or "")
    got = bpe.digests(hard, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(HARD)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for x in HARD:
        ids = ref.encode_ordinary(x[1] or "")
        want.append((x[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha((x[1] or "").encode())))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_pairs_and_backtracking():
    c, rng = bpe.codec(RANKS, public_tokenizers.PATTERN), np.random.default_rng(5)
    for a, b in rng.integers(0, 3000, (20_000, 2)).tolist():
        assert c.fits(a, b) == (c.merge(c.token[a] + c.token[b]) == [a, b])
    for n in (1, 2, 7, 40, 300):
        for _ in range(40):
            data = bytes(rng.choice(list(b"aeinrst "), n).tolist())
            assert c.encode_match(data) == ([c.rank[data]] if data in c.rank else c.merge(data))


def test_bpe_one_very_long_match(monkeypatch):
    c, rng = bpe.codec(RANKS, public_tokenizers.PATTERN), np.random.default_rng(6)
    data = bytes(rng.choice(list(b"aeinrst"), 3000).tolist())
    want = c.encode_match(data)
    assert want == c.merge(data)
    monkeypatch.setattr(bpe, "WINDOW", 50)
    assert c.encode_match(data) == want
    monkeypatch.undo()
    long = data * 700  # 2 MB
    ids = c.encode_match(long)
    assert b"".join(c.token[i] for i in ids) == long and long.decode() not in c.matches


# 5

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header>Site</header><nav><a>Menu</a></nav><div class="cookie-notice">Accept</div>
<article><h1>A &amp; B</h1><p>one<br>two   <b>three<p>four<div class="ad">buy</div><ul><li>x<li>y</ul><script>if (a<b) "</article>"</script><form><input>send</form><!-- c --></article>
<aside>side</aside><div id="comments"><p>reader</p></div><footer>end</footer></body></html>"""


def test_html_page():
    own = html.Settings()
    assert html.main_text(PAGE, (), own) == "A & B\none two three\nfour\nx\ny"
    assert html.blocks(None) == [] and html.blocks("<p>cut <a href='") == [("/p", "cut", 1.0)]
    assert html.main_text("<article><p>a <math><mi>x</mi></math> b<canvas>c</canvas><p>d</article>", (), own) == "a x bc\nd"
    assert html.main_text("<body><nav>menu</nav><div><p>no article here</div><footer>end</footer>", (), own) == "no article here"


def test_html_tree_by_brute_force(spark):
    rng = np.random.default_rng(4)
    words = lambda: " ".join(rng.choice(list("abcdefgh"), 2))
    rows = [(f"h{i % 3}", f"<body><nav>{words()}</nav><div class=box><p>{words()}</p><p>{words()}</p></div><section><h2>Same</h2><p>own {i}</p></section>") for i in range(60)]
    got = {(r.host, r.path): (r.pages, r.importance) for r in html.tree(spark.createDataFrame(rows, "host string, html string"), html.Settings()).collect()}
    own, want = html.Settings(), {}
    for host in ("h0", "h1", "h2"):
        seen = defaultdict(list)
        for page in (page for h, page in rows if h == host):
            found = html.blocks(page)
            for path, ts in html.nodes(found).items():
                texts = [t for p, t, _ in found if p == path] or ts
                runs = {" ".join(t.split(" ")[i:i + own.words]) for t in texts for i in range(max(1, len(t.split(" ")) - own.words + 1))}
                hashes = [(x - 2**64 if x >= 2**63 else x) for x in (xxhash.xxh64_intdigest(r) for r in runs)]
                seen[path].append((*[min(x ^ int(salt) for x in hashes) for salt in html._salts(own.minima)], len(ts)))
        for path, xs in seen.items():
            part = []
            for k in range(own.minima + 1):
                c = np.array(list(Counter(x[k] for x in xs).values()), float)
                part.append(1 - (c * np.log(c)).sum() / (c.sum() * np.log(c.sum())) if c.sum() > 1 else 1.0)
            m = len(xs)
            want[host, path] = (m, (m * ((1 - own.share) * np.mean(part[:-1]) + own.share * part[-1]) + own.prior) / (m + own.prior))
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert got["h0", "/body/section/h2"][1] < own.threshold < got["h0", "/body/section/p"][1]


def test_html_tables_by_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html.extract(pages).join(pages.select(F.col("page_id").alias("k"), "html"), F.col("page_id") == F.col("k")).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:p|h1|li|ul)\b[^>]*>", "\n", inner)).split("\n")
        assert r.text == "\n".join(x for x in (" ".join(entities.unescape(p).split()) for p in parts) if x) and r.n_chars == len(r.text)


def test_html_site_tree_drops_repeated_branches(spark):
    page = "<body><div class='x'>Same words on all pages</div><div class='y'><p>Own words {0} of page {0}</p></div></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(16)] + [(20, "http://b.example/1", page.format(1)), (21, None, None), (22, "", "")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own words 3 of page 3" and got[20].startswith("Same words") and got[21] == got[22] == "" and len(got) == 19
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_boilerplate_with_a_number_goes(spark):
    """A footer of nine words whose date changes goes on pages without an article; texts of their own stay, also directly in the body."""
    rng = np.random.default_rng(5)
    own = ["Text " + " ".join(rng.choice([f"w{k}" for k in range(500)], 12)) for _ in range(40)]
    page = "<body>{0}<div class=x1>Shop of many things in a street, updated {1}</div><div class=y><p>Own {0}</p></div></body>"
    rows = [(i, f"http://c.example/{i}", page.format(own[i], i)) for i in range(40)]
    rows += [(100 + i, f"http://d.example/{i}", f"<body><article><p>{own[i]}</p><div class=x1>Edition of a book that has many pages, {i}</div></article></body>") for i in range(40)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{own[i]}\nOwn {own[i]}" for i in range(40))
    assert all(got[100 + i] == f"{own[i]}\nEdition of a book that has many pages, {i}" for i in range(40))


def test_html_names_in_an_article():
    keep = ('<div class="related-work"><p>a</div><section id="search"><h2>b</h2></section><p class="side note">c</p><blockquote class="share">d</blockquote>'
            '<div class="advertising-history">e2</div><section id="comments-on-the-law">e</section>')
    gone = '<div class="share-buttons">x</div><div class="related-posts">x</div><section class="ad">x</section><div id="comments"><p>x</div><aside>x</aside>'
    assert html.main_text(f"<article>{keep}{gone}<p>f</p></article><article class='comment'><p>reader</p></article>", (), html.Settings()) == "a\nb\nc\nd\ne2\ne\nf"
    assert html.main_text("<article><p>a</p><article class='reply'>x</article><article><p>part</p></article></article>", (), html.Settings()) == "a\npart"


# 6

def slow_fingerprint(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(fps, most):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_by_brute_force(docs, texts, hard, empty):
    got = sorted(simhash.near_dedup(docs).collect())
    fps = [int(r.fingerprint, 16) for r in got]
    assert fps[:60] == [slow_fingerprint(texts[r.doc_id], 3) for r in got[:60]]
    assert [got[i].doc_id for i in closure(fps, 2)] == [r.component_id for r in got]
    assert simhash.near_dedup(hard).count() == len(HARD) and simhash.near_dedup(empty).count() == 0
    zero = {r.component_id for r in simhash.near_dedup(hard).collect() if r.doc_id in (1, 2, 3)}
    assert zero == {1}


def test_simhash_forest_and_masks():
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**63))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))} | {int(x) for x in rng.integers(0, 2**63, 50)})
    got = simhash.forest(np.array(fps, np.uint64), 2)
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in got:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = closure(fps, 2)
    assert len({find(i) for i in root}) == len(set(want)) and len(got) == len(fps) - len(set(want))
    # a crowded block gives the same components
    crowd = np.array(sorted({(base & ~0xFFF) | int(x) for x in rng.integers(0, 4096, 200)}), np.uint64)
    root = list(range(len(crowd)))
    for i, j in simhash.crowded(crowd, 2):
        root[i] = j
    assert [int(crowd[i]) for i in root] == [int(crowd[i]) for i in closure([int(x) for x in crowd], 2)]
    for a in range(0, 64, 7):
        for b in range(64):
            assert any((m & ((1 << a) | (1 << b))) == 0 for m in simhash.masks())


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 105), (105, 103), (200, 200), (None, 3)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 105: 100, 103: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7

def test_licences_base_by_brute_force(docs, texts, hard, empty):
    for r in licences.scan(docs).collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or ""))
        at = [(i, s) for p, s in licences.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == (min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({s for _, s in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert licences.scan(hard).count() == len(HARD) and licences.scan(empty).count() == 0


def test_licence_templates():
    a = licences.compile_template("(( a | b )) x [[ y {{2}} ]] z")
    accepts = lambda t: a.match(licences.words(t), 0) == len(licences.words(t))
    assert all(map(accepts, ("a x z", "b x y z", "A x, y q z", "a x y q r z"))) and not any(map(accepts, ("x z", "a x y q r s z", "a x q z", "a b x z")))
    s = licences.Scanner()
    assert [m[2] for m in s.scan("Licensed under the Apache License, Version 2.0.")[1]] == ["apache-2.0"]
    assert not s.scan("Licensed under the Apache Licence, Version 2.0.")[1]


# 8

def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-6, 7, 5) / 8]) for i in range(400)]
    rows += [(400, None), (450, [1.0, None, 1.0, 1.0, 1.0]), (451, [float("nan")] * 5), (452, [float("inf")] * 5), (453, []), (None, [1.0] * 5), (7, rows[7][1])]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    v = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows[:400] + rows[-2:]]
    assert set(got) == set(range(0, 400, 50))
    for q in got:
        own = next(x for i, x in v if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, x)), i is None, i or 0) for i, x in v if i != q)[:5]
        assert sorted(got[q], key=repr) == [(k + 1, None if none else c, -s) for k, (s, none, c) in enumerate(best)]
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few, lambda i: i == 0).collect()] == [(0, 1, 1, 131072)]
    assert topk.top_k(few.limit(0), lambda i: i == 0).count() == 0
    # a repeated query row asks twice and is its twin's candidate; scores stay exact beyond 2**53
    big = spark.createDataFrame([(0, [2.0**20, 1.0]), (0, [2.0**20, 1.0]), (1, [2.0**20, 2.0]), (2, [2.0**-8, 0.0])], "vec_id long, embedding array<double>")
    want = [(0, 1, 1, 2**56 + 131072), (0, 2, 0, 2**56 + 65536), (0, 3, 2, 2**28)]
    assert sorted(tuple(r) for r in topk.top_k(big, lambda i: i == 0).collect()) == sorted(want * 2)


# 9

def test_lines_against_brute_force(docs, hard, empty):
    s = lines.Settings()
    got = lines.decide(docs).collect()
    place = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in got}
    known = {(r.doc_id, r.pos): r.line for r in lines.lines(docs, "doc_id", "text").collect()}
    assert set(place) == set(known)
    sets, where = {}, {}
    for k, line in known.items():
        sets[line] = frozenset(line[i:i + s.shingle] for i in range(max(1, len(line) - s.shingle + 1)))
        where.setdefault(line, set()).add(place[k])
    assert all(len(x) == 1 for x in where.values())  # equal lines share their fate
    index, pairs = defaultdict(list), set()
    for line, x in sets.items():
        for sh in x:
            index[sh].append(line)
    for ls in index.values():
        pairs |= {(a, b) for a in ls for b in ls if a < b}
    alike = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= s.similarity * len(sets[a] | sets[b])]
    assert sum(where[a] == where[b] for a, b in alike) >= 0.95 * len(alike)
    heads = {k for k, v in place.items() if k == v}
    assert {tuple(v) for v in place.values()} == heads and all(r.kept == ((r.doc_id, r.line_no) in heads) for r in got)
    assert lines.decide(empty).count() == 0
    assert lines.decide(hard).where("kept").count() >= 5


def passage_pairs(n, seed=5):
    """2 * n lines of one passage of 300 characters and 80 of their own: similar within a pair, under 0.8 between pairs."""
    rng = np.random.default_rng(seed)
    word = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), k))
    passage, own = word(300), [word(50) for _ in range(n)]
    return [(2 * i + j, passage + own[i] + word(30)) for i in range(n) for j in range(2)]


def test_lines_of_a_frequent_passage_meet_their_like(spark):
    rows = passage_pairs(100)
    got = {r.doc_id: r.keep_doc_id for r in lines.decide(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_lines_of_boilerplate_meet_their_like(spark):
    # 3,000 pairs of lines of about 105 characters, 88 of them the same in all: similar within a pair, under 0.8 between pairs
    rng = np.random.default_rng(8)
    word = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), k))
    common_part, rows = word(88), []
    for i in range(3000):
        own = word(17)
        rows += [(2 * i, common_part + own), (2 * i + 1, common_part + own + word(4))]
    got = {r.doc_id: r.keep_doc_id for r in lines.decide(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {t[k:k + 7] for k in range(len(t) - 6)} for i, t in rows}
    alike = [i for i in range(0, 6000, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(alike) > 2900 and sum(got[i] == got[i + 1] for i in alike) >= 0.99 * len(alike)
    assert len(set(got.values())) > 2900


def test_links_in_a_bucket_whose_shingles_are_all_frequent(spark):
    # sets of ten shingles out of twelve frequent ones: no rare shingle separates them
    rng = np.random.default_rng(3)
    sets = {i: frozenset(rng.choice(14, 10, replace=False).tolist()) for i in range(60)}
    sh = spark.createDataFrame([(k, h) for k, x in sets.items() for h in x], "k1 long, h long")
    likeness = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    alike = lambda pairs: spark.createDataFrame([(r.a, r.b) for r in pairs.collect() if likeness[r.a, r.b] >= 0.8], "a long, b long")
    banded = spark.createDataFrame([(k, 1, 0) for k in sets], "k1 long, band long, sketch long")
    found = common.links(banded, lambda keys: sh.join(keys, "k1", "left_semi"), alike, 0.8, 1000, lambda x: x == 0)
    every = spark.createDataFrame([p for p, x in likeness.items() if x >= 0.8], "a long, b long")
    assert sorted(common.components(found).collect()) == sorted(common.components(every).collect())


def test_links_in_large_bands_meet_by_what_is_rare_there(spark):
    # two bands; what is common to all of one is what single members of the other have of their own, so over both bands nothing is rare
    rng = np.random.default_rng(11)
    base, sets = [range(0, 60), range(60, 120)], {}
    for i in range(240):
        own = rng.choice(list(base[1 - i % 2]), int(rng.choice([4, 20])), replace=False).tolist()
        sets[i] = frozenset(rng.choice(list(base[i % 2]), 50, replace=False).tolist() + own) if i < 200 or i % 4 < 2 else sets[i - 2] ^ {0, 61}
    likeness = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    asked = []

    def alike(pairs):
        asked.append([(r.a, r.b) for r in pairs.collect()])
        return spark.createDataFrame([p for p in asked[-1] if likeness[p] >= 0.8], "a long, b long")

    raw = spark.createDataFrame([(k, ",".join(map(str, x))) for k, x in sets.items()], "k1 long, raw string")
    banded = spark.createDataFrame([(k, k % 2, 0) for k in sets], "k1 long, band long, sketch long")
    found = common.links(banded, lambda keys: raw.join(keys, "k1", "left_semi"), alike, 0.8, 1000, lambda x: x == 0, lambda c: F.split(c, ",").cast("array<long>"))
    every = spark.createDataFrame([p for p, x in likeness.items() if x >= 0.8 and (p[1] - p[0]) % 2 == 0], "a long, b long")
    assert sorted(common.components(found).collect()) == sorted(common.components(every).collect())
    assert sum(map(len, asked)) < sum((b - a) % 2 == 0 for a, b in likeness) / 2


def test_lines_dedup_keeps_columns(hard):
    out = lines.dedup(hard)
    assert out.columns == hard.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert 1 in got and 2 in got and got[4] == "the same text here" and 6 not in got and got[11] == "une ligne\n\n"


# 10

def check_packing(rows, texts):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, ps in by.items():
        ids, at = t.encode(texts[i] or "", add_special_tokens=False).ids + [2], 0
        for k, r in enumerate(sorted(ps, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            assert k == 0 or r.length == 1024
            at += r.length
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    return len(seqs)


def test_packing_by_brute_force(docs, texts, hard, empty):
    rows = packing.pack(docs, JSON).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert check_packing(rows, texts) <= 1.02 * sum(r.length for r in rows) / 1024 + 1
    one = hard.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(one, JSON).collect(), {r.doc_id: r.text for r in one.collect()})
    assert packing.pack(hard, JSON).where("piece = 0").count() == len(HARD)
    assert packing.pack(empty, JSON).count() == 0


def test_packing_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(9)
    for _ in range(500):
        sizes = {int(s): int(n) for s, n in zip(rng.integers(1, 60, 12), rng.integers(1, 30, 12))}
        runs, gaps = packing.plan(sizes, 64), []
        for size in sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True):
            fits = [g for g in gaps if g >= size]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - size)
            else:
                gaps.append(64 - size)
        assert len({q + k for _, _, n, q, _ in runs for k in range(n)}) == len(gaps)
        for size, n in sizes.items():
            assert sorted(r for s, a, m, _, _ in runs if s == size for r in range(a, a + m)) == list(range(n))
