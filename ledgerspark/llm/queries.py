"""The subpackage's queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, html, langid, lexical, licences, lines, packing, quality, resample, simhash, tokenids, topk

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, table(spark, sf_dir, "labels"), host=F.col("source"), path=F.concat_ws("/", "source", "lang"))


def op2_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_exact(spark, sf_dir):
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_html(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op6_simhash(spark, sf_dir):
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op7_licences(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op9_lines(spark, sf_dir):
    return lines.decide(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_tokenids(spark, sf_dir):
    path = tokenids.new_folder(spark)
    tokenids.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenids.read(spark, path).drop("ids")


def op12_lexical(spark, sf_dir):
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_resampling(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    found = [op1_quality, op2_language, op3_exact, op4_bpe, op5_html, op6_simhash, op7_licences, op8_topk, op9_lines, op10_packing, op11_tokenids, op12_lexical, op13_resampling]
    return {f.__name__: f for f in found}


OP3_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as n from documents),
g as (select n, min(doc_id) as keep_id, count(*) as group_size from t group by n)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.n) as text_sha256
from t join g on t.n = g.n
"""

OP8_SQL = """
with e as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings where embedding is not null),
fine as (select vec_id, count(*) as n from e group by vec_id having count(*) = count(x) and bool_and(isfinite(x))),
v as (select e.vec_id, e.i, fine.n, floor(256 * e.x)::bigint as x from e join fine on e.vec_id = fine.vec_id),
s as (select q.vec_id as query_id, c.vec_id, sum(q.x * c.x)::bigint as score
      from v q join v c on q.i = c.i and q.n = c.n and q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by q.vec_id, c.vec_id),
r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5
"""


OP12_SQL = r"""
with words as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
sizes as (select doc_id, count(*) as n from words group by doc_id),
whole as (select count(*) as docs, sum(n)::bigint as len from sizes),
post as (select doc_id, term, count(*) as tf from words group by doc_id, term),
w as (select term, floor(1000 * ln((2 * whole.docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from post, whole group by term, whole.docs),
asked as (select item_id, term, count(*) as c from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by item_id, term),
scores as (select item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len))))::bigint as score
           from asked join w using (term) join post using (term) join sizes using (doc_id), whole group by item_id, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
select item_id, rank::integer as rank, doc_id, score from r where rank <= 20
"""

#: CRC-32 of distinct words, byte by byte, with its table made by rule.
OP13_SQL = r"""
with crc as (select list(c order by i) as tab from (select i, list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i) as c from range(256) r(i))),
dw as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as f from documents),
bw as (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as f from benchmark),
bytes as (select f, list_transform(range(len(hex(encode(f))) // 2), lambda k: ('0x' || hex(encode(f))[2 * k + 1:2 * k + 2])::bigint) as b from (select f from dw union select f from bw)),
b as (select f, xor(list_reduce(b, lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1]), 4294967295::bigint), 4294967295) % 10000 as bucket from bytes, crc),
s as (select bucket, count(*) as s from dw join b using (f) group by bucket),
t as (select bucket, count(*) as t from bw join b using (f) group by bucket),
whole as (select (select sum(s) from s)::double as s, (select sum(t) from t)::double as t),
gain as (select bucket, floor(1000 * ln((coalesce(t.t, 0) + 1)::double * (whole.s + 10000) / ((coalesce(s.s, 0) + 1)::double * (whole.t + 10000))))::bigint as g from s full join t using (bucket), whole),
fed as (select doc_id, count(*) as n, sum(g) as total from dw join b using (f) join gain using (bucket) group by doc_id),
weighed as (select doc_id, coalesce(n, 0) as n_features, coalesce(floor(total / n), 0)::bigint as weight from documents left join fed using (doc_id)),
scored as (select *, (weight + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::bigint + 0.5::double) / 4294967296))))::bigint as score from weighed),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as fit from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= (10 * fit) // 100 then rank end as rank from scored left join ranked using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact": OP3_SQL, "op8_topk": OP8_SQL, "op12_lexical": OP12_SQL, "op13_resampling": OP13_SQL}
