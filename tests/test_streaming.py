"""Streams give the rows of the batch operators on the same documents."""

import random


from ledgerspark.operators import matching
from ledgerspark.sources.adapter import Ledger
from ledgerspark.streaming import ingest

SF = "/root/testdata/sf0.001"


def parts(df, path, n):
    """Files of consecutive ids, one a micro-batch."""
    rows = sorted(df.collect(), key=lambda r: r[0])
    size = -(-len(rows) // n)
    for k in range(n):
        df.sparkSession.createDataFrame(rows[k * size:(k + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, df, path, n):
    parts(df, path, n)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collected(df, tmp_path, reduce=None):
    out = []
    q = df.writeStream.foreachBatch(lambda b, _: out.extend((reduce(b) if reduce else b).collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return out


def test_stream_of_duplicates_equals_the_cascade(spark, tmp_path):
    a = Ledger(spark, SF).asientos.where("id % 50 = 0 or id < 600 or id >= 10000000").select("id", "actividad_id", "factura_id", "estado", "fecha", "total_c", "emisor", "nif_emisor", "numero_factura")
    want = {tuple(r) for r in matching.cascade(a).collect()}
    got = collected(ingest.duplicate_hits(stream(spark, a, str(tmp_path / "in"), 3)), tmp_path, ingest.first_hits)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 5


def test_stream_of_duplicates_after_a_snapshot(spark, tmp_path):
    a = Ledger(spark, SF).asientos.where("id % 50 = 0 or id >= 10000000").select("id", "actividad_id", "factura_id", "estado", "fecha", "total_c", "emisor", "nif_emisor", "numero_factura")
    old, new = a.where("id < 10000000"), a.where("id >= 10000000")
    got = collected(ingest.duplicate_hits(stream(spark, new, str(tmp_path / "in"), 2), snapshot=old), tmp_path, ingest.first_hits)
    want = {tuple(r) for r in matching.cascade(a).collect() if r["id"] >= 10000000}
    assert {tuple(r) for r in got} == want and want


def test_stream_of_documents_equals_clusters(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, 1, rng.choice(["SN", "F1"]), *rng.choice([("A", "X"), ("B", "Y"), (None, "Z")]), rng.choice([None, *range(1000, 1010), 5000]), 1) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, actividad_id long, numero string, nif string, emisor_norm string, total_c long, pagina int")
    want = {(r["doc_id"], r["factura_id"]) for r in matching.cluster(df).collect()}
    got = collected(ingest.resolve(stream(spark, df.withColumnRenamed("id", "doc_id"), str(tmp_path / "in"), 4)), tmp_path)
    assert {(r["doc_id"], r["factura_id"]) for r in got} == want and len(got) == 150
    last = {}
    for r in got:
        last[r["doc_id"]] = r["conflicto"]
    assert last[0] is False and any(last.values())


def test_repeated_ids_and_missing_parts(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "N1", "A", "X", None, 1), (2, None, "N1", "A", "X", 5, 1), (3, 1, None, None, None, 5, 1)], "doc_id long, actividad_id long, numero string, nif string, emisor_norm string, total_c long, pagina int")
    got = collected(ingest.resolve(stream(spark, df, str(tmp_path / "in"), 1)), tmp_path)
    assert {(r["doc_id"], r["factura_id"]) for r in got} == {(1, 1), (2, 2), (3, 3)}
