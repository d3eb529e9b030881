import zlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallyspark.llm import quality
from tests.llm.conftest import SF


def test_query_on_held_out_rows(spark, documents):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in quality.query(docs, labels).collect()}
    assert rows.keys() == {d["doc_id"] for d in documents}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["doc_id"] in rows and rows[r["doc_id"]].held_out}
    assert len(truth) > 40
    assert sum(rows[i].predicted == y for i, y in truth.items()) / len(truth) > 0.85
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.query(docs, flipped).collect()}
    assert again == {i: r.score for i, r in rows.items()}


def test_scores_by_force(spark, documents):
    """A score is the sum of one entry of each table, looked up one by one."""
    import bisect
    import math

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.classify(docs, model).collect()}
    for d in documents[::7]:
        x = quality.features([d["text"]])[0]
        total = model.base + sum(t[bisect.bisect_right(list(e), v)] for t, e, v in zip(model.tables, model.edges, x))
        for (i, j), t in zip(model.pairs, model.pair_tables):
            total += t[bisect.bisect_right(list(model.pair_edges[i]), x[i])][bisect.bisect_right(list(model.pair_edges[j]), x[j])]
        assert math.isclose(got[d["doc_id"]], 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_rows_to_fit_are_bounded(spark, monkeypatch):
    """Documents that repeat a labelled id do not add to the bound."""
    docs = spark.range(0, 400).select((F.col("id") % 20).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(0, 20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)))
    quality.train(docs, labels, fit_rows=15)
    assert seen == [15]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.query(docs, none).collect()] == [0.5, 0.5]


def test_odd_rows(spark, odd, none):
    docs = spark.read.parquet(odd)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (8, 1, None), (8, 0, 1), (None, 1, 1), (7, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.classify(docs.withColumn("score", F.lit("clash")), model)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert set(out.columns) == {*docs.columns, "score", "predicted"}
    empty = quality.train(spark.read.parquet(none), labels.limit(0))
    assert quality.classify(spark.read.parquet(none), empty).count() == 0
