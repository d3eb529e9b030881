"""What the driver gathers comes as columns: rows of Python's objects would take many times the memory."""

from tallyspark.llm import near_dedup, quality


def test_gathered_as_columns(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i} and more") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")

    def refused(self):
        raise AssertionError("rows on the driver")

    monkeypatch.setattr(type(docs), "toPandas", refused)
    assert 1 <= near_dedup.inverse_frequencies(docs).min() <= near_dedup.inverse_frequencies(docs).max() <= 2
    assert quality.classify(docs, quality.train(docs, labels)).count() == 40
