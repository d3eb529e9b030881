import hashlib

from tallyspark.llm import exact_dedup, line_dedup
from tests.llm.conftest import SF, same


def test_exact_sql(spark, duck):
    same(exact_dedup.query(spark, SF).toPandas(), duck.sql(exact_dedup.SQL).df())


def test_exact_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(spark, odd).collect()}
    assert {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 5, 3, False), (9, 9, 2, True), (8, 8, 1, True)} <= got
    assert exact_dedup.exact_duplicates(spark, none).count() == 0


def test_exact_state_goes_on(spark, tmp_path):
    path, checkpoint = str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    for rows in ([(1, "a"), (2, "b")], [(3, "a")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        exact_dedup.update_state(spark, path, checkpoint)
    assert {(r.keep_id, r.group_size) for r in exact_dedup.state(spark, checkpoint).collect()} == {(3, 2), (2, 1)}


def test_exact_increment_reads_new_files_and_hits(spark, tmp_path, monkeypatch):
    """A collision with a content of an earlier file is found, in a folder with pattern characters and a trailing slash."""
    from pyspark.sql import functions as F

    sha2 = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: sha2(F.substring(c, 1, 1), n))
    path, checkpoint = str(tmp_path / "docs[1]{x}.parquet") + "/", str(tmp_path / "state")
    asked = []
    kept = exact_dedup._contents
    monkeypatch.setattr(exact_dedup, "_contents", lambda s, p, a, t: asked.append(sorted({r.file for r in a.collect()})) or kept(s, p, a, t))
    for rows in ([(1, "a1"), (2, "b")], [(3, "b"), (4, "c")], [(5, "a2"), (6, "a1"), (7, "d")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(spark, path, checkpoint).collect()}
    assert got == {(1, 6, 2, False), (6, 6, 2, True), (5, 5, 1, True), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True), (7, 7, 1, True)}
    assert [len(files) for files in asked[:3]] == [0, 2, 2]
    # an update without new files compares nothing again
    before = len(asked)
    exact_dedup.update_state(spark, path, checkpoint)
    assert len(asked) == before


def test_exact_files_that_share_a_cell(spark, tmp_path, monkeypatch):
    """All files in one cell of names: more is read, and the result is the same."""
    monkeypatch.setattr(exact_dedup, "FILE_CELLS", 1)
    path, checkpoint = str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    for rows in ([(1, "a"), (2, "b")], [(3, "a")], [(4, None), (5, "")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(spark, path, checkpoint).collect()}
    assert got == {(1, 3, 2), (3, 3, 2), (2, 2, 1), (4, 5, 2), (5, 5, 2)}


def test_exact_collision(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    sha2 = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: sha2(F.lit("one digest for all"), n))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").write.parquet(path)
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(spark, path).collect()}
    assert got == {(1, 3, 2), (2, 2, 1), (3, 3, 2)}


def test_lines_sql(spark, duck):
    same(line_dedup.query(spark.read.parquet(f"{SF}/documents.parquet")).toPandas(), duck.sql(line_dedup.SQL).df())


def test_lines_odd_rows(spark, odd, none):
    docs = spark.read.parquet(odd)
    out = line_dedup.dedup_lines(docs, min_docs=4).collect()
    assert len(out) == docs.count() and out[0].asDict().keys() == {*docs.columns, "n_lines", "n_dropped"}
    by = {r.doc_id: r for r in out}
    assert (by[1].text, by[1].n_lines, by[1].n_dropped) == ("a b c d e f\n\nlast", 4, 1)
    assert (by[7].text, by[7].n_dropped) == ("É ß 😀\r", 1)
    assert (by[3].text, by[3].n_lines, by[6].text, by[6].n_lines) == (None, 1, "\n\n", 3)
    assert hashlib.sha256(by[8].text.encode()).hexdigest() == hashlib.sha256(b"w " * 60000).hexdigest()
    assert line_dedup.dedup_lines(spark.read.parquet(none)).count() == 0
    clash = line_dedup.dedup_lines(docs.withColumn("n_lines", docs.d).withColumn("n_dropped", docs.d), min_docs=4)
    assert sorted(clash.columns) == sorted({*docs.columns, "n_lines", "n_dropped"}) and {r.n_lines for r in clash.collect() if r.doc_id == 1} == {4}
