from pyspark.sql import functions as F

from tallyspark.sources import statements
from tallyspark.streaming import ingest

FIELDS = "user_id long, month int, cents long, row_hash string"


def test_rows_come_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([(1, 1, 5, "a"), (1, 2, 6, "b")], [(1, 2, 6, "b"), (2, 1, 7, "c")]):
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest_new_rows(spark, source, FIELDS, target, checkpoint, ["row_hash"])
    assert sorted(r.row_hash for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_accept_and_decode(spark):
    files = [("a.csv", b"x,y"), ("b.pdf", b"%PDF-1"), ("c.xlsx", b"PK\x03\x04.."), ("d.txt", b"OFXHEADER\n<OFX>"), ("e.csv", b""), ("f.csv", "é".encode("utf-16")), ("g.csv", b"\n<STMTTRN>"), ("h.qbo", b"a,b"), ("i.csv", b'a,"b'), ("k.bin", b"abc")]
    df = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in files], "path string, length long, content binary")
    got = {r.path: (r.kind, r.reason) for r in statements.accept(df).collect()}
    assert got == {"a.csv": ("CSV", None), "b.pdf": ("PDF", None), "c.xlsx": ("XLSX", "unsupported"), "d.txt": ("OFX", None), "e.csv": ("CSV", "empty"), "f.csv": ("CSV", None), "g.csv": ("OFX", None), "h.qbo": ("QBO", None), "i.csv": ("CSV", "truncated"), "k.bin": (None, "unknown kind")}
    assert {r.path for r in statements.accept(df).collect() if r.format_mismatch} == {"g.csv", "h.qbo"}
    texts = {r.path: r.t for r in df.select("path", statements.decoded(F.col("content")).alias("t")).collect()}
    assert texts["a.csv"] == "x,y" and texts["f.csv"] == "é"


def test_export_and_pdf_files(spark, tmp_path):
    """Cells with quotes and commas come back as they were, line ends as the file's; bytes of PDF files are told apart."""
    from tallyspark.operators import lists
    from tallyspark.sources import pdf_candidates

    odd = ['a "b", c', "x\ny", "", None, "plain"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(odd)], "user_id long, place int, description string")
    lists.write_csv(rows, str(tmp_path / "out"), ["description"])
    back = spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"', multiLine=True, lineSep="\r\n")
    assert [r.description for r in back.collect()][:2] == [odd[0], "x\r\ny"]
    assert [r.line for r in lists.csv_lines(rows, ["description"]).orderBy("place").collect()] == ['"a ""b"", c"', '"x\ny"', "", "", "plain"]
    files = [("ok", b"%PDF /Type /Page BT x ET"), ("locked", b"/Encrypt BT"), ("scan", b"/Type /Page"), ("long", b"BT" + b" /Type /Page " * 31)]
    got = pdf_candidates.classified(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary"))
    assert {r.path: r.reason for r in got.collect()} == {"ok": None, "locked": "encrypted", "scan": "no text", "long": "too many pages"}
