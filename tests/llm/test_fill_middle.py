import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import fill_middle
from tests.llm.conftest import SF, same


def plain_version(doc_id, text):
    """(n, form, prefix, middle, output) by lists of units."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, len(units))))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_sql(spark, duck):
    got = fill_middle.query(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    same(got.astype(object).where(got.notna(), None), duck.sql(fill_middle.SQL).df().astype(object).where(lambda x: x.notna(), None))
    assert {"psm", "spm"} <= set(got["form"])


def checked(spark, rows):
    out = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    back = out.withColumn("back", fill_middle.restored(out.fim_text, out.fim_form)).collect()
    found = sorted(map(repr, ((r.doc_id, r.text, r.n_units, r.fim_form, r.prefix_chars, r.middle_chars, r.fim_text) for r in back)))
    assert found == sorted(repr((i, t, *plain_version(i, t))) for i, t in rows)
    assert all(r.back == (r.text or "") for r in back)


def test_delimiters_in_the_text(spark):
    bits = ["\x01", "\x02", "\x02m", "\x02e", "\x01\n", "\n", "<P", "P>", "<", "<S", "M>", "$1\\", "é😀", "\r\n", "a"]
    texts = [x + y + z for x in bits for y in bits for z in bits]
    checked(spark, list(enumerate(texts)) + [(-1, "x<P>y\n"), (-2, "<S>"), (-3, "a\n<M>")])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 10**12), st.text(alphabet="\x01\x02me\n<PSM>aé😀", max_size=30)), min_size=1, max_size=40))
def test_any_text(spark, rows):
    checked(spark, rows)


def test_odd_rows(spark, odd, none):
    docs = spark.read.parquet(odd).withColumn("fim_form", fill_middle.F.lit(1))
    out = fill_middle.transform(docs)
    assert out.columns == [*docs.drop("fim_form").columns, "n_units", "fim_form", "prefix_chars", "middle_chars", "fim_text"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_units, r.fim_form, r.prefix_chars, r.middle_chars, r.fim_text) == plain_version(r.doc_id, r.text)
    assert fill_middle.transform(spark.read.parquet(none)).count() == 0
    assert {r.fim_form for r in fill_middle.transform(docs, fim_percent=0).collect()} == {"plain"}
