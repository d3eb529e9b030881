import pytest

SF = "/root/testdata/sf0.01"
ODD = [
    (1, "a b c d e f\nShared line\n\nlast", "x"), (2, "a b c d e f\nShared line\n\nlast", "x"), (3, None, "x"), (4, "", None),
    (5, "", "y"), (6, "\n\n", "y"), (7, "É ß 😀\r\n  Shared LINE \t", "y"), (8, "w " * 60000, "y"), (9, "x" * 70000, None),
    (9, "x" * 70000, None), (None, "a b c d e f\nShared line\n\nlast", "z"), (-5, " ", "z"),
]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A small table of nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    clash = "id key a digest node doc body drops given above root d s b h times shard word row"
    rows = [(i, t, "en", s, len(t or ""), *range(len(clash.split()))) for i, t, s in ODD]
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash.split())
    spark.createDataFrame(rows, columns).write.parquet(path)
    return path


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    return path


@pytest.fixture(scope="session")
def documents():
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def same(got, expected, key="doc_id"):
    got = got.sort_values(key, ignore_index=True)
    expected = expected.sort_values(key, ignore_index=True)[list(got.columns)]
    assert len(got) == len(expected)
    for c in got.columns:
        assert got[c].tolist() == expected[c].tolist(), c
