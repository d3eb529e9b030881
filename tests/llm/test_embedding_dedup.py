import numpy as np
import pyarrow.parquet as pq

from tallyspark.llm import embedding_dedup
from tests.llm.brute import classes
from tests.llm.conftest import SF

FIELDS = "vec_id long, embedding array<float>, label int"


def by_force(rows, threshold=0.98):
    def usable(r):
        v = r[1]
        return v is not None and r[2] is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    at = [i for i, r in enumerate(rows) if usable(r)]
    links, width = [], max([len(rows[i][1]) for i in at], default=0)
    x = np.array([np.pad(np.array(rows[i][1], np.float64), (0, width - len(rows[i][1]))) for i in at])
    if at:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        links = [(at[i], at[j]) for i, j in zip(a, b) if rows[at[i]][2] == rows[at[j]][2]]
    n, root = [0] * len(rows), classes(len(rows), links)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    low = {}
    for r, k in zip(rows, root):
        low[k] = min(low.get(k, r[0]), r[0])
    return sorted((r[0], n[i], low[root[i]], r[0] == low[root[i]]) for i, r in enumerate(rows))


def got(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.query(df).collect())


def test_query_by_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    assert got(spark.read.parquet(f"{SF}/embeddings.parquet")) == by_force(rows)


def test_planted_neighbours(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 16)  # full filters are cut
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 64))
    x = np.concatenate([centres, np.repeat(centres, 10, 0) + 0.11 * rng.standard_normal((400, 64)), np.repeat(centres[:1], 100, 0)])
    rows = [(i, v.astype(np.float32).tolist(), i % 2) for i, v in enumerate(x)]
    expected = by_force(rows)
    assert sum(n for _, n, _, _ in expected) > 500
    assert got(spark.createDataFrame(rows, FIELDS)) == expected


def test_odd_rows(spark):
    v = [1.0, 2.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [1.0, float("nan")], 1),
            (9, v, None), (10, [1.0, float("inf")], 1), (11, [2.0, 4.0, 0.0], 1), (12, [1e-30, 2e-30], 1)]
    assert got(spark.createDataFrame(rows, FIELDS)) == by_force(rows)
    assert got(spark.createDataFrame([], FIELDS)) == []


def test_long_and_extreme_vectors(spark):
    """Vectors of thousands of components, and components whose squares overflow or vanish, beside columns with clashing names."""
    rng = np.random.default_rng(3)
    long = rng.standard_normal(5000)
    rows = [(1, long.tolist(), 1), (2, (long + 1e-3).tolist(), 1), (3, rng.standard_normal(5000).tolist(), 1), (4, [1e200, 2e200], 2), (5, [1e-200, 2e-200], 2), (6, [2e200, 1e200], 2), (6, [1.0, 2.0], 2)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "vec_id long, embedding array<double>, label int, id int, node int, n_links int")
    found = {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.query(df).collect()}
    assert found == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 2, 4), (5, 2, 4), (6, 2, 4), (6, 0, 6)}


def test_threshold_needs_little_memory():
    import tracemalloc

    tracemalloc.start()
    embedding_dedup.make_code(64, 10**8)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
