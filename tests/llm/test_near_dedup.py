import random

import numpy as np

from tallyspark.llm import near_dedup
from tests.llm.brute import near_classes
from tests.llm.conftest import SF


def test_query_by_force(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.component_id, r.group_size, r.kept) for r in near_dedup.query(docs).collect()}
    expected = near_classes([(d["doc_id"], d["text"]) for d in documents], near_dedup.inverse_frequencies(docs))
    assert got == {i: (low, n, i == low) for i, (low, n) in expected.items()}
    assert sum(n > 1 for _, n in expected.values()) > 20


def test_large_buckets_lose_nothing(spark):
    """A passage in all texts fills buckets with texts that are not alike; copies among them are still found."""
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = words(60)
    rows = [(i, f"{passage} {words(30)}") for i in range(60)]
    rows += [(100 + i, text + " end") for i, (_, text) in enumerate(rows[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.group_size) for r in near_dedup.query(docs).collect()}
    assert got == near_classes(rows, near_dedup.inverse_frequencies(docs))
    assert all(got[100 + i][0] == i for i in range(30))


def test_chains_in_large_buckets_lose_nothing(spark):
    """Z is near Y and Y near the many copies of H, but Z is not near H: the head takes Y and not Z."""
    rng, rows = random.Random(5), []
    for family in range(16):
        base = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        rows += [(100 * family + i, " ".join([*base, f"end{i}"])) for i in range(12)]
        rows += [(100 * family + 50, " ".join(base[:101])), (100 * family + 51, " ".join(base[:83]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    inverse = near_dedup.inverse_frequencies(docs)
    w = [near_dedup.weighted(near_dedup._Words(), inverse, text) for _, text in rows[:14]]
    assert near_dedup.similarity(w[13], w[12]) >= 0.8 > max(near_dedup.similarity(w[13], x) for x in w[:12])
    got = {r.doc_id: (r.component_id, r.group_size) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == near_classes(rows, inverse)
    assert all(n == 14 for _, n in got.values())


def test_blocks_shared_with_one_copy_lose_nothing(spark):
    """Many near copies of a text, one of them with a block of words that only one other text has: the two are linked, and no other is."""
    rng, rows = random.Random(11), []
    for group in range(24):
        base, block = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (100, 14))
        rows += [(1000 * group + i, " ".join([*base[:50], f"mid{group}x{i}", *base[50:]])) for i in range(30)]
        rows += [(1000 * group + 500, " ".join([*base, *block])), (1000 * group + 501, " ".join([*base[10 + group % 4 :], *block]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.group_size) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == near_classes(rows, near_dedup.inverse_frequencies(docs))


def test_prefix_pairs_cross_classes_only(spark, monkeypatch):
    """All pairs between classes, none within, however the holders of a shingle are dealt to cells."""
    monkeypatch.setattr(near_dedup, "CELL", 3)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = [" ".join([*base, f"x{i}"]) for i in range(30)]
    docs = spark.createDataFrame([(i, t, min(i, 20)) for i, t in enumerate(texts)], "doc_id long, text string, of long")
    inverse = near_dedup.inverse_frequencies(docs)
    nodes = docs.selectExpr("cast(lpad(doc_id, 4, '0') as binary) AS node", "cast(lpad(of, 4, '0') as binary) AS class", "text")
    pairs = {(int(r.a.decode()), int(r.b.decode())) for r in near_dedup._prefix_pairs(nodes, nodes, inverse, 0.8).collect()}
    assert pairs == {(i, j) for j in range(30) for i in range(min(j, 20))}


def test_hot_shingle_pairs_weights_that_can_match(spark, monkeypatch):
    """All holders of a shingle are dealt by weight, and no link across the border of two spans is lost."""
    monkeypatch.setattr(near_dedup, "CELL", 4)
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base[:k]) for k in range(20, 400, 4)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    inverse = np.ones(1 << near_dedup.CLASS_BITS, np.float32)  # so a shingle of all texts is among the first of each
    nodes = docs.selectExpr("cast(lpad(doc_id, 4, '0') as binary) AS node", "text")
    tables = {}
    kept = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, label: tables.setdefault(label, kept(df, label)))
    pairs = {(int(r.a.decode()), int(r.b.decode())) for r in near_dedup._prefix_pairs(nodes, nodes, inverse, 0.8).collect()}
    w = [near_dedup.weighted(near_dedup._Words(), inverse, t) for t in texts]
    links = {(i, j) for j in range(len(w)) for i in range(j) if near_dedup.similarity(w[i], w[j]) >= 0.8}
    assert links and links <= pairs
    assert tables["near-spans"].groupBy("token").count().agg({"count": "max"}).first()[0] > 5


def test_prefix_pairs_hold_all_links(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    texts = [" ".join(base[:k] + [f"x{i}{rng.randrange(9)}" for i in range(80 - k)]) for k in range(40, 80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    inverse = near_dedup.inverse_frequencies(docs)
    nodes = docs.selectExpr("cast(lpad(doc_id, 4, '0') as binary) AS node", "text")
    pairs = {(int(r.a.decode()), int(r.b.decode())) for r in near_dedup._prefix_pairs(nodes, nodes, inverse, 0.8).collect()}
    w = [near_dedup.weighted(near_dedup._Words(), inverse, t) for t in texts]
    links = {(i, j) for j in range(len(w)) for i in range(j) if near_dedup.similarity(w[i], w[j]) >= 0.8}
    assert links and links <= pairs


def test_samples_agree_as_weights_do():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    w = 1 + rng.random(300)
    a, b = (h[:270], w[:270]), (h[30:], w[30:])
    low = w[30:270].sum()
    share = low / (w.sum())
    same = [np.mean(near_dedup.band_keys(x[0] ^ np.uint64(s), x[1]) == near_dedup.band_keys(y[0] ^ np.uint64(s), y[1])) for s in range(200) for x, y in [(a, b)]]
    assert abs(np.mean(same) - share**near_dedup.ROWS) < 0.06


def test_odd_rows(spark, odd, none):
    docs = spark.read.parquet(odd)
    out = near_dedup.near_duplicates(docs)
    assert set(out.columns) == {*docs.columns, "component_id", "group_size", "kept"}
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: (r.component_id, r.group_size, r.kept) for r in rows}
    assert by[1] == (1, 3, True) and by[2] == (1, 3, False) and by[None] == (1, 3, False)
    assert by[3] == (3, 3, True) and by[5] == (3, 3, False) and by[8] == (8, 1, True) and by[9] == (9, 2, True)
    assert near_dedup.near_duplicates(spark.read.parquet(none)).count() == 0
