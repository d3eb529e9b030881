import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tallyspark.llm import sharding
from tests.llm.conftest import SF


def smallest_by_force(sizes, shards):
    """Fewest bytes of the largest part over all contiguous cuts, by dynamic programming."""
    best = [[0] + [10**18] * len(sizes)] + [[0] * (len(sizes) + 1) for _ in range(shards)]
    for k in range(1, shards + 1):
        for i in range(1, len(sizes) + 1):
            best[k][i] = min(max(best[k - 1][j], sum(sizes[j:i])) for j in range(i + 1))
    return best[shards][-1]


def test_capacity_is_smallest(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_BINS", 8)
    rng = random.Random(3)
    for shards in (1, 3, 5):
        sizes = [rng.choice([1, 2, 3, 5, 8, 30]) for _ in range(40)]
        groups = spark.createDataFrame([(bytes([i]), s, i) for i, s in enumerate(sizes)], "key binary, bytes long, first_row long")
        found, _ = sharding.plan(groups, shards)
        rest = [s for i, s in enumerate(sizes) if bytes([i]) not in {bytes(g) for g in found.giants}]
        assert found.capacity == smallest_by_force(rest, shards - len(found.giants))


def test_query(spark, documents):
    got = {r.doc_id: r for r in sharding.query(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert len(got) == len(documents)
    group, load, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for d in documents:
        r, raw = got[d["doc_id"]], d["text"].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        group[raw].add(r.shard), slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(len(s) == 1 for s in group.values()) and set(load) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) <= sum(load.values()) / 40 + max(len(t) + 16 for t in group)


def test_hot_group_and_odd_rows(spark, odd, none):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("z" * 500)).otherwise(F.concat(F.lit("t" * 400), "id")).alias("text"))
    out = sharding.shard_documents(hot, 10).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.sum("size").alias("b")).collect()
    assert sorted(r.shard for r in out) == list(range(10)) and all(r.top == r.n - 1 for r in out)
    assert max(r.b for r in out if r.shard) < 1.1 * min(r.b for r in out if r.shard)
    out = sharding.shard_documents(spark.read.parquet(odd), 4).collect()
    assert len(out) == 12 and len({r.shard for r in out if r.doc_id in (1, 2, None)}) == 1
    assert sharding.shard_documents(spark.read.parquet(none)).count() == 0
