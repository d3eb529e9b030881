import hashlib
import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tallyspark.llm import mixing
from tests.llm.conftest import SF


def sources_of(rows):
    seen, shown, weight, repeats = defaultdict(dict), defaultdict(int), {}, {}
    for r in rows:
        seen[r.source][(r.id, r.body)] = r.n_tokens
        shown[r.source] += r.n_tokens
        weight[r.source], repeats[r.source] = r.weight, r.repeats
    return {s: (sum(v.values()), shown[s], weight[s], repeats[s]) for s, v in seen.items()}


def test_flattest_within_the_repeats(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.plan(docs).collect()
    assert {r.id for r in rows} == {d["doc_id"] for d in documents}
    found = sources_of(rows)
    assert math.isclose(sum(w for _, _, w, _ in found.values()), 1, rel_tol=1e-9)
    total = sum(t for t, *_ in found.values())
    logs = {s: (math.log(t / total), math.log(w)) for s, (t, _, w, _) in found.items()}
    (x0, y0), (x1, y1) = min(logs.values()), max(logs.values())
    exponent = (y1 - y0) / (x1 - x0)
    assert 0 <= exponent <= 1 and all(abs(y - y0 - exponent * (x - x0)) < 1e-6 for x, y in logs.values())
    assert max(r for *_, r in found.values()) <= 2 + 1e-6 and min(r for *_, r in found.values()) >= 1 - 1e-6
    assert exponent < 1e-6 or math.isclose(max(r for *_, r in found.values()), 2, rel_tol=1e-3)
    for tokens, shown, _, repeats in found.values():
        assert tokens <= shown <= repeats * tokens + 1e-6


def brute_plan(spark, rows, budget=None, most=2.0, seed=17):
    """The rows (id, source, epoch, block, block_rank) that are shown of (id, text, source); only hashes come from Spark."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    tokens = defaultdict(int)
    for i, _, s in rows:
        tokens[s] += size[i]
    total, top = sum(tokens.values()), max(tokens.values())
    low, high = 0.0, 1.0

    def worst(a):
        """The most that a source is repeated."""
        z = sum((n / top) ** a for n in tokens.values() if n)
        all_shown = top * z if budget is None else budget
        return max(all_shown * (n / top) ** a / z / n for n in tokens.values() if n)

    for _ in range(100):
        a = (low + high) / 2
        low, high = (low, a) if worst(a) <= most + 1e-12 else (a, high)
    a = 0.0 if worst(0.0) <= most + 1e-12 else high
    z = sum((n / top) ** a for n in tokens.values() if n)
    weight = {s: (n / top) ** a / z if n else 0.0 for s, n in tokens.items()}
    repeats = {s: (top * z if budget is None else max(0.0, budget)) * weight[s] / n if n else 1.0 for s, n in tokens.items()}
    bodies = [(i, hashlib.md5((t or "").encode()).digest()) for i, t, _ in rows]
    hashed = spark.createDataFrame(bodies, "id long, body binary").select("id", F.xxhash64(F.lit(seed), "id", "body").alias("h"))
    h = {r.id: r.h for r in hashed.collect()}
    count = {s: min(mixing.MAX_BLOCKS, max(1, math.ceil(n / mixing.BLOCK_TOKENS))) for s, n in tokens.items()}
    block = {i: h[i] % count[s] for i, _, s in rows}
    cells = {(s, e, block[i]) for i, _, s in rows for e in range(math.ceil(round(repeats[s], 9)))}
    keyed = spark.createDataFrame(sorted(cells, key=str), "source string, epoch int, block int").withColumn("h", F.xxhash64(F.lit(seed), F.lit("order"), "source", "epoch", "block"))
    order = defaultdict(list)
    for r in keyed.collect():
        order[r.source, r.epoch].append((r.h, r.block))
    inside, out = defaultdict(int), set()
    for i, _, s in rows:
        inside[s, block[i]] += size[i]
    for (s, epoch), found in order.items():
        spent = 0
        for rank, (_, b) in enumerate(sorted(found), 1):
            spent += inside[s, b]
            left = round(repeats[s], 9) - epoch
            if left >= 1 or spent <= left * tokens[s]:
                out |= {(i, s, epoch, b, rank) for i, _, t in rows if t == s and block[i] == b}
    return out


def test_plan_by_force(spark, documents):
    rows = [(d["doc_id"], d["text"], d["source"]) for d in documents]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = sum(r.n for r in docs.select(mixing.tokens().alias("n")).collect())
    for budget in (None, 0.4 * total, 3.0 * total):
        got = {(r.id, r.source, r.epoch, r.block, r.block_rank) for r in mixing.plan(docs, budget=budget, max_repeats=4.0 if budget else 2.0).collect()}
        assert got == brute_plan(spark, rows, budget, 4.0 if budget else 2.0), budget


def test_small_budgets_show_nothing(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(mixing.plan(docs, budget=b).count() == 0 for b in (0.0, 1e-9, -5.0))


def test_epochs_are_permutations_of_blocks(spark, documents):
    rows = mixing.plan(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    ranks = defaultdict(set)
    for r in rows:
        ranks[r.source, r.epoch].add((r.block_rank, r.block))
    for found in ranks.values():
        assert len({k for k, _ in found}) == len({b for _, b in found}) == len(found)


def test_target_entropy(spark):
    rows = [(i, "a b", "x") for i in range(90)] + [(100 + i, "a b", "y") for i in range(9)] + [(200, "a b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sources_of(mixing.plan(docs, target_entropy=0.8, budget=2000).collect())
    entropy = -sum(w * math.log(w) for _, _, w, _ in found.values())
    assert math.isclose(entropy, 0.8 * math.log(3), rel_tol=1e-6)
    assert sum(s for _, s, _, _ in found.values()) <= 2000


def test_odd_rows(spark, odd, none):
    docs = spark.read.parquet(odd)
    rows = mixing.mix(docs).collect()
    assert rows[0].asDict().keys() == set(docs.columns) and len(rows) >= docs.count()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert mixing.mix(spark.read.parquet(none)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "x")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in mixing.mix(blank).collect()) == [1, 2]
