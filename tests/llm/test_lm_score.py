import math
import re
import zlib
from collections import Counter

import numpy as np

from tallyspark.llm import lm_score
from tests.llm.conftest import SF

UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)) + [None]


def test_query(spark, documents):
    part = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 7 for d in documents}
    counts = Counter(w for d in documents if part[d["doc_id"]] != 2 for w in words(d["text"]))
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in lm_score.query(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert len(rows) == len(documents)
    gain = []
    for d in documents:
        r, tokens = rows[d["doc_id"]], words(d["text"])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (part[d["doc_id"]] == 2, len(tokens), n)
        assert r.n_known == sum(counts[w] > 0 for w in tokens)
        base = sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9), (r.base_score, base)
        assert math.isfinite(r.score) and r.score < 0
        if r.held_out:
            gain.append((r.score - r.base_score) / r.n_tokens)
    assert np.mean(gain) > 0.1 and np.mean(np.array(gain) > 0) > 0.9


def brute_scores(rows):
    """{id: score} of (id, text), from dictionaries of counts and expectation-maximisation over cells of held-out bigrams."""
    part = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 for i, _ in rows}
    texts = [(part[i], [None, *words(t)]) for i, t in rows]
    pairs, single = {2: Counter(), 3: Counter()}, {2: Counter(), 3: Counter()}
    for p, t in texts:
        for counted in [2] * (p != 2) + [3] * (p == 3):
            pairs[counted].update(zip(t, t[1:]))
            single[counted].update(t[1:])
    (pair, held), (word, word_held) = pairs.values(), single.values()
    n, v, held_n = sum(word.values()), len(word), sum(word_held.values())
    bucket = lambda c: min(lm_score.BUCKETS - 1, math.ceil(math.log2(c + 1)))
    level = lambda x: round(math.log2(x) * lm_score.CELLS) if x else None
    cells = {}
    for (b, w), k in held.items():
        context, one = word[b] - word_held[b], word[w] - word_held[w]
        p = (pair[b, w] - k) / max(1, context)
        cell = cells.setdefault((bucket(context), level(p), level(one)), [0, 0.0, 0.0])
        for j, x in enumerate((1, p, one / max(1, n - held_n))):
            cell[j] += k * x
    by_bucket = {}
    for (b, *_), (seen, p, one) in cells.items():
        by_bucket.setdefault(b, []).append((seen, (p / seen, one / seen, 1 / (v + 1))))
    weights, last = {}, (1 / 3,) * 3
    for b in range(lm_score.BUCKETS):
        if b in by_bucket:
            last = (1 / 3,) * 3
            for _ in range(lm_score.ROUNDS):
                sums = [1e-3] * 3
                for seen, parts in by_bucket[b]:
                    mixed = sum(x * y for x, y in zip(last, parts))
                    for k in range(3):
                        sums[k] += seen * last[k] * parts[k] / mixed
                last = tuple(x / sum(sums) for x in sums)
        weights[b] = last
    return {
        i: sum(
            math.log10(x * pair[b, w] / max(1, word[b]) + y * word[w] / max(1, n) + z / (v + 1))
            for b, w in zip(t, t[1:]) for x, y, z in [weights[bucket(word[b])]]
        )
        for (i, _), (_, t) in zip(rows, texts)
    }


def test_scores_by_force(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.score for r in lm_score.query(docs).collect()}
    expected = brute_scores([(d["doc_id"], d["text"]) for d in documents])
    assert got.keys() == expected.keys() and all(math.isclose(got[i], expected[i], rel_tol=1e-9) for i in got)


def test_rare_words_by_force(spark):
    """Every bigram of words counts, rare ones too; the order of rare words tells."""
    rng = np.random.default_rng(8)
    rare = [f"r{i:04d}x" for i in range(1200)]  # of one length and one kind of last byte
    phrases = [" ".join(rare[4 * i : 4 * i + 4]) for i in range(300)]
    rows = [(i, " ".join(phrases[j] for j in rng.integers(0, 300, 12))) for i in range(600)]
    test = [i for i in range(600, 700) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    sensible = rows[0][1].split()
    rows += [(test[0], " ".join(sensible)), (test[1], " ".join(np.random.default_rng(9).permutation(sensible)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.score for r in lm_score.score(docs).collect()}
    expected = brute_scores(rows)
    assert all(math.isclose(got[i], expected[i], rel_tol=1e-9) for i in expected)
    assert got[test[0]] > got[test[1]] + 20


def test_weights_raise_the_likelihood():
    rng = np.random.default_rng(3)
    which, seen = rng.integers(0, 5, 400), rng.integers(1, 9, 400)
    parts = rng.random((400, 3)) ** 4
    w = lm_score.learned(which, parts, seen)
    assert np.allclose(w.sum(1), 1) and (w > 0).all()
    likelihood = lambda weights: (seen * np.log((weights[which] * parts).sum(1))).sum()
    assert likelihood(w) > likelihood(np.full_like(w, 1 / 3))


def test_odd_rows(spark, odd, none):
    docs = spark.read.parquet(odd)
    rows = lm_score.score(docs).collect()
    assert len(rows) == docs.count() and all(r.n_tokens >= 1 and math.isfinite(r.score) for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[3] == 1
    expected = brute_scores([(r.doc_id, r.text) for r in docs.collect()])
    assert all(math.isclose(r.score, expected[r.doc_id], rel_tol=1e-9) for r in rows)
    assert lm_score.score(spark.read.parquet(none)).count() == 0
