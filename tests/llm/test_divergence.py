import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import divergence
from tests.llm.conftest import SF, same


def force(rows, min_docs, top):
    """rows: (lang, source, text). The audit by dictionaries over every group and kept term."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups[lang].add(source)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        counts[lang, None].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(source, lang=lang, kept=kept):
            n = [counts[lang, source][t] for t in kept]
            return [1 + 10**9 * (x + 5) // (sum(n) + 5 * len(kept)) for x in n]

        p = {s: shares(s) for s in [*sources, None]}
        for s in sources:
            pairs = [(-sum(abs(x - y) for x, y in zip(p[s], p[t], strict=True)), t.encode()) for t in sources if t != s]
            over = [(q - x, t.encode()) for t, x, q in zip(kept, p[s], p[None], strict=True) if counts[lang, s][t] and x > q]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def test_sql(spark, duck):
    got, expected = divergence.query(spark, SF).toPandas(), duck.sql(divergence.SQL).df()
    order = ["lang", "source", "part", "rank"]
    same(got[[*order, "item", "value"]], expected, order)
    assert set(got["part"]) == {"pair", "term"}


@pytest.mark.parametrize("bits", [16, 4])
def test_force(spark, bits):
    """Also with a sketch so small that many terms collide, and with texts in pieces and counts sent early."""
    sizes = divergence.Sizes(least_bits=bits, most_bits=bits, block=8, held=40, piece=50)
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["É", "éa", "ß", "😀", "ÀB"]
    rows = []
    for i in range(300):
        picked = rng.zipf(1.3, rng.integers(0, 40)) % len(words)
        text = " ".join(words[k].upper() if k % 3 else words[k] + "1," for k in picked)
        rows.append((["en", "de", None, "x"][min(3, i % 7)], [None, "b", "a", "é"][int(rng.integers(4))], text or None))
    rows += [("solo", "only", "alone"), ("bare", "p", "12 34"), ("bare", "q", None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = {tuple(r) for r in divergence.audit(docs, min_docs=4, top_terms=5, sizes=sizes).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == force(rows, 4, 5)


def test_shares_are_exact(spark):
    big = 9_000_000_000_000_000_000
    rows = [(big - 1, big, 7), (0, 0, 3), (123_456_789_012_345, 10**15 + 1, 10**6), (0, 0, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "n long, total long, kept long").select(divergence.share("n", "total", "kept")).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * k) if k else None for n, t, k in rows]


def test_odd_rows(spark, odd, none):
    docs = spark.read.parquet(odd)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    clash = docs.withColumn("term", divergence.F.lit(1)).withColumn("value", divergence.F.lit(2)).withColumn("part", divergence.F.lit(2))
    got = {tuple(r) for r in divergence.audit(clash, min_docs=2).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == force(rows, 2, 50)
    assert divergence.audit(spark.read.parquet(none)).count() == 0


def test_sketch_never_underestimates_and_discards(spark, documents):
    docs = spark.createDataFrame([(d["lang"], d["source"], d["text"]) for d in documents], "lang string, source string, text string")
    mask = divergence.passing_cells(docs, 30, 16)
    seen = defaultdict(Counter)
    for d in documents:
        seen[d["lang"]].update(set().union(*divergence.terms(d["text"].encode())))
    passed = missed = rare = 0
    for lang, counted in seen.items():
        names = list(counted)
        ok = np.ones(len(names), bool)
        for k, place in enumerate(divergence.cells(lang, names, 16)):
            ok &= (mask[k, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
        often = np.array([counted[t] >= 30 for t in names])
        missed += int((often & ~ok).sum())
        passed += int((ok & ~often).sum())
        rare += int((~often).sum())
    assert missed == 0 and passed < 0.02 * rare
