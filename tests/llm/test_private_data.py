import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import private_data as pd_
from tests.llm.conftest import SF


def luhn(number):
    total = 0
    for k, d in enumerate(reversed(number)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def patterns(text):
    """The plain patterns, with re alone."""
    found = [(m.start(), 1, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = re.sub("[^0-9]", "", m[0])
        if 12 <= len(number) <= 19 and luhn(number):
            found.append((m.start(), 3, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 4, m.end()))
    return sorted(found)


BITS = st.sampled_from(["1", "23", "255", "256", ".", ".", "-", " ", "+1", "(", ")", "a", "b@", "@", "c.d", "_", "%", "4111111111111111", "é", "\n", "  ", "000", "555"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(BITS, max_size=25).map("".join))
def test_base_spans(text):
    assert pd_.base_spans(text) == patterns(text)


def test_base_spans_of_the_table(documents):
    found = [pd_.base_spans(d["text"]) for d in documents]
    assert found == [patterns(d["text"]) for d in documents]
    assert {k for f in found for _, k, _ in f} == {1, 2, 3, 4}


@pytest.mark.parametrize("unit", ["x", "1", "1.", "+1", "@", "a@", "a.", "1 ", "(", "+1(", "@a.", "-", "_@b.c"])
def test_time_is_linear(unit):
    pd_.nodes(unit * 300_000)


@pytest.mark.parametrize("seed", range(6))
def test_beliefs_are_exact_on_trees(seed):
    """On a tree messages give the marginals; those are sums over all labellings."""
    rng = np.random.default_rng(seed)
    n = 6
    edges = np.array([(rng.integers(4), rng.integers(i), i) for i in range(1, n)])
    pairs = rng.normal(size=(4, 5, 5))
    pairs = pairs + pairs.transpose(0, 2, 1)
    unary = rng.normal(size=(n, 5))
    exact = np.zeros((n, 5))
    for labels in itertools.product(range(5), repeat=n):
        w = np.exp(sum(unary[i, k] for i, k in enumerate(labels)) + sum(pairs[t, labels[i], labels[j]] for t, i, j in edges))
        for i, k in enumerate(labels):
            exact[i, k] += w
    assert np.allclose(pd_.beliefs(unary, edges, pairs, rounds=60), exact / exact.sum(1, keepdims=True), atol=1e-5)


def test_loops_agree_with_the_likeliest_labelling():
    """A repeated token, three times neighbour of the same word: on loops the labels are those of the best labelling."""
    seen = [(-1, pd_.shape(c), k, n) for c in ("(743", "555-3824") for k, n in ((0, 30), (4, 70))]
    model = pd_.learned([*seen, (pd_.CHAIN, 4, 4, 50), (pd_.CHAIN, 0, 0, 50)])
    _, _, _, _, cores, label, near = pd_.nodes("+1 (743) 555-3824 or (743) 555-3824 or (743) 555-3824")
    edges = np.array(pd_.links(cores, label, near))
    unary = np.array([pd_._FIXED[k] if k else model.unary(c) for c, k in zip(cores, label, strict=True)])
    weigh = lambda labels: sum(unary[i, k] for i, k in enumerate(labels)) + sum(model.pairs[t, labels[i], labels[j]] for t, i, j in edges)
    best = max(itertools.product(range(5), repeat=len(cores)), key=weigh)
    assert tuple(pd_.beliefs(unary, edges, model.pairs).argmax(1)) == best == (4,) * 7


def spans(spark, rows, **how):
    out = pd_.entities(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
    text = dict(rows)
    return {r.doc_id: [(s.kind, text[r.doc_id][s.start : s.end], s.added) for s in r.spans] for r in out}


def test_labels_carry_across_a_text(spark):
    filler = "many words of no kind at all " * 40
    rows = [
        (1, f"Call +1 (743) 555-3824 now. {filler} Again: (743) 555-3824, {filler} or 7435553824."),
        (2, f"Call (743) 555-3824 now. {filler}"),
        (3, f"From 152.143.123.131 today {filler} and 152-143-123-131 or 152[.]143[.]123[.]131!"),
        (4, f"joe.b@mail.example.com {filler} JOE.B@mail"),
        (5, f"Order 7435553824 of 2024-01-05, part 12-34-56, 3.14 and 99 {filler} 7435553824"),
        (6, "4111111111111111 4111111111111111"),
        (7, f"4111111111111111 {filler} 4111111111111111 4111111111111111"),
    ] + [(100 + i, f"Item {i * 7919 % 10**10:010d} and {i} cost {i}.50, call +1 (200) 555-{1000 + i}") for i in range(200)]
    got = spans(spark, rows)
    assert got[1] == [("phone", "+1 (743) 555-3824", False), ("phone", "(743) 555-3824", True), ("phone", "7435553824", True)]
    assert got[3][0] == ("ip", "152.143.123.131", False) and [x[:2] for x in got[3][1:]] == [("ip", "152-143-123-131"), ("ip", "152[.]143[.]123[.]131")]
    assert got[4] == [("email", "joe.b@mail.example.com", False), ("email", "JOE.B@mail", True)]
    assert got[5] == []
    assert got[7] == [("card", "4111111111111111", False), ("card", "4111111111111111", True), ("card", "4111111111111111", True)]
    assert all(len(got[100 + i]) == 1 and not got[100 + i][0][2] for i in range(200))


def test_query(spark, documents):
    rows = {r.doc_id: r for r in pd_.query(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert len(rows) == len(documents)
    for d in documents:
        r, base = rows[d["doc_id"]], patterns(d["text"])
        said = [f"{pd_.KINDS[k - 1]}:{a}:{b}" for a, k, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(1, 5)]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(said) <= set(every) and len(every) == len(said) + r.n_added
        at = [(int(s.split(":")[1]), pd_.KINDS.index(s.split(":")[0])) for s in every]
        assert at == sorted(at)
    assert sum(r.n_added for r in rows.values()) < 0.1 * sum(len(patterns(d["text"])) for d in documents)


def test_odd_rows(spark, odd, none):
    docs = spark.read.parquet(odd)
    clash = docs.withColumn("spans", pd_.F.lit(1)).withColumn("kinds", pd_.F.lit(1))
    out = pd_.entities(clash).collect()
    assert len(out) == docs.count() and all(r.spans == [] for r in out)
    assert pd_.entities(spark.read.parquet(none)).count() == 0
    got = spans(spark, [(None, "a@b.c"), (1, "😀 é +1 (743) 555-3824"), (2, "1" * 70000 + " x@y.z")])
    assert got == {None: [("email", "a@b.c", False)], 1: [("phone", "+1 (743) 555-3824", False)], 2: [("email", "x@y.z", False)]}
