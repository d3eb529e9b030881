"""The index of words, against comparing each text with each word."""

import contextlib
import io
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.operators import dictionaries, rules
from tallyspark.operators.substrings import holding, required


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain("formatted")
    return said.getvalue()


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from([1, 2]), st.text("abé😀 ", max_size=9)), max_size=30, unique=True),
    st.lists(st.tuples(st.sampled_from([1, 2]), st.text("abé😀 ", max_size=5)), max_size=20, unique=True),
    st.booleans(),
)
def test_holding(spark, texts, words, measured):
    t = spark.createDataFrame([*texts, (1, None)], "user_id int, text string")
    w = spark.createDataFrame([*words, (2, None)], "user_id int, word string")
    got = sorted(tuple(r) for r in holding(t, w, ["user_id"], measured).collect())
    assert got == sorted((u, x, y) for u, x in texts for v, y in words if u == v and y in x)


PIECES = st.sampled_from(["ab", "b", "c ", "(a|b)", "[abc]", "a?", "b+", "c{2}", "c{0,2}", "(ab)*", "|", r"\b", r"\s", "^", "$", ".", r"\.", "(?:a(b)|c)", "[^]a]x"])


@settings(max_examples=3000, deadline=None)
@given(st.lists(PIECES, max_size=6).map("".join), st.text("abcx .", max_size=8))
def test_required_words(pattern, text):
    """No match is lost: what matches holds one of the words."""
    if re.search(pattern, text, re.I):
        assert any(w in text.lower() for w in required(pattern))


def test_required_words_are_found():
    assert required(r"\bamazon\b|\bamzn\b") == ["amazon", "amzn"]
    assert required(r"(?i)x{3}\s+Wide Open") == ["wide open"]
    assert [required(p) for p in (r"\d+", "a||b", "(a|b)", r"abc\p{L}|z", None)] == [[""], [""], [""], [""], []]


def test_no_nested_loops_at_any_size(spark):
    many = spark.range(60_000).selectExpr("cast(id as int) rank", "concat('w', conv(id * 7919, 10, 16)) pattern", "id v")
    rows = spark.range(3000).selectExpr("id", "concat('Pay W', conv(id * 2 * 7919, 10, 16), ' x') t")
    out = dictionaries.first_match(rows, F.col("t"), many, ["v"])
    assert not re.search("NestedLoop|Cartesian", plan(out))
    words = {f"w{i * 7919:x}": i for i in range(60_000)}
    for r in out.collect():
        held = [words[w] for w in ("w" + f"{r.id * 2 * 7919:x}"[:k] for k in range(1, 9)) if w in words]
        assert r.v == min(held)


def test_many_rules_of_many_users(spark):
    """More rules than could go to every task, both ways round, in a plan without nested loops."""
    rng = random.Random(5)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    made = [(u, u * 20 + k, "contains", rng.choice(names), None, None, f"C{k % 3}", "always") for u in range(1500) for k in range(20)]
    asked = [(i, i % 1500, "a", rng.choice(names), -100) for i in range(4000)]
    r = spark.createDataFrame(made, "user_id long, rule_id long, match_type string, value string, account_id string, amount_exact long, category string, mode string")
    t = spark.createDataFrame(asked, "tx_id long, user_id long, account_id string, vendor string, amount_cents long")
    out = rules.apply_to_upload(t, r)
    assert not re.search("NestedLoop|Cartesian", plan(out))
    by_user = {}
    for u, rule, _, value, *_ in made:
        by_user.setdefault(u, []).append((rule, value))
    got = {x.tx_id: (x.matches, x.rule_id) for x in out.collect()}
    for tx, u, _, vendor, _ in asked:
        met = [rule for rule, value in by_user[u] if value in vendor or vendor in value]
        assert got[tx] == (len(met), met[0] if len(met) == 1 else None)


def test_scope_of_every_user(spark):
    users = spark.range(5000).select(F.col("id").alias("user_id"))
    dimension = spark.createDataFrame([(None, 1), (None, 2), (7, 3), (9999, 4)], "owner_id long, rule_id int")
    got = {tuple(r) for r in rules.in_scope(dimension, users).select("user_id", "rule_id").collect()}
    assert got == {(u, k) for u in range(5000) for k in (1, 2)} | {(7, 3)}
