"""Chains and places worked in spans, against one pass over each key's rows in order."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import checks, lists, scans

FIELDS = "account string, tx_id int, tx_date date, amount_cents long, balance_cents long"


def made(seed, n=600, accounts=("hot",) * 8 + ("b", "c", None)):
    """Rows of one long account and a few others: balances missing or broken, dates missing or alike, a month that is empty."""
    rng, out = random.Random(seed), []
    for i in range(n):
        month = rng.choice([1, 2, 3, 5, 6])
        day = None if rng.random() < 0.03 else datetime.date(2024, month, rng.randint(1, 28))
        out.append((rng.choice(accounts), i, day, rng.randint(-50, 50), None if rng.random() < 0.4 else rng.randint(0, 200)))
    return out


def ordered(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {a: sorted(rs, key=lambda r: (r[2] is not None, r[2] or datetime.date.min, r[1])) for a, rs in out.items()}


def chain(rows, opening=None):
    """{tx_id: (expected after, expected before)}"""
    out = {}
    for rs in ordered(rows).values():
        known = prior = None
        for r in rs:
            has = r[4] is not None
            start = known if known is not None else opening
            out[r[1]] = (start + r[3] if has and start is not None else None, known + prior if has and known is not None else None)
            known, prior = r[4] if has else known, r[3]
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("grain", ["month", "week", "year"])
def test_chains(spark, seed, grain):
    rows = made(seed)
    df, want, opened = spark.createDataFrame(rows, FIELDS), chain(rows), chain(rows, 7)
    how = {"by": ["account"], "order": ["tx_date", "tx_id"], "span": F.trunc("tx_date", grain)}
    assert {r.tx_id: r.expected_cents for r in checks.chain_after(df, **how).collect()} == {k: v[0] for k, v in want.items()}
    assert {r.tx_id: r.expected_cents for r in checks.chain_before(df, **how).collect()} == {k: v[1] for k, v in want.items()}
    got = checks.chain_after(df.withColumn("o", F.lit(7)), opening="o", **how).collect()
    assert {r.tx_id: r.expected_cents for r in got} == {k: v[0] for k, v in opened.items()}
    assert all(r.is_valid == (None if r.expected_cents is None else r.expected_cents == r.balance_cents) for r in got)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_rechained(spark, seed):
    """Dates chosen anew, rows gone and come: the chain made from the old one is that of all rows."""
    rows, rng = made(seed, accounts=("hot",) * 5 + ("b", "c", "still", None)), random.Random(seed)
    now = []
    for r in rows:
        if r[0] != "still" and r[2] and r[2].month > 3 and rng.random() < 0.1:
            r = (r[0], r[1], r[2] + datetime.timedelta(days=rng.randint(-60, 60)), r[3], r[4])
        if r[0] == "still" or rng.random() > 0.02 or r[2] is None:
            now.append(r)
    now.append(("new", 10_000, datetime.date(2024, 1, 1), 5, 5))
    by, order = ["account"], ["tx_date", "tx_id"]
    old = checks.chain_after(spark.createDataFrame(rows, FIELDS), by, order)
    got = checks.rechained_after(old, spark.createDataFrame(now, FIELDS), by, order, ["tx_id"])
    assert {r.tx_id: r.expected_cents for r in got.collect()} == {k: v[0] for k, v in chain(now).items()} and got.count() == len(now)


def test_a_long_account_is_worked_by_many_tasks(spark):
    """No window is by account alone over rows: only over spans' ends."""
    df = spark.createDataFrame(made(9), FIELDS)
    said = checks.chain_after(df, ["account"], ["tx_date", "tx_id"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in said.split("\n") if "Window [" in line]
    assert len(windows) == 2 and sum("__span" in line.split("],")[1] for line in windows) == 1
    assert any("Aggregate [" in line for line in said.split("\n"))


def test_models(spark):
    day = datetime.date(2024, 1, 1)
    rows = [
        *(("after", i, day, 10, 100 + 10 * i) for i in range(5)), *(("before", i, day, 10 + i, 100 + sum(range(10, 10 + i))) for i in range(5)), ("one", 1, day, 5, 5), ("none", 1, day, 5, None), ("none", 2, day, 5, None),
        ("two", 1, day, 7, 0), ("two", 2, day, 5, 7), ("tie", 1, day, 1, 0), ("tie", 2, day, 1, 1), ("tie", 3, day, 1, 2),
    ]
    got = checks.balance_model(spark.createDataFrame(rows, FIELDS), ["account"], ["tx_date", "tx_id"]).collect()
    assert {r.account: (r.model, r.needs_review, r.pairs) for r in got} == {
        "after": ("AFTER", True, 4), "before": ("BEFORE", False, 4), "one": ("AFTER", True, 0), "none": ("AFTER", True, 0), "two": ("AFTER", True, 1), "tie": ("AFTER", True, 2)}


def test_reconcile_modes(spark):
    day = datetime.date(2024, 1, 1)
    rows = [
        *((a, i, day, 10, 100 + 10 * i, False) for a in ("chain", "totals", "bad totals", "ends", "warned") for i in range(20)), ("broken", 1, day, 1, 1, False), ("broken", 2, day, 2, 3, False), ("broken", 3, day, 9, 4, False), ("broken", 4, day, 3, 7, False),
        ("bare", 1, day, 5, None, False), ("bare", 2, day, 5, 7, True), ("warned", 99, day, 10, 300, True),
    ]
    said = [("totals", 200, 0, None, None), ("bad totals", 201, 0, None, None), ("ends", None, None, 0, 200), ("broken", None, 5, 0, None)]
    df = spark.createDataFrame(rows, FIELDS + ", is_unresolved boolean")
    totals = spark.createDataFrame(said, "account string, total_credits long, total_debits long, opening long, closing long")
    got = {r.account: r for r in checks.reconcile(df, totals, ["account"], ["tx_date", "tx_id"]).collect()}
    assert {k: (r.mode, r.status, r.checks, r.failed) for k, r in got.items()} == {
        "chain": ("RUNNING_BALANCE", "PASS", 1, 0), "totals": ("STATEMENT_TOTALS", "PASS", 2, 0), "bad totals": ("STATEMENT_TOTALS", "FAIL", 2, 1), "ends": ("STATEMENT_TOTALS", "PASS", 1, 0),
        "warned": ("RUNNING_BALANCE", "PASS_WITH_WARNINGS", 1, 0), "broken": ("RUNNING_BALANCE", "FAIL", 1, 1), "bare": ("UNVERIFIABLE", "UNVERIFIABLE", 0, 0)}
    broken = got["broken"]
    assert (broken.breaks, broken.valid, broken.break_percent, broken.constant_offset) == (1, 3, 25.0, True)


@pytest.mark.parametrize("by", ["date", "amount", "vendor"])
@pytest.mark.parametrize("down", [False, True])
def test_queue(spark, by, down):
    rng, day = random.Random(1), datetime.date(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), i, day + datetime.timedelta(days=rng.randint(0, 9)), rng.randint(-3, 3), rng.choice(["b", "A", "", None]), rng.choice(["Z", "a", "", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "user_id int, tx_id int, tx_date date, amount_cents long, merchant string, description string").repartition(6)
    got = {}
    for r in lists.queued(df, by, down).orderBy("place").collect():
        got.setdefault(r.user_id, []).append((r.place, r.tx_id))
    vendor = lambda r: (r[4] or r[5] or "").lower()
    for user in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == user), key=lambda r: (-r[2].toordinal(), r[1]))
        mine.sort(key={"date": lambda r: r[2], "amount": lambda r: r[3], "vendor": vendor}[by], reverse=down)
        if by == "vendor":
            mine.sort(key=lambda r: vendor(r) == "")
        assert got[user] == [(i + 1, r[1]) for i, r in enumerate(mine)]


def test_places_span_ranges(spark):
    """One key's rows lie in many ranges, and their places have no gap."""
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.hash("id").alias("v")).repartition(8)
    kept = scans.placed(df, ["k"], [F.col("v").asc()])
    got = [r.v for r in kept.orderBy("place").collect()]
    assert got == sorted(got) and kept.agg(F.min("place"), F.max("place"), F.countDistinct("place")).first()[:] == (1, 20_000, 20_000)
