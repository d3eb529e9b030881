"""What a query's work grows with, told by its plan, and results where keys repeat as in large tables."""

import datetime

import pytest

from tallyspark.operators import checks, substrings
from tallyspark.plans import cards, registry
from tallyspark.plans import rules as rule_plans
from tallyspark.sources import csv_statements as csv
from tallyspark.sources import ledgers

QUERIES = registry.queries()
SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_headers_found_once(spark):
    """A file's header is worked out before its rows are made, and rows take no shuffle."""
    plan = plan_of(QUERIES["s09_statement_rows"](spark, SMALL))
    assert plan.count("transaction[\\s._-]?desc") == 0 and "Window" not in plan and "Aggregate" not in plan
    plan = plan_of(QUERIES["f06_normalized_rows"](spark, SMALL))
    assert plan.count("transaction[\\s._-]?desc") == 0 and plan.count("RLIKE") < 200


def test_quotes_in_header(spark):
    """A header's words may be parted by quotes; blank records of quotes only are skipped and not counted."""
    files = spark.createDataFrame([(0, 'Da"te",Amount,Memo\n"",""," "\n1,2,""""\n"""",,\n')], "file int, text string")
    rows = sorted(csv.rows(csv.with_header(csv.records(files))).collect(), key=lambda r: r.row_index)
    assert [(r.data_row_index, r.row_index, r.fields) for r in rows] == [
        (0, 2, {"Date": "1", "Amount": "2", "Memo": '"'}), (1, 3, {"Date": '"', "Amount": "", "Memo": ""}),
    ]


def test_alerts_of_repeated_ids(spark, monkeypatch):
    """Of rows that share a tx_id each counts as it stands: a repeat is one alert, however many rows have its tx_id."""
    day = datetime.date
    rows = [(1, 7, "a", day(2024, 1, 5), "shop", "food", -500), (1, 7, "a", day(2024, 1, 6), "shop", "food", -500), (1, 7, "a", day(2024, 2, 9), "bar", "food", -700), (2, 7, "a", day(2024, 2, 9), "bar", "food", -700)]
    ledger = spark.createDataFrame([(*r, False, False, False, False, r[4]) for r in rows],
        "tx_id long, user_id long, account_id string, tx_date date, merchant string, app_category string, amount_cents long, is_transfer boolean, is_excluded boolean, is_duplicate boolean, is_foreign boolean, description string")
    monkeypatch.setattr(cards, "_described", lambda s, d: ledger)
    monkeypatch.setattr(cards, "_subscribed", lambda s, d: s.createDataFrame([], "user_id long, merchant string, price_cents long"))
    assert {(r.month, r.anomalies) for r in cards._month_signals(spark, SMALL).collect()} == {(1, 1), (2, 1)}
    assert "tx_id" in checks.repeats_within(ledger).columns


def counted(monkeypatch, module, name):
    """The calls of a function, which works on."""
    calls, own = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(a) or own(*a, **k))
    return calls


def test_words_of_scopes(spark, monkeypatch):
    """Of many words, only the texts of scopes with many are taken apart; what is found is the same."""
    texts = [(u, f"a{i} pay {u}") for u in (1, 2, 3) for i in range(30)]
    words = [(1, "pay"), (1, "a1"), (1, ""), (3, "pay"), (3, "zz"), *((2, f"a{i}") for i in range(20)), (2, "y 2"), (2, None), (4, "a")]
    expected = sorted((u, t, w) for u, t in texts for v, w in words if u == v and w is not None and w in t)
    t, w = spark.createDataFrame(texts, "user long, text string"), spark.createDataFrame(words, "user long, word string")
    assert sorted(map(tuple, substrings.holding(t, w, ["user"]).collect())) == expected
    apart = counted(monkeypatch, substrings, "_by_grams")
    monkeypatch.setattr(substrings, "FEW", 0)
    assert sorted(map(tuple, substrings.holding(t, w, ["user"]).collect())) == expected
    assert {r.user for r in apart[0][0].collect()} == {2}


def test_queue_made_once(spark, monkeypatch):
    calls = counted(monkeypatch, rule_plans, "_queue")
    QUERIES["t04_queue_orders"](spark, SMALL)
    assert len(calls) == 1


@pytest.mark.parametrize("name", ["d15_metrics", "g20_every_kind"])
def test_order_lines_joined_once(name, spark, monkeypatch):
    calls = counted(monkeypatch, ledgers, "ledger_li")
    QUERIES[name](spark, SMALL)
    assert len(calls) == 1
