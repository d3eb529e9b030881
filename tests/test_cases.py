"""Single cases of rules, as tables of what goes in and what comes out."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.functions import scalars as f
from tallyspark.operators import cards, checks
from tallyspark.sources import csv_statements as csv


def results(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_amounts(spark):
    cases = {
        "12.34": "12.34", " $1,234.50 ": "1234.50", "(12.34)": "-12.34", "12.34-": "-12.34", "1.234,56": "1234.56", "12,34": "12.34", "12,345": "12345", "1.234": "1.234", "€ 5": "5", "5 zł": None,
        "R$7,00": "7.00", "HK$-3": "-3", "-$5.00": None, "($5.00)": None, "": None, "-": None, "abc": None, "Rp 10": "10", "+5": "5", "1,23": "1.23", "1,2": None, "--5": None, None: None, "1e3": "1000", "0x1F": "31", "2.5e-1": "0.25", "1e": None, "0xg": None, "12.345": "12.35",
    }
    got = results(spark, list(cases), f.normalize_amount)
    assert got == [None if v is None else Decimal(v).quantize(Decimal("0.01")) for v in cases.values()]


def test_dates(spark):
    day = datetime.date
    cases = {
        "2024-03-15": (day(2024, 3, 15), "RESOLVED"), "03/15/2024": (day(2024, 3, 15), "RESOLVED"), "20/01/2024": (day(2024, 1, 20), "RESOLVED"), "04/05/2024": (None, "AMBIGUOUS"), "": (None, "MISSING"),
        "05/05/24": (day(2024, 5, 5), "RESOLVED"), "20240229": (day(2024, 2, 29), "RESOLVED"), "2023-02-29": (None, "INVALID"), "Mar 5, 2024": (day(2024, 3, 5), "RESOLVED"), "5 March 2024": (day(2024, 3, 5), "RESOLVED"),
        "15-Jan-24": (day(2024, 1, 15), "RESOLVED"), "15/Jan/2024": (day(2024, 1, 15), "RESOLVED"), "Jan 15, 24": (day(2024, 1, 15), "RESOLVED"), "Sept/15 2024": (day(2024, 9, 15), "RESOLVED"), "january 5 2024": (day(2024, 1, 5), "RESOLVED"),
        "15 - jan - 2024": (day(2024, 1, 15), "RESOLVED"), "2024/03/15": (day(2024, 3, 15), "RESOLVED"), "Marble 5, 2024": (None, "INVALID"), "Jan-15-2024": (None, "INVALID"), "2024-3-5": (None, "INVALID"), "2024-03/15": (None, "INVALID"),
        "2024-03-15T10:00": (None, "INVALID"), "Jan. 5, 2024": (None, "INVALID"), "1/2/199": (None, "AMBIGUOUS"), "13/13/2024": (None, "INVALID"), "soon": (None, "INVALID"), None: (None, "MISSING"),
    }
    got = results(spark, list(cases), f.normalize_date)
    assert [(r.date, r.status) for r in got] == list(cases.values())
    ambiguous = got[3]
    assert (ambiguous.option_a, ambiguous.option_b) == (day(2024, 4, 5), day(2024, 5, 4))
    assert [r.date for r in results(spark, ["04/05/2024"] * 2, lambda v: f.normalize_date(v, F.lit("DMY")))] == [day(2024, 5, 4)] * 2


def test_names(spark):
    assert results(spark, ["SHELL OIL TX", "AMAZON #422 purchase", "Acme San Francisc Ca Date X Xx X 734 Card 25 G0"], f.normalize_merchant) == ["Shell Oil", "Amazon", "Acme San Francisc"]
    assert results(spark, ["Walmart 4321", "walmart", "7-11 22", None], f.rule_key) == ["walmart", "walmart", "711", ""]
    assert results(spark, ["POS Joe's Diner", "SQ *Cafe - 12"], f.normalize_vendor) == ["joes diner", "cafe - 12"]
    assert results(spark, ["Payment To Verizon Wireless", "verizon wireless", "ONLINE PMT Gas Co. Autopay"], f.recurring_key) == ["verizon wireless", "verizon wireless", "gas co"]
    assert results(spark, ["call 555-123-4567 or a@b.co, card 4111 1111 1111 1111, acct 123456789"], f.redact) == ["call [PHONE] or [EMAIL], card [CARD], acct [ACCOUNT]"]


def test_transfers(spark):
    yes = ["PAYMENT THANK YOU", "Autopay 12", "AUTO PAY", "credit card payment", "CARD PAYMENT", "online  payment", "Bill Payment x", "bank transfer", "ACH TRANSFER", "wire transfer", "Transfer to savings", "transfer from", "account transfer"]
    no = ["Zelle to Ann", "wire shop", "transferware", "venmo", "payment", "", None]
    assert results(spark, yes + no, checks.is_transfer_description) == [True] * len(yes) + [False] * len(no)


def read(spark, texts):
    files = spark.createDataFrame(list(enumerate(texts)), "file int, text string")
    return csv.with_header(csv.records(files))


def test_csv_records(spark):
    texts = [
        'Date,Description,Amount\r\n1/2/2024,"a, ""b""\nc",5\r\n\r\n3/4/2024,x,6', "no header\nat all", "", None, 'Date;Amount;Memo\n1.2.24;5;"open\nrest;1', "Bank of X\n\nPosted Date\tDebit\tCredit\tNotes\tNotes\n1\t2\t3\t4\t5\t6",
        "Date|Amount|Description\n1|2", '"Date","Amount",Payee\n"1""",2,x"y"z',
    ]
    headed = read(spark, texts)
    heads = {r.file: r for r in headed.select("file", "delimiter", "line_ending", "header").collect()}
    assert [heads[i].delimiter for i in range(8)] == [",", ",", ",", ",", ";", "\t", "|", ","]
    assert (heads[0].line_ending, heads[4].line_ending, heads[2].line_ending) == ("CRLF", "LF", "CRLF")
    assert [heads[i].header.confidence for i in range(8)] == [0.95, 0, 0, 0, 0.95, 0.65, 0.95, 0.95]
    assert heads[5].header.row == 2 and heads[5].header.ambiguous == ["description"] and heads[5].header.needs_confirmation
    rows = sorted(csv.rows(headed).collect(), key=lambda r: (r.file, r.row_index))
    assert [(r.file, r.row_index, r.fields, r.warning) for r in rows] == [
        (0, 1, {"Date": "1/2/2024", "Description": 'a, "b"\nc', "Amount": "5"}, None), (0, 3, {"Date": "3/4/2024", "Description": "x", "Amount": "6"}, None),
        (4, 1, {"Date": "1.2.24", "Amount": "5", "Memo": "open\nrest;1"}, None),
        (5, 3, {"Posted Date": "1", "Debit": "2", "Credit": "3", "Notes": "5", "__col5__": "6"}, "COLUMN_COUNT_MISMATCH_OVER"),
        (6, 1, {"Date": "1", "Amount": "2", "Description": ""}, "COLUMN_COUNT_MISMATCH_UNDER"), (7, 1, {"Date": '1"', "Amount": "2", "Payee": "xyz"}, None),
    ]
    assert rows[0].raw_line == '1/2/2024,"a, ""b""\nc",5'


def test_csv_long_cells(spark):
    """A cell of a million characters, and a record of thousands of quoted cells, go through the expressions."""
    long, wide = "x" * 1_000_000, ",".join('"a,b"' for _ in range(3000))
    rows = csv.rows(read(spark, [f'Date,Amount,Memo\n1,2,"{long}"', f"Date,Amount,Memo\n1,2,{wide}"])).collect()
    by = {r.file: r.fields for r in rows}
    assert by[0]["Memo"] == long and len(by[1]) == 3002 and by[1]["__col3001__"] == "a,b"


def test_csv_rows_to_ledger(spark):
    texts = ["Status,Date,Description,Debit,Credit,Other\nPending,2024-01-05,,5.00,,Coffee house\nPosted,13/01/2024,Pay,,1.00 €,\nPosted,,x,,,\nPosted,2024-01-06,both,1.00,2.00,",
             "Date,Amount,Type,Transaction Type,Name\n2024-01-05,5,x,Debit,n\n2024-01-05,-5,x,CR,n"]
    files = spark.createDataFrame(list(enumerate(texts)), "file int, text string")
    got = sorted(csv.read_statements(files, ["file"]).collect(), key=lambda r: (r.file, r.data_row_index))
    assert [(r.status, r.amount and float(r.amount), r.description, r.currency, r.issues) for r in got] == [
        ("WARNING", -5.0, "Coffee house", "USD", ["PENDING_TRANSACTION"]), ("VALID", 1.0, "Pay", "EUR", ["MULTI_CURRENCY"]), ("REJECTED", None, "x", "USD", ["DATE_UNPARSEABLE", "AMOUNT_PARSE_FAIL"]),
        ("VALID", -1.0, "both", "USD", ["AMOUNT_CONTRADICTION"]), ("VALID", -5.0, "n", "USD", []), ("VALID", 5.0, "n", "USD", []),
    ]


def test_date_orders(spark):
    files = {"mdy": ["01/31/2024", "02/01/2024", "02/29/24"], "dmy": ["31/01/2024", "01/02/2024", "x", "2024-05-05"], "unsure": ["01/02/2024", "03/04/2024"], "clear": ["2024-01-01", "05/05/2024"]}
    rows = [(k, d, i) for k, days in files.items() for i, d in enumerate(days)]
    found = checks.date_order(spark.createDataFrame(rows, "file string, raw_date string, parse_order int"), ["file"]).collect()
    got = {r.file: (r.mdy_cost, r.dmy_cost, r.date_order, r.confidence, r.needs_confirmation) for r in found}
    assert got == {"mdy": (0, 2000, "MDY", 99, False), "dmy": (1000, 0, "DMY", 99, False), "unsure": (0, 0, "MDY", 0, True), "clear": (0, 0, "MDY", 70, False)}


def test_storyline_text(spark):
    """One user a case: a gain with a goal, a loss with a lever, a loss of fixed costs alone, a new charge, and a month under way."""
    month = [(u, 2024, m) for u in range(1, 6) for m in (1, 2)]
    money = {1: (500_000, 200_050), 2: (100_000, 250_000), 3: (0, 90_000), 4: (100_000, 90_000), 5: (100_000, 60_000)}
    paced = spark.createDataFrame(
        [(u, y, m, *money[u], money[u][0] - money[u][1], u == 5 and m == 2, 29, 10 if (u, m) == (5, 2) else 29, money[u][1] / 10, money[u][1] * 2.9 if (u, m) == (5, 2) else None) for u, y, m in month],
        "user_id int, year int, month int, income_cents long, spending_cents long, net_cents long, is_partial boolean, days_in_month int, elapsed int, daily_cents double, projected_cents double")
    split = {1: {"Food": 150_050, "Fun": 50_000}, 2: {"Rent": 150_000, "Food": 50_000, "Fun": 50_000}, 3: {"Rent": 90_000}, 4: {"Food": 90_000}, 5: {"Food": 60_000}}
    grown = {(1, 1): 2, (2, 1): 3}  # the month before had half or a third less
    categories = spark.createDataFrame(
        [(u, y, m, c, 0, x - x // grown[u, m] if (u, m) in grown else x, False, x - x // grown[u, m] if (u, m) in grown else x, x / money[u][1]) for u, y, m in month for c, x in split[u].items()],
        "user_id int, year int, month int, category string, income_cents long, spending_cents long, is_income boolean, total_cents long, share double")
    subs = spark.createDataFrame([(4, "Tunes", 999, 2, "low"), (4, "Films", 1549, 2, "medium")] + [(5, f"s{k}", 1000, 9, "high") for k in range(5)], "user_id int, merchant string, price_cents long, months long, confidence string")
    small = spark.createDataFrame([(1, 2024, 2, 16, 20_100)], "user_id int, year int, month int, tx_count long, total_cents long")
    got = {r.user_id: r for r in cards.storyline_text(paced, categories, subs, small).where("month = 2").collect()}
    assert got[1].summary == (
        "You spent $2,001 this month — 40% of income — leaving $3,000 unspent. That's up 100% from last month across tracked categories. The biggest drivers are Food (75%) and Fun (25%). "
        "16 small purchases quietly added up to $201 — worth a look. Cutting back on small daily purchases is the quickest win with the least sacrifice.")
    assert got[2].summary == (
        "You spent $2,500 this month, 250% of income, with a $1,500 shortfall. That's up 50% from last month across tracked categories. The biggest drivers are Rent (60%) and Food (20%). "
        "To get back to positive, start with Food — it's your biggest lever.")
    assert got[3].summary == "You spent $900 this month. Rent makes up 100% of spending. Review your variable expense categories to find the easiest reductions."
    assert got[4].summary == (
        "You spent $900 this month — 90% of income — leaving $100 unspent. Food makes up 100% of spending. A new recurring charge appeared: Films at $15/month (and 1 more). "
        "Confirm whether the new recurring charge is expected and set to continue.")
    assert got[5].summary == (
        "You spent $600 this month — 60% of income — leaving $400 unspent. Food makes up 100% of spending. 5 active subscriptions are running in the background at $50/month. "
        "At $60/day you're on pace for $1,740 — $740 over income with 19 days left. Auditing even one unused subscription could free up meaningful annual savings.")
    assert [got[u].action_label for u in range(1, 6)] == ["View transactions", "Review Food", "View transactions", "Review subscriptions", "Review subscriptions"]
    assert [tuple(n) for n in got[4].numbers] == [("Total spending", "$900", "total_spending"), ("Net", "+$100", "net"), ("Food", "100%", "top_cat_1_pct"), ("New: Films", "$15/mo", "new_sub")]
    assert [n.field for n in got[3].numbers] == ["total_spending", "top_cat_1_pct"]
