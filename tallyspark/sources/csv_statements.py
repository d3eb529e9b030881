"""CSV statements as DataFrames: one row a file becomes one row a record, with built-in functions only.

A file is read whole (its header may stand below other lines, its quotes may span lines);
files are many and small, and are dealt to tasks like other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars as f
from tallyspark.sources.scratch import written
from tallyspark.sources.statements import line_ending

#: In this order; of equal scores the first wins.
DELIMITERS = [",", "\t", ";", "|"]
SAMPLE_LINES, HEADER_ROWS = 10, 8
#: A quote opens or closes wherever it stands; one that is not closed goes on to the end of the text.
_QUOTED = r'"[^"]*+(?:"|\z)'
RECORD = rf'([^"\r\n]*+(?:{_QUOTED}[^"\r\n]*+)*+)(\r\n|\r|\n|\z)'

# The columns of statements, and what their headers look like (in lower case).
HEADER_PATTERNS = {
    "date": [
        "date", r"trans(action)?[\s._-]?date", r"trans\.?\s*date", r"posted[\s._-]?date", r"posting[\s._-]?date", r"post[\s._-]?date", r"value[\s._-]?date",
        r"settlement[\s._-]?date", r"effective[\s._-]?date", r"activity[\s._-]?date",
    ],
    "postedDate": [r"posted[\s._-]?date", r"posting[\s._-]?date", r"post[\s._-]?date"],
    "transactionDate": [r"trans(action)?[\s._-]?date", r"trans\.?\s*date"],
    "amount": ["amount", r"trans(action)?[\s._-]?amount", r"net[\s._-]?amount", r"total[\s._-]?amount"],
    "debit": ["debits?", "withdrawals?", "withdraws?", "charges?", r"payments?[\s._-]?out", r"money[\s._-]?out", r"dr\.?"],
    "credit": ["credits?", "deposits?", r"payments?[\s._-]?in", r"money[\s._-]?in", r"cr\.?"],
    "description": [
        "desc(ription)?", "memo", "narration", "particulars?", "payee", "name", "merchant", "details?", r"original[\s._-]?desc(ription)?",
        r"transaction[\s._-]?desc(ription)?", "transaction", "remarks?", r"reference[\s._-]?text", "narrative", r"merchant[\s._-]?name", r"payee[\s._-]?name",
        r"transaction[\s._-]?details?", r"extended[\s._-]?details?", r"vendor[\s._-]?name?", r"counterparty[\s._-]?name?", r"beneficiary[\s._-]?name?",
        r"desc(ription)?[\s._-]?/?[\s._-]?memo", r"additional[\s._-]?info(rmation)?", "label", "notes?", "text", "info(rmation)?", r"transaction[\s._-]?name",
        r"account[\s._-]?description", r"payment[\s._-]?details?", r"entry[\s._-]?details?",
    ],
    "runningBalance": [
        "balance", r"running[\s._-]?bal(ance)?\.?", r"avail(able)?[\s._-]?bal(ance)?", r"ledger[\s._-]?bal(ance)?", r"closing[\s._-]?bal(ance)?",
        r"end[\s._-]?bal(ance)?", r"bal\.?",
    ],
    "checkNumber": [r"check[\s._-]?(no\.?|num(ber)?)?", r"cheque[\s._-]?(no\.?|num(ber)?)?", r"chk[\s._-]?(no\.?|num(ber)?)?", r"ck[\s._-]?no\.?"],
    "bankTransactionId": [
        r"trans(action)?[\s._-]?id", r"reference[\s._-]?id", r"ref(erence)?[\s._-]?(no\.?|num(ber)?)?", r"unique[\s._-]?id",
        r"transaction[\s._-]?ref(erence)?", r"confirmation[\s._-]?(no\.?|num(ber)?)?", r"seq(uence)?[\s._-]?(no\.?|num(ber)?)?",
    ],
    "currency": ["curr(ency)?", r"currency[\s._-]?code", r"iso[\s._-]?curr(ency)?", "ccy"],
    "pending": ["status", "pending", r"posted[\s._-]?status", "type", "state"],
    "transactionType": [
        r"transaction[\s._-]?type", r"trans(action)?[\s._-]?type", r"txn[\s._-]?type", r"debit[\s._-]?/[\s._-]?credit", r"dr[\s._-]?/[\s._-]?cr",
    ],
    "referenceNumber": [r"ref(erence)?[\s._-]?num(ber)?", r"reference[\s._-]?#", r"ref[\s._-]?no\.?", r"seq(uence)?[\s._-]?no\.?"],
    "bankCategory": [
        r"transaction[\s._-]?category", "category", r"bank[\s._-]?category", r"tx[\s._-]?category", r"spending[\s._-]?category", r"merchant[\s._-]?category",
    ],
}

# Banks in this order, the order of their dates, and parts of their headers.
BANKS = [
    ("chase_checking_v1", "Chase", "MDY", ["transaction date", "description", "category", "type", "amount", "balance"]),
    ("chase_credit_v1", "Chase Credit", "MDY", ["transaction date", "post date", "description", "category", "type", "amount"]),
    ("bofa_checking_v1", "Bank of America", "MDY", ["date", "description", "amount", "running bal."]),
    ("capital_one_v1", "Capital One", "MDY", ["transaction date", "posted date", "card no.", "description", "category", "debit", "credit"]),
    ("discover_v1", "Discover", "MDY", ["trans. date", "post date", "description", "amount", "category"]),
    ("citi_v1", "Citibank", "MDY", ["status", "date", "description", "debit", "credit"]),
    ("wells_fargo_v1", "Wells Fargo", "MDY", ["date", "amount", "asterisk", "check", "description"]),
    ("amex_v1", "American Express", "MDY", ["date", "description", "amount", "extended details", "appears on your statement as"]),
    ("usaa_v1", "USAA", "MDY", ["date", "description", "original description", "category", "amount", "status"]),
    ("ally_v1", "Ally Bank", "MDY", ["date", "time", "amount", "type", "description", "balance"]),
    ("pnc_v1", "PNC Bank", "MDY", ["date", "description", "withdrawals", "deposits", "balance"]),
    ("barclays_v1", "Barclays", "DMY", ["date", "merchant name", "amount", "closing balance"]),
    ("hsbc_uk_v1", "HSBC UK", "DMY", ["date", "description", "paid in", "paid out", "balance"]),
    ("commonwealth_au_v1", "Commonwealth Bank (AU)", "DMY", ["date", "description", "debit", "credit", "balance"]),
]


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _lines(text: Column) -> Column:
    """The first lines that are not blank, without what stands in quotes."""
    lines = F.filter(F.split(text, "\r\n|\r|\n"), lambda x: x.rlike(r"\S"))
    return F.transform(F.slice(lines, 1, SAMPLE_LINES), lambda x: F.regexp_replace(x, r'"[^"]*("|\z)', ""))


def _occurrences(sign: str):
    return lambda line: F.length(line) - F.length(F.replace(line, F.lit(sign), F.lit("")))


def _matches(pattern: str, low: Column):
    return lambda _, i: F.get(low, i).rlike(pattern)


def _holds(part: str):
    return lambda header: F.contains(header, F.lit(part))


def delimiter(text: Column) -> Column:
    """The sign with the best score over the first lines: its mean number in lines that have it, by how alike those numbers
    are and how many lines have it. Comma if there is none."""

    def scored(lines: Column) -> Column:
        options = []
        for rank, sign in enumerate(DELIMITERS):
            counts = F.filter(F.transform(lines, _occurrences(sign)), lambda n: n > 0)
            total = F.aggregate(counts, F.lit(0), lambda a, n: a + n)
            # mean x least / most x share of lines; the lines that have it cancel out
            score = F.when(F.size(counts) > 0, total * F.array_min(counts) / F.array_max(counts) / F.size(lines)).otherwise(F.lit(-1.0))
            options.append(F.struct(F.round(score, 9).alias("score"), F.lit(-rank).alias("rank"), F.lit(sign).alias("sign")))
        best = F.array_max(F.array(*options))
        return F.when(best["score"] > 0, best["sign"]).otherwise(F.lit(","))

    return F.coalesce(f.let(_lines(text), scored), F.lit(","))


def records(files: DataFrame, text_col: str = "text") -> DataFrame:
    """files without their text, with delimiter, line_ending and lines array<string>: the records of each file as they are written,
    quotes and all. Null texts have none."""
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(RECORD), 1)
    # the empty match at the end is no record
    last = F.element_at(found, -1) == ""
    lines = F.when(F.length(text) == 0, F.array().cast("array<string>")).when(last, F.slice(found, 1, F.size(found) - 1)).otherwise(found)
    return files.withColumns({"delimiter": delimiter(text), "line_ending": line_ending(text), "lines": lines}).drop(text_col)


def cells(line: Column, sign: Column) -> Column:
    """The cells of a record: quotes go, doubled quotes within quotes stay as one."""
    escaped = F.when(sign == "|", r"\|").otherwise(sign)
    pattern = F.concat(escaped, F.lit('([^"'), escaped, F.lit(r']*+(?:"[^"]*+(?:"|\z)[^"'), escaped, F.lit("]*+)*+)"))
    raw = F.regexp_extract_all(F.concat(sign, line), pattern, 1)
    bare = lambda x: F.replace(F.regexp_replace(x, r'"([^"]*+(?:""[^"]*+)*+)(?:"|\z)', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda x: F.when(F.contains(x, F.lit('"')), bare(x)).otherwise(x))


def _header(cell: Column) -> Column:
    return F.regexp_replace(_trim(cell), "^[\"']|[\"']$", "")


def _mapped(headers: Column, low: Column) -> Column:
    """struct of the headers that match each field; low: the headers in lower case."""
    found = []
    for field, patterns in HEADER_PATTERNS.items():
        found.append(F.filter(headers, _matches("^(" + "|".join(patterns) + ")$", low)).alias(field))
    return F.struct(*found)


def with_header(read: DataFrame) -> DataFrame:
    """records with header: struct(row, columns, mapping map<field, column>, ambiguous, unmapped, confidence, needs_confirmation).

    Of the first rows the one whose cells match most fields: 1 for a field that one cell matches, 0.5 where several do (it stays
    unmapped), 1 more for a description, 0.5 for four cells. It needs a date and an amount, a debit or a credit.
    confidence: 0.95 with a description, 0.65 without, 0 if there is no such row.
    """

    def judged(row: Column, at: Column) -> Column:
        def of(m: Column, headers: Column) -> Column:
            one = lambda *names: F.greatest(*(F.size(m[n]) == 1 for n in names)) if len(names) > 1 else F.size(m[names[0]]) == 1
            points = sum((F.when(F.size(m[n]) == 1, 1.0).when(F.size(m[n]) > 1, 0.5).otherwise(0.0) for n in HEADER_PATTERNS), F.lit(0.0))
            score = points + F.when(one("description"), 1.0).otherwise(0.0) + F.when(F.size(row) >= 4, 0.5).otherwise(0.0)
            fits = one("date", "postedDate", "transactionDate") & one("amount", "debit", "credit")
            pairs = lambda keep: F.filter(F.array(*(F.struct(F.lit(n).alias("field"), m[n].alias("found")) for n in HEADER_PATTERNS)), keep)
            mapping = F.map_from_entries(F.transform(pairs(lambda p: F.size(p["found"]) == 1), lambda p: F.struct(p["field"], F.get(p["found"], F.lit(0)))))
            return F.when(
                fits,
                F.struct(
                    score.alias("score"), (-at).alias("order"), at.alias("row"), headers.alias("columns"), F.to_json(mapping).alias("mapping"),
                    F.transform(pairs(lambda p: F.size(p["found"]) > 1), lambda p: p["field"]).alias("ambiguous"),
                    F.filter(headers, lambda h: (h != "") & ~F.array_contains(F.map_values(mapping), h)).alias("unmapped"),
                    F.when(one("description"), 0.95).otherwise(0.65).alias("confidence"),
                ),
            )

        def mapped(headers: Column) -> Column:
            low = lambda lowered: f.let(_mapped(headers, lowered), lambda m: of(m, headers))
            return f.let(F.transform(headers, lambda h: _trim(F.lower(h))), low)

        return F.when(F.size(row) >= 2, f.let(F.transform(row, _header), mapped))

    # every pattern of a date's column holds this word, so what lacks it is no header; quotes may part a word
    dated = lambda x: F.contains(F.lower(F.replace(x, F.lit('"'), F.lit(""))), F.lit("date"))
    first = F.transform(F.slice("lines", 1, HEADER_ROWS), lambda x: F.when(dated(x), cells(x, F.col("delimiter"))))
    best = F.array_max(F.filter(F.transform(first, judged), lambda s: s.isNotNull()))
    b = F.col("__best")
    header = F.struct(
        F.coalesce(b["row"], F.lit(0)).alias("row"), F.coalesce(b["columns"], F.array().cast("array<string>")).alias("columns"),
        F.coalesce(F.from_json(b["mapping"], "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")).alias("mapping"),
        F.coalesce(b["ambiguous"], F.array().cast("array<string>")).alias("ambiguous"), F.coalesce(b["unmapped"], F.array().cast("array<string>")).alias("unmapped"),
        F.coalesce(b["confidence"], F.lit(0.0)).alias("confidence"),
        (F.coalesce(b["confidence"], F.lit(0.0)) < 0.7).alias("unsure"),
    )
    found = read.withColumn("__best", best).withColumn("header", header).drop("__best")
    return found.withColumn("header", F.col("header").withField("needs_confirmation", F.col("header.unsure") | (F.size("header.ambiguous") > 0)).dropFields("unsure"))


def rows(headed: DataFrame) -> DataFrame:
    """One row a data record: the file's columns without its lines, row_index, data_row_index, raw_line, row_hash, names array<string>, fields map<string,string>,
    warning (null, COLUMN_COUNT_MISMATCH_UNDER or _OVER).

    Blank records are skipped; data_row_index counts the others from 0 in each file. Missing cells are empty; further ones are kept as __col5__ and the like. Of
    columns with one name the last counts. Files without a header have no rows.
    """
    sign = F.col("delimiter")
    # what is left without quotes and delimiters stands in a cell; only a line without such is cut to see if it is blank
    said = lambda x: F.replace(F.replace(x, F.lit('"'), F.lit("")), sign, F.lit("")).rlike(r"\S")
    full = lambda x: F.when(said(x), True).otherwise(F.exists(cells(x, sign), lambda c: c.rlike(r"\S")))
    placed = F.transform("lines", lambda x, i: F.struct(i.alias("row_index"), x.alias("raw_line")))
    kept = F.filter(placed, lambda r: (r["row_index"] > F.col("header.row")) & full(r["raw_line"]))
    # files without a header have no lines here, rather than be filtered: a filter would be moved below and work the header out again
    kept = F.when(F.col("header.confidence") > 0, kept)
    exploded = headed.withColumn("lines", kept).select("*", F.posexplode("lines").alias("data_row_index", "__line")).drop("lines")
    split = exploded.withColumns({"row_index": F.col("__line.row_index"), "raw_line": F.col("__line.raw_line"), "cells": cells(F.col("__line.raw_line"), sign)}).drop("__line")
    n = F.size("header.columns")
    extra = F.transform(
        F.when(F.size("cells") > n, F.sequence(n, F.size("cells") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("__col"), i.cast("string"), F.lit("__"))
    )
    named = split.withColumn("__names", F.concat("header.columns", extra))
    names = F.col("__names")
    pairs = F.transform(names, lambda name, i: F.struct(name.alias("name"), F.coalesce(F.get("cells", i), F.lit("")).alias("value"), i.alias("i")))
    last = F.filter(pairs, lambda p: (p["name"] != "") & ~F.array_contains(F.slice(names, p["i"] + 2, F.greatest(F.size(names), F.lit(1))), p["name"]))
    out = named.withColumn("__last", last).withColumns({
        "names": F.transform("__last", lambda p: p["name"]), "fields": F.map_from_entries(F.transform("__last", lambda p: F.struct(p["name"], p["value"]))),
        "row_hash": F.sha2("raw_line", 256),
        "warning": F.when(F.size("cells") < n, "COLUMN_COUNT_MISMATCH_UNDER").when(F.size("cells") > n, "COLUMN_COUNT_MISMATCH_OVER"),
    })
    return out.drop("cells", "__names", "__last")


def bank(columns: Column) -> Column:
    """struct(bank_key, bank_name, bank_order, bank_confidence) by the headers of a file; null fields and Low if no bank fits.

    The first bank all of whose parts stand in headers (High); else, of those with six in ten, the one with
    most, the first of equals (Medium).
    """

    def of(low: Column) -> Column:
        options = []
        for rank, (key, name, order, parts) in enumerate(BANKS):
            hits = sum((F.when(F.exists(low, _holds(p)), 1).otherwise(0) for p in parts), F.lit(0))
            options.append(F.struct(hits.alias("hits"), F.lit(-rank).alias("rank"), F.lit(key).alias("key"), F.lit(name).alias("name"), F.lit(order).alias("order"), F.lit(len(parts)).alias("parts")))
        every = F.array(*options)
        full = F.array_max(F.transform(F.filter(every, lambda o: o["hits"] == o["parts"]), lambda o: F.struct(o["rank"].alias("rank"), o["key"].alias("key"), o["name"].alias("name"), o["order"].alias("order"))))
        partly = F.array_max(F.filter(every, lambda o: o["hits"] >= o["parts"] * 0.6))
        take = lambda c, sure: F.struct(c["key"].alias("bank_key"), c["name"].alias("bank_name"), c["order"].alias("bank_order"), F.lit(sure).alias("bank_confidence"))
        none = F.lit(None).cast("string")
        return F.when(full.isNotNull(), take(full, "High")).when(partly.isNotNull(), take(partly, "Medium")).otherwise(
            F.struct(none.alias("bank_key"), none.alias("bank_name"), none.alias("bank_order"), F.lit("Low").alias("bank_confidence")))

    return f.let(F.transform(columns, lambda h: _trim(F.lower(h))), of)


def format_name(columns: Column, mapping: Column) -> Column:
    """What a file's format is called, by its headers and what is mapped."""
    low = F.transform(columns, F.lower)
    has = lambda *names: F.forall(F.array(*(F.lit(n) for n in names)), lambda n: F.array_contains(low, n))
    mapped = lambda n: F.map_contains_key(mapping, n)
    date = mapped("date") | mapped("transactionDate") | mapped("postedDate")
    amount = mapped("amount") | (mapped("debit") & mapped("credit"))
    return (
        F.when(has("transaction date", "card no."), "Capital One").when(has("transaction date", "description") & mapped("transactionDate"), "Chase")
        .when(has("running bal."), "Bank of America").when(has("trans. date", "post date"), "Discover").when(has("status", "debit", "credit"), "Citibank")
        .when(has("withdrawals", "deposits"), "PNC").when(has("original description"), "USAA").when(has("time", "type"), "Ally")
        .when(date & mapped("description") & amount, "CSV (auto-detected)").when(date | mapped("description") | amount, "CSV (partial match)").otherwise("Unknown")
    )


def normalized(data: DataFrame, order: Column | None = None) -> DataFrame:
    """rows with date, date_status, option_a, option_b, amount, description, balance, check_number, bank_id, is_pending,
    currency, bank_category, status, issues array<string>, fingerprint.

    order: MDY or DMY of the file. The date is the posted one (else the plain one), else that of the transaction. The amount is its
    column's, else the debit as negative, else the credit; a type column decides the sign. Without a description the first unmapped
    cell that reads like text is taken.
    """
    mapping, fields = F.col("header.mapping"), F.col("fields")

    def cell(*keys: str) -> Column:
        found = [F.try_element_at(fields, F.try_element_at(mapping, F.lit(k))) for k in keys]
        return F.coalesce(*found, F.lit(""))

    spare = F.filter("names", lambda n: ~F.array_contains(F.map_values(mapping), n))
    value = lambda n: _trim(F.try_element_at(fields, n))
    texts = F.filter(F.transform(spare, value), lambda v: (F.length(v) >= 2) & ~v.rlike(r"^[\d.,\-+$£€¥%\s]+$") & ~v.rlike(r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}$"))
    read = data.withColumns({
        "__posted": cell("postedDate", "date"), "__made": cell("transactionDate"), "__amount": cell("amount"), "__debit": cell("debit"), "__credit": cell("credit"),
        "__kind": cell("transactionType"), "__desc": F.when(cell("description") != "", cell("description")).otherwise(F.coalesce(F.get(texts, F.lit(0)), F.lit(""))),
        "__balance": cell("runningBalance"), "__pending": cell("pending"), "__code": cell("currency"),
        **{name: F.nullif(cell(key), F.lit("")) for name, key in (("check_number", "checkNumber"), ("bank_id", "bankTransactionId"), ("bank_category", "bankCategory"))},
    })
    # each amount is read once, as a column of its own
    read = read.withColumns({f"{c}_read": f.normalize_amount(F.col(c)) for c in ("__amount", "__debit", "__credit")})
    single = F.col("__amount") != ""
    debit, credit = F.col("__debit_read"), F.col("__credit_read")
    source = F.when(single, F.col("__amount")).when(F.coalesce(debit, F.lit(0)) != 0, F.col("__debit")).when(F.coalesce(credit, F.lit(0)) != 0, F.col("__credit"))
    read = read.withColumn("__merged", F.when(single, F.col("__amount_read")).otherwise(f.merge_debit_credit(debit, credit)))
    read = read.withColumns({
        "__date": f.normalize_date(F.when(F.col("__posted") != "", F.col("__posted")).otherwise(F.col("__made")), order), "amount": f.enforce_sign(F.col("__merged"), F.col("__kind")),
        "__both": ~single & (F.coalesce(debit, F.lit(0)) != 0) & (F.coalesce(credit, F.lit(0)) != 0), "balance": f.normalize_amount(F.col("__balance")),
        "currency": f.currency(F.coalesce(source, F.lit("")), F.col("__code")), "is_pending": _trim(F.col("__pending")).rlike("(?i)^(pending|p)$"),
        "description": f.normalize_description(F.col("__desc")),
    })
    status = F.col("__date.status")
    issues = F.array_compact(F.array(
        F.when(F.col("__both"), "AMOUNT_CONTRADICTION"), F.when(F.col("is_pending"), "PENDING_TRANSACTION"), F.when(F.col("currency") != "USD", "MULTI_CURRENCY"),
        F.when(status.isin("MISSING", "INVALID"), "DATE_UNPARSEABLE").when(status == "AMBIGUOUS", "DATE_AMBIGUOUS"), F.when(F.col("amount").isNull(), "AMOUNT_PARSE_FAIL"),
    ))
    out = read.withColumns({
        "date": F.col("__date.date"), "date_status": status, "option_a": F.col("__date.option_a"), "option_b": F.col("__date.option_b"),
        "status": f.ingestion_status(status, F.col("amount"), F.col("is_pending")), "issues": issues,
        "fingerprint": f.fingerprint(F.coalesce("__date.date", "__date.option_a"), F.col("amount"), F.col("__desc"), F.col("balance")),
    })
    return out.drop(*(c for c in out.columns if c.startswith("__")))


ISSUE_SEVERITY = {"AMOUNT_CONTRADICTION": "ERROR", "PENDING_TRANSACTION": "WARNING", "MULTI_CURRENCY": "WARNING", "DATE_UNPARSEABLE": "ERROR", "DATE_AMBIGUOUS": "ERROR", "AMOUNT_PARSE_FAIL": "ERROR"}


def read_statements(files: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """Files with a text to normalised rows, each file in the date order that its dates and its bank speak for."""
    from tallyspark.operators.checks import date_order

    # a file's header is found once; its date order joins the file, before its rows are made
    headed = written(with_header(records(files, text_col)).withColumn("bank", bank(F.col("header.columns"))), "statements")
    mapping = F.col("header.mapping")
    raw = F.coalesce(*(F.nullif(F.try_element_at("fields", F.try_element_at(mapping, F.lit(k))), F.lit("")) for k in ("postedDate", "date", "transactionDate")), F.lit(""))
    dates = rows(headed).select(*by, raw.alias("raw_date"), F.col("data_row_index").alias("parse_order"))
    orders = date_order(dates, by, headed.select(*by, "bank.bank_order", "bank.bank_confidence"))
    return normalized(rows(headed.join(orders.select(*by, "date_order"), by)), F.col("date_order"))
