"""Queries of CSV statements: each customer's orders as one file, in five formats; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars as f
from tallyspark.sources import csv_statements as c
from tallyspark.sources.ledgers import table
from tallyspark.sources.scratch import written

HEADERS = [
    "Date,Description,Amount,Balance\n", "Account export\r\nTransaction Date;Posted Date;Card No.;Description;Category;Debit;Credit",
    "Status\tDate\tDescription\tDebit\tCredit\tExtra", "Date|Merchant Name|Amount|Closing Balance", "When,Value",
]


def files(spark, d) -> DataFrame:
    """One text a customer: quoted cells with delimiters and quotes in them, blank and short lines, text before the header, none at all."""
    amount = f.from_cents(F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long"))
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("file"), (F.col("o_custkey") % 5).alias("k"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderpriority").alias("said"), amount.alias("amount"),
    )
    day = lambda p: F.date_format("day", p)
    even = F.col("key") % 2 == 0
    line = (
        F.when(F.col("k") == 0, F.concat(day("MM/dd/yyyy"), F.lit(',"'), "said", F.lit(', no ""'), "key", F.lit('""",-'), "amount", F.lit(","), "amount"))
        .when(F.col("k") == 1, F.concat(day("yyyy-MM-dd"), F.lit(";"), day("yyyy-MM-dd"), F.lit(";1234;"), "said", F.lit(";Shop;"), F.when(even, F.col("amount")).otherwise(""), F.lit(";"), F.when(even, "").otherwise(F.concat("amount", F.lit(" €")))))
        .when(F.col("k") == 2, F.concat(F.when(F.col("key") % 3 == 0, "Pending").otherwise("Posted"), F.lit("\t"), day("dd/MM/yyyy"), F.lit("\t\t"), "amount", F.lit("\t0.00\tRef "), "key"))
        .when(F.col("k") == 3, F.concat(day("yyyyMMdd"), F.lit('|"'), "said", F.lit(' | x"|-'), "amount", F.when(F.col("key") % 7 == 0, "").otherwise(F.concat(F.lit("|"), "amount"))))
        .otherwise(F.concat("key", F.lit(","), "amount"))
    )
    lines = o.groupBy("file", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "key", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    end = F.when(F.col("k") == 1, "\r\n").otherwise("\n")
    head = F.get(F.array(*(F.lit(h) for h in HEADERS)), F.col("k").cast("int"))
    return lines.select("file", F.concat(head, end, F.array_join(F.col("lines"), "\x00"), F.when(F.col("k") == 1, "\r\n").otherwise("")).alias("t"), end.alias("end")).select(
        "file", F.replace("t", F.lit("\x00"), F.col("end")).alias("text"))


def _formats(spark, d):
    headed = c.with_header(c.records(files(spark, d)))
    b = c.bank(F.col("header.columns"))
    return headed.select(
        "file", "delimiter", "line_ending", F.col("header.row").cast("long").alias("header_row"), F.array_join("header.columns", "/").alias("columns"),
        F.array_join("header.ambiguous", "/").alias("ambiguous"), F.array_join("header.unmapped", "/").alias("unmapped"), F.col("header.confidence").alias("confidence"),
        F.col("header.needs_confirmation").alias("needs_confirmation"), b["bank_key"].alias("bank_key"), b["bank_order"].alias("bank_order"),
        b["bank_confidence"].alias("bank_confidence"), c.format_name(F.col("header.columns"), F.col("header.mapping")).alias("format"),
    )


def _rows(spark, d):
    data = c.rows(written(c.with_header(c.records(files(spark, d))), "statements"))
    return data.select("file", F.col("row_index").cast("long"), F.col("data_row_index").cast("long"), "raw_line", "row_hash", "warning", F.array_join(F.transform("names", lambda n: F.concat(n, F.lit("="), F.col("fields")[n])), "/").alias("fields"))


def _normalized(spark, d):
    out = c.read_statements(files(spark, d), ["file"])
    return out.select(
        "file", F.col("data_row_index").cast("long"), "date", "date_status", (F.col("amount") * 100).cast("long").alias("cents"), "description",
        (F.col("balance") * 100).cast("long").alias("balance_cents"), "currency", "bank_category", "is_pending", "status", F.array_join("issues", "/").alias("issues"), "fingerprint",
    )


ORDERS = '''WITH o AS (SELECT o_custkey AS file, o_custkey % 5 AS k, o_orderkey AS key, CAST(o_orderdate AS DATE) AS dt, o_orderpriority AS said, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders),
a AS (SELECT *, CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS amt, row_number() OVER (PARTITION BY file ORDER BY dt, key) AS rn, bool_or(day(dt) > 12) OVER (PARTITION BY file) AS plain FROM o),
l AS (SELECT *, CASE k WHEN 0 THEN strftime(dt, '%m/%d/%Y') || ',"' || said || ', no ""' || key || '""",-' || amt || ',' || amt
  WHEN 1 THEN CAST(dt AS VARCHAR) || ';' || CAST(dt AS VARCHAR) || ';1234;' || said || ';Shop;' || CASE WHEN key % 2 = 0 THEN amt || ';' ELSE ';' || amt || ' €' END
  WHEN 2 THEN CASE WHEN key % 3 = 0 THEN 'Pending' ELSE 'Posted' END || chr(9) || strftime(dt, '%d/%m/%Y') || chr(9) || chr(9) || amt || chr(9) || '0.00' || chr(9) || 'Ref ' || key
  WHEN 3 THEN strftime(dt, '%Y%m%d') || '|"' || said || ' | x"|-' || amt || CASE WHEN key % 7 = 0 THEN '' ELSE '|' || amt END END AS line FROM a WHERE k < 4)
'''

QUERIES = {
    "s10_statement_formats": (
        _formats,
        """SELECT DISTINCT o_custkey AS file, [',', ';', chr(9), '|', ','][o_custkey % 5 + 1] AS delimiter, CASE WHEN o_custkey % 5 = 1 THEN 'CRLF' ELSE 'LF' END AS line_ending,
           CASE WHEN o_custkey % 5 = 1 THEN 1 ELSE 0 END::BIGINT AS header_row,
           ['Date/Description/Amount/Balance', 'Transaction Date/Posted Date/Card No./Description/Category/Debit/Credit', 'Status/Date/Description/Debit/Credit/Extra', 'Date/Merchant Name/Amount/Closing Balance', ''][o_custkey % 5 + 1] AS columns,
           CASE WHEN o_custkey % 5 = 1 THEN 'date' ELSE '' END AS ambiguous, ['', 'Card No.', 'Extra', '', ''][o_custkey % 5 + 1] AS unmapped, CASE WHEN o_custkey % 5 = 4 THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence,
           o_custkey % 5 IN (1, 4) AS needs_confirmation, ['ally_v1', 'capital_one_v1', 'citi_v1', 'barclays_v1', NULL][o_custkey % 5 + 1] AS bank_key, ['MDY', 'MDY', 'MDY', 'DMY', NULL][o_custkey % 5 + 1] AS bank_order,
           ['Medium', 'High', 'High', 'High', 'Low'][o_custkey % 5 + 1] AS bank_confidence, ['CSV (auto-detected)', 'Capital One', 'Citibank', 'CSV (auto-detected)', 'Unknown'][o_custkey % 5 + 1] AS format FROM orders""",
    ),
    "s09_statement_rows": (
        _rows,
        ORDERS + """SELECT file, rn + CASE WHEN k < 2 THEN 1 ELSE 0 END AS row_index, rn - 1 AS data_row_index, line AS raw_line, sha256(line) AS row_hash,
          CASE WHEN k = 3 AND key % 7 = 0 THEN 'COLUMN_COUNT_MISMATCH_UNDER' END AS warning,
          CASE k WHEN 0 THEN 'Date=' || strftime(dt, '%m/%d/%Y') || '/Description=' || said || ', no "' || key || '"/Amount=-' || amt || '/Balance=' || amt
            WHEN 1 THEN 'Transaction Date=' || CAST(dt AS VARCHAR) || '/Posted Date=' || CAST(dt AS VARCHAR) || '/Card No.=1234/Description=' || said || '/Category=Shop/Debit=' || CASE WHEN key % 2 = 0 THEN amt || '/Credit=' ELSE '/Credit=' || amt || ' €' END
            WHEN 2 THEN 'Status=' || CASE WHEN key % 3 = 0 THEN 'Pending' ELSE 'Posted' END || '/Date=' || strftime(dt, '%d/%m/%Y') || '/Description=/Debit=' || amt || '/Credit=0.00/Extra=Ref ' || key
            ELSE 'Date=' || strftime(dt, '%Y%m%d') || '/Merchant Name=' || said || ' | x/Amount=-' || amt || '/Closing Balance=' || CASE WHEN key % 7 = 0 THEN '' ELSE amt END END AS fields FROM l""",
    ),
    "f06_normalized_rows": (
        _normalized,
        ORDERS + """, n AS (SELECT *, CASE WHEN k = 2 AND NOT plain THEN make_date(year(dt), day(dt), month(dt)) ELSE dt END AS date, CASE WHEN k = 1 AND key % 2 = 1 THEN cents ELSE -cents END AS signed,
            CASE k WHEN 0 THEN said || ', no "' || key || '"' WHEN 1 THEN said WHEN 2 THEN 'Ref ' || key ELSE said || ' | x' END AS description,
            CASE WHEN k = 0 OR (k = 3 AND key % 7 > 0) THEN cents END AS balance_cents, k = 2 AND key % 3 = 0 AS is_pending, CASE WHEN k = 1 AND key % 2 = 1 THEN 'EUR' ELSE 'USD' END AS currency FROM l)
        SELECT file, rn - 1 AS data_row_index, date, 'RESOLVED' AS date_status, signed AS cents, description, balance_cents, currency, CASE WHEN k = 1 THEN 'Shop' END AS bank_category, is_pending,
          CASE WHEN is_pending THEN 'WARNING' ELSE 'VALID' END AS status, CASE WHEN is_pending THEN 'PENDING_TRANSACTION' WHEN currency = 'EUR' THEN 'MULTI_CURRENCY' ELSE '' END AS issues,
          sha256(CAST(date AS VARCHAR) || '|||' || CASE WHEN signed < 0 THEN '-' ELSE '' END || amt || '|||' || lower(description) || '|||' || CASE WHEN balance_cents IS NULL THEN 'NO_BALANCE' ELSE amt END) AS fingerprint FROM n""",
    ),
}
