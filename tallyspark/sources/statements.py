"""Statement files as DataFrames: acceptance, decoding, and transactions of OFX texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BYTES = 50 * 1024 * 1024


def accept(files: DataFrame) -> DataFrame:
    """files (path, length, content) with kind, reason (null: accepted), file_hash, encoding, sniffed_kind and format_mismatch.

    The kind goes by the first bytes, then the file's ending, then by how the text begins. A file called CSV
    that holds OFX is read as OFX; one called OFX that does not is only marked. Rejected: empty, too large, of no known
    kind, XLSX, and CSV whose last quote is not closed.
    """
    head = F.hex(F.substring("content", 1, 4))
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    named = F.upper(F.substring(ending, 2, 9))
    start = F.decode(F.substring("content", 1, 20), "ISO-8859-1")
    kind = (
        F.when(head == "504B0304", "XLSX").when(head == "25504446", "PDF").when(ending.isin(".csv", ".pdf", ".ofx", ".qfx", ".qbo"), named)
        .when(ending.isin(".xlsx", ".xls"), "XLSX").when(start.startswith("OFXHEADER") | start.startswith("<OFX>"), "OFX")
    )
    text = decoded(F.col("content"))
    is_ofx = F.substring(text, 1, 2048).rlike("OFXHEADER|<OFX>|<STMTTRN>")
    family = F.col("named_kind").isin("OFX", "QFX", "QBO")
    seen = files.withColumn("named_kind", kind)
    readable = (F.col("length") > 0) & (F.col("length") <= MAX_BYTES) & F.col("named_kind").isin("CSV", "OFX", "QFX", "QBO")
    seen = seen.withColumn("sniffed_kind", F.when(readable & (F.col("named_kind") == "CSV") & is_ofx, "OFX").when(readable & family & ~is_ofx, "CSV"))
    seen = seen.withColumn("kind", F.when(F.col("sniffed_kind") == "OFX", "OFX").otherwise(F.col("named_kind")))
    reason = (
        F.when(F.col("length") == 0, "empty").when(F.col("length") > MAX_BYTES, "too large").when(F.col("kind").isNull(), "unknown kind").when(F.col("kind") == "XLSX", "unsupported")
        .when((F.col("kind") == "CSV") & is_truncated(text), "truncated")
    )
    return seen.withColumns({
        "reason": reason, "file_hash": F.sha2("content", 256), "format_mismatch": F.col("sniffed_kind").isNotNull(), "encoding": F.when(readable, encoding(F.col("content"))),
    }).drop("named_kind")


def encoding(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head == "EFBBBF", "utf-8-bom").when(head.startswith("FFFE"), "utf-16-le").when(head.startswith("FEFF"), "utf-16-be").otherwise("utf-8")


def versions(files: DataFrame, by: list[str]) -> DataFrame:
    """files (file_hash, created_at, upload_id) with version, previous_upload_id and is_superseded: files with the same bytes follow one another."""
    order = Window.partitionBy(*by, "file_hash").orderBy("created_at", "upload_id")
    return files.withColumns({"version": F.row_number().over(order), "previous_upload_id": F.lag("upload_id").over(order), "is_superseded": F.lead("upload_id").over(order).isNotNull()})


def canonical_hash(date: Column, description: Column, amount: Column, bank_category: Column, row_index: Column) -> Column:
    """The hash of a row's raw values and its place."""
    return F.sha2(F.concat_ws("|", date, description, amount, F.coalesce(bank_category, F.lit("")), row_index.cast("string")), 256)


def decoded(content: Column) -> Column:
    """Bytes to text by their byte-order mark; UTF-8 without one."""
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda at, charset: F.decode(F.substring(content, at, 2**31 - 1), charset)
    return F.when(head == "EFBBBF", rest(4, "UTF-8")).when(head.startswith("FFFE"), rest(3, "UTF-16LE")).when(head.startswith("FEFF"), rest(3, "UTF-16BE")).otherwise(rest(1, "UTF-8"))


def is_truncated(text: Column) -> Column:
    """An odd number of quotes: the last one is not closed."""
    return (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1


def line_ending(text: Column) -> Column:
    crlf = F.regexp_count(text, F.lit("\r\n"))
    cr, lf = F.regexp_count(text, F.lit("\r")) - crlf, F.regexp_count(text, F.lit("\n")) - crlf
    return F.when((crlf >= cr) & (crlf >= lf), "CRLF").when(cr >= lf, "CR").otherwise("LF")


def _field(text: Column, tag: str) -> Column:
    return F.trim(F.regexp_extract(text, rf"(?i)<{tag}>([^<\r\n]*)", 1))


def ofx_envelope(files: DataFrame, text_col: str = "text") -> DataFrame:
    """files without their text, with currency, account, account_type, bank, first_day, last_day, ledger_balance of what follows <OFX>."""
    body = F.when(F.contains(text_col, F.lit("<OFX>")), F.concat(F.lit("<OFX>"), F.substring_index(text_col, "<OFX>", -1))).otherwise(F.col(text_col))
    day = lambda tag: F.try_to_date(F.substring(_field(body, tag), 1, 8), "yyyyMMdd")
    return files.withColumns({
        "currency": F.coalesce(F.nullif(_field(body, "CURDEF"), F.lit("")), F.lit("USD")), "account": _field(body, "ACCTID"), "account_type": _field(body, "ACCTTYPE"), "bank": _field(body, "BANKID"),
        "first_day": day("DTSTART"), "last_day": day("DTEND"), "ledger_balance": _field(body, "BALAMT").try_cast("decimal(18,2)"),
    }).drop(text_col)


def ofx_variant(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(ending == ".qfx", "QFX").when(ending == ".qbo", "QBO").otherwise("OFX")


def ofx_transactions(files: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a transaction of each text: the file's other columns, account, currency, parse_order, the transaction's fields.

    Blocks without a date or an amount are left out. posted is null if the date is no date.
    """
    text = F.col(text_col)
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)<STMTTRN>(.*?)</STMTTRN>"), 1)
    whole = F.filter(blocks, lambda b: (_field(b, "DTPOSTED") != "") & (_field(b, "TRNAMT") != ""))
    others = [c for c in files.columns if c != text_col]
    rows = files.select(
        *others, _field(text, "ACCTID").alias("account"), F.coalesce(F.nullif(_field(text, "CURDEF"), F.lit("")), F.lit("USD")).alias("currency"),
        F.posexplode(whole).alias("parse_order", "block"),
    )
    b = F.col("block")
    name, memo = F.nullif(_field(b, "NAME"), F.lit("")), F.nullif(_field(b, "MEMO"), F.lit(""))
    return rows.select(
        *others, "account", "currency", "parse_order", _field(b, "TRNTYPE").alias("kind"),
        F.try_to_date(F.substring(_field(b, "DTPOSTED"), 1, 8), "yyyyMMdd").alias("posted"),
        _field(b, "TRNAMT").try_cast("decimal(18,2)").alias("amount"), _field(b, "FITID").alias("fit_id"),
        F.coalesce(name, memo).alias("description"), F.coalesce(memo, name).alias("description_raw"),
        F.nullif(_field(b, "CHECKNUM"), F.lit("")).alias("check_number"),
        # a transaction without the bank's number is known by its whole block
        F.sha2(F.concat("account", F.lit("|ofx:"), F.when(_field(b, "FITID") != "", _field(b, "FITID")).otherwise(F.concat(F.lit("<STMTTRN>"), b, F.lit("</STMTTRN>")))), 256).alias("row_key"),
    )
