"""Queries that run the scalar functions over generated statement text, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars as f
from tallyspark.sources.ledgers import table


def raw_dates(spark, d) -> DataFrame:
    """Order days in eight written forms, some of them wrong."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 8
    text = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyyMMdd")).when(k == 2, F.date_format(day, "MM/dd/yyyy"))
        .when(k == 3, F.date_format(day, "dd.MM.yy")).when(k == 4, F.concat(F.lit(" "), F.date_format(day, "MMM d, yyyy"))).when(k == 5, F.date_format(day, "dd-MMM-yyyy"))
        .when(k == 6, F.lit("2024-02-30")).otherwise(F.lit(""))
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("raw"), (F.col("o_orderkey") % 3).alias("file_order"))


def raw_amounts(spark, d) -> DataFrame:
    """Values in twelve written forms."""
    k, x = F.col("event_id") % 12, F.floor(F.col("value") * 100 + 0.5).cast("long")
    plain, two = f.from_cents(x), F.lpad((x % 100).cast("string"), 2, "0")
    comma = F.replace(plain, F.lit("."), F.lit(","))
    text = (
        F.when(k == 0, plain).when(k == 1, F.concat(F.lit("("), plain, F.lit(")"))).when(k == 2, F.concat(F.lit("$ "), plain)).when(k == 3, F.concat(plain, F.lit("-")))
        .when(k == 4, F.concat(comma, F.lit(" €"))).when(k == 5, F.concat(F.lit("1.2"), two, F.lit(",50"))).when(k == 6, F.concat(F.lit("1,2"), two, F.lit(".5")))
        .when(k == 7, F.concat(F.lit("-$"), plain)).when(k == 8, F.concat(F.lit("R$"), plain)).when(k == 9, F.concat(F.lit("HK$ -"), plain))
        .when(k == 10, F.concat(F.lit("($"), plain, F.lit(")"))).otherwise(F.concat(F.lit("Rp"), comma, F.lit("-")))
    )
    return table(spark, d, "events").select(F.col("event_id").alias("id"), text.alias("raw"))


AMOUNTS = """WITH e AS (SELECT event_id AS id, event_id % 12 AS k, CAST(floor(value * 100 + 0.5) AS BIGINT) AS x FROM events),
t AS (SELECT *, CAST(x // 100 AS VARCHAR) || '.' || lpad(CAST(x % 100 AS VARCHAR), 2, '0') AS plain, lpad(CAST(x % 100 AS VARCHAR), 2, '0') AS p FROM e)"""


def names(spark, d) -> DataFrame:
    """Part names as bank lines, in six forms."""
    k, name, number = F.col("p_partkey") % 6, F.col("p_name"), F.col("p_partkey").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit("POS Debit "), name, F.lit("  #"), number, F.lit(" 12345 CA")))
        .when(k == 1, F.concat(F.lit(" TST*"), name, F.lit(" San Jose Ca Date X Xx X 734 Card 25 G0a3")))
        .when(k == 2, F.concat(name, F.lit(" Type: PPD Co: 99 Id: "), number)).when(k == 3, F.concat(F.lit("Recurring "), name, F.lit(", new york")))
        .when(k == 4, F.concat(F.lit("Payment To "), name, F.lit(" Autopay"))).otherwise(F.concat(name, F.lit(" ny card 25 x")))
    )
    plain = F.concat(name, F.lit(" "), number)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw"), plain.alias("plain"))


NAMES = """WITH p AS (SELECT p_partkey AS id, p_name AS name, CAST(p_partkey AS VARCHAR) AS number, p_partkey % 6 AS k FROM part),
n AS (SELECT id, CASE k WHEN 0 THEN 'POS Debit ' || name || '  #' || number || ' 12345 CA' WHEN 1 THEN ' TST*' || name || ' San Jose Ca Date X Xx X 734 Card 25 G0a3'
  WHEN 2 THEN name || ' Type: PPD Co: 99 Id: ' || number WHEN 3 THEN 'Recurring ' || name || ', new york' WHEN 4 THEN 'Payment To ' || name || ' Autopay'
  ELSE name || ' ny card 25 x' END AS raw, name || ' ' || number AS plain, lower(name) AS low, number, k FROM p)"""
TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"
SQUEEZE = "regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"


def _dates(spark, d):
    order = F.when(F.col("file_order") == 1, "MDY").when(F.col("file_order") == 2, "DMY")
    return raw_dates(spark, d).select("id", f.normalize_date(F.col("raw"), order).alias("n")).select("id", "n.date", "n.status", "n.option_a", "n.option_b")


QUERIES = {
    "f01_normalize_date": (
        _dates,
        """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, o_orderkey % 3 AS fo, CAST(o_orderdate AS DATE) AS dt FROM orders),
        r AS (SELECT *, CASE WHEN k = 2 THEN dt WHEN k = 3 AND day(dt) <= 12 THEN make_date(year(dt), day(dt), month(dt)) END AS a0,
                     CASE WHEN k = 3 THEN dt WHEN k = 2 AND day(dt) <= 12 THEN make_date(year(dt), day(dt), month(dt)) END AS b0 FROM o),
        s AS (SELECT *, CASE WHEN k = 3 THEN make_date(2000 + year(dt) % 100, month(a0), day(a0)) ELSE a0 END AS a, CASE WHEN k = 3 THEN make_date(2000 + year(dt) % 100, month(b0), day(b0)) ELSE b0 END AS b FROM r),
        u AS (SELECT *, k IN (2, 3) AND a IS NOT NULL AND b IS NOT NULL AND a <> b AS two FROM s),
        v AS (SELECT *, CASE WHEN k IN (0, 1, 4, 5) THEN dt WHEN two THEN CASE fo WHEN 1 THEN a WHEN 2 THEN b END WHEN k IN (2, 3) THEN coalesce(a, b) END AS date FROM u)
        SELECT id, date, CASE WHEN k = 7 THEN 'MISSING' WHEN date IS NOT NULL THEN 'RESOLVED' WHEN two THEN 'AMBIGUOUS' ELSE 'INVALID' END AS status,
               CASE WHEN two AND date IS NULL THEN a END AS option_a, CASE WHEN two AND date IS NULL THEN b END AS option_b FROM v""",
    ),
    "f02_normalize_amount": (
        lambda s, d: raw_amounts(s, d).select("id", (f.normalize_amount(F.col("raw")) * 100).cast("long").alias("cents")),
        AMOUNTS + """SELECT id, CASE WHEN k IN (0, 2, 4, 8) THEN x WHEN k IN (1, 3, 9, 11) THEN -x WHEN k IN (5, 6) THEN 120000 + (x % 100) * 100 + 50 END AS cents FROM t""",
    ),
    "f11_cents": (
        lambda s, d: raw_amounts(s, d).select("id", f.to_cents(F.col("raw")).alias("cents"), f.from_cents(-f.to_cents(F.col("raw"))).alias("back")),
        AMOUNTS + "SELECT id, CASE WHEN k = 0 THEN x END AS cents, CASE WHEN k = 0 THEN CASE WHEN x > 0 THEN '-' ELSE '' END || plain END AS back FROM t",
    ),
    "f04_fingerprint": (
        lambda s, d: table(s, d, "events").select(
            F.col("event_id").alias("id"),
            f.fingerprint(F.when(F.col("event_id") % 5 > 0, F.col("ts").cast("date")), F.col("event_id"), F.concat(F.lit(" "), F.upper("event_type")), F.lit(None)).alias("fingerprint"),
            f.row_hash(F.col("user_id").cast("string"), F.col("props")).alias("row_hash")),
        """SELECT event_id AS id, sha256(CASE WHEN event_id % 5 > 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) ELSE 'NO_DATE' END || '|||' || CAST(event_id AS VARCHAR) || '|||' || event_type || '|||NO_BALANCE') AS fingerprint,
           sha256(CAST(user_id AS VARCHAR) || '|' || props) AS row_hash FROM events""",
    ),
    "f14_normalize_merchant": (
        lambda s, d: names(s, d).select("id", f.normalize_merchant(F.col("raw")).alias("merchant")),
        NAMES + f"""SELECT id, {TITLE.format("CASE k WHEN 1 THEN 'tst ' || low || ' san jose' WHEN 3 THEN 'recurring ' || low WHEN 4 THEN 'payment to ' || low || ' autopay' ELSE low END")} AS merchant FROM n""",
    ),
    "f15_normalize_vendor": (
        lambda s, d: names(s, d).select(
            "id", f.normalize_vendor(F.col("raw")).alias("vendor"), f.upload_vendor(F.col("plain")).alias("upload_vendor"), f.recurring_key(F.col("raw")).alias("recurring_key"),
            f.visited_merchant(F.concat("plain", F.lit("  x #12 "))).alias("visited")),
        NAMES + """SELECT id, CASE k WHEN 0 THEN 'debit ' || low || ' ' || number || ' 12345 ca' WHEN 1 THEN 'tst' || low || ' san jose ca date x xx x 734 card 25 g0a3'
              WHEN 2 THEN low || ' type ppd co 99 id ' || number WHEN 3 THEN low || ' new york' WHEN 4 THEN 'payment to ' || low || ' autopay' ELSE low || ' ny card 25 x' END AS vendor,
            low AS upload_vendor,
            CASE k WHEN 0 THEN low || ' ' || number || ' 12345 ca' WHEN 1 THEN 'tst ' || low || ' san jose ca date x xx x 734 card 25 g0a3' WHEN 2 THEN low || ' type ppd co 99 id ' || number
              WHEN 3 THEN 'recurring ' || low || ' new york' WHEN 4 THEN low ELSE low || ' ny card 25 x' END AS recurring_key, plain || ' x' AS visited FROM n""",
    ),
    "f17_vendor_key": (
        lambda s, d: names(s, d).select("id", f.vendor_key(F.col("plain")).alias("vendor_key"), f.rule_key(F.concat(F.lit("a&b "), "id")).alias("rule_key")),
        NAMES + "SELECT id, upper(low) AS vendor_key, 'ab ' || number AS rule_key FROM n",
    ),
    "f26_redact": (
        lambda s, d: table(s, d, "documents").select("doc_id", f.redact(F.col("text"), None).alias("t"), F.md5(f.normalize_description(F.col("text"))).alias("one_line_md5")).select(
            "doc_id", F.md5("t").alias("redacted_md5"), F.substring("t", 1, 200).alias("shown"), "one_line_md5"),
        r"""WITH r AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
              '\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b', '[CARD]', 'g'), '\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b', '[PHONE]', 'g'),
              '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[EMAIL]', 'g'), '\b\d{9}\b', '[ACCOUNT]', 'g'), '\*{4}\d{4}', '[CARD]', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)
            SELECT doc_id, md5(t) AS redacted_md5, t[1:200] AS shown,
              md5(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[\r\n]+', ' ', 'g'), '[ \t]{2,}', ' ', 'g')) AS one_line_md5 FROM r""",
    ),
    "f07_signs_and_currency": (
        lambda s, d: table(s, d, "events").select(
            F.col("event_id").alias("id"),
            f.merge_debit_credit(F.when(F.col("event_id") % 3 == 0, F.col("event_id")), F.when(F.col("event_id") % 3 > 0, F.col("user_id"))).alias("merged"),
            f.enforce_sign(F.col("event_id"), F.when(F.col("event_id") % 2 == 0, " DR").otherwise("Credit")).alias("signed"),
            f.currency(F.when(F.col("event_id") % 2 == 0, "5 NZ$").otherwise("5"), F.when(F.col("event_id") % 3 == 0, "chf")).alias("currency"),
            f.transaction_type(F.col("event_id") - 50, F.col("event_id") % 5 == 0).alias("type"), f.escalated(F.lit("VALID"), F.col("event_id") % 2 == 0).alias("escalated"),
            f.rule_specificity(F.lit("vendor_smart")).cast("long").alias("specificity"), f.rule_reason(F.lit("vendor_exact")).alias("reason"),
            f.days_until(F.lit("2024-02-01").cast("date"), F.col("ts").cast("date")).cast("long").alias("days_until"),
            f.ingestion_status(F.when(F.col("event_id") % 5 == 0, "AMBIGUOUS").otherwise("RESOLVED"), F.when(F.col("event_id") % 7 > 0, F.lit(1)), F.col("event_id") % 11 == 0).alias("status")),
        """SELECT event_id AS id, nullif(CASE WHEN event_id % 3 = 0 THEN -event_id ELSE user_id END, 0) AS merged, CASE WHEN event_id % 2 = 0 THEN -event_id ELSE event_id END AS signed,
           CASE WHEN event_id % 2 = 0 THEN 'NZD' WHEN event_id % 3 = 0 THEN 'CHF' ELSE 'USD' END AS currency,
           CASE WHEN event_id % 5 = 0 THEN 'transfer' WHEN event_id >= 50 THEN 'income' ELSE 'expense' END AS type, CASE WHEN event_id % 2 = 0 THEN 'WARNING' ELSE 'VALID' END AS escalated,
           2::BIGINT AS specificity, 'Vendor only' AS reason, CAST(DATE '2024-02-01' - CAST(ts AS DATE) AS BIGINT) AS days_until,
           CASE WHEN event_id % 5 = 0 THEN 'UNRESOLVED' WHEN event_id % 7 = 0 THEN 'UNRESOLVED' WHEN event_id % 11 = 0 THEN 'WARNING' ELSE 'VALID' END AS status
           FROM events""",
    ),
    "f34_json": (
        lambda s, d: table(s, d, "events").select(
            F.col("event_id").alias("id"), F.from_json("props", "k long")["k"].alias("k"),
            F.size(f.tolerant_json_array(F.concat(F.lit('```json [{"a":1},{"a":2},{"a":'), F.when(F.col("event_id") % 2 == 0, "3}]").otherwise("")), "struct<a:int>")).cast("long").alias("items")),
        "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS items FROM events",
    ),
}
