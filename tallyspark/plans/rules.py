"""Queries of rules, statement files and lists, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tallyspark.operators import dictionaries, lists
from tallyspark.operators import rules as r
from tallyspark.sources import ledgers, statements
from tallyspark.sources.ledgers import table
from tallyspark.sources.scratch import written

RULES = [
    (1, "exact", "CLICK 5", "Exact", 1, 9), (2, "contains", "purchase", "Shopping", 1, 5), (3, "regex", "^(view|CLICK) [1-9]$", "Browsing", 1, 7),
    (4, "contains", " 1", "Ones", 0, 1), (5, "contains", "sign", "Joining", 1, 5), (6, "regex", "err.r", "Faults", 1, 2),
]
RULE_FIELDS = "rule_id int, match_type string, match_value string, category string, owner_rank int, priority int"
RULE_SQL = "rules(rule_id, match_type, match_value, category, owner_rank, priority) AS (VALUES " + ", ".join(map(str, RULES)) + ")"
MATCH = """CASE match_type WHEN 'exact' THEN lower(merchant) = lower(match_value) WHEN 'contains' THEN contains(lower(merchant), lower(match_value))
           ELSE regexp_matches(merchant, match_value, 'i') END"""


def _owned_rules(spark, d):
    """Four rules a user, two of them by part and one an expression, and three of the system."""
    own = ledgers.ledger_ev(spark, d).select("user_id").distinct().select(F.col("user_id").alias("owner_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    kind, who = F.get(F.array(*map(F.lit, ("contains", "exact", "regex", "contains"))), F.col("k")), F.col("owner_id")
    word = F.get(F.array(*map(F.lit, ("URCH", "click", "^(view|sig).* [1-9]$", "n 1"))), F.col("k"))
    value = F.when(F.col("k") == 1, F.concat(word, F.lit(" "), (who % 9).cast("string"))).otherwise(word)
    own = own.select("owner_id", (who * 4 + F.col("k")).cast("int").alias("rule_id"), kind.alias("match_type"), value.alias("match_value"),
                     F.concat(F.lit("U"), (who % 5).cast("string"), F.lit("-"), F.col("k").cast("string")).alias("category"), F.lit(0).alias("owner_rank"), ((who + F.col("k") * 7) % 4).cast("int").alias("priority"))
    system = spark.createDataFrame(RULES[1:4], RULE_FIELDS).select(F.lit(None).cast("long").alias("owner_id"), (-F.col("rule_id")).alias("rule_id"), "match_type", "match_value", "category", F.lit(1).alias("owner_rank"), "priority")
    return own.unionByName(system)


OWNED_SQL = """rules AS (SELECT user_id AS owner_id, user_id * 4 + k AS rule_id, ['contains', 'exact', 'regex', 'contains'][k + 1] AS match_type,
    CASE WHEN k = 1 THEN 'click ' || (user_id % 9) ELSE ['URCH', 'click', '^(view|sig).* [1-9]$', 'n 1'][k + 1] END AS match_value, 'U' || (user_id % 5) || '-' || k AS category, 0 AS owner_rank, (user_id + k * 7) % 4 AS priority
    FROM (SELECT DISTINCT user_id FROM events), range(4) t(k)
  UNION ALL SELECT NULL, -rule_id, match_type, match_value, category, 1, priority FROM (VALUES """ + ", ".join(map(str, RULES[1:4])) + """) v(rule_id, match_type, match_value, category, owner_rank, priority))"""


def _vendor_rules(spark):
    rows = [(k, t, f"m{k % 10}", None if k % 3 else "1-URGENT", -(500 + 100 * (k % 10) + 1), [500 + 100 * (k % 10) + 2], f"C{k % 4}", "always" if k % 5 else "suggest")
            for k in range(30) for t in [("vendor_exact", "vendor_exact_amount", "vendor_smart")[k % 3]]]
    return spark.createDataFrame(rows, "rule_id int, match_type string, vendor_key string, account_id string, amount_cents long, learned array<long>, category string, mode string")


VENDOR_SQL = """rules AS (SELECT k AS rule_id, ['vendor_exact', 'vendor_exact_amount', 'vendor_smart'][k % 3 + 1] AS match_type, 'm' || (k % 10) AS rk,
  CASE WHEN k % 3 = 0 THEN '1-URGENT' END AS ra, -(500 + 100 * (k % 10) + 1) AS rc, 500 + 100 * (k % 10) + 2 AS learned, 'C' || (k % 4) AS category, k % 5 > 0 AS always FROM range(30) t(k))"""


KINDS = ["vendor_exact_amount", "vendor_amount_range", "vendor_contains_text", "vendor_smart", "vendor_exact"]


def _user_rules(spark):
    """400 rules of 20 users for ten vendors, of all kinds; some are off, for one account or one direction."""
    k = F.col("k")
    v = F.floor(k / 20) % 10
    pick = lambda values, n: F.get(F.array(*(F.lit(x) for x in values)), (k % n).cast("int"))
    name = F.concat(F.lit("m"), v.cast("string"))
    return spark.range(400).withColumnRenamed("id", "k").select(
        k.cast("int").alias("rule_id"), (k % 20).alias("user_id"), F.when(k % 10 == 4, "").otherwise(name).alias("vendor_key"), name.alias("match_value"), (k % 11 > 0).alias("is_enabled"),
        F.when(k % 7 == 0, "1-URGENT").alias("account_id"), pick(["debits", "both", "credits"], 3).alias("applies_to"), pick(KINDS, 5).alias("match_type"), (k % 3).cast("int").alias("priority"),
        F.concat(F.lit("C"), (k % 4).cast("string")).alias("category"), F.when(k % 2 == 0, "ask").otherwise("always").alias("mode"), F.when(k % 3 == 0, "low").otherwise("high").alias("confidence"),
        (500 + 100 * v + 1).alias("amount_exact"), (500 + 100 * v + 2).alias("amount_min"), (500 + 100 * v + 3).alias("amount_max"),
        F.concat(F.lit("PAY M"), v.cast("string")).alias("contains_text"), F.array(500 + 100 * v + 4).alias("learned"),
    )


def _charges(spark, d):
    """One row for each id of the recurring ledger."""
    rows = ledgers.ledger_rec(spark, d).groupBy("tx_id").agg(*(F.min(c).alias(c) for c in ("user_id", "account_id", "merchant", "amount_cents")))
    return rows.select("tx_id", "user_id", "account_id", F.upper("merchant").alias("vendor_key"), F.upper("merchant").alias("vendor"), "amount_cents", F.concat(F.lit("pay "), "merchant").alias("description"))


CHARGES = f"""WITH {ledgers.SQL}, t AS (SELECT tx_id, min(user_id) AS user_id, min(account_id) AS account_id, min(merchant) AS merchant, min(amount_cents) AS amount_cents FROM ledger_rec GROUP BY tx_id),
u AS (SELECT k AS rule_id, k % 20 AS user_id, 'm' || ((k // 20) % 10) AS vendor, CASE WHEN k % 7 = 0 THEN '1-URGENT' END AS account_id, ['debits', 'both', 'credits'][k % 3 + 1] AS applies_to,
  {KINDS}[k % 5 + 1] AS match_type, k % 3 AS priority, 'C' || (k % 4) AS category, CASE WHEN k % 2 = 0 THEN 'ask' ELSE 'always' END AS mode, CASE WHEN k % 3 = 0 THEN 'low' ELSE 'high' END AS confidence,
  500 + 100 * ((k // 20) % 10) AS base, k % 11 > 0 AS is_enabled FROM range(400) r(k))"""


def _ofx(spark, d):
    """Each customer's orders as one OFX text."""
    o = table(spark, d, "orders")
    part = F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("<TRNAMT>-"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    block = F.concat(F.lit("<STMTTRN>\n<TRNTYPE>DEBIT\n<DTPOSTED>"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000\n"), part,
                     F.lit("\n<FITID>"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("\n<NAME>"), F.col("o_orderpriority"))).otherwise(""), F.lit("\n<MEMO>Memo "), F.col("o_orderstatus"), F.lit("\n</STMTTRN>"))
    texts = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", block.alias("b")))), lambda x: x["b"]), "\n").alias("body"))
    return texts.select(F.col("o_custkey").alias("file"), F.concat(F.lit("OFXHEADER:100\n<OFX><CURDEF>EUR\n<ACCTID>"), F.col("o_custkey").cast("string"), F.lit("\n<ACCTTYPE>SAVINGS\n<DTSTART>20010203\n<BALAMT>"), F.col("o_custkey").cast("string"), F.lit(".5\n"), F.col("body"), F.lit("</OFX>")).alias("text"))


def _queue(spark, d):
    """One row for each id of the order lines; some without a merchant, some without either name."""
    one = ledgers.ledger_li(spark, d).groupBy("tx_id").agg(*(F.min(c).alias(c) for c in ("user_id", "tx_date", "amount_cents", "merchant", "app_category")))
    return one.select("tx_id", "user_id", "tx_date", "amount_cents", F.when(F.col("tx_id") % 3 > 0, F.initcap("merchant")).alias("merchant"), F.trim("app_category").alias("description"))


def _queue_orders(queue):
    """The queue in six orders; it is made once."""
    asked = [(by, down) for by in ("date", "amount", "vendor") for down in (False, True)]
    return reduce(lambda a, b: a.unionByName(b), (lists.queued(queue, by, down, ["user_id", "tx_id"]).select(F.lit(f"{by} {down}").alias("sorted"), "user_id", "tx_id", "place") for by, down in asked))


QUEUE_SQL = """one AS (SELECT tx_id, min(user_id) AS user_id, min(tx_date) AS tx_date, min(amount_cents) AS amount_cents, min(merchant) AS merchant, min(app_category) AS app_category FROM ledger_li GROUP BY tx_id),
queue AS (SELECT tx_id, user_id, tx_date, amount_cents, lower(CASE WHEN tx_id % 3 > 0 THEN merchant ELSE coalesce(trim(app_category), '') END) AS vendor FROM one)"""


QUERIES = {
    "k01_ordered_rules": (
        lambda s, d: r.apply_ordered_rules(ledgers.ledger_ev(s, d).select("tx_id", "merchant"), s.createDataFrame(RULES, RULE_FIELDS), "merchant"),
        f"""WITH {ledgers.SQL}, {RULE_SQL}, f AS (SELECT tx_id, category, rule_id FROM ledger_ev JOIN rules ON {MATCH}
            QUALIFY row_number() OVER (PARTITION BY tx_id ORDER BY owner_rank, priority DESC, rule_id) = 1)
            SELECT l.tx_id, merchant, category, rule_id FROM ledger_ev l LEFT JOIN f ON l.tx_id = f.tx_id""",
    ),
    "k01_user_rules": (
        lambda s, d: r.apply_ordered_rules(ledgers.ledger_ev(s, d).select("tx_id", "user_id", "merchant"), _owned_rules(s, d), "merchant", "user_id"),
        f"""WITH {ledgers.SQL}, {OWNED_SQL}, f AS (SELECT tx_id, category, rule_id FROM ledger_ev JOIN rules ON (owner_id IS NULL OR owner_id = user_id) AND {MATCH}
            QUALIFY row_number() OVER (PARTITION BY tx_id ORDER BY owner_rank, priority DESC, rule_id) = 1)
            SELECT l.tx_id, user_id, merchant, category, rule_id FROM ledger_ev l LEFT JOIN f ON l.tx_id = f.tx_id""",
    ),
    "k03_categorize": (
        lambda s, d: r.categorize(ledgers.ledger_ev(s, d).select("tx_id", "merchant", "amount_cents"), s.createDataFrame(RULES[1:4], RULE_FIELDS), "merchant", keywords=dictionaries.table_of(s, [("ERR", "Fees"), ("or 2", "Twos")], "category string"))
        .groupBy("category", "confidence").agg(F.count("*").alias("tx_count"), F.sum("amount_cents").alias("net_cents")),
        f"""WITH {ledgers.SQL}, {RULE_SQL}, f AS (SELECT tx_id, category FROM ledger_ev JOIN rules ON rule_id BETWEEN 2 AND 4 AND {MATCH}
            QUALIFY row_number() OVER (PARTITION BY tx_id ORDER BY owner_rank, priority DESC, rule_id) = 1)
            SELECT CASE WHEN f.category IS NOT NULL THEN f.category WHEN amount_cents > 0 THEN 'Income' WHEN contains(merchant, 'err') THEN 'Fees' WHEN contains(merchant, 'or 2') THEN 'Twos' ELSE 'Other' END AS category,
                   CASE WHEN f.category IS NOT NULL THEN 1.0 WHEN amount_cents > 0 THEN 0.75 WHEN contains(merchant, 'err') OR contains(merchant, 'or 2') THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence, count(*) AS tx_count, CAST(sum(amount_cents) AS BIGINT) AS net_cents
            FROM ledger_ev l LEFT JOIN f ON l.tx_id = f.tx_id GROUP BY 1, 2""",
    ),
    "k08_vendor_rules": (
        lambda s, d: r.apply_vendor_rules(
            ledgers.ledger_rec(s, d).groupBy("tx_id").agg(F.min("account_id").alias("account_id"), F.min("merchant").alias("vendor_key"), F.min("amount_cents").alias("amount_cents")), _vendor_rules(s)
        ),
        f"""WITH {ledgers.SQL}, {VENDOR_SQL}, t AS (SELECT tx_id, min(account_id) AS account_id, min(merchant) AS vendor_key, min(amount_cents) AS amount_cents FROM ledger_rec GROUP BY tx_id)
        SELECT tx_id, CASE WHEN count(DISTINCT category) > 1 THEN 'conflict' WHEN bool_and(always) THEN 'assigned' ELSE 'review' END AS outcome,
               CASE WHEN count(DISTINCT category) = 1 THEN min(category) END AS category
        FROM t JOIN rules ON vendor_key = rk AND (ra IS NULL OR ra = account_id)
          AND (match_type = 'vendor_exact' OR match_type = 'vendor_exact_amount' AND amount_cents = rc OR match_type = 'vendor_smart' AND abs(amount_cents) = learned)
        GROUP BY tx_id""",
    ),
    "k05_match_rules": (
        lambda s, d: r.dry_run(r.match_rules(_charges(s, d), _user_rules(s))),
        CHARGES + """, c AS (SELECT t.tx_id, t.merchant, -t.amount_cents AS x, u.*, CASE match_type WHEN 'vendor_exact_amount' THEN 1 WHEN 'vendor_amount_range' THEN 2 WHEN 'vendor_smart' THEN 2 WHEN 'vendor_contains_text' THEN 3 ELSE 4 END AS score
            FROM t JOIN u ON t.user_id = u.user_id AND t.merchant = u.vendor AND (u.account_id IS NULL OR u.account_id = t.account_id) AND applies_to <> 'credits' AND is_enabled),
        w AS (SELECT *, row_number() OVER o AS k, lead(score) OVER o AS ns, lead(category) OVER o AS nc FROM c WINDOW o AS (PARTITION BY tx_id ORDER BY score, priority, rule_id)),
        j AS (SELECT *, CASE WHEN ns = score AND nc <> category THEN 'needs_review' WHEN CASE match_type WHEN 'vendor_exact_amount' THEN x = base + 1 WHEN 'vendor_amount_range' THEN x BETWEEN base + 2 AND base + 3
              WHEN 'vendor_smart' THEN x = base + 4 ELSE true END THEN 'matched' ELSE 'unmatched' END AS status FROM w WHERE k = 1),
        m AS (SELECT tx_id, status, CASE WHEN status = 'matched' THEN rule_id END AS rule_id, CASE WHEN status = 'matched' THEN category END AS category, CASE WHEN status = 'matched' THEN mode END AS mode,
              CASE WHEN status = 'matched' THEN confidence END AS confidence, CASE status WHEN 'needs_review' THEN 'rule_conflict' WHEN 'matched' THEN CASE match_type WHEN 'vendor_exact_amount' THEN 'Vendor + Exact Amount'
              WHEN 'vendor_amount_range' THEN 'Vendor + Amount Range' WHEN 'vendor_smart' THEN 'Vendor + Smart Amounts' WHEN 'vendor_contains_text' THEN 'Vendor + Description' ELSE 'Vendor only' END END AS reason FROM j)
        SELECT t.tx_id, coalesce(status, 'unmatched') AS status, rule_id, category, mode, confidence, reason,
          CASE WHEN status = 'matched' AND mode = 'always' AND confidence = 'high' THEN 'auto' WHEN coalesce(status, 'unmatched') = 'unmatched' THEN 'unmatched' ELSE 'needs_review' END AS outcome FROM t LEFT JOIN m USING (tx_id)""",
    ),
    "k07_apply_to_upload": (
        lambda s, d: r.apply_to_upload(_charges(s, d), _user_rules(s).select(
            "user_id", "rule_id", F.when(F.col("rule_id") % 4 == 0, "contains").when(F.col("rule_id") % 4 == 1, "vendor_exact").otherwise("vendor_exact_amount").alias("match_type"),
            F.col("match_value").alias("value"), "account_id", (-F.col("amount_exact")).alias("amount_exact"), "category", "mode")),
        CHARGES + """, m AS (SELECT t.tx_id, count(*) AS matches, min(rule_id) AS rule_id, any_value(category) AS category, any_value(mode) AS mode FROM t JOIN u ON t.user_id = u.user_id AND (u.account_id IS NULL OR u.account_id = t.account_id)
            AND CASE WHEN rule_id % 4 = 0 THEN contains(t.merchant, vendor) OR contains(vendor, t.merchant) WHEN rule_id % 4 = 1 THEN t.merchant = vendor ELSE t.merchant = vendor AND -t.amount_cents = base + 1 END GROUP BY t.tx_id)
        SELECT t.tx_id, coalesce(matches, 0) AS matches, CASE WHEN matches IS NULL THEN 'skipped' WHEN matches > 1 THEN 'conflict' WHEN mode = 'always' THEN 'assigned' ELSE 'review' END AS outcome,
          CASE WHEN matches = 1 THEN rule_id END AS rule_id, CASE WHEN matches = 1 AND mode = 'always' THEN category END AS category FROM t LEFT JOIN m USING (tx_id)""",
    ),
    "a19_rule_preview": (
        lambda s, d: r.preview(_charges(s, d), _user_rules(s).withColumn("vendor_key", F.col("match_value"))),
        CHARGES + """SELECT rule_id, count(tx_id) AS vendor_count, count(*) FILTER (-amount_cents = base + 1) AS exact_count, count(*) FILTER (-amount_cents = base + 4) AS smart_count
            FROM u LEFT JOIN t ON t.user_id = u.user_id AND t.merchant = u.vendor GROUP BY rule_id""",
    ),
    "s14_ofx_transactions": (
        lambda s, d: statements.ofx_transactions(_ofx(s, d)).select("file", "account", "currency", "parse_order", "kind", "posted", F.col("amount").cast("double").alias("amount"), "fit_id", "description", "description_raw", "row_key"),
        """SELECT o_custkey AS file, CAST(o_custkey AS VARCHAR) AS account, 'EUR' AS currency, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS parse_order,
           'DEBIT' AS kind, CAST(o_orderdate AS DATE) AS posted, -CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, CAST(o_orderkey AS VARCHAR) AS fit_id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority ELSE 'Memo ' || o_orderstatus END AS description, 'Memo ' || o_orderstatus AS description_raw,
           sha256(o_custkey || '|ofx:' || o_orderkey) AS row_key FROM orders WHERE o_orderkey % 7 <> 0""",
    ),
    "s15_ofx_envelope": (
        lambda s, d: statements.ofx_envelope(_ofx(s, d)).select("file", "currency", "account", "account_type", "bank", "first_day", "last_day", F.col("ledger_balance").cast("double").alias("ledger_balance"), statements.ofx_variant(F.concat(F.lit("a/b."), F.when(F.col("file") % 2 == 0, "QFX").otherwise("txt"))).alias("variant")),
        """SELECT DISTINCT o_custkey AS file, 'EUR' AS currency, CAST(o_custkey AS VARCHAR) AS account, 'SAVINGS' AS account_type, '' AS bank, DATE '2001-02-03' AS first_day, NULL::DATE AS last_day, o_custkey + 0.5::DOUBLE AS ledger_balance,
           CASE WHEN o_custkey % 2 = 0 THEN 'QFX' ELSE 'OFX' END AS variant FROM orders""",
    ),
    "s31_canonical_hash": (
        lambda s, d: table(s, d, "events").select("event_id", statements.canonical_hash(F.col("ts").cast("date").cast("string"), F.col("event_type"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "c"), F.col("event_id")).alias("row_hash")),
        "SELECT event_id, sha256(CAST(CAST(ts AS DATE) AS VARCHAR) || '|' || event_type || '|' || user_id || '|' || CASE WHEN event_id % 2 = 0 THEN 'c' ELSE '' END || '|' || event_id) AS row_hash FROM events",
    ),
    "s04_text_checks": (
        lambda s, d: table(s, d, "pages").select("page_id", statements.is_truncated(F.col("html")).alias("is_truncated"), statements.line_ending(F.col("html")).alias("line_ending")),
        """WITH c AS (SELECT page_id, length(html) - length(replace(html, '"', '')) AS q, (length(html) - length(replace(html, chr(13) || chr(10), ''))) // 2 AS crlf,
           length(html) - length(replace(html, chr(13), '')) AS cr, length(html) - length(replace(html, chr(10), '')) AS lf FROM pages)
           SELECT page_id, q % 2 = 1 AS is_truncated, CASE WHEN crlf >= cr - crlf AND crlf >= lf - crlf THEN 'CRLF' WHEN cr >= lf THEN 'CR' ELSE 'LF' END AS line_ending FROM c""",
    ),
    "s05_file_versions": (
        lambda s, d: statements.versions(table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("upload_id"), F.md5("o_orderpriority").alias("file_hash"), F.col("o_orderdate").alias("created_at")), ["o_custkey"]).select(
            "upload_id", "version", "previous_upload_id", "is_superseded"),
        """SELECT o_orderkey AS upload_id, CAST(row_number() OVER w AS INT) AS version, lag(o_orderkey) OVER w AS previous_upload_id, lead(o_orderkey) OVER w IS NOT NULL AS is_superseded FROM orders
           WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)""",
    ),
    "t04_queue_sort": (
        lambda s, d: lists.queued(_queue(s, d), "vendor", False).select("tx_id", "place"),
        f"""WITH {ledgers.SQL}, {QUEUE_SQL} SELECT tx_id, row_number() OVER (PARTITION BY user_id ORDER BY vendor = '', vendor, tx_date DESC, tx_id) AS place FROM queue""",
    ),
    "t04_queue_orders": (
        lambda s, d: _queue_orders(written(_queue(s, d), "queue")),
        f"WITH {ledgers.SQL}, {QUEUE_SQL} " + " UNION ALL ".join(
            f"SELECT '{by} {down}' AS sorted, user_id, tx_id, row_number() OVER (PARTITION BY user_id ORDER BY {first}{key} {'DESC' if down else 'ASC'}, tx_date DESC, tx_id) AS place FROM queue"
            for by, first, key in (("date", "", "tx_date"), ("amount", "", "amount_cents"), ("vendor", "vendor = '', ", "vendor")) for down in (False, True)
        ),
    ),
}
