"""Queries of lists, exports, progress and candidates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import checks as c
from tallyspark.operators import lists as l
from tallyspark.operators import months as m
from tallyspark.operators import recurring as r
from tallyspark.operators import rules
from tallyspark.plans import recurring as r_sql
from tallyspark.plans.months import BASE, _base, _cats, _totals, budgets
from tallyspark.sources import ledgers
from tallyspark.sources import pdf_candidates as pdf


def _wide(spark, d):
    """The month's ledger with what lists filter by."""
    k = F.col("tx_id")
    return ledgers.ledger_ev(spark, d).withColumns({
        "upload_id": F.floor(k / 500).cast("long"), "description": F.concat(F.lit("Paid, at "), F.upper("merchant"), F.when(k % 6 == 0, ' "x"').otherwise("")), "bank_category": F.when(k % 4 == 0, "Bank A").otherwise("Bank B"),
        "app_category": F.when(k % 5 > 0, F.col("app_category")), "category": F.when(k % 3 == 0, "C1"), "override_category": F.when(k % 7 == 0, "C2"),
        "status": F.when(k % 8 == 0, "UNRESOLVED").when(k % 8 == 1, "WARNING").otherwise("VALID"), "is_possible_duplicate": k % 9 == 0,
    })


WIDE = f"""WITH {ledgers.SQL}, w AS (SELECT tx_id, user_id, account_id, tx_date, merchant, amount_cents, is_transfer, is_excluded, is_duplicate, tx_id // 500 AS upload_id, 'Paid, at ' || upper(merchant) || CASE WHEN tx_id % 6 = 0 THEN ' "x"' ELSE '' END AS description,
  CASE WHEN tx_id % 4 = 0 THEN 'Bank A' ELSE 'Bank B' END AS bank_category, CASE WHEN tx_id % 5 > 0 THEN app_category END AS app_category, CASE WHEN tx_id % 3 = 0 THEN 'C1' END AS category, CASE WHEN tx_id % 7 = 0 THEN 'C2' END AS override_category,
  CASE tx_id % 8 WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'WARNING' ELSE 'VALID' END AS status, tx_id % 9 = 0 AS is_possible_duplicate FROM ledger_ev)
"""
PLACE = "CAST(row_number() OVER (PARTITION BY user_id ORDER BY {0}) AS INT)"


def _exportable(spark, d):
    """The month's ledger with all that an export says."""
    k = F.col("tx_id")
    return _wide(spark, d).withColumns({
        "merchant": F.when(k % 10 == 0, "").when(k % 10 > 1, F.col("merchant")), "description_raw": F.when(k % 12 > 0, F.concat(F.lit("raw, "), k.cast("string"))), "currency": F.lit("USD"), "source": F.lit("rule"),
        "is_pending": k % 13 == 0, "foreign_currency": F.when(k % 59 == 0, "EUR"), "balance_cents": F.when(k % 4 > 0, F.col("amount_cents") - 12345), "check_number": F.when(k % 15 == 0, F.concat(F.lit("00"), k.cast("string"))),
        "bank_id": F.when(k % 3 == 0, F.concat(F.lit("b"), k.cast("string"))),
    })


DECIMAL = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || CAST(abs({0}) // 100 AS VARCHAR) || '.' || lpad(CAST(abs({0}) % 100 AS VARCHAR), 2, '0')"


def _dims(spark):
    accounts = spark.range(3).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("account_id"), F.concat(F.lit("Account "), F.col("id").cast("string")).alias("account_name"))
    uploads = spark.range(0, 100_000, 2).select(F.col("id").alias("upload_id"), F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".csv")).alias("filename"))
    return accounts, uploads


def _candidates(spark, d):
    """The month's events as candidates of statements, some of them without a part."""
    k = F.col("tx_id")
    rows = ledgers.ledger_ev(spark, d).select(
        F.col("user_id").alias("file_id"), k.alias("position"), F.when(k % 11 > 0, F.col("tx_date")).alias("date"), F.when(k % 7 == 0, " ").otherwise(F.col("app_category")).alias("description"),
        F.when(k % 13 > 0, F.when(k % 50 == 1, 200_000_000).otherwise(F.floor(F.abs("amount_cents") / 1000) * 1000)).cast("long").alias("amount_cents"),
        F.when(k % 5 == 0, "credit").when(k % 5 < 4, "debit").alias("direction"), (F.col("tx_id") % 15 / 10).alias("confidence"),
    )
    return pdf.validated(rows)


CANDIDATES = f"""WITH {ledgers.SQL}, c0 AS (SELECT user_id AS file_id, tx_id AS position, CASE WHEN tx_id % 11 > 0 THEN tx_date END AS date, CASE WHEN tx_id % 7 = 0 THEN ' ' ELSE app_category END AS description,
  CASE WHEN tx_id % 13 = 0 THEN NULL WHEN tx_id % 50 = 1 THEN 200000000 ELSE abs(amount_cents) // 1000 * 1000 END AS amount_cents, CASE WHEN tx_id % 5 = 0 THEN 'credit' WHEN tx_id % 5 < 4 THEN 'debit' END AS direction,
  least(1, (tx_id % 15) / 10::DOUBLE) AS confidence FROM ledger_ev),
cand AS (SELECT *, (confidence + (CASE WHEN date IS NULL THEN 0 ELSE 1 END + CASE WHEN description = ' ' THEN 0 ELSE 1 END + CASE WHEN coalesce(amount_cents, 0) = 0 THEN 0 ELSE 1 END + CASE WHEN direction IS NULL THEN 0 ELSE 1 END) / 4::DOUBLE) / 2 AS combined FROM c0)
"""


def _pages(spark, d):
    """Each customer's orders as a page of text: page numbers, blank lines, lines that go on with a transaction, and notes."""
    k = F.col("o_orderkey")
    amount = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    line = F.concat(
        F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" "), "o_orderpriority", F.lit(" $"), F.floor(amount / 100).cast("string"), F.lit("."), F.lpad((amount % 100).cast("string"), 2, "0"), F.lit("  \nPage 1 of 2\n"),
        F.when(k % 2 == 0, F.concat(F.lit("   ref "), k.cast("string"), F.lit("\n"))).otherwise(""), F.when(k % 3 == 0, "\n\nNotes 1.50\n=====\n").otherwise(""),
    )
    orders = ledgers.table(spark, d, "orders").select("o_custkey", k, line.alias("line"))
    body = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "").alias("body"))
    return body.select(F.col("o_custkey").alias("file"), F.concat(F.lit("\n7\nStatement of "), F.col("o_custkey").cast("string"), F.lit("\n \n\n"), "body").alias("text"))


def _files(spark, d):
    """Uploads of the month's ledger, every other one listed newest first; some dates are missing."""
    ev, k = ledgers.ledger_ev(spark, d), F.col("tx_id")
    up = F.floor(k / 100).cast("long")
    order = F.when(up % 2 == 0, k % 100).otherwise(99 - k % 100)
    return ev.select(up.alias("upload_id"), "tx_id", F.when(k % 19 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 100 / 4).cast("int"))).alias("tx_date"), F.when(k % 3 > 0, F.col("tx_date")).alias("posted_date"),
                     F.when(k % 4 > 0, (k % 10).cast("string")).alias("reference"), order.cast("int").alias("parse_order"), "amount_cents")


FILES = f"""WITH {ledgers.SQL}, fl AS (SELECT tx_id // 100 AS upload_id, tx_id, CASE WHEN tx_id % 19 > 0 THEN DATE '2024-01-01' + CAST(tx_id % 100 // 4 AS INT) END AS tx_date, CASE WHEN tx_id % 3 > 0 THEN tx_date END AS posted_date,
  CASE WHEN tx_id % 4 > 0 THEN CAST(tx_id % 10 AS VARCHAR) END AS reference, CAST(CASE WHEN tx_id // 100 % 2 = 0 THEN tx_id % 100 ELSE 99 - tx_id % 100 END AS INT) AS parse_order, amount_cents FROM ledger_ev),
di AS (SELECT upload_id, CASE WHEN arg_min(tx_date, parse_order) > arg_max(tx_date, parse_order) THEN 'descending' ELSE 'ascending' END AS direction
       FROM (SELECT upload_id, tx_date, parse_order FROM fl QUALIFY parse_order = min(parse_order) OVER (PARTITION BY upload_id) OR parse_order = max(parse_order) OVER (PARTITION BY upload_id)) GROUP BY upload_id),
ch AS (SELECT fl.*, direction, row_number() OVER (PARTITION BY fl.upload_id ORDER BY coalesce(CAST(tx_date AS VARCHAR), ''), coalesce(CAST(posted_date AS VARCHAR), ''), coalesce(reference, ''), CASE WHEN direction = 'descending' THEN -parse_order ELSE parse_order END) - 1 AS place
       FROM fl JOIN di USING (upload_id))
"""


def _totals_mode(spark, d):
    sums = _files(spark, d).groupBy("upload_id").agg(
        F.sum(F.when(F.col("amount_cents") > 0, F.col("amount_cents")).otherwise(0)).alias("credit_cents"), F.sum(F.when(F.col("amount_cents") < 0, F.col("amount_cents")).otherwise(0)).alias("debit_cents"), F.sum("amount_cents").alias("net_cents"),
    )
    k = F.col("upload_id")
    return c.reconcile_totals(sums.withColumns({
        "total_credits": F.when(k % 4 < 2, F.col("credit_cents")), "total_debits": F.when(k % 4 == 0, -F.col("debit_cents")).when(k % 4 == 1, F.lit(5).cast("long")), "opening": F.when(k % 3 == 0, F.lit(1000).cast("long")),
        "closing": F.when(k % 3 == 0, 1000 + F.col("net_cents") + F.when(k % 9 == 0, 7).otherwise(0)), "unresolved": k % 5,
    })).select("upload_id", "discrepancy_cents", "status")


def _monthly(spark, d):
    w = _wide(spark, d)
    return l.month_list(w, 2024, 1, merchant="R", min_cents=500, category="c2")


def _context(spark, d):
    base = _base(spark, d)
    return l.chat_context(_totals(spark, d), m.merchant_totals(base), m.compare(_cats(spark, d)), m.budget_status(_cats(spark, d), budgets(spark, d)))


def _upcoming(spark, d):
    charges = r.recurring_charges(ledgers.ledger_rec(spark, d)).withColumn("confidence", F.when(F.col("score") >= 80, "high").when(F.col("score") >= 60, "medium").otherwise("low"))
    return l.upcoming(charges, F.lit("2001-08-01").cast("date")).select("user_id", "merchant", "mean_cents", "next_charge", F.col("days_left").cast("long"))


QUERIES = {
    "p03_filtered_list": (
        lambda s, d: l.paged(l.filtered(_wide(s, d), 2024, 1, category="C1", shown_category="Bank A", max_cents=5000), "amount", False, 1, 20).select("user_id", "place", "tx_id").unionByName(
            l.paged(l.filtered(_wide(s, d), search="ERROR", shown_category="nothing"), "vendor", True, 2, 3).select("user_id", "place", "tx_id")),
        WIDE + f""", a AS (SELECT user_id, {PLACE.format("amount_cents, tx_id")} AS place, tx_id FROM w WHERE NOT is_excluded AND tx_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND amount_cents <= 5000
              AND (app_category = 'Bank A' OR (app_category IS NULL AND bank_category = 'Bank A'))),
        b AS (SELECT user_id, {PLACE.format("merchant DESC, tx_id")} AS place, tx_id FROM w WHERE NOT is_excluded AND (contains(description, 'ERROR') OR contains(merchant, 'ERROR')))
        SELECT * FROM a WHERE place <= 20 UNION ALL SELECT * FROM b WHERE place BETWEEN 4 AND 6""",
    ),
    "p04_ingestion_lists": (
        lambda s, d: l.filtered(_wide(s, d), ingestion="same-price").select("tx_id", F.lit("same-price").alias("kind")).unionByName(l.filtered(_wide(s, d), ingestion="flagged", uncategorized=True).select("tx_id", F.lit("flagged").alias("kind"))).unionByName(
            l.filtered(_wide(s, d), ingestion="duplicate", category="C1").select("tx_id", F.lit("duplicate").alias("kind"))),
        WIDE + """SELECT tx_id, 'same-price' AS kind FROM (SELECT tx_id, count(*) OVER (PARTITION BY user_id, amount_cents) AS n FROM w WHERE NOT is_excluded) WHERE n > 1
            UNION ALL SELECT tx_id, 'flagged' FROM w WHERE NOT is_excluded AND app_category IS NULL AND NOT is_transfer AND status IN ('UNRESOLVED', 'WARNING')
            UNION ALL SELECT tx_id, 'duplicate' FROM w WHERE NOT is_excluded AND is_possible_duplicate AND coalesce(override_category, category) = 'C1'""",
    ),
    "a10_list_counts": (
        lambda s, d: l.counted(l.filtered(_wide(s, d))),
        WIDE + """SELECT user_id, count(*) AS total, count(*) FILTER (status <> 'VALID') AS flagged, count(*) FILTER (is_possible_duplicate) AS duplicates, count(*) FILTER (app_category IS NULL) AS uncategorized, count(*) FILTER (n > 1) AS same_price
            FROM (SELECT *, count(*) OVER (PARTITION BY user_id, amount_cents) AS n FROM w WHERE NOT is_excluded) GROUP BY user_id""",
    ),
    "p05_month_list": (
        _monthly,
        WIDE + f""", a AS (SELECT *, {PLACE.format("tx_date, tx_id")} AS place FROM w WHERE NOT is_excluded AND NOT is_transfer AND NOT is_duplicate AND tx_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND contains(lower(merchant), 'r') AND amount_cents <= -500)
        SELECT user_id, tx_id, tx_date, merchant, -amount_cents AS size_cents, 'C2' AS shown_category FROM a WHERE place <= 500 AND override_category = 'C2'""",
    ),
    "s28_export_lines": (
        lambda s, d: l.csv_lines(l.exported(_exportable(s, d), *_dims(s))),
        WIDE + f""", c AS (SELECT *, {PLACE.format("tx_date DESC, tx_id")} AS place FROM w)
            SELECT user_id, place, CAST(tx_date AS VARCHAR) || ',' || CASE WHEN tx_id % 10 > 1 THEN merchant ELSE '"' || replace(description, '"', '""') || '"' END || ',' || CASE WHEN tx_id % 12 = 0 THEN '' ELSE '"raw, ' || tx_id || '"' END
            || ',' || {DECIMAL.format("amount_cents")} || ',USD,' || CASE WHEN is_transfer THEN 'transfer' WHEN amount_cents >= 0 THEN 'income' ELSE 'expense' END || ',' || coalesce(override_category, category, '') || ',' || CASE WHEN override_category IS NOT NULL THEN 'user' ELSE 'rule' END
            || ',Account ' || account_id[2:] || ',' || CASE WHEN upload_id % 2 = 0 THEN 'f' || upload_id || '.csv' ELSE '' END || ',' || status || ',' || (tx_id % 13 = 0) || ',' || is_transfer || ',' || (tx_id % 59 = 0) || ',' || CASE WHEN tx_id % 59 = 0 THEN 'EUR' ELSE '' END
            || ',' || CASE WHEN tx_id % 4 = 0 THEN '' ELSE {DECIMAL.format("amount_cents - 12345")} END || ',' || CASE WHEN tx_id % 15 = 0 THEN '00' || tx_id ELSE '' END || ',' || CASE WHEN tx_id % 3 = 0 THEN 'b' || tx_id ELSE '' END AS line FROM c""",
    ),
    "t07_newest": (
        lambda s, d: l.newest(_wide(s, d).groupBy("user_id", "upload_id").agg(F.max("tx_date").alias("last_date")), ["user_id"], [F.desc("last_date"), F.desc("upload_id")], 5).select("user_id", "upload_id", "place"),
        WIDE + ", u AS (SELECT user_id, upload_id, max(tx_date) AS last_date FROM w GROUP BY ALL) SELECT user_id, upload_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_date DESC, upload_id DESC) AS INT) AS place FROM u QUALIFY place <= 5",
    ),
    "k16_rules_in_scope": (
        lambda s, d: rules.in_scope(
            s.range(200).select(F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("owner_id"), F.col("id").alias("rule_id")), ledgers.ledger_ev(s, d).select("user_id").distinct()).select("user_id", "rule_id"),
        "WITH r AS (SELECT CASE WHEN id % 3 > 0 THEN id % 50 END AS owner_id, id AS rule_id FROM range(200) t(id)), u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, rule_id FROM u JOIN r ON owner_id IS NULL OR owner_id = user_id",
    ),
    "p11_upcoming": (
        _upcoming,
        r_sql.QUERIES["d13_recurring_charges"][1].replace("SELECT user_id, merchant, usual_category", ", u AS (SELECT user_id, merchant, usual_category", 1)
        + ") SELECT user_id, merchant, mean_cents, next_charge, CAST(next_charge - DATE '2001-08-01' AS BIGINT) AS days_left FROM u WHERE next_charge - DATE '2001-08-01' BETWEEN 0 AND 14 AND score >= 60",
    ),
    "a23_progress": (
        lambda s, d: l.progress(_wide(s, d)),
        WIDE + """SELECT user_id, count(*) AS total, count(*) FILTER (app_category IS NULL) AS uncategorized, CAST(floor(CAST(count(app_category) * 100 AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS percent, count(*) = count(app_category) AS is_unlocked
            FROM w WHERE NOT is_excluded GROUP BY user_id""",
    ),
    "a11_issue_counts": (
        lambda s, d: l.issue_counts(_wide(s, d).where("status <> 'VALID'").select("upload_id", F.col("status").alias("issue_type"), F.when(F.col("tx_id") % 2 == 0, "ERROR").otherwise("WARNING").alias("severity"), (F.col("tx_id") % 3 == 0).alias("resolved"))),
        WIDE + """SELECT upload_id, CASE WHEN tx_id % 2 = 0 THEN 'ERROR' ELSE 'WARNING' END AS severity, status AS issue_type, count(*) FILTER (tx_id % 3 > 0) AS open, count(*) FILTER (tx_id % 3 = 0) AS resolved FROM w WHERE status <> 'VALID' GROUP BY ALL""",
    ),
    "d24_after_deletion": (
        lambda s, d: l.without(_wide(s, d), s.range(0, 5).select(F.col("id").alias("upload_id")), ["upload_id"])[1].withColumn("rows_left", F.lit(None).cast("long")).unionByName(
            l.without(_wide(s, d), s.range(0, 5).select(F.col("id").alias("upload_id")), ["upload_id"])[0].groupBy("user_id").agg(F.count("*").alias("rows_left")).select("user_id", F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("month"), "rows_left")),
        WIDE + """SELECT DISTINCT user_id, CAST(year(tx_date) AS INT) AS year, CAST(month(tx_date) AS INT) AS month, NULL::BIGINT AS rows_left FROM w WHERE upload_id < 5
            UNION ALL SELECT user_id, NULL, NULL, count(*) FROM w WHERE upload_id >= 5 GROUP BY user_id""",
    ),
    "d23_chosen_dates": (
        lambda s, d: l.chosen_dates(
            _wide(s, d).select("tx_id", F.lit(None).cast("date").alias("date"), F.when(F.col("tx_id") % 2 == 0, "AMBIGUOUS").otherwise("INVALID").alias("date_status"), F.lit("2024-01-02").cast("date").alias("option_a"), F.lit("2024-02-01").cast("date").alias("option_b"), "status"),
            F.when(F.col("tx_id") % 3 == 0, "A").when(F.col("tx_id") % 3 == 1, "B")).select("tx_id", "date", "date_status", "status"),
        WIDE + """SELECT tx_id, CASE WHEN tx_id % 2 = 0 AND tx_id % 3 = 0 THEN DATE '2024-01-02' WHEN tx_id % 2 = 0 AND tx_id % 3 = 1 THEN DATE '2024-02-01' END AS date, CASE WHEN tx_id % 2 = 1 THEN 'INVALID' WHEN tx_id % 3 < 2 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS date_status,
            CASE WHEN tx_id % 2 = 0 AND tx_id % 3 < 2 AND status = 'UNRESOLVED' THEN 'VALID' ELSE status END AS status FROM w""",
    ),
    "j19_matched_rows": (
        lambda s, d: l.matched_rows(_wide(s, d).where("tx_id % 2 = 0").withColumn("amount_cents", F.col("amount_cents") + F.col("tx_id") % 5 - 2), _wide(s, d)),
        WIDE + """SELECT a.tx_id AS staged_id, min(b.tx_id) AS tx_id FROM w a JOIN w b ON a.upload_id = b.upload_id AND a.tx_date = b.tx_date AND abs(a.amount_cents + a.tx_id % 5 - 2 - b.amount_cents) <= 1
            AND abs((a.amount_cents + a.tx_id % 5 - 2) / 100::DOUBLE - b.amount_cents / 100::DOUBLE) <= 0.01::DOUBLE WHERE a.tx_id % 2 = 0 GROUP BY a.tx_id""",
    ),
    "w01_chronological": (lambda s, d: c.chronological(_files(s, d), ["upload_id"]).select("upload_id", "tx_id", F.col("place").cast("long")), FILES + "SELECT upload_id, tx_id, place FROM ch"),
    "w06_rows_reordered": (
        lambda s, d: c.reordered(c.chronological(_files(s, d), ["upload_id"]), ["upload_id"]),
        FILES + """, q AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY parse_order) - 1 AS rd FROM ch) SELECT upload_id, count(*) FILTER (rd <> place) AS rows_reordered, any_value(direction) AS direction FROM q GROUP BY upload_id""",
    ),
    "d04_reconcile_totals": (
        _totals_mode,
        FILES + """, s AS (SELECT upload_id, sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS cr, sum(CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END) AS db FROM fl GROUP BY upload_id)
        SELECT upload_id, CASE WHEN upload_id % 3 = 0 THEN CASE WHEN upload_id % 9 = 0 THEN 7 ELSE 0 END END::BIGINT AS discrepancy_cents,
          CASE WHEN upload_id % 4 >= 2 AND upload_id % 3 > 0 THEN 'UNVERIFIABLE' WHEN (upload_id % 4 = 1 AND db <> -5) OR upload_id % 9 = 0 THEN 'FAIL' WHEN upload_id % 5 > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status FROM s""",
    ),
    "s19_preprocessed": (
        lambda s, d: pdf.preprocessed(_pages(s, d), ["file"]),
        """WITH o AS (SELECT o_custkey AS file, o_orderkey AS key, o_orderpriority AS said, CAST(o_orderdate AS DATE) AS dt, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c FROM orders)
        SELECT file, 'Statement of ' || file || chr(10) || chr(10) || string_agg('[DATE]' || strftime(dt, '%m/%d/%Y') || ' ' || said || ' [AMT:$' || CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ']'
          || CASE WHEN key % 2 = 0 THEN ' ref ' || key ELSE '' END || CASE WHEN key % 3 = 0 THEN chr(10) || chr(10) || 'Notes [AMT:1.50]' ELSE '' END, chr(10) ORDER BY key) AS text FROM o GROUP BY file""",
    ),
    "j03_parse_order": (
        lambda s, d: c.with_parse_order(_files(s, d).drop("parse_order").withColumnRenamed("tx_id", "raw_id"), _files(s, d).where("tx_id % 5 > 0").select(F.col("tx_id").alias("raw_id"), "parse_order")).select("raw_id", "parse_order"),
        FILES + "SELECT tx_id AS raw_id, CASE WHEN tx_id % 5 > 0 THEN parse_order ELSE 0 END AS parse_order FROM fl",
    ),
    "s22_candidates": (
        lambda s, d: pdf.deduplicated(_candidates(s, d), ["file_id"]).select("file_id", "position", "combined"),
        CANDIDATES + "SELECT file_id, position, combined FROM cand QUALIFY row_number() OVER (PARTITION BY file_id, date, amount_cents, description ORDER BY combined DESC, position) = 1",
    ),
    "s23_candidate_issues": (
        lambda s, d: pdf.issues(_candidates(s, d), ["file_id"], F.lit("2024-01-12").cast("date"), F.lit("2024-01-16").cast("date")),
        CANDIDATES + """, n AS (SELECT *, count(*) OVER (PARTITION BY file_id, date, amount_cents, description) AS n FROM cand)
        SELECT file_id, position, 'DATE_OUT_OF_RANGE' AS issue FROM n WHERE date < DATE '2024-01-05' OR date > DATE '2024-01-23' UNION ALL SELECT file_id, position, 'AMOUNT_SUSPICIOUS' FROM n WHERE amount_cents > 100000000
        UNION ALL SELECT file_id, position, 'DUPLICATE_CANDIDATE' FROM n WHERE n > 1 UNION ALL SELECT file_id, position, 'LOW_CONFIDENCE' FROM n WHERE combined < 0.75::DOUBLE UNION ALL SELECT file_id, position, 'INCOMPLETE' FROM n WHERE date IS NULL AND amount_cents IS NULL""",
    ),
    "s24_candidate_rows": (
        lambda s, d: pdf.ledger_rows(_candidates(s, d)).select("file_id", "position", "amount_cents"),
        CANDIDATES + "SELECT file_id, position, CASE direction WHEN 'debit' THEN -abs(amount_cents) WHEN 'credit' THEN abs(amount_cents) ELSE amount_cents END AS amount_cents FROM cand WHERE combined >= 0.75::DOUBLE",
    ),
    "r05_chat_context": (
        lambda s, d: _context(s, d).select("user_id", "year", "month", "net_cents", F.md5("merchants").alias("merchants_md5"), F.md5("changes").alias("changes_md5")),
        BASE + """, mt AS (SELECT user_id, year, month, merchant, CAST(sum(-amount_cents) AS BIGINT) AS spent FROM base WHERE amount_cents < 0 AND coalesce(merchant, '') <> '' GROUP BY ALL),
        mk AS (SELECT *, row_number() OVER (PARTITION BY user_id, year, month ORDER BY spent DESC, merchant) AS k FROM mt),
        mj AS (SELECT user_id, year, month, md5('[' || string_agg('{"place":' || k || ',"merchant":"' || merchant || '","spent_cents":' || spent || '}', ',' ORDER BY k) || ']') AS merchants_md5 FROM mk WHERE k <= 10 GROUP BY ALL),
        seen AS (SELECT DISTINCT user_id, mi FROM cats),
        j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.mi, b.mi) AS mi, coalesce(a.category, b.category) AS category, coalesce(a.spending_cents, 0) - coalesce(b.spending_cents, 0) AS dc
          FROM cats a FULL JOIN (SELECT c.user_id, c.mi + 1 AS mi, category, spending_cents FROM cats c SEMI JOIN seen s ON c.user_id = s.user_id AND c.mi + 1 = s.mi) b ON a.user_id = b.user_id AND a.mi = b.mi AND a.category = b.category),
        ck AS (SELECT *, row_number() OVER (PARTITION BY user_id, mi ORDER BY abs(dc) DESC, category) AS k FROM j WHERE abs(dc) > 100),
        cj AS (SELECT user_id, mi, md5('[' || string_agg('{"rank":' || k || ',"category":"' || category || '","delta_cents":' || dc || '}', ',' ORDER BY k) || ']') AS changes_md5 FROM ck WHERE k <= 8 GROUP BY ALL)
        SELECT t.user_id, t.year, t.month, net_cents, merchants_md5, changes_md5 FROM totals t LEFT JOIN mj USING (user_id, year, month) LEFT JOIN cj ON t.user_id = cj.user_id AND t.mi = cj.mi""",
    ),
    "s29_upserted": (
        lambda s, d: l.upserted(
            _totals(s, d).select("user_id", "year", "month", "net_cents"), _totals(s, d).where("month % 2 = 0").select(F.col("user_id") + 10, "year", "month", F.lit(0).cast("long")).toDF("user_id", "year", "month", "net_cents"), m.MONTH),
        BASE + """, n AS (SELECT user_id + 10 AS user_id, year, month, 0::BIGINT AS net_cents FROM totals WHERE month % 2 = 0)
        SELECT user_id, year, month, net_cents FROM n UNION ALL SELECT user_id, year, month, net_cents FROM totals t ANTI JOIN n USING (user_id, year, month)""",
    ),
}
