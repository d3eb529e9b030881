"""Queries of reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import reports as rep
from tallyspark.operators import rules as r
from tallyspark.operators import staging as st
from tallyspark.plans.months import BASE, _base
from tallyspark.plans.recurring import KINDS_SQL, NAMED, SUBS, SUBS_OUT, _named
from tallyspark.plans.staging import NAMES, STAGED, staged
from tallyspark.sources import ledgers


def _rows(spark, d):
    k = F.col("tx_id")
    return ledgers.ledger_ev(spark, d).select(
        F.floor(k / 500).cast("long").alias("upload_id"), "tx_id", F.when(k % 10 > 0, F.col("merchant")).alias("merchant"), F.when(k % 5 > 0, F.col("app_category")).alias("category"), "amount_cents",
        F.when(k % 4 > 0, F.concat(F.lit("f"), (k % 40).cast("string"))).alias("fingerprint"), (k % 9 == 0).alias("is_possible_duplicate"), F.when(k % 3 > 0, k % 11 > 0).alias("balance_valid"),
    )


def _issues(spark, d):
    k = F.col("tx_id")
    return _rows(spark, d).where("tx_id % 6 = 0").select("upload_id", F.when(k % 4 == 0, "error").when(k % 4 == 1, "WARNING").otherwise("INFO").alias("severity"))


ROWS = f"""WITH {ledgers.SQL}, rw AS (SELECT tx_id // 500 AS upload_id, tx_id, CASE WHEN tx_id % 10 > 0 THEN merchant END AS merchant, CASE WHEN tx_id % 5 > 0 THEN app_category END AS category, amount_cents AS c,
  CASE WHEN tx_id % 4 > 0 THEN 'f' || tx_id % 40 ELSE 'tx' || tx_id END AS fp, tx_id % 9 = 0 AS dup, CASE WHEN tx_id % 3 > 0 THEN tx_id % 11 > 0 END AS bv FROM ledger_ev),
tt AS (SELECT upload_id, count(*) AS tx_count, CAST(sum(CASE WHEN c > 0 THEN c ELSE 0 END) AS BIGINT) AS income_cents, CAST(sum(CASE WHEN c < 0 THEN -c ELSE 0 END) AS BIGINT) AS spending_cents, count(*) FILTER (NOT bv) AS balance_breaks,
  count(DISTINCT CASE WHEN dup THEN fp END) AS duplicate_groups, count(*) FILTER (tx_id % 6 = 0 AND tx_id % 4 = 0) AS high, count(*) FILTER (tx_id % 6 = 0 AND tx_id % 4 = 1) AS medium, count(*) FILTER (tx_id % 6 = 0 AND tx_id % 4 > 1) AS low FROM rw GROUP BY upload_id),
mg AS (SELECT upload_id, coalesce(merchant, 'Unknown') AS merchant, CAST(sum(-c) AS BIGINT) AS cents, count(*) AS visits FROM rw WHERE c < 0 GROUP BY ALL),
mr AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY cents DESC, merchant) AS k FROM mg),
mm AS (SELECT upload_id, string_agg(merchant || ':' || cents || ':' || visits, ',' ORDER BY k) AS merchants, arg_min(merchant, k) AS top, max(CASE WHEN k = 1 THEN cents END) AS top_cents FROM mr WHERE k <= 10 GROUP BY upload_id),
cg AS (SELECT upload_id, coalesce(category, 'Uncategorized') AS category, CAST(sum(-c) AS BIGINT) AS cents FROM rw WHERE c < 0 GROUP BY ALL),
cr AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY cents DESC, category) AS k, CAST(floor(CAST(cents * 100 AS DOUBLE) / sum(cents) OVER (PARTITION BY upload_id) + 0.5) AS BIGINT) AS pct FROM cg),
cc AS (SELECT upload_id, string_agg(category || ':' || cents || ':' || pct, ',' ORDER BY k) AS categories FROM cr GROUP BY upload_id)
"""
MONEY = "('$' || format('{{:,}}', ({0}) // 100) || '.' || lpad(CAST(({0}) % 100 AS VARCHAR), 2, '0'))"


def _joined(name, *parts):
    return F.array_join(F.transform(name, lambda x: F.concat_ws(":", *(x[p].cast("string") for p in parts))), ",")


def _charges(spark, d):
    """Merchants of an upload with many expenses as its recurring charges; some uploads have none."""
    upload = F.floor(F.col("tx_id") / 500).cast("long")
    by = ledgers.ledger_ev(spark, d).where("amount_cents < 0").withColumn("upload_id", upload).where("upload_id % 4 > 0").groupBy("upload_id", "merchant").agg(F.max(-F.col("amount_cents")).alias("mean_cents"), F.count("*").alias("n"))
    return by.where("n > 12 + upload_id % 4").select("upload_id", "merchant", "mean_cents")


def _alerts(spark, d):
    return ledgers.ledger_ev(spark, d).where("tx_id % 211 = 0").select(F.floor(F.col("tx_id") / 500).cast("long").alias("upload_id"), F.col("app_category").alias("kind"), F.col("tx_id").cast("string").alias("subject"))


def _imported(spark, d):
    k = F.col("tx_id")
    return ledgers.ledger_ev(spark, d).select(
        F.floor(k / 500).cast("long").alias("upload_id"), k.alias("parse_order"), F.when(k % 8 == 0, "REJECTED").when(k % 8 == 1, "UNRESOLVED").otherwise("VALID").alias("status"),
        F.when(k % 8 != 1, F.col("amount_cents")).alias("amount_cents"), F.when(k % 3 == 0, F.col("app_category")).when(k % 3 == 1, "").alias("bank_category"), F.concat(F.lit("h"), (k % 450).cast("string")).alias("row_hash"),
    )


def _known(spark, d):
    from tallyspark.operators import recurring

    return recurring.known_subscriptions(ledgers.ledger_rec(spark, d)).select("user_id", "merchant", "price_cents")


QUERIES = {
    "r01_scan_report": (
        lambda s, d: rep.narrative(rep.scan_report(_rows(s, d), _issues(s, d), _charges(s, d), _alerts(s, d))).select(
            "upload_id", "tx_count", "income_cents", "spending_cents", "net_cents", "balance_breaks", "duplicate_groups", "high", "medium", "low", "recurring_count", "recurring_cents", "alert_count",
            _joined("merchants", "merchant", "cents", "visits").alias("merchants"), _joined("categories", "category", "cents", "percent").alias("categories"), _joined("recurring", "merchant", "mean_cents").alias("recurring"),
            _joined("alerts", "kind", "subject").alias("alerts"), "narrative"),
        ROWS + f""", rc AS (SELECT upload_id, count(*) AS recurring_count, CAST(sum(mean_cents) AS BIGINT) AS recurring_cents, string_agg(merchant || ':' || mean_cents, ',' ORDER BY mean_cents DESC, merchant) AS recurring FROM
            (SELECT tx_id // 500 AS upload_id, merchant, CAST(max(-amount_cents) AS BIGINT) AS mean_cents FROM ledger_ev WHERE amount_cents < 0 AND (tx_id // 500) % 4 > 0 GROUP BY ALL HAVING count(*) > 12 + (tx_id // 500) % 4) GROUP BY upload_id),
          al AS (SELECT tx_id // 500 AS upload_id, count(*) AS alert_count, string_agg(app_category || ':' || tx_id, ',' ORDER BY app_category, CAST(tx_id AS VARCHAR)) AS alerts FROM ledger_ev WHERE tx_id % 211 = 0 GROUP BY ALL)
          SELECT upload_id, tx_count, income_cents, spending_cents, income_cents - spending_cents AS net_cents, balance_breaks, duplicate_groups, high, medium, low, coalesce(recurring_count, 0) AS recurring_count, coalesce(recurring_cents, 0) AS recurring_cents,
          coalesce(alert_count, 0) AS alert_count, merchants, categories, recurring, alerts,
          'This statement contains ' || tx_count || CASE WHEN tx_count = 1 THEN ' transaction' ELSE ' transactions' END || ' with ' || {MONEY.format("income_cents")} || ' in income and ' || {MONEY.format("spending_cents")} || ' in spending, resulting in '
            || CASE WHEN income_cents >= spending_cents THEN 'a surplus of ' ELSE 'a deficit of ' END || {MONEY.format("abs(income_cents - spending_cents)")} || '.'
            || CASE WHEN recurring_count > 0 THEN ' ' || recurring_count || CASE WHEN recurring_count = 1 THEN ' recurring subscription' ELSE ' recurring subscriptions' END || ' were detected totaling an estimated ' || {MONEY.format("recurring_cents")} || ' per month.' ELSE '' END
            || CASE WHEN duplicate_groups > 0 OR alert_count > 0 THEN ' The scan flagged ' || concat_ws(' and ', CASE WHEN duplicate_groups > 0 THEN duplicate_groups || CASE WHEN duplicate_groups = 1 THEN ' possible duplicate' ELSE ' possible duplicates' END END,
                CASE WHEN alert_count > 0 THEN alert_count || CASE WHEN alert_count = 1 THEN ' anomaly' ELSE ' anomalies' END END) || ' that may need your review.' ELSE '' END
            || ' Your top merchant by spending was ' || top || ' at ' || {MONEY.format("top_cents")} || '.'
            || CASE WHEN high > 0 THEN CASE WHEN high = 1 THEN ' There is ' ELSE ' There are ' END || high || CASE WHEN high = 1 THEN ' high-severity ingestion issue' ELSE ' high-severity ingestion issues' END || ' that could affect accuracy.' ELSE '' END AS narrative
          FROM tt JOIN mm USING (upload_id) JOIN cc USING (upload_id) LEFT JOIN rc USING (upload_id) LEFT JOIN al USING (upload_id)""",
    ),
    "r02_import_report": (
        lambda s, d: rep.import_report(_imported(s, d)),
        f"""WITH {ledgers.SQL}, i AS (SELECT tx_id // 500 AS upload_id, CASE tx_id % 8 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'UNRESOLVED' ELSE 'VALID' END AS status, CASE WHEN tx_id % 8 <> 1 THEN amount_cents END AS c,
              CASE tx_id % 3 WHEN 0 THEN app_category WHEN 1 THEN '' END AS bc, row_number() OVER (PARTITION BY tx_id // 500, tx_id % 450 ORDER BY tx_id) > 1 AS again FROM ledger_ev),
        t AS (SELECT *, status <> 'REJECTED' AND NOT again AS taken FROM i)
        SELECT upload_id, count(*) AS parsed, count(*) FILTER (taken) AS committed, count(*) FILTER (NOT taken) AS rejected, count(*) FILTER (taken AND status = 'UNRESOLVED') AS pending_review,
          CAST(sum(CASE WHEN taken THEN coalesce(c, 0) END) AS BIGINT) AS committed_cents, count(*) FILTER (taken AND coalesce(bc, '') <> '') AS with_category,
          coalesce(string_agg(DISTINCT bc, ',' ORDER BY bc) FILTER (taken AND coalesce(bc, '') <> ''), '') AS bank_categories FROM t GROUP BY upload_id""",
    ),
    "a16_snapshot": (
        lambda s, d: rep.snapshot(staged(s, d)),
        STAGED + f""", sp AS (SELECT * FROM stg WHERE CASE WHEN neg THEN amount_cents < 0 ELSE amount_cents > 0 END), tm AS (SELECT upload_id, v, CAST(sum(abs(amount_cents)) AS BIGINT) AS total FROM sp GROUP BY ALL),
        tp AS (SELECT * FROM tm QUALIFY row_number() OVER (PARTITION BY upload_id ORDER BY total DESC, 'v' || v) = 1)
        SELECT s.upload_id, count(*) AS tx_count, any_value({"[" + ", ".join(f"'{n}'" for n in NAMES) + "]"}[tp.v + 1]) AS top_merchant, any_value(total) AS top_cents,
          any_value((SELECT max(abs(amount_cents)) FROM sp WHERE sp.upload_id = s.upload_id)) AS largest_cents, any_value((SELECT count(*) FROM often o WHERE o.upload_id = s.upload_id)) AS recurring, count(*) < 10 AS few_transactions
        FROM stg s LEFT JOIN tp ON s.upload_id = tp.upload_id GROUP BY s.upload_id""",
    ),
    "p09_staging_view": (
        lambda s, d: rep.staging_view(st.scrub(staged(s, d)), "needs_review").select("tx_id", F.lit("needs_review").alias("kind")).unionByName(rep.staging_view(st.scrub(staged(s, d)), "canonical_merchant", "Amazon").select("tx_id", F.lit("amazon").alias("kind"))),
        STAGED + "SELECT tx_id, 'needs_review' AS kind FROM scr WHERE confidence = 'low' AND NOT is_transfer AND NOT is_income UNION ALL SELECT tx_id, 'amazon' FROM scr WHERE v = 7",
    ),
    "f32_commitment": (
        lambda s, d: _named(s, d).select("user_id", "merchant", rep.commitment(F.col("merchant"), F.when(F.col("user_id") % 2 == 0, "Phone & Internet").otherwise("Bank")).alias("commitment")),
        NAMED + ", k AS (SELECT *, lower(merchant) AS m FROM s) SELECT user_id, merchant, CASE " + " ".join(
            f"WHEN regexp_matches(regexp_replace(regexp_replace(m, '[^a-z0-9_\\s-]', ' ', 'g'), '\\s+', ' ', 'g'), '{p}') THEN '{kind}'" for kind, p in rep.COMMITMENTS.items()) + " WHEN user_id % 2 = 0 THEN 'utility' ELSE 'other' END AS commitment FROM k",
    ),
    "t08_category_order": (
        lambda s, d: rep.in_order(
            ledgers.table(s, d, "part").select((F.col("p_partkey") % 20).alias("user_id"), F.col("p_partkey").alias("category_id"), F.col("p_type").alias("name")), ["STANDARD", "PROMO", "ECONOMY"],
            ledgers.table(s, d, "part").where("p_partkey % 3 = 0").select((F.col("p_partkey") % 20).alias("user_id"), F.col("p_partkey").alias("category_id"), F.col("p_size").alias("position"))).select("user_id", "category_id", "place"),
        """SELECT p_partkey % 20 AS user_id, p_partkey AS category_id, CAST(row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 9999 END,
           CASE p_type WHEN 'STANDARD' THEN 0 WHEN 'PROMO' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 99 END, p_partkey) AS INT) AS place FROM part""",
    ),
    "f35_audit_json": (
        lambda s, d: ledgers.table(s, d, "events").select("event_id", rep.audit_json(F.create_map(F.lit("type"), F.col("event_type")), F.concat(F.array(F.struct(F.lit("amount").alias("field"), F.lit("TRIM").alias("rule"))), F.slice(F.array(F.struct(F.lit("date").alias("field"), F.col("event_type").alias("rule"))), 1, F.when(F.col("event_id") % 2 == 0, 1).otherwise(0)))).alias("json")),
        """SELECT event_id, '{"fields":{"type":"' || event_type || '"},"transformations":[{"field":"amount","rule":"TRIM"}' || CASE WHEN event_id % 2 = 0 THEN ',{"field":"date","rule":"' || event_type || '"}' ELSE '' END || ']}' AS json FROM events""",
    ),
    "j13_known_subscriptions": (
        _known,
        SUBS + f""", o AS ({SUBS_OUT}) SELECT user_id, merchant, price_cents FROM o SEMI JOIN (SELECT user_id, merchant FROM ledger_rec WHERE NOT is_excluded AND amount_cents < 0 AND lower(app_category) IN ('subscriptions', 'utilities', 'insurance', 'memberships', 'housing', 'loans', 'internet', 'phone', 'cable', 'recurring')) USING (user_id, merchant)""",
    ),
    "k09_weak_categories": (
        lambda s, d: r.weak_categories(ledgers.ledger_ev(s, d).select("tx_id", F.when(F.col("tx_id") % 7 == 0, "Other").otherwise("Food").alias("category"), (F.col("tx_id") % 10 / 10).alias("confidence"), F.when(F.col("tx_id") % 3 > 0, F.col("tx_id") % 3 == 1).alias("reviewed"))).select("tx_id"),
        "SELECT event_id AS tx_id FROM events WHERE event_id % 3 <> 1 AND (event_id % 7 = 0 OR event_id % 10 < 6)",
    ),
    "a24_distinct_names": (
        lambda s, d: _base(s, d).select("user_id", F.explode(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")), F.struct(F.lit("merchant").alias("kind"), F.col("merchant").alias("name")))).alias("x")).select("user_id", "x.kind", "x.name").distinct(),
        BASE + "SELECT DISTINCT user_id, 'category' AS kind, category AS name FROM base UNION SELECT DISTINCT user_id, 'merchant', merchant FROM base",
    ),
}
