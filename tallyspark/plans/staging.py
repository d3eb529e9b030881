"""Queries of staged uploads and dictionaries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import dictionaries as dic
from tallyspark.operators import staging as st
from tallyspark.plans.months import BASE, _cats
from tallyspark.sources import ledgers

KINDS = ["Food", "Rent", "Coffee", "Other", "Travel"]

# names, and by hand what the word lists make of them
NAMES = [
    "SQ *Blue Bottle Coffee", "WHOLE FOODS 4321", "Uber Eats", "PAYROLL ACME", "Online Payment thank", "Netflix.com", "Corner Shop NY", "PAYPAL *AMZN Mktp", "Zelle to Ann Lee",
    "City Water Dept", "SHELL OIL 12", "Employer Hilton Annual Fee",
]
WORD = [None, "Groceries", "Food & Dining", "Income", None, "Entertainment", None, "Transfer", "Transfer", None, "Transport", "Travel"]
SURE = [None, "high", "high", "high", None, "high", None, "medium", "high", None, "high", "high"]
SHOWN = ["Blue Bottle Coffee", "Whole Foods", "Uber Eats", "Payroll", "Online Payment Thank", "Netflix", "Corner Shop", "Amazon", "Ann Lee", "City Water Dept", "Shell", "Hilton"]
KIND = ["unknown", "grocery", "restaurant", "income", "unknown", "subscription", "unknown", "shopping", "unknown", "unknown", "gas", "travel"]
BANK = [None, "Groceries", "Food & Drink", "Gas/Automotive", "Other services", "Online Payment Fee", "Fees & Adjustments"]
MAPPED = [None, "Groceries", "Food & Dining", "Transport", None, "Fees & Charges", "Fees & Charges"]
MASTER_NAMES = ["Food & Dining", "Housing", "Other", "misc", "Coffee Shops", "Gas & Fuel", "Nothing", " Transfer ", "Steakhouse", "Barber", "Spanish course", "Rental cars", "Apparel", "LOTTERY"]
MASTER_OF = ["FOOD", "HOME", None, None, "COFFEE", "TRANSPORT", None, None, "COFFEE", "FOOD", "PERSONAL_CARE", "HOME", "DIGITAL", "LIFESTYLE"]
STYLE_NAMES = ["Food & Dining", "Utilities", "Income", "food & dining", "Pets", None, "Transfer", "Books"]


def _of(values: list, n: int):
    return F.get(F.array(*(F.lit(v) for v in values)), (F.col("tx_id") % n).cast("int"))


def staged(spark, d) -> DataFrame:
    """The month's ledger in uploads of 500 rows; one vendor has a fixed price, one nearly so."""
    ev = ledgers.ledger_ev(spark, d)
    cents = F.when(F.col("tx_id") % 12 == 5, -1599).when(F.col("tx_id") % 12 == 9, -2000 - F.col("tx_id") % 3 * 90).otherwise(F.col("amount_cents"))
    return ev.select(
        F.floor(F.col("tx_id") / 500).cast("long").alias("upload_id"), "tx_id", F.col("tx_id").alias("parse_order"), "tx_date", _of(NAMES, 12).alias("vendor_raw"),
        F.concat(F.lit("v"), (F.col("tx_id") % 12).cast("string")).alias("vendor_key"), cents.cast("long").alias("amount_cents"), _of(BANK, 7).alias("bank_category"),
        F.when(F.col("tx_id") % 17 == 0, "excluded").when(F.col("tx_id") % 3 == 0, "categorized").otherwise("uncategorized").alias("status"),
    )


def _sql(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


STAGED = f"""WITH {ledgers.SQL}, stg0 AS (
  SELECT tx_id // 500 AS upload_id, tx_id, tx_date, tx_id % 12 AS v, tx_id % 7 AS b, CASE tx_id % 12 WHEN 5 THEN -1599 WHEN 9 THEN -2000 - tx_id % 3 * 90 ELSE amount_cents END AS amount_cents,
         CASE WHEN tx_id % 17 = 0 THEN 'excluded' WHEN tx_id % 3 = 0 THEN 'categorized' ELSE 'uncategorized' END AS status FROM ledger_ev),
stg AS (SELECT *, count(*) FILTER (amount_cents < 0) OVER w * 2 > count(*) FILTER (amount_cents <> 0) OVER w AS neg FROM stg0 WHERE status <> 'excluded' WINDOW w AS (PARTITION BY upload_id)),
often AS (SELECT upload_id, v FROM stg WHERE CASE WHEN neg THEN amount_cents < 0 ELSE amount_cents > 0 END GROUP BY ALL
  HAVING count(*) >= 2 AND arg_min(abs(amount_cents), tx_id) - min(abs(amount_cents)) <= arg_min(abs(amount_cents), tx_id) * 0.1::DOUBLE AND max(abs(amount_cents)) - arg_min(abs(amount_cents), tx_id) <= arg_min(abs(amount_cents), tx_id) * 0.1::DOUBLE),
sug AS (SELECT stg.*, {_sql(WORD)}[v + 1] AS word, {_sql(SURE)}[v + 1] AS sure, {_sql(MAPPED)}[b + 1] AS bank, CASE WHEN neg THEN amount_cents > 0 ELSE amount_cents <= 0 END AS comes,
  {_sql(SHOWN)}[v + 1] AS canonical, {_sql(KIND)}[v + 1] AS kind, row_number() OVER (PARTITION BY upload_id, tx_date, v, amount_cents ORDER BY tx_id) > 1 AS is_duplicate FROM stg),
cat AS (SELECT *, CASE WHEN v = 4 THEN 'Transfer' WHEN bank IS NOT NULL THEN bank WHEN word IS NOT NULL THEN word WHEN comes THEN 'Income' ELSE 'Uncategorized' END AS category,
  CASE WHEN v = 4 THEN 'high' WHEN bank = 'Other' THEN 'medium' WHEN bank IS NOT NULL THEN 'high' WHEN word IS NOT NULL THEN sure ELSE 'low' END AS confidence FROM sug),
scr AS (SELECT c.*, category = 'Transfer' AS is_transfer, category = 'Income' OR kind = 'income' AS is_income, o.v IS NOT NULL AS is_recurring FROM cat c LEFT JOIN often o ON c.upload_id = o.upload_id AND c.v = o.v)
"""


def _edited(spark, d):
    """The month's ledger after a commit of some rows, an edit of all alike, and a category that is deleted."""
    ledger = ledgers.ledger_ev(spark, d).select("tx_id", "user_id", "merchant", "amount_cents", "app_category", "is_transfer", "is_excluded")
    done = st.committed(ledger, staged(spark, d).where("status <> 'uncategorized'").select("tx_id", "status", F.when(F.col("tx_id") % 2 == 0, "Transfer").otherwise("Food").alias("category")))
    edits = ledger.where("tx_id % 10 = 1").select("user_id", "merchant", "amount_cents", F.col("tx_id").alias("edit_id"), F.concat(F.lit("E"), (F.col("tx_id") % 4).cast("string")).alias("category"))
    return st.removed_category(st.apply_to_all(done, edits), F.col("app_category") == "click")


def _names(spark, d) -> DataFrame:
    return ledgers.table(spark, d, "part").select("p_partkey", "p_name")


def _name_words(spark, d) -> DataFrame:
    """Two words a part: two to eight characters of its name, in capitals, and one that no name holds."""
    k = F.col("p_partkey")
    cut = _names(spark, d).select(k.alias("rank"), F.upper(F.substring("p_name", 1 + k % 5, 2 + k % 7)).alias("pattern"), F.concat(F.lit("C"), k.cast("string")).alias("category"))
    return cut.unionByName(_names(spark, d).select((-k).alias("rank"), F.concat(F.lit("none "), k.cast("string")).alias("pattern"), F.lit("X").alias("category")))


QUERIES = {
    "k13_scrubbed": (
        lambda s, d: st.scrub(staged(s, d)).select("tx_id", "category", "confidence", "category_source", "canonical", "merchant_type", "merchant_confidence", "is_duplicate", "is_recurring", "is_transfer", "is_income", F.array_join("review_flags", ",").alias("flags")),
        STAGED + """SELECT tx_id, category, confidence, CASE WHEN v <> 4 AND bank IS NOT NULL THEN 'bank' ELSE 'engine' END AS category_source, canonical, kind AS merchant_type,
            CASE WHEN kind <> 'unknown' THEN 'high' ELSE 'low' END AS merchant_confidence, is_duplicate, is_recurring, is_transfer, is_income,
            array_to_string(list_filter([CASE WHEN v IN (0, 7, 8) THEN 'aggregator_prefix' END, CASE WHEN kind = 'unknown' THEN 'unclear_merchant' END, CASE WHEN is_transfer THEN 'possible_transfer' END,
              CASE WHEN is_income THEN 'possible_income' END, CASE WHEN confidence = 'low' AND NOT is_transfer AND NOT is_income THEN 'needs_manual_review' END], lambda x: x IS NOT NULL), ',') AS flags FROM scr""",
    ),
    "a17_import_summary": (
        lambda s, d: st.summary(st.scrub(staged(s, d))),
        STAGED + """, n AS (SELECT upload_id, category, count(*) AS n FROM scr GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY n DESC, category) AS k FROM n),
        t AS (SELECT upload_id, string_agg(category || ':' || n, ',' ORDER BY k) AS top_categories FROM k WHERE k <= 6 GROUP BY ALL)
        SELECT upload_id, count(*) AS tx_count, count(*) FILTER (is_transfer) AS transfers, count(*) FILTER (is_income) AS incomes, count(*) FILTER (confidence = 'low') AS needs_review,
          count(*) FILTER (is_duplicate) AS duplicates, count(DISTINCT CASE WHEN is_recurring THEN v END) AS recurring_vendors, any_value(top_categories) AS top_categories FROM scr JOIN t USING (upload_id) GROUP BY upload_id""",
    ),
    "a18_status_counts": (
        lambda s, d: st.status_counts(staged(s, d)),
        STAGED + "SELECT upload_id, count(*) AS total, count(*) FILTER (status = 'uncategorized') AS uncategorized, count(*) FILTER (status = 'categorized') AS categorized, count(*) FILTER (status = 'excluded') AS excluded FROM stg0 GROUP BY upload_id",
    ),
    "a21_top_merchants": (
        lambda s, d: st.top_merchants(st.scrub(staged(s, d))),
        STAGED + """, n AS (SELECT upload_id, canonical, count(*) AS tx_count FROM scr GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (PARTITION BY upload_id ORDER BY tx_count DESC, canonical) AS INT) AS rank FROM n QUALIFY rank <= 5""",
    ),
    "a22_category_amounts": (
        lambda s, d: st.category_amounts(st.scrub(staged(s, d))),
        STAGED + "SELECT upload_id, category, CAST(sum(abs(amount_cents)) AS BIGINT) AS total_cents, count(*) AS tx_count FROM scr GROUP BY ALL",
    ),
    "k15_edits": (
        _edited,
        f"""WITH {ledgers.SQL}, c AS (SELECT *, CASE WHEN tx_id % 17 = 0 THEN 'x' WHEN tx_id % 3 = 0 THEN 'c' END AS s FROM ledger_ev),
        e AS (SELECT user_id, merchant, amount_cents, 'E' || (max(tx_id) % 4) AS c FROM ledger_ev WHERE tx_id % 10 = 1 GROUP BY ALL),
        g AS (SELECT c.user_id, c.merchant, c.amount_cents, tx_id, CASE WHEN s = 'c' THEN CASE WHEN tx_id % 2 = 0 THEN 'Transfer' ELSE 'Food' END ELSE app_category END AS cat,
              CASE WHEN s = 'c' THEN tx_id % 2 = 0 ELSE is_transfer END AS is_transfer, CASE WHEN s = 'x' THEN true ELSE is_excluded END AS is_excluded, coalesce(s = 'c', false) AS reviewed FROM c)
        SELECT g.user_id, g.merchant, g.amount_cents, tx_id, CASE WHEN e.c IS NOT NULL THEN e.c WHEN cat = 'click' THEN 'Other' ELSE cat END AS app_category, is_transfer, is_excluded, reviewed, e.c IS NOT NULL AS edited
        FROM g LEFT JOIN e ON g.user_id = e.user_id AND g.merchant = e.merchant AND g.amount_cents = e.amount_cents""",
    ),
    "d17_traits": (
        lambda s, d: dic.traits(_cats(s, d).withColumn("category", F.get(F.array(*(F.lit(x) for x in KINDS)), (F.length("category") % 5).cast("int"))).groupBy("user_id", "year", "month", "category").agg(F.sum("spending_cents").alias("spending_cents"))),
        BASE + f""", k AS (SELECT user_id, year, month, {KINDS}[length(category) % 5 + 1] AS kind, CAST(sum(spending_cents) AS BIGINT) AS s FROM cats GROUP BY ALL)
        SELECT user_id, year, month, ['margin_eater', NULL, 'daily_grind', NULL, 'mail_goes_home'][list_position({KINDS}, kind)] AS trait FROM k WHERE s > 0 AND kind NOT IN ('Rent', 'Other')
        QUALIFY row_number() OVER (PARTITION BY user_id, year, month ORDER BY s DESC, kind) = 1""",
    ),
    "f22_master_category": (
        lambda s, d: dic.master_category(ledgers.table(s, d, "part").select("p_partkey", _of_part(MASTER_NAMES).alias("name")), F.col("name")),
        f"SELECT p_partkey, {_sql(MASTER_NAMES)}[p_partkey % 14 + 1] AS name, {_sql(MASTER_OF)}[p_partkey % 14 + 1] AS master FROM part",
    ),
    "f31_category_styles": (
        lambda s, d: dic.category_styles(ledgers.table(s, d, "part").select("p_partkey", _of_part(STYLE_NAMES).alias("name")), F.col("name")),
        f"""SELECT p_partkey, {_sql(STYLE_NAMES)}[p_partkey % 8 + 1] AS name, p_partkey % 8 = 2 AS is_income,
            ['#f97316', '#6366f1', '#16a34a', '#94a3b8', '#a3e635', '#94a3b8', '#64748b', '#94a3b8'][p_partkey % 8 + 1] AS color,
            ['UtensilsCrossed', 'Zap', 'TrendingUp', '📦', 'PawPrint', '📦', 'ArrowLeftRight', '📦'][p_partkey % 8 + 1] AS icon,
            ['FOOD', 'HOME', NULL, NULL, 'PETS', NULL, NULL, NULL][p_partkey % 8 + 1] AS master FROM part""",
    ),
    "j09_first_word": (
        lambda s, d: dic.first_match(_names(s, d), F.col("p_name"), _name_words(s, d), ["category"]),
        """WITH words AS (SELECT p_partkey AS rank, upper(substr(p_name, 1 + p_partkey % 5, 2 + p_partkey % 7)) AS pattern, 'C' || p_partkey AS category FROM part
             UNION ALL SELECT -p_partkey, 'none ' || p_partkey, 'X' FROM part)
           SELECT p_partkey, p_name, (SELECT min_by(category, rank) FROM words w WHERE contains(lower(p.p_name), lower(w.pattern))) AS category FROM part p""",
    ),
    "j09_first_expression": (
        lambda s, d: dic.first_match(_names(s, d), F.col("p_name"), _name_words(s, d).withColumn("pattern", F.concat(F.lit(r"\b"), F.regexp_replace("pattern", " ", r"\\s+"), F.lit("[a-z]?|z{3}$"))), ["category"], regex=True),
        r"""WITH words AS (SELECT p_partkey AS rank, '\b' || regexp_replace(upper(substr(p_name, 1 + p_partkey % 5, 2 + p_partkey % 7)), ' ', '\\s+', 'g') || '[a-z]?|z{3}$' AS pattern, 'C' || p_partkey AS category FROM part
             UNION ALL SELECT -p_partkey, '\bnone\s+' || p_partkey || '[a-z]?|z{3}$', 'X' FROM part)
           SELECT p_partkey, p_name, (SELECT min_by(category, rank) FROM words w WHERE regexp_matches(lower(p.p_name), w.pattern, 'i')) AS category FROM part p""",
    ),
}


def _of_part(values: list):
    return F.get(F.array(*(F.lit(v) for v in values)), (F.col("p_partkey") % len(values)).cast("int"))
