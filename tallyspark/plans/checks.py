"""Queries of ledger integrity, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators import checks as c
from tallyspark.plans.months import BASE, _cats
from tallyspark.sources import ledgers

EV = f"WITH {ledgers.SQL}"


def uploads(spark, d) -> DataFrame:
    """The month's ledger as uploads of 500 rows; bank ids and fingerprints repeat."""
    return ledgers.ledger_ev(spark, d).select(
        "tx_id", "account_id", F.floor(F.col("tx_id") / 500).cast("long").alias("upload_id"),
        F.when(F.col("tx_id") % 7 == 0, F.concat(F.lit("b"), (F.col("tx_id") % 1400).cast("string"))).when(F.col("tx_id") % 11 == 0, F.lit("")).alias("bank_id"),
        F.sha2(F.concat_ws("|||", F.col("tx_date").cast("string"), F.lower("merchant")), 256).alias("fingerprint"),
    )


UPLOADS = EV + """, uploads AS (
  SELECT tx_id, account_id, tx_id // 500 AS upload_id, CASE WHEN tx_id % 7 = 0 THEN 'b' || CAST(tx_id % 1400 AS VARCHAR) WHEN tx_id % 11 = 0 THEN '' END AS bank_id,
         sha256(CAST(tx_date AS VARCHAR) || '|||' || lower(merchant)) AS fingerprint FROM ledger_ev
)"""


def statement(spark, d) -> DataFrame:
    """A running balance for each account and user, missing on some rows and broken on others; some users' stand before their rows, some have none."""
    ev = ledgers.ledger_ev(spark, d)
    run = F.sum("amount_cents").over(Window.partitionBy("user_id", "account_id").orderBy("tx_date", "tx_id")) - F.when(F.col("user_id") % 13 == 5, F.col("amount_cents")).otherwise(0)
    balance = F.when((F.col("tx_id") % 5 == 0) | (F.col("user_id") % 11 == 3), F.lit(None)).otherwise(100_000 + run + F.when(F.col("tx_id") % 97 == 0, 500).otherwise(0))
    return ev.select("user_id", "account_id", "tx_id", "tx_date", "amount_cents", balance.cast("long").alias("balance_cents"))


STATEMENT = EV + """, stm AS (
  SELECT user_id, account_id, tx_id, tx_date, amount_cents,
         CASE WHEN tx_id % 5 = 0 OR user_id % 11 = 3 THEN NULL ELSE CAST(100000 + sum(amount_cents) OVER (PARTITION BY user_id, account_id ORDER BY tx_date, tx_id) - CASE WHEN user_id % 13 = 5 THEN amount_cents ELSE 0 END
           + CASE WHEN tx_id % 97 = 0 THEN 500 ELSE 0 END AS BIGINT) END AS balance_cents
  FROM ledger_ev
),
known AS (
  SELECT *, last_value(balance_cents IGNORE NULLS) OVER (PARTITION BY user_id, account_id ORDER BY tx_date, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known,
    lag(amount_cents) OVER (PARTITION BY user_id, account_id ORDER BY tx_date, tx_id) AS prior FROM stm
),
pairs AS (SELECT *, balance_cents - lag(balance_cents) OVER w AS delta, lag(amount_cents) OVER w AS before, row_number() OVER w AS k FROM stm WHERE balance_cents IS NOT NULL WINDOW w AS (PARTITION BY user_id, account_id ORDER BY tx_date, tx_id)),
votes AS (SELECT user_id, account_id, count(*) FILTER (delta = amount_cents) AS after_votes, count(*) FILTER (delta = before) AS before_votes, count(*) AS pairs FROM pairs WHERE k BETWEEN 2 AND 21 GROUP BY ALL),
models AS (SELECT f.user_id, f.account_id, coalesce(after_votes, 0) AS after_votes, coalesce(before_votes, 0) AS before_votes, coalesce(pairs, 0) AS pairs, CASE WHEN pairs >= 2 AND before_votes > after_votes THEN 'BEFORE' ELSE 'AFTER' END AS model,
    coalesce(pairs, 0) < 2 OR after_votes = before_votes OR pairs - greatest(after_votes, before_votes) > pairs * 0.3::DOUBLE AS needs_review FROM (SELECT DISTINCT user_id, account_id FROM stm) f LEFT JOIN votes v ON f.user_id = v.user_id AND f.account_id = v.account_id)
"""


def said(spark, d) -> DataFrame:
    """What statements say: by user credits and debits, wrong for some; both balances; only an opening one; nothing, or no row at all."""
    sums = statement(spark, d).groupBy("user_id", "account_id").agg(
        F.sum(F.when(F.col("amount_cents") > 0, F.col("amount_cents")).otherwise(0)).alias("plus"), F.sum(F.when(F.col("amount_cents") < 0, F.col("amount_cents")).otherwise(0)).alias("minus"))
    u = F.col("user_id") % 8
    return sums.where(u < 7).select(
        "user_id", "account_id", F.when(u == 0, F.col("plus")).when(u == 1, F.col("plus") + F.col("user_id") % 2 + 1).alias("total_credits"), F.when(u < 2, -F.col("minus")).alias("total_debits"),
        F.when(u.isin(2, 3, 4), 100_000).cast("long").alias("opening"), F.when(u == 2, 100_000 + F.col("plus") + F.col("minus")).when(u == 3, 100_000 + F.col("plus")).alias("closing"),
    )


def _redated(spark, d):
    """The statement with some dates of the month's second half moved by a day, and its chain made anew from that of before."""
    now = statement(spark, d).withColumn("tx_date", F.when((F.dayofmonth("tx_date") > 15) & (F.col("tx_id") % 31 == 0), F.date_add("tx_date", 1)).otherwise(F.col("tx_date")))
    week = F.trunc("tx_date", "week")
    return c.rechained_after(c.chain_after(statement(spark, d), BY, ORDER, span=week), now, BY, ORDER, ["tx_id"], week)


BY, ORDER = ["user_id", "account_id"], ["tx_date", "tx_id"]


def transfers(spark, d) -> DataFrame:
    """Purchases, and the same amounts coming in on another account up to six days later."""
    ev = ledgers.ledger_ev(spark, d).select("user_id", "tx_id", "account_id", "tx_date", "merchant", "amount_cents")
    back = ev.where("amount_cents < 0 AND tx_id % 3 = 0").select(
        "user_id", (F.col("tx_id") + 1_000_000).alias("tx_id"), F.lit("a9").alias("account_id"),
        F.date_add("tx_date", (F.col("tx_id") % 7).cast("int")).alias("tx_date"), F.when(F.col("tx_id") % 2 == 0, "CARD PAYMENT").otherwise("Zelle in").alias("merchant"), (-F.col("amount_cents") + F.col("tx_id") % 3).alias("amount_cents"),
    )
    return ev.withColumn("merchant", F.when(F.col("tx_id") % 3 == 0, F.concat(F.lit("Transfer to "), "merchant")).otherwise(F.col("merchant"))).unionByName(back)


TRANSFERS = EV + """, t AS (
  SELECT user_id, tx_id, account_id, tx_date, CASE WHEN tx_id % 3 = 0 THEN 'Transfer to ' || merchant ELSE merchant END AS merchant, amount_cents FROM ledger_ev
  UNION ALL SELECT user_id, tx_id + 1000000, 'a9', tx_date + CAST(tx_id % 7 AS INT), CASE WHEN tx_id % 2 = 0 THEN 'CARD PAYMENT' ELSE 'Zelle in' END, -amount_cents + tx_id % 3 FROM ledger_ev WHERE amount_cents < 0 AND tx_id % 3 = 0
)"""


def raw_dates(spark, d) -> DataFrame:
    """Order dates as text, month first in even files and day first in odd ones, some with short years, some as ISO dates."""
    orders = ledgers.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("file_id"), F.col("o_orderdate").cast("date").alias("day"))
    short = F.when(F.col("file_id") % 2 == 0, F.date_format("day", "MM/dd/yy")).otherwise(F.date_format("day", "dd.MM.yy"))
    long = F.when(F.col("file_id") % 2 == 0, F.date_format("day", "MM/dd/yyyy")).otherwise(F.date_format("day", "dd/MM/yyyy"))
    text = F.when((F.col("o_orderkey") % 9 == 0) | (F.col("file_id") >= 36), F.date_format("day", "yyyy-MM-dd")).when((F.col("o_orderkey") % 9 == 1) & (F.col("day") >= "2000-01-01"), short).otherwise(long)
    return orders.select("file_id", text.alias("raw_date"), F.row_number().over(Window.partitionBy("file_id").orderBy("day", "o_orderkey")).alias("parse_order"))


def banks(spark, d) -> DataFrame:
    """Every fourth file has a bank that is known."""
    files = spark.range(0, 40, 4).select(F.col("id").alias("file_id"))
    return files.select("file_id", F.when(F.col("file_id") % 8 == 0, "DMY").otherwise("MDY").alias("bank_order"), F.when(F.col("file_id") % 3 == 0, "High").otherwise("Medium").alias("bank_confidence"))


QUERIES = {
    "d03_duplicate_flags": (
        lambda s, d: c.duplicate_flags(uploads(s, d)).select("tx_id", "within_upload", "cross_upload", "duplicate_of", "confidence"),
        UPLOADS + """, a AS (
          SELECT *, coalesce(bank_id, '') <> '' AS u, count(*) OVER (PARTITION BY account_id, nullif(bank_id, ''), upload_id) AS w,
                 count(*) OVER (PARTITION BY account_id, nullif(bank_id, '')) AS t, min(tx_id) OVER (PARTITION BY account_id, nullif(bank_id, '')) AS f FROM uploads),
        b AS (SELECT *, CASE WHEN NOT (u AND t > 1) THEN fingerprint END AS fp FROM a),
        e AS (SELECT *, count(*) OVER (PARTITION BY account_id, fp, upload_id) AS w2, count(*) OVER (PARTITION BY account_id, fp) AS t2, min(tx_id) OVER (PARTITION BY account_id, fp) AS f2 FROM b)
        SELECT tx_id, (u AND w > 1) OR (fp IS NOT NULL AND w2 > 1) AS within_upload, (u AND t > w) OR (fp IS NOT NULL AND t2 > w2) AS cross_upload,
               CASE WHEN u AND t > 1 THEN f WHEN fp IS NOT NULL AND t2 > 1 THEN f2 END AS duplicate_of,
               CASE WHEN u AND t > 1 THEN 1.0::DOUBLE WHEN fp IS NOT NULL AND t2 > 1 THEN 0.9::DOUBLE END AS confidence FROM e""",
    ),
    "w04_chain_after": (
        lambda s, d: c.chain_after(statement(s, d), BY, ORDER, span=F.trunc("tx_date", "week")),
        STATEMENT + "SELECT user_id, account_id, tx_id, tx_date, amount_cents, balance_cents, CASE WHEN balance_cents IS NOT NULL THEN known + amount_cents END AS expected_cents, balance_cents = known + amount_cents AS is_valid FROM known",
    ),
    "w05_chain_before": (
        lambda s, d: c.chain_before(statement(s, d), BY, ORDER, span=F.trunc("tx_date", "week")),
        STATEMENT + "SELECT user_id, account_id, tx_id, tx_date, amount_cents, balance_cents, CASE WHEN balance_cents IS NOT NULL THEN known + prior END AS expected_cents, balance_cents = known + prior AS is_valid FROM known",
    ),
    "w04_rechained": (
        _redated,
        STATEMENT + """, now AS (SELECT * REPLACE (CASE WHEN day(tx_date) > 15 AND tx_id % 31 = 0 THEN tx_date + 1 ELSE tx_date END AS tx_date) FROM stm),
        k AS (SELECT *, last_value(balance_cents IGNORE NULLS) OVER (PARTITION BY user_id, account_id ORDER BY tx_date, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + amount_cents AS e FROM now)
        SELECT * EXCLUDE (e), CASE WHEN balance_cents IS NOT NULL THEN e END AS expected_cents, balance_cents = e AS is_valid FROM k""",
    ),
    "w03_balance_model": (lambda s, d: c.balance_model(statement(s, d), BY, ORDER), STATEMENT + "SELECT * FROM models"),
    "d04_reconcile": (
        lambda s, d: c.reconcile(statement(s, d).withColumn("is_unresolved", (F.col("user_id") % 3 == 0) & (F.col("tx_id") % 4 == 0)), said(s, d), BY, ORDER),
        STATEMENT + """, chain AS (SELECT k.*, model, needs_review, CASE WHEN model = 'BEFORE' THEN known + prior ELSE coalesce(known, CASE WHEN user_id % 8 IN (2, 3, 4) THEN 100000 END) + amount_cents END AS expected FROM known k JOIN models USING (user_id, account_id)),
        m AS (SELECT *, balance_cents = expected AS ok, CASE WHEN balance_cents <> expected THEN balance_cents - expected END AS delta FROM chain),
        f AS (SELECT *, first_value(delta IGNORE NULLS) OVER (PARTITION BY user_id, account_id ORDER BY tx_date, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fd FROM m),
        g AS (SELECT user_id, account_id, count(*) AS tx_count, CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS credit_cents, CAST(sum(CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS debit_cents,
              CAST(sum(amount_cents) AS BIGINT) AS net_cents, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS breaks, count(*) FILTER (delta = fd) AS same_offset, count(balance_cents) AS balances,
              count(*) FILTER (user_id % 3 = 0 AND tx_id % 4 = 0) AS unresolved, any_value(model) AS model, any_value(needs_review) AS needs_review, user_id % 8 AS u FROM f GROUP BY ALL),
        h AS (SELECT *, CASE WHEN u < 4 THEN 'STATEMENT_TOTALS' WHEN balances >= 2 THEN 'RUNNING_BALANCE' ELSE 'UNVERIFIABLE' END AS mode FROM g),
        i AS (SELECT *, CASE WHEN u < 2 THEN 2 WHEN u < 4 OR mode = 'RUNNING_BALANCE' THEN 1 ELSE 0 END AS checks, CASE WHEN u = 1 THEN 1 WHEN u = 3 THEN CAST(debit_cents <> 0 AS INT) WHEN mode = 'RUNNING_BALANCE' THEN CAST(breaks > 0 AS INT) ELSE 0 END AS failed FROM h)
        SELECT user_id, account_id, mode, CASE WHEN mode = 'UNVERIFIABLE' THEN mode WHEN failed > 0 THEN 'FAIL' WHEN unresolved > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status, checks, failed, tx_count, credit_cents, debit_cents, net_cents, balances,
          CASE WHEN mode = 'RUNNING_BALANCE' THEN model END AS model, CASE WHEN mode = 'RUNNING_BALANCE' THEN needs_review END AS needs_review, CASE WHEN mode = 'RUNNING_BALANCE' THEN valid END AS valid, CASE WHEN mode = 'RUNNING_BALANCE' THEN breaks END AS breaks,
          CASE WHEN mode = 'RUNNING_BALANCE' THEN breaks > 0 AND same_offset >= 0.8::DOUBLE * breaks END AS constant_offset, CASE WHEN mode = 'RUNNING_BALANCE' THEN floor(CAST(breaks * 1000 AS DOUBLE) / tx_count + 0.5) / 10 END AS break_percent FROM i""",
    ),
    "d07_transfer_pairs": (
        lambda s, d: c.transfer_pairs(transfers(s, d)),
        TRANSFERS + """SELECT a.user_id, a.tx_id, b.tx_id AS partner_id, b.tx_date AS partner_date FROM t a JOIN t b
          ON a.user_id = b.user_id AND b.amount_cents BETWEEN -a.amount_cents - 1 AND -a.amount_cents + 1
          WHERE (a.merchant LIKE 'Transfer to %' OR a.merchant = 'CARD PAYMENT') AND a.account_id <> b.account_id AND b.tx_date - a.tx_date <= 5
            AND (b.tx_date > a.tx_date OR (b.tx_date = a.tx_date AND b.tx_id > a.tx_id))
            AND abs(a.amount_cents / 100::DOUBLE + b.amount_cents / 100::DOUBLE) <= 0.01::DOUBLE
          QUALIFY row_number() OVER (PARTITION BY a.user_id, a.tx_id ORDER BY b.tx_date, b.tx_id) = 1""",
    ),
    "j16_repeats_within_two_days": (
        lambda s, d: c.repeats_within(ledgers.ledger_rec(s, d).groupBy("user_id", "merchant", "amount_cents", "tx_date").agg(F.min("tx_id").alias("tx_id"))),
        EV + """, l AS (SELECT user_id, merchant, amount_cents, tx_date, min(tx_id) AS tx_id FROM ledger_rec GROUP BY ALL),
        r AS (SELECT *, lag(tx_id) OVER w AS earlier_id, CAST(date_diff('day', lag(tx_date) OVER w, tx_date) AS INT) AS gap FROM l WHERE amount_cents < 0 WINDOW w AS (PARTITION BY user_id, merchant, amount_cents ORDER BY tx_date, tx_id))
        SELECT user_id, tx_id, earlier_id, merchant, amount_cents, gap FROM r WHERE gap <= 2""",
    ),
    "j14_same_amounts": (
        lambda s, d: c.same_amounts(ledgers.ledger_ev(s, d)),
        EV + "SELECT user_id, amount_cents, count(*) AS n, min(tx_id) AS first_id FROM ledger_ev GROUP BY ALL HAVING count(*) > 1",
    ),
    "d06_category_spikes": (
        lambda s, d: c.category_spikes(_cats(s, d)),
        BASE + """, p AS (SELECT a.user_id, a.year, a.month, a.category, a.spending_cents, list(b.spending_cents) AS past FROM cats a JOIN cats b
            ON a.user_id = b.user_id AND a.category = b.category AND b.mi < a.mi GROUP BY ALL HAVING count(*) >= 3),
        q AS (SELECT *, list_median(past) AS med FROM p), r AS (SELECT *, list_median(list_transform(past, lambda v: abs(v - med))) AS mad FROM q)
        SELECT user_id, year, month, category, spending_cents, med AS median_cents, mad AS mad_cents, 0.6745::DOUBLE * abs(spending_cents - med) / mad AS z
        FROM r WHERE mad > 0 AND 0.6745::DOUBLE * abs(spending_cents - med) / mad > 3.5 AND spending_cents > med""",
    ),
    "d01_date_order": (
        lambda s, d: c.date_order(raw_dates(s, d), ["file_id"], banks(s, d)),
        """WITH o AS (SELECT o_orderkey, o_custkey % 40 AS file_id, CAST(o_orderdate AS DATE) AS dt FROM orders),
        t AS (SELECT file_id, o_orderkey % 9 <> 0 AND file_id < 36 AS num, dt, row_number() OVER (PARTITION BY file_id ORDER BY dt, o_orderkey) AS k FROM o),
        r AS (SELECT file_id, num, k, CASE WHEN NOT num THEN NULL WHEN file_id % 2 = 0 THEN dt WHEN day(dt) <= 12 THEN make_date(year(dt), day(dt), month(dt)) END AS mdy,
              CASE WHEN NOT num THEN NULL WHEN file_id % 2 = 1 THEN dt WHEN day(dt) <= 12 THEN make_date(year(dt), day(dt), month(dt)) END AS dmy FROM t),
        l AS (SELECT *, last_value(mdy IGNORE NULLS) OVER w AS mb, last_value(dmy IGNORE NULLS) OVER w AS db FROM r WINDOW w AS (PARTITION BY file_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        s AS (SELECT file_id, 1000 * count(*) FILTER (num AND mdy IS NULL) + count(*) FILTER (mdy < mb) AS mdy_cost, 1000 * count(*) FILTER (num AND dmy IS NULL) + count(*) FILTER (dmy < db) AS dmy_cost,
              count(*) FILTER (mdy <> dmy) AS ambiguous, count(*) FILTER (num AND mdy IS NULL) AS mi, count(*) FILTER (num AND dmy IS NULL) AS di FROM l GROUP BY ALL),
        b AS (SELECT *, CASE WHEN file_id % 4 = 0 THEN CASE WHEN file_id % 8 = 0 THEN 'DMY' ELSE 'MDY' END END AS bank, abs(mdy_cost - dmy_cost) AS gap FROM s),
        c AS (SELECT *, CASE WHEN ambiguous = 0 THEN 'clear' WHEN bank IS NOT NULL AND file_id % 3 = 0 AND CASE WHEN bank = 'DMY' THEN di ELSE mi END = 0 THEN 'bank'
              WHEN gap >= 10 THEN 'scored' WHEN bank IS NOT NULL THEN 'close' ELSE 'ask' END AS how FROM b)
        SELECT file_id, mdy_cost, dmy_cost, ambiguous, CASE WHEN how = 'scored' THEN CASE WHEN dmy_cost < mdy_cost THEN 'DMY' ELSE 'MDY' END ELSE coalesce(bank, 'MDY') END AS date_order,
          CASE how WHEN 'clear' THEN CASE WHEN bank IS NULL THEN 70 ELSE 95 END WHEN 'bank' THEN 95 WHEN 'close' THEN 60 WHEN 'ask' THEN 0
            ELSE CAST(least(99, floor(CAST(gap AS DOUBLE) / greatest(1, mdy_cost + dmy_cost) * 100 + 50 + 0.5)) AS BIGINT) END::BIGINT AS confidence,
          how = 'ask' AS needs_confirmation FROM c""",
    ),
    "d06_large_anomalies": (
        lambda s, d: c.large_anomalies(ledgers.ledger_ev(s, d), 1000),
        EV + """, x AS (SELECT *, year(tx_date) AS year, month(tx_date) AS month FROM ledger_ev WHERE amount_cents < 0),
        p AS (SELECT user_id, year, month, greatest(1000, (list_sort(list(-amount_cents)))[CAST(floor(count(*) * 0.95::DOUBLE) AS INT) + 1]) AS threshold_cents FROM x GROUP BY ALL)
        SELECT user_id, CAST(year AS INT) AS year, CAST(month AS INT) AS month, threshold_cents, tx_date, tx_id, amount_cents, merchant FROM x JOIN p USING (user_id, year, month) WHERE -amount_cents > threshold_cents
        QUALIFY row_number() OVER (PARTITION BY user_id, year, month ORDER BY tx_date, tx_id) = 1""",
    ),
}
