"""Queries of the monthly analytics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import months as m
from tallyspark.operators import recurring as r
from tallyspark.sources import ledgers

KEEP = "NOT is_transfer AND NOT is_excluded AND NOT is_duplicate AND NOT is_foreign AND amount_cents <> 0"
CATEGORY = "coalesce(nullif(regexp_replace(app_category, '^\\s+|\\s+$', '', 'g'), ''), 'Uncategorized')"
BASE = f"""WITH {ledgers.SQL},
base AS (
  SELECT *, CAST(year(tx_date) AS INT) AS year, CAST(month(tx_date) AS INT) AS month, {CATEGORY} AS category
  FROM ledger_li WHERE {KEEP}
),
totals AS (
  SELECT user_id, year, month,
         CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS income_cents,
         CAST(sum(CASE WHEN amount_cents < 0 THEN -amount_cents ELSE 0 END) AS BIGINT) AS spending_cents,
         CAST(sum(amount_cents) AS BIGINT) AS net_cents, count(*) AS tx_count,
         count(*) FILTER (amount_cents > 0) AS income_count, min(tx_date) AS first_date, max(tx_date) AS last_date,
         year * 12 + month - 1 AS mi
  FROM base GROUP BY user_id, year, month
),
cats AS (
  SELECT *, sum(spending_cents) OVER (PARTITION BY user_id, year, month) AS all_cents, year * 12 + month - 1 AS mi FROM (
    SELECT user_id, year, month, category,
           CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS income_cents,
           CAST(sum(CASE WHEN amount_cents < 0 THEN -amount_cents ELSE 0 END) AS BIGINT) AS spending_cents, count(*) AS tx_count
    FROM base GROUP BY user_id, year, month, category)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, year, month ORDER BY spending_cents DESC, category) AS k FROM cats WHERE spending_cents > 0
),
tops AS (
  SELECT user_id, year, month, max(CASE WHEN k = 1 THEN category END) AS top_category, max(CASE WHEN k = 2 THEN category END) AS second_category,
         CAST(sum(CASE WHEN k = 1 THEN spending_cents END) AS DOUBLE) / CAST(sum(spending_cents) AS DOUBLE) AS top_share,
         CAST(sum(CASE WHEN k = 2 THEN spending_cents END) AS DOUBLE) / CAST(sum(spending_cents) AS DOUBLE) AS second_share,
         CAST(sum(CASE WHEN k <= 3 THEN spending_cents END) AS DOUBLE) / CAST(sum(spending_cents) AS DOUBLE) AS top3_share
  FROM ranked GROUP BY user_id, year, month
),
rolling AS (
  SELECT user_id, year, month, mi, sum(spending_cents) OVER w AS s, count(*) OVER w AS n FROM totals
  WINDOW w AS (PARTITION BY user_id ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)
)
"""


def _described(spark, d):
    """The order lines with descriptions, of which a few speak of cards or of interest."""
    lines = ledgers.ledger_li(spark, d, keep=["l_partkey"])
    k = F.col("l_partkey")
    return lines.withColumn("description", F.when(k % 401 == 5, "VISA Payment 12").when(k % 311 == 7, "Purchase Interest Charge").otherwise(F.col("merchant"))).drop("l_partkey")


def _base(spark, d):
    return m.analytic_base(ledgers.ledger_li(spark, d))


def _totals(spark, d):
    return m.month_totals(_base(spark, d))


def _cats(spark, d):
    return m.category_totals(_base(spark, d))


def budgets(spark, d):
    """A budget for each user and every other category, from the user's number."""
    users = _base(spark, d).select("user_id", "category").distinct()
    return users.where(F.length("category") % 2 == 0).select("user_id", "category", (1_000_000 + F.col("user_id") * 100_000).cast("long").alias("budget_cents"))


def _health(spark, d):
    cats = m.written(_cats(spark, d), "categories")
    totals = cats.groupBy("user_id", "year", "month").agg(F.sum("income_cents").alias("income_cents"), F.sum("spending_cents").alias("spending_cents"), F.sum(F.col("income_cents") - F.col("spending_cents")).alias("net_cents"))
    recurring = r.recurring_list(ledgers.ledger_rec(spark, d)).groupBy("user_id").agg(m.half_up(F.sum("mean_cents")).alias("recurring_cents"))
    return m.health_score(totals, m.positive_streak(totals), recurring, m.concentration(cats))


QUERIES = {
    "p01_analytic_base": (
        lambda s, d: _base(s, d).select("tx_id", "user_id", "year", "month", "category", "amount_cents"),
        BASE + "SELECT tx_id, user_id, year, month, category, amount_cents FROM base",
    ),
    "p02_base_variants": (
        lambda s, d: m.analytic_base(ledgers.ledger_li(s, d), duplicates=True, foreign=True).groupBy("user_id").agg(F.count("*").alias("tx_count"), F.sum("amount_cents").alias("net_cents")),
        f"WITH {ledgers.SQL} SELECT user_id, count(*) AS tx_count, CAST(sum(amount_cents) AS BIGINT) AS net_cents FROM ledger_li WHERE NOT is_transfer AND NOT is_excluded AND amount_cents <> 0 GROUP BY user_id",
    ),
    "a01_month_totals": (
        lambda s, d: _totals(s, d),
        BASE + """SELECT user_id, year, month, income_cents, spending_cents, net_cents, tx_count, income_count, first_date, last_date,
                  date_diff('day', first_date, last_date) + 1 < 0.9::DOUBLE * day(last_day(last_date)) AS is_partial FROM totals""",
    ),
    "a03_category_totals": (
        lambda s, d: _cats(s, d),
        BASE + """SELECT user_id, year, month, category, income_cents, spending_cents, tx_count, spending_cents = 0 AND income_cents > 0 AS is_income,
                  CASE WHEN spending_cents = 0 AND income_cents > 0 THEN income_cents ELSE spending_cents END AS total_cents,
                  CASE WHEN all_cents > 0 THEN CAST(spending_cents AS DOUBLE) / CAST(all_cents AS DOUBLE) ELSE 0.0::DOUBLE END AS share FROM cats""",
    ),
    "a04_merchant_totals": (
        lambda s, d: m.merchant_totals(_base(s, d)),
        BASE + """SELECT user_id, year, month, merchant, CAST(sum(-amount_cents) AS BIGINT) AS spent_cents, count(*) AS visits
                  FROM base WHERE amount_cents < 0 AND coalesce(merchant, '') <> '' GROUP BY ALL""",
    ),
    "a05_category_history": (
        lambda s, d: m.category_history(_cats(s, d)),
        BASE + """SELECT user_id, year, month, category, spending_cents, tx_count,
                  CAST(sum(spending_cents) OVER (PARTITION BY user_id, category ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS DOUBLE)
                    / CAST(nullif(count(*) OVER (PARTITION BY user_id, category ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS avg_cents,
                  CAST(sum(spending_cents) OVER (PARTITION BY user_id, category ORDER BY mi RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS BIGINT) AS before_cents
                  FROM cats""",
    ),
    "a06_small_purchases": (
        lambda s, d: m.small_purchases(m.analytic_base(ledgers.ledger_ev(s, d)))[0],
        f"""WITH {ledgers.SQL} SELECT user_id, CAST(year(tx_date) AS INT) AS year, CAST(month(tx_date) AS INT) AS month, count(*) AS tx_count, CAST(sum(-amount_cents) AS BIGINT) AS total_cents
            FROM ledger_ev WHERE {KEEP} AND amount_cents < 0 AND amount_cents > -1500 GROUP BY ALL""",
    ),
    "a06_small_purchase_merchants": (
        lambda s, d: m.small_purchases(m.analytic_base(ledgers.ledger_ev(s, d)))[1],
        f"""WITH {ledgers.SQL}, g AS (SELECT user_id, CAST(year(tx_date) AS INT) AS year, CAST(month(tx_date) AS INT) AS month, merchant, count(*) AS visits, CAST(sum(-amount_cents) AS BIGINT) AS spent_cents
            FROM ledger_ev WHERE {KEEP} AND amount_cents < 0 AND amount_cents > -1500 GROUP BY ALL)
            SELECT *, CAST(row_number() OVER (PARTITION BY user_id, year, month ORDER BY visits DESC, spent_cents DESC, merchant) AS INT) AS rank FROM g QUALIFY rank <= 5""",
    ),
    "a07_large_threshold": (
        lambda s, d: m.large_threshold(ledgers.ledger_ev(s, d)),
        f"""WITH {ledgers.SQL}, x AS (SELECT user_id, -amount_cents AS x, row_number() OVER (PARTITION BY user_id ORDER BY -amount_cents) AS k, count(*) OVER (PARTITION BY user_id) AS n
            FROM ledger_ev WHERE amount_cents < 0)
            SELECT user_id, greatest(x, 50000) AS threshold_cents FROM x WHERE k = floor(n * 0.95::DOUBLE) + 1""",
    ),
    "a08_rolling_average": (
        lambda s, d: m.rolling_average(_totals(s, d)),
        BASE + "SELECT user_id, year, month, CASE WHEN n > 0 THEN CAST(s AS DOUBLE) / n ELSE 0.0::DOUBLE END AS avg_cents, n AS months_found FROM rolling",
    ),
    "a09_distinct_months": (
        lambda s, d: m.analytic_base(ledgers.ledger_li(s, d), transfers=True, duplicates=True, foreign=True, zero=True).select("user_id", "year", "month").distinct(),
        f"WITH {ledgers.SQL} SELECT DISTINCT user_id, CAST(year(tx_date) AS INT) AS year, CAST(month(tx_date) AS INT) AS month FROM ledger_li WHERE NOT is_excluded",
    ),
    "t01_top_expenses": (
        lambda s, d: m.top_expenses(m.analytic_base(ledgers.ledger_ev(s, d))),
        f"""WITH {ledgers.SQL} SELECT user_id, CAST(year(tx_date) AS INT) AS year, CAST(month(tx_date) AS INT) AS month,
            CAST(row_number() OVER (PARTITION BY user_id, year(tx_date), month(tx_date) ORDER BY amount_cents, tx_id, merchant, tx_date, account_id) AS INT) AS rank, tx_id, merchant, amount_cents
            FROM ledger_ev WHERE {KEEP} AND amount_cents < 0 QUALIFY rank <= 5""",
    ),
    "t02_large_transactions": (
        lambda s, d: m.top_expenses(m.analytic_base(ledgers.ledger_ev(s, d)), 10, m.large_threshold(ledgers.ledger_ev(s, d), 10_000)),
        f"""WITH {ledgers.SQL}, x AS (SELECT user_id, -amount_cents AS x, row_number() OVER (PARTITION BY user_id ORDER BY -amount_cents) AS k, count(*) OVER (PARTITION BY user_id) AS n
            FROM ledger_ev WHERE amount_cents < 0), t AS (SELECT user_id AS u, greatest(x, 10000) AS threshold_cents FROM x WHERE k = floor(n * 0.95::DOUBLE) + 1)
            SELECT user_id, CAST(year(tx_date) AS INT) AS year, CAST(month(tx_date) AS INT) AS month,
            CAST(row_number() OVER (PARTITION BY user_id, year(tx_date), month(tx_date) ORDER BY amount_cents, tx_id, merchant, tx_date, account_id) AS INT) AS rank, tx_id, merchant, amount_cents
            FROM ledger_ev JOIN t ON user_id = u WHERE {KEEP} AND amount_cents < 0 AND -amount_cents > threshold_cents QUALIFY rank <= 10""",
    ),
    "d05_month_summary": (
        lambda s, d: m.month_summary(_described(s, d), "description"),
        BASE + """SELECT t.user_id, t.year, t.month, income_cents, spending_cents, net_cents, tx_count, income_count, first_date, last_date,
                  date_diff('day', first_date, last_date) + 1 < 0.9::DOUBLE * day(last_day(last_date)) AS is_partial,
                  CASE WHEN n > 0 THEN CAST(s AS DOUBLE) / n ELSE 0.0::DOUBLE END AS avg_cents, top_category, second_category, top_share, second_share, top3_share, statement_type, interest_detected
                  FROM totals t JOIN (SELECT user_id, year, month, CASE WHEN bool_or(l_partkey % 401 = 5) THEN 'credit' ELSE 'unknown' END AS statement_type, bool_or(l_partkey % 311 = 7) AS interest_detected FROM (SELECT user_id, year(tx_date) AS year, month(tx_date) AS month, l_partkey
                    FROM (SELECT o_custkey % 20 AS user_id, CAST(o_orderdate AS DATE) AS tx_date, l_partkey, l_suppkey, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS x FROM lines) WHERE l_suppkey % 37 <> 0 AND l_suppkey % 41 <> 0 AND l_partkey % 53 <> 0 AND l_partkey % 59 <> 0 AND x <> 0)
                    GROUP BY ALL) g ON t.user_id = g.user_id AND t.year = g.year AND t.month = g.month JOIN rolling r ON t.user_id = r.user_id AND t.mi = r.mi LEFT JOIN tops p ON t.user_id = p.user_id AND t.year = p.year AND t.month = p.month""",
    ),
    "d08_month_comparison": (
        lambda s, d: m.compare(_cats(s, d)),
        BASE + """, seen AS (SELECT DISTINCT user_id, mi FROM cats),
        j AS (
          SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.mi, b.mi) AS mi, coalesce(a.category, b.category) AS category,
                 coalesce(a.spending_cents, 0) AS now_cents, coalesce(b.spending_cents, 0) AS before_cents
          FROM cats a FULL JOIN (SELECT c.user_id, c.mi + 1 AS mi, category, spending_cents FROM cats c SEMI JOIN seen s ON c.user_id = s.user_id AND c.mi + 1 = s.mi) b
          ON a.user_id = b.user_id AND a.mi = b.mi AND a.category = b.category)
        SELECT user_id, CAST(mi // 12 AS INT) AS year, CAST(mi % 12 + 1 AS INT) AS month, category, now_cents, before_cents, now_cents - before_cents AS delta_cents,
               CAST(row_number() OVER (PARTITION BY user_id, mi ORDER BY abs(now_cents - before_cents) DESC, category) AS INT) AS rank
        FROM j WHERE abs(now_cents - before_cents) > 100 QUALIFY rank <= 8""",
    ),
    "d22_trends": (
        lambda s, d: m.trends(_totals(s, d), 36),
        BASE + """, slots AS (SELECT user_id, unnest(range(max(mi) - 35, max(mi) + 1)) AS mi FROM totals GROUP BY user_id)
        SELECT s.user_id, CAST(s.mi // 12 AS INT) AS year, CAST(s.mi % 12 + 1 AS INT) AS month, income_cents, spending_cents, net_cents
        FROM slots s LEFT JOIN totals t ON s.user_id = t.user_id AND s.mi = t.mi""",
    ),
    "w09_positive_streak": (
        lambda s, d: m.positive_streak(_totals(s, d)),
        BASE + """, b AS (SELECT user_id, sum(CASE WHEN net_cents < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY mi DESC ROWS UNBOUNDED PRECEDING) AS broken FROM totals)
        SELECT user_id, count(*) FILTER (broken = 0) AS streak FROM b GROUP BY user_id""",
    ),
    "d20_concentration": (
        lambda s, d: m.concentration(_cats(s, d)),
        BASE + "SELECT * FROM tops",
    ),
    "d21_analysis_gate": (
        lambda s, d: m.analysis_gate(ledgers.ledger_li(s, d)),
        f"""WITH {ledgers.SQL}, b AS (SELECT *, {CATEGORY} AS category FROM ledger_li WHERE NOT is_transfer AND NOT is_excluded AND NOT is_duplicate AND amount_cents <> 0)
            SELECT user_id, CAST(year(tx_date) AS INT) AS year, CAST(month(tx_date) AS INT) AS month, count(*) AS tx_count, count(*) FILTER (category = 'Uncategorized') AS uncategorized,
            min(tx_date) AS first_date, max(tx_date) AS last_date, count(*) FILTER (category = 'Uncategorized') = 0 AS is_open FROM b GROUP BY 1, 2, 3""",
    ),
    "d18_budget_status": (
        lambda s, d: m.budget_status(_cats(s, d), budgets(s, d)),
        BASE + """, budgets AS (SELECT DISTINCT user_id, category, 1000000 + user_id * 100000 AS budget_cents FROM base WHERE length(category) % 2 = 0)
        SELECT m.user_id, m.year, m.month, b.category, budget_cents, coalesce(spending_cents, 0) AS spending_cents, budget_cents - coalesce(spending_cents, 0) AS remaining_cents,
               CAST(floor(CAST(coalesce(spending_cents, 0) * 100 AS DOUBLE) / budget_cents + 0.5) AS BIGINT) AS percent, coalesce(spending_cents, 0) > budget_cents AS is_over
        FROM (SELECT DISTINCT user_id, year, month FROM cats) m JOIN budgets b ON m.user_id = b.user_id
        LEFT JOIN cats c ON c.user_id = m.user_id AND c.year = m.year AND c.month = m.month AND c.category = b.category""",
    ),
    "d25_month_badge": (
        lambda s, d: m.mom_badge(_totals(s, d)),
        BASE + """, p AS (SELECT t.user_id, t.year, t.month, t.spending_cents, b.spending_cents AS before_cents,
          CAST(floor(CAST((t.spending_cents - b.spending_cents) * 100 AS DOUBLE) / nullif(b.spending_cents, 0) + 0.5) AS BIGINT) AS pct
          FROM totals t LEFT JOIN totals b ON t.user_id = b.user_id AND t.mi = b.mi + 1)
        SELECT user_id, year, month, spending_cents, before_cents, CASE WHEN abs(pct) >= 3 THEN pct END AS percent FROM p""",
    ),
    "a04_month_cube": (
        lambda s, d: m.totals_of(m.month_sets(_base(s, d))).join(m.small_of(m.month_sets(_base(s, d), 200_000)).withColumnRenamed("tx_count", "small_count"), m.MONTH, "left").drop("is_partial"),
        BASE + """, sm AS (SELECT user_id, year, month, count(*) AS small_count, CAST(sum(-amount_cents) AS BIGINT) AS total_cents FROM base WHERE amount_cents < 0 AND amount_cents > -200000 GROUP BY ALL)
        SELECT user_id, year, month, income_cents, spending_cents, net_cents, tx_count, income_count, first_date, last_date, small_count, total_cents FROM totals LEFT JOIN sm USING (user_id, year, month)""",
    ),
    "d16_health_score": (
        _health,
        BASE + """, rs AS (SELECT *, -amount_cents AS x FROM ledger_rec WHERE NOT is_excluded AND amount_cents < 0 AND coalesce(merchant, '') <> ''),
        rm AS (SELECT user_id, merchant, CAST(sum(x) AS DOUBLE) / count(*) AS mean FROM rs GROUP BY ALL HAVING CAST(sum(x) AS DOUBLE) / count(*) >= 100),
        rc AS (SELECT user_id, CAST(sum(CAST(floor(mean + 0.5) AS BIGINT)) AS BIGINT) AS rec FROM rm GROUP BY user_id),
        b AS (SELECT user_id, sum(CASE WHEN net_cents < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY mi DESC ROWS UNBOUNDED PRECEDING) AS broken FROM totals),
        st AS (SELECT user_id, count(*) FILTER (broken = 0) AS streak FROM b GROUP BY user_id),
        j AS (SELECT t.user_id, t.year, t.month, income_cents AS i, coalesce(streak, 0) AS streak, coalesce(rec, 0) AS rec, top_share AS ts,
              CASE WHEN income_cents > 0 THEN CAST(spending_cents AS DOUBLE) / income_cents ELSE 1 END AS r, CASE WHEN income_cents > 0 THEN CAST(income_cents - spending_cents AS DOUBLE) / income_cents ELSE 0 END AS sv
              FROM totals t LEFT JOIN st ON t.user_id = st.user_id LEFT JOIN rc ON t.user_id = rc.user_id LEFT JOIN tops p ON t.user_id = p.user_id AND t.year = p.year AND t.month = p.month),
        f AS (SELECT user_id, year, month, CASE WHEN r <= 0.6::DOUBLE THEN 100 ELSE greatest(0, least(100, floor((1 - (r - 0.6::DOUBLE) / 0.4::DOUBLE) * 100 + 0.5))) END AS spend,
              CASE WHEN sv >= 0.2::DOUBLE THEN 100 WHEN sv >= 0.1::DOUBLE THEN greatest(0, least(100, floor(50 + (sv - 0.1::DOUBLE) / 0.1::DOUBLE * 50 + 0.5))) WHEN sv >= 0 THEN greatest(0, least(100, floor(sv / 0.1::DOUBLE * 50 + 0.5))) ELSE 0 END AS savings,
              greatest(0, least(100, floor(least(streak, 3) / 3::DOUBLE * 100 + 0.5))) AS streak_s,
              CASE WHEN rec = 0 THEN 90 WHEN i <= 0 THEN 80 WHEN CAST(rec AS DOUBLE) / i <= 0.05::DOUBLE THEN 100 ELSE greatest(0, least(100, floor((1 - (CAST(rec AS DOUBLE) / i - 0.05::DOUBLE) / 0.15::DOUBLE) * 100 + 0.5))) END AS recurring,
              CASE WHEN ts IS NULL THEN 80 WHEN ts <= 0.3::DOUBLE THEN 100 ELSE greatest(0, least(100, floor((1 - (ts * 100 - 30) / 50) * 100 + 0.5))) END AS diversity FROM j),
        g AS (SELECT *, CAST(floor(CAST(spend * 35 + savings * 30 + streak_s * 15 + recurring * 10 + diversity * 10 AS DOUBLE) / 100 + 0.5) AS BIGINT) AS score FROM f)
        SELECT user_id, year, month, CAST(spend AS BIGINT) AS spend_score, CAST(savings AS BIGINT) AS savings_score, CAST(streak_s AS BIGINT) AS streak_score, CAST(recurring AS BIGINT) AS recurring_score, CAST(diversity AS BIGINT) AS diversity_score,
          score, CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Fair' ELSE 'Needs Work' END AS label FROM g""",
    ),
}
