"""Queries of recurring charges, each with its SQL."""

from __future__ import annotations

from tallyspark.operators import recurring as r
from tallyspark.sources import ledgers

STATS = f"""WITH {ledgers.SQL},
spent AS (
  SELECT *, -amount_cents AS x, year(tx_date) * 12 + month(tx_date) - 1 AS mi,
         date_diff('day', lag(tx_date) OVER (PARTITION BY user_id, merchant ORDER BY tx_date, tx_id), tx_date) AS gap
  FROM ledger_rec WHERE NOT is_excluded AND amount_cents < 0 AND coalesce(merchant, '') <> ''
),
g AS (
  SELECT user_id, merchant, count(*) AS n, CAST(sum(x) AS DOUBLE) / count(*) AS mean, stddev_pop(x) AS sd, CAST(sum(gap) AS DOUBLE) / count(gap) AS mean_gap,
         coalesce(stddev_pop(gap), 0) AS gap_sd, count(DISTINCT mi) AS months, max(tx_date) AS last_date
  FROM spent GROUP BY ALL
),
runs AS (
  SELECT user_id, merchant, max(run) AS longest_run FROM (
    SELECT user_id, merchant, isl, count(*) AS run FROM (
      SELECT user_id, merchant, mi - row_number() OVER (PARTITION BY user_id, merchant ORDER BY mi) AS isl
      FROM (SELECT DISTINCT user_id, merchant, mi FROM spent)) GROUP BY ALL) GROUP BY ALL
),
usual AS (
  SELECT user_id, merchant, app_category AS usual_category FROM (
    SELECT user_id, merchant, app_category, count(*) AS k, min(tx_date) AS since FROM spent WHERE app_category IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY user_id, merchant ORDER BY k DESC, since, app_category) = 1
),
stats AS (
  SELECT g.*, longest_run, usual_category, sd / mean * 100 AS cv, CASE WHEN mean_gap > 0 THEN gap_sd / mean_gap * 100 ELSE 0 END AS gap_cv,
         CASE WHEN mean_gap BETWEEN 5 AND 9 THEN 'weekly' WHEN mean_gap BETWEEN 12 AND 16 THEN 'biweekly'
              WHEN mean_gap BETWEEN 20 AND 40 THEN 'monthly' WHEN mean_gap BETWEEN 340 AND 400 THEN 'annual' END AS pattern
  FROM g JOIN runs USING (user_id, merchant) LEFT JOIN usual USING (user_id, merchant)
)
"""

SUBS = f"""WITH {ledgers.SQL},
rows0 AS (SELECT *, -amount_cents AS x, year(tx_date) * 12 + month(tx_date) - 1 AS mi FROM ledger_rec WHERE NOT is_excluded AND amount_cents < 0 AND coalesce(merchant, '') <> ''),
rows1 AS (SELECT * FROM rows0 QUALIFY mi > max(mi) OVER (PARTITION BY user_id) - 12),
monthly AS (
  SELECT user_id, merchant, mi, (list_sort(list(x)))[count(*) // 2 + 1] AS price, count(*) AS n, min(tx_date) AS first_date, day(min(tx_date)) AS dom
  FROM rows1 GROUP BY ALL
),
seq AS (
  SELECT *, first_value(price) OVER w AS start, lag(price) OVER w AS before, row_number() OVER (PARTITION BY user_id, merchant ORDER BY mi DESC) AS newest
  FROM monthly WINDOW w AS (PARTITION BY user_id, merchant ORDER BY mi)
),
subs AS (
  SELECT user_id, merchant, count(*) AS months, CAST(sum(n) AS BIGINT) AS n, bool_and(abs(price - start) <= 0.05::DOUBLE * start) AS all_near,
         bool_or(coalesce(abs(price - before) <= 0.05::DOUBLE * before, false)) AS pair_near, stddev_pop(dom) AS day_sd,
         max(CASE WHEN newest = 1 THEN price END) AS price_cents, avg(CASE WHEN newest > 1 THEN price END) AS old_cents, stddev_pop(price) AS sd, avg(price) AS mean,
         min(first_date) AS first_date
  FROM seq GROUP BY ALL
),
scored AS (
  SELECT *, CAST(least(100, CASE WHEN n >= 5 THEN 40 WHEN n = 4 THEN 35 WHEN n = 3 THEN 30 WHEN n = 2 THEN 20 ELSE 0 END
         + floor(30 * greatest(0, 1 - sd / mean / 0.1::DOUBLE) + 0.5) + floor(20 * greatest(0, 1 - day_sd / 5) + 0.5)) AS BIGINT) AS score,
         (price_cents - old_cents) / old_cents AS rise
  FROM subs WHERE months >= 2 AND (all_near OR (pair_near AND day_sd <= 3))
)
"""
SUBS_OUT = """SELECT user_id, merchant, months, n, price_cents, score,
  CASE WHEN months >= 3 AND score >= 65 THEN 'high' WHEN all_near AND day_sd <= 5 THEN 'medium' ELSE 'low' END AS confidence,
  rise > 0.05::DOUBLE AS price_increased, CASE WHEN rise > 0.05::DOUBLE THEN floor(rise * 1000 + 0.5) / 10 END AS increase_percent, first_date FROM scored"""


WORDS = [w for words in r.SERVICES.values() for w in words]
WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
KINDS_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(merchant), '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in r.SERVICES.items()) + " END"


def _named(spark, d):
    """Parts under the names of services, some with other words around them."""
    from pyspark.sql import functions as F

    word = F.get(F.array(*(F.lit(w) for w in WORDS)), (F.col("p_partkey") % len(WORDS)).cast("int"))
    part = ledgers.table(spark, d, "part").withColumn("merchant", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Pay "), F.upper(word))).when(F.col("p_partkey") % 3 == 1, F.concat(word, F.lit(" x"))).otherwise(F.col("p_name")))
    return part.select((F.col("p_partkey") % 20).alias("user_id"), "merchant", F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long").alias("cents"))


def _services(spark, d):
    from pyspark.sql import functions as F

    return r.duplicate_services(_named(spark, d).groupBy("user_id", "merchant").agg(F.max("cents").alias("price_cents")))


NAMED = f"""WITH s AS (SELECT p_partkey % 20 AS user_id, CASE p_partkey % 3 WHEN 0 THEN 'Pay ' || upper({WORDS_SQL}[p_partkey % {len(WORDS)} + 1]) WHEN 1 THEN {WORDS_SQL}[p_partkey % {len(WORDS)} + 1] || ' x' ELSE p_name END AS merchant,
  CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS cents FROM part)"""


def _trials(spark, d):
    """The month's ledger, with names of trials on some rows and amounts of 0 on others."""
    from pyspark.sql import functions as F

    ev, k = ledgers.ledger_ev(spark, d), F.col("tx_id") % 13
    said = F.when(k == 0, F.concat("merchant", F.lit(" Free"))).when(k == 1, F.concat("merchant", F.lit(" 7day trial"))).when(k == 2, F.concat("merchant", F.lit(" 14 day trial"))).otherwise(F.col("merchant"))
    return ev.withColumns({"merchant": said, "amount_cents": F.when(k == 3, 0).otherwise(F.col("amount_cents")).cast("long")})


TRIALS = f"""WITH {ledgers.SQL}, e AS (SELECT tx_id, user_id, tx_date, is_excluded, merchant || CASE tx_id % 13 WHEN 0 THEN ' Free' WHEN 1 THEN ' 7day trial' WHEN 2 THEN ' 14 day trial' ELSE '' END AS merchant,
              CASE WHEN tx_id % 13 = 3 THEN 0 ELSE amount_cents END AS amount_cents FROM ledger_ev),
        x AS (SELECT *, -amount_cents AS x FROM e WHERE NOT is_excluded AND amount_cents <= 0),
        known AS (SELECT DISTINCT user_id, merchant FROM x WHERE tx_date < DATE '2024-01-08'),
        t AS (SELECT x.user_id, x.merchant, tx_date AS trial_date, x AS trial_cents, tx_date + CASE WHEN contains(x.merchant, '7day') THEN 7 WHEN contains(x.merchant, '14 day') THEN 14 ELSE 30 END AS billing_date
              FROM x LEFT JOIN known k USING (user_id, merchant) WHERE tx_date >= DATE '2024-01-08' AND ((k.merchant IS NULL AND (x = 0 OR x BETWEEN 99 AND 199)) OR regexp_matches(lower(x.merchant), 'trial|free'))
              QUALIFY row_number() OVER (PARTITION BY x.user_id, x.merchant ORDER BY tx_date, tx_id) = 1),
        p AS (SELECT user_id, merchant, x.tx_date AS converted_date, x.x AS converted_cents FROM x JOIN t USING (user_id, merchant)
              WHERE x.x > 499 AND x.tx_date > trial_date AND x.tx_date <= trial_date + 45 QUALIFY row_number() OVER (PARTITION BY user_id, merchant ORDER BY x.tx_date, x.tx_id) = 1)
"""


QUERIES = {
    "a13_merchant_statistics": (
        lambda s, d: r.merchant_statistics(ledgers.ledger_rec(s, d)).select(
            "user_id", "merchant", "n", "months", "longest_run", "usual_category", "pattern", r.half_up(r.F.col("cv") * 1000).alias("cv_milli"), r.half_up(r.F.col("gap_cv") * 1000).alias("gap_cv_milli")),
        STATS + """SELECT user_id, merchant, n, months, longest_run, usual_category, pattern, CAST(floor(cv * 1000 + 0.5) AS BIGINT) AS cv_milli,
                   CAST(floor(gap_cv * 1000 + 0.5) AS BIGINT) AS gap_cv_milli FROM stats""",
    ),
    "d13_recurring_charges": (
        lambda s, d: r.recurring_charges(ledgers.ledger_rec(s, d)),
        STATS + """, f AS (SELECT *, coalesce(lower(usual_category) IN ('subscriptions', 'entertainment', 'utilities', 'health', 'insurance', 'memberships', 'housing', 'loans', 'internet', 'phone', 'cable', 'recurring'), false) AS in_category,
            coalesce(pattern IS NOT NULL AND cv <= 40 AND (cv <= 15 OR gap_cv <= 25), false) AS recurs FROM stats WHERE mean >= 200)
        SELECT user_id, merchant, usual_category, n, months, CAST(floor(mean + 0.5) AS BIGINT) AS mean_cents, pattern,
          CASE WHEN cv <= 15 THEN 'high' WHEN cv <= 40 THEN 'variable' ELSE 'low' END AS amount_kind,
          CAST(least(100, CASE WHEN in_category THEN 20 ELSE 0 END + CASE WHEN recurs THEN 15 ELSE 0 END + least(10 * months, 30)
            + floor(2 * greatest(0, 15 - cv) + 0.5) + CASE WHEN cv <= 15 THEN 10 ELSE 0 END + CASE WHEN gap_cv < 10 THEN 10 ELSE 0 END) AS BIGINT) AS score,
          CASE WHEN coalesce(pattern = 'monthly', false) THEN longest_run ELSE n END AS consecutive_months,
          last_date + CAST(floor(mean_gap + 0.5) AS INT) AS next_charge
        FROM f WHERE CASE WHEN in_category THEN NOT (cv > 40 AND n > 1) ELSE recurs AND coalesce(pattern IN ('monthly', 'annual'), false) AND cv <= 15 END""",
    ),
    "d14_recurring_list": (
        lambda s, d: r.recurring_list(ledgers.ledger_rec(s, d)),
        STATS + """SELECT user_id, merchant, n, months, CAST(floor(mean + 0.5) AS BIGINT) AS mean_cents,
          CAST(least(100, 20 + least(10 * months, 30) + floor(2 * greatest(0, 15 - cv) + 0.5) + CASE WHEN cv <= 15 THEN 10 ELSE 0 END) AS BIGINT) AS score,
          CASE WHEN months >= 2 THEN 'high' ELSE 'medium' END AS confidence, longest_run FROM stats WHERE mean >= 100""",
    ),
    "d09_subscriptions": (lambda s, d: r.subscriptions(ledgers.ledger_rec(s, d)), SUBS + SUBS_OUT),
    "d11_trials": (
        lambda s, d: r.trials(_trials(s, d), "2024-02-01", "2024-01-08"),
        TRIALS + """SELECT user_id, merchant, trial_date, trial_cents, billing_date, date_diff('day', DATE '2024-02-01', billing_date) BETWEEN 0 AND 3 AS alert,
               converted_date, converted_cents, CASE WHEN converted_date IS NOT NULL THEN 'converted' WHEN DATE '2024-02-01' > trial_date + 45 THEN 'expired' ELSE 'pending' END AS status
        FROM t LEFT JOIN p USING (user_id, merchant)""",
    ),
    "d12_duplicate_services": (
        _services,
        NAMED + f""", p AS (SELECT user_id, merchant, max(cents) AS price_cents FROM s GROUP BY ALL), k AS (SELECT *, {KINDS_SQL} AS service FROM p)
        SELECT user_id, service, count(*) AS merchants, CAST(sum(price_cents) AS BIGINT) AS total_cents, min(price_cents) AS least_cents,
               CAST(sum(price_cents) - min(price_cents) AS BIGINT) AS saving_cents FROM k WHERE service IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""",
    ),
    "f24_service_category": (
        lambda s, d: _named(s, d).select("user_id", "merchant", r.service_category(r.F.col("merchant")).alias("service")),
        NAMED + f"SELECT user_id, merchant, {KINDS_SQL} AS service FROM s",
    ),
}
