"""Queries of the insight cards, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import cards as c
from tallyspark.operators import checks
from tallyspark.operators import months as m
from tallyspark.operators import recurring as r
from tallyspark.plans.months import BASE, KEEP, _base, _cats, _described, _totals
from tallyspark.plans.recurring import SUBS, SUBS_OUT, TRIALS, _trials
from tallyspark.sources import ledgers
from tallyspark.sources.scratch import written

CARDS = BASE + """, hist AS (
  SELECT *, CAST(sum(spending_cents) OVER (PARTITION BY user_id, category ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS BIGINT) AS prior,
         CAST(sum(spending_cents) OVER (PARTITION BY user_id, category ORDER BY mi RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS BIGINT) AS was FROM cats
),
merch AS (
  SELECT user_id, year, month, year * 12 + month - 1 AS mi, merchant, CAST(sum(-amount_cents) AS BIGINT) AS spent, count(*) AS visits
  FROM base WHERE amount_cents < 0 AND coalesce(merchant, '') <> '' GROUP BY ALL
),
small AS (
  SELECT user_id, year, month, count(*) AS n, CAST(sum(-amount_cents) AS BIGINT) AS total FROM base WHERE amount_cents < 0 AND amount_cents > -1500 GROUP BY ALL
),
cards AS (
  SELECT user_id, year, month, 'over_budget' AS card_type, NULL::VARCHAR AS subject, spending_cents - income_cents AS value_cents, 1 AS priority,
         CASE WHEN income_cents > 0 THEN 'high' ELSE 'medium' END AS confidence FROM totals WHERE spending_cents > income_cents
  UNION ALL SELECT * FROM (SELECT user_id, year, month, 'category_spike', category, spending_cents - was, 2, 'high' FROM hist
    WHERE category NOT IN ('Housing', 'Rent', 'Mortgage', 'Insurance') AND spending_cents > 0 AND was > 0 AND prior > 0 AND spending_cents - was > 5000 AND (spending_cents - was) * 100 > was * 20
    QUALIFY row_number() OVER (PARTITION BY user_id, year, month ORDER BY spending_cents - was DESC, category) = 1)
  UNION ALL SELECT * FROM (SELECT a.user_id, a.year, a.month, 'merchant_spike', a.merchant, a.spent - b.spent, 3, CASE WHEN a.spent - b.spent > 30000 THEN 'high' ELSE 'medium' END
    FROM merch a JOIN merch b ON a.user_id = b.user_id AND a.merchant = b.merchant AND a.mi = b.mi + 1
    WHERE a.spent - b.spent > 10000 AND (a.spent - b.spent) * 100 > b.spent * 30
    QUALIFY row_number() OVER (PARTITION BY a.user_id, a.mi ORDER BY a.spent - b.spent DESC, a.merchant) = 1)
  UNION ALL SELECT user_id, year, month, 'small_leaks', NULL, total, 5, 'high' FROM small WHERE n > 10 AND total > 15000
  UNION ALL SELECT * FROM (SELECT user_id, year, month, 'merchant_frequency', merchant, spent, 5, CASE WHEN visits >= 15 THEN 'high' WHEN visits >= 10 THEN 'medium' ELSE 'low' END
    FROM merch WHERE visits >= 8 QUALIFY row_number() OVER (PARTITION BY user_id, mi ORDER BY visits DESC, merchant) = 1)
  UNION ALL SELECT a.user_id, a.year, a.month, 'mom_income_change', NULL, a.income_cents - b.income_cents, 3, CASE WHEN abs(a.income_cents - b.income_cents) >= 50000 THEN 'high' ELSE 'medium' END
    FROM totals a JOIN totals b ON a.user_id = b.user_id AND a.mi = b.mi + 1 WHERE abs(a.income_cents - b.income_cents) >= 20000
  UNION ALL SELECT user_id, year, month, 'monthly_summary', NULL, net_cents, 6, 'high' FROM totals WHERE income_cents > 0 OR spending_cents > 0
)
"""


def _one(kind):
    return CARDS + f"SELECT * FROM cards WHERE card_type = '{kind}'"


def _few(spark, d):
    """The month's ledger of seven users, each with many small purchases."""
    return m.analytic_base(ledgers.ledger_ev(spark, d).withColumn("user_id", F.col("user_id") % 7))


FEW = f"""WITH {ledgers.SQL}, few AS (SELECT user_id % 7 AS user_id, CAST(year(tx_date) AS INT) AS year, CAST(month(tx_date) AS INT) AS month, merchant, amount_cents FROM ledger_ev WHERE {KEEP}),
fm AS (SELECT user_id, year, month, merchant, CAST(sum(-amount_cents) AS BIGINT) AS spent, count(*) AS visits FROM few WHERE amount_cents < 0 GROUP BY ALL),
ft AS (SELECT user_id, year, month, CAST(sum(CASE WHEN amount_cents < 0 THEN -amount_cents ELSE 0 END) AS BIGINT) AS spending FROM few GROUP BY ALL),
fs AS (SELECT user_id, year, month, count(*) AS n, CAST(sum(-amount_cents) AS BIGINT) AS total FROM few WHERE amount_cents < 0 AND amount_cents > -1500 GROUP BY ALL)
"""
AS_OF = "2001-07-20"
#: BASE and the subscriptions, under one WITH
BOTH = BASE + "," + SUBS.split(ledgers.SQL + ",", 1)[1] + f", sb AS ({SUBS_OUT}), lt AS (SELECT * FROM totals QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY mi DESC) = 1)\n"


def _subscribed(spark, d):
    # subscriptions reads its ledger twice: the joined lines are written once, in the columns it needs
    charges = ledgers.ledger_rec(spark, d).select("tx_id", "user_id", "tx_date", "merchant", "amount_cents", "is_excluded")
    return written(r.subscriptions(written(charges, "charges")), "subscriptions")


#: What a ledger's rows are counted by.
FLAGS = ["is_transfer", "is_excluded", "is_duplicate", "is_foreign"]


def _ledger(spark, d, *columns):
    """The order lines joined once and written, in the columns that a query reads more than once."""
    return written(ledgers.ledger_li(spark, d).select(*columns, *FLAGS), "ledger")


def _metrics(spark, d):
    ledger = _ledger(spark, d, "user_id", "tx_date", "amount_cents")
    base = m.analytic_base(ledger.withColumn("app_category", F.lit(None).cast("string")))
    paced = m.month_pace(m.month_totals(base).withColumn("is_partial", F.lit(True)), F.lit(AS_OF).cast("date"))
    return m.metrics(paced, _subscribed(spark, d), m.small_purchases(base.withColumn("merchant", F.lit(None).cast("string")), 500_000)[0], m.large_threshold(ledger))


def _subscription_cards(spark, d):
    totals, subs = _totals(spark, d), _subscribed(spark, d)
    return c.subscription_summary(totals, subs).unionByName(c.subscription_new(totals, subs)).unionByName(c.subscription_creep(totals, subs))


def _paced(spark, d):
    """Months with the last ones of the users as the current ones, each seen in part."""
    return m.month_pace(_totals(spark, d).withColumn("is_partial", F.lit(True)), F.lit(AS_OF).cast("date"))


def _fixes(spark, d):
    """Categories joined into one of more than 40 %; merchants of the recurring ledger as services of two kinds."""
    base = _base(spark, d).withColumn("category", F.when(F.col("category") == "Uncategorized", "Rent").otherwise("Goods")).withColumn("amount_cents", F.when(F.col("amount_cents") > 0, F.floor(F.col("amount_cents") / 20)).otherwise(F.col("amount_cents")))
    subs = _subscribed(spark, d).withColumn("price_cents", F.col("price_cents") * 10)
    duplicates = subs.where("price_cents % 3 > 0").select("user_id", F.concat(F.lit("kind"), (F.col("price_cents") % 3).cast("string")).alias("service"), "merchant", "price_cents")
    return c.fix_opportunity(m.month_totals(base), m.category_totals(base), subs, duplicates)


def _stored(spark, d):
    """Cards as stored a while ago, each seventh dismissed."""
    old = c.rank_and_cap(c.income_change(_totals(spark, d)).unionByName(c.over_budget(_totals(spark, d))))
    return old.withColumns({"value_cents": F.col("value_cents") + 1, "is_dismissed": F.col("month") % 7 == 0})


def _month_signals(spark, d):
    """Signals of the described order lines, their alerts of three kinds and the recurring ledger's subscriptions."""
    base = m.analytic_base(_described(spark, d))
    sets = m.month_sets(base)
    categories = m.categories_of(sets)
    again = checks.repeats_within(base, carried=["year", "month"])
    alerts = checks.category_spikes(categories).select(*m.MONTH).unionByName(checks.large_anomalies(base).select(*m.MONTH)).unionByName(again.select(*m.MONTH))
    return m.month_signals(m.totals_of(sets), categories, m.statement_signs(base, "description"), _subscribed(spark, d), alerts)


CUT = "CAST(floor({0} + 0.5) AS BIGINT)"
RANK = f"CAST(row_number() OVER (PARTITION BY user_id, year, month ORDER BY priority, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, list_position({c.KINDS}, card_type), value_cents DESC, subject) AS INT)"


def _every_card(spark, d):
    """Cards of all kinds from one aggregate of the order lines, with the recurring ledger's subscriptions and the trials."""
    ledger = _ledger(spark, d, "tx_id", "user_id", "account_id", "tx_date", "merchant", "app_category", "amount_cents")
    base = m.analytic_base(ledger)
    sets, subs = m.month_sets(base), _subscribed(spark, d)
    paced = m.month_pace(m.totals_of(sets).withColumn("is_partial", F.lit(True)), F.lit(AS_OF).cast("date"))
    large = m.top_expenses(base, 3, m.large_threshold(ledger))
    duplicates = subs.where("price_cents % 3 > 0").select("user_id", F.concat(F.lit("kind"), (F.col("price_cents") % 3).cast("string")).alias("service"), "merchant", "price_cents")
    return c.all_cards(sets, paced, large, subs, r.trials(_trials(spark, d), "2024-02-01", "2024-01-08"), duplicates)


def _told(spark, d):
    """Months with small purchases, losses and gains, one category or many, and subscriptions that are new, many or none."""
    x = F.col("amount_cents")
    base = _base(spark, d).withColumns({
        "amount_cents": F.when((x < 0) & (F.col("tx_id") % 3 == 0), -(1 - x % 1499)).when(x > 0, x * (F.col("month") % 5)).otherwise(x),
        "category": F.when(F.col("user_id") % 3 == 0, "Rent").when(F.col("user_id") % 3 == 1, F.substring("category", 1, 3)).otherwise(F.col("category")),
    })
    subs = _subscribed(spark, d).where("user_id % 4 > 0").withColumn("months", F.when((F.col("user_id") % 4 == 1) & (F.col("merchant") != "m3"), 2).otherwise(F.col("months")))
    sets = m.month_sets(base)
    paced = m.month_pace(m.totals_of(sets).withColumn("is_partial", F.lit(True)), F.lit(AS_OF).cast("date"))
    told = c.storyline_text(paced, m.categories_of(sets), subs, m.small_of(sets))
    return told.select(*m.MONTH, "summary", "action_label", F.array_join(F.transform("numbers", lambda n: F.concat_ws("=", n["field"], n["label"], n["value"])), ";").alias("numbers"))


def _usd(cents):
    return f"format('${{:,}}', CAST(floor(abs({cents}) / 100.0::DOUBLE + 0.5) AS BIGINT))"


TOLD = BOTH + f""", nb AS (
  SELECT user_id, year, month, CASE WHEN user_id % 3 = 0 THEN 'Rent' WHEN user_id % 3 = 1 THEN category[1:3] ELSE category END AS category,
         CASE WHEN amount_cents < 0 AND tx_id % 3 = 0 THEN -(1 + (-amount_cents) % 1499) WHEN amount_cents > 0 THEN amount_cents * (month % 5) ELSE amount_cents END AS x FROM base),
nt AS (SELECT user_id, year, month, year * 12 + month - 1 AS mi, CAST(sum(greatest(x, 0)) AS BIGINT) AS inc, CAST(sum(greatest(-x, 0)) AS BIGINT) AS sp, CAST(count(*) FILTER (x < 0 AND x > -1500) AS BIGINT) AS few,
  CAST(coalesce(sum(-x) FILTER (x < 0 AND x > -1500), 0) AS BIGINT) AS few_c FROM nb GROUP BY ALL),
nc AS (SELECT *, NOT (sp = 0 AND inc > 0) AS cost, CASE WHEN sp = 0 AND inc > 0 THEN inc ELSE sp END AS tot FROM (
  SELECT user_id, year, month, year * 12 + month - 1 AS mi, category, CAST(sum(greatest(x, 0)) AS BIGINT) AS inc, CAST(sum(greatest(-x, 0)) AS BIGINT) AS sp FROM nb GROUP BY ALL)),
mv AS (SELECT a.user_id, a.mi, count(*) AS n, sum(b.tot) AS was, sum(a.tot) AS now FROM nc a JOIN nc b ON a.user_id = b.user_id AND a.category = b.category AND a.mi = b.mi + 1 WHERE a.cost GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, mi ORDER BY sp DESC, category) AS k, CAST(sp AS DOUBLE) / CAST(sum(sp) OVER (PARTITION BY user_id, mi) AS DOUBLE) AS share FROM nc WHERE sp > 0),
dr AS (SELECT user_id, mi, max(category) FILTER (k = 1) AS c1, max(category) FILTER (k = 2) AS c2, CAST(floor(max(share) FILTER (k = 1) * 100 + 0.5) AS BIGINT) AS p1, CAST(floor(max(share) FILTER (k = 2) * 100 + 0.5) AS BIGINT) AS p2,
  arg_min(category, k) FILTER (category NOT IN ('Housing', 'Rent', 'Mortgage', 'Insurance')) AS lever FROM rk GROUP BY ALL),
ss AS (SELECT user_id, merchant, price_cents, confidence IN ('high', 'medium') AS sure, CASE WHEN user_id % 4 = 1 AND merchant <> 'm3' THEN 2 ELSE months END AS months FROM sb WHERE user_id % 4 > 0),
us AS (SELECT user_id, count(*) FILTER (sure) AS subs, coalesce(sum(price_cents) FILTER (sure), 0) AS subs_c, count(*) FILTER (months = 2) AS news, arg_min(struct_pack(merchant, price_cents), (-price_cents, merchant)) FILTER (months = 2) AS newest FROM ss GROUP BY user_id),
f AS (SELECT nt.*, inc - sp AS net, coalesce(n, 0) AS n, was, now, c1, c2, p1, p2, lever, coalesce(subs, 0) AS subs, subs_c, coalesce(news, 0) AS news, newest, few_c / CAST(sp AS DOUBLE) * 100 AS few_p,
  CAST(floor((now - was) / CAST(nullif(was, 0) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS change, CAST(floor(CAST(sp AS DOUBLE) / nullif(inc, 0) * 100 + 0.5) AS BIGINT) AS used, CAST(floor(CAST(inc - sp AS DOUBLE) / nullif(inc, 0) * 100 + 0.5) AS BIGINT) AS saved,
  CASE WHEN nt.mi = 2001 * 12 + 6 THEN CAST(sp AS DOUBLE) / 20 END AS daily
  FROM nt LEFT JOIN mv USING (user_id, mi) LEFT JOIN dr USING (user_id, mi) LEFT JOIN us ON nt.user_id = us.user_id AND nt.mi = (SELECT max(z.mi) FROM nt z WHERE z.user_id = nt.user_id) WHERE sp > 0)
SELECT user_id, year, month,
  concat_ws(' ', CASE WHEN inc > 0 AND net >= 0 THEN format('You spent {{}} this month — {{}}% of income — leaving {{}} unspent.', {_usd("sp")}, used, {_usd("net")})
      WHEN inc > 0 THEN format('You spent {{}} this month, {{}}% of income, with a {{}} shortfall.', {_usd("sp")}, used, {_usd("net")}) ELSE format('You spent {{}} this month.', {_usd("sp")}) END,
    CASE WHEN n >= 2 AND was > 0 AND change >= 5 THEN format('That''s up {{}}% from last month across tracked categories.', change) WHEN n >= 2 AND was > 0 AND change <= -5 THEN format('That''s down {{}}% from last month across tracked categories.', -change) END,
    CASE WHEN c2 IS NOT NULL THEN format('The biggest drivers are {{}} ({{}}%) and {{}} ({{}}%).', c1, p1, c2, p2) ELSE format('{{}} makes up {{}}% of spending.', c1, p1) END,
    CASE WHEN news > 0 THEN format('A new recurring charge appeared: {{}} at {{}}/month{{}}.', newest.merchant, {_usd("newest.price_cents")}, CASE WHEN news > 1 THEN format(' (and {{}} more)', news - 1) ELSE '' END)
      WHEN subs >= 4 THEN format('{{}} active subscriptions are running in the background at {{}}/month.', subs, {_usd("subs_c")}) WHEN few >= 10 AND few_p >= 8 THEN format('{{}} small purchases quietly added up to {{}} — worth a look.', few, {_usd("few_c")}) END,
    CASE WHEN daily IS NULL THEN NULL WHEN inc > 0 AND daily * 31 > inc THEN format('At {{}}/day you''re on pace for {{}} — {{}} over income with 11 days left.', {_usd("daily")}, {_usd("daily * 31")}, {_usd("daily * 31 - inc")})
      ELSE format('At this pace, projected month-end spend is {{}} with 11 days remaining.', {_usd("daily * 31")}) END,
    CASE WHEN net < 0 AND lever IS NOT NULL THEN format('To get back to positive, start with {{}} — it''s your biggest lever.', lever) WHEN net < 0 THEN 'Review your variable expense categories to find the easiest reductions.'
      WHEN news > 0 THEN 'Confirm whether the new recurring charge is expected and set to continue.' WHEN subs >= 5 THEN 'Auditing even one unused subscription could free up meaningful annual savings.'
      WHEN few >= 15 AND few_p >= 10 THEN 'Cutting back on small daily purchases is the quickest win with the least sacrifice.'
      WHEN inc > 0 AND saved >= 20 THEN format('You saved {{}}% this month — consider putting the surplus toward a specific goal.', saved) WHEN inc > 0 THEN 'Your finances look stable this month.' END) AS summary,
  CASE WHEN net < 0 AND lever IS NOT NULL THEN 'Review ' || lever WHEN net < 0 THEN 'View transactions' WHEN news > 0 OR subs >= 5 THEN 'Review subscriptions' WHEN few >= 15 AND few_p >= 10 THEN 'View transactions' WHEN inc > 0 THEN 'View details' ELSE 'View transactions' END AS action_label,
  concat_ws(';', 'total_spending=Total spending=' || {_usd("sp")}, CASE WHEN inc > 0 THEN 'net=Net=' || CASE WHEN net >= 0 THEN '+' ELSE '-' END || {_usd("net")} END, 'top_cat_1_pct=' || c1 || '=' || p1 || '%', 'top_cat_2_pct=' || c2 || '=' || p2 || '%',
    CASE WHEN news > 0 THEN 'new_sub=New: ' || newest.merchant || '=' || {_usd("newest.price_cents")} || '/mo' WHEN subs >= 4 THEN 'sub_total=Subscriptions/mo=' || {_usd("subs_c")} WHEN few >= 10 AND few_p >= 8 THEN 'small_total=Small purchases=' || {_usd("few_c")} END,
    CASE WHEN daily IS NOT NULL THEN 'projected=Projected total=' || {_usd("daily * 31")} END) AS numbers
FROM f
"""


#: From g (totals, shares and signs of months) to their personalities.
PERSONALITY = """h AS (SELECT *, CASE WHEN i > 0 THEN CAST(s AS DOUBLE) / i ELSE 1 END AS r, CASE WHEN i > 0 THEN CAST(n AS DOUBLE) / i ELSE 0 END AS sv, coalesce(tp, 0) - coalesce(sp, 0) AS spread FROM g)
        SELECT user_id, year, month, CASE WHEN i >= 1000000 AND r < 0.5::DOUBLE AND sv > 0.4::DOUBLE THEN 'quiet_millionaire' WHEN r BETWEEN 0.85::DOUBLE AND 0.95::DOUBLE AND a = 0 AND spread < 10 THEN 'strategic_deployer'
          WHEN r > 1.05::DOUBLE THEN 'full_send' WHEN a >= 3 AND r > 0.88::DOUBLE THEN 'adrenaline_accountant' WHEN a >= 5 AND n >= 0 THEN 'chaos_controller' WHEN i > 0 AND abs(n) < i * 0.03::DOUBLE THEN 'breakeven_poet'
          WHEN n > 0 AND i > 0 AND sv < 0.05::DOUBLE THEN 'wire_dancer' WHEN coalesce(tp, 0) > 50 THEN 'big_ticket_player' WHEN subs >= 5 THEN 'subscription_collector' WHEN r < 0.5::DOUBLE AND n > 0 THEN 'low_key_saver'
          WHEN k = 'bank' AND (n < 0 OR (a > 1 AND r > 0.95::DOUBLE)) THEN 'overdraft_artist' WHEN k = 'bank' AND r < 0.4::DOUBLE THEN 'cash_keeper' WHEN k = 'bank' AND a = 0 AND r >= 0.5::DOUBLE AND r < 0.75::DOUBLE THEN 'direct_depositor'
          WHEN k = 'credit' AND u > 0.9::DOUBLE THEN 'minimum_payer' WHEN k = 'credit' AND u > 0.75::DOUBLE THEN 'utilization_king' WHEN k = 'credit' AND bc AND it THEN 'revolving_door' WHEN k = 'credit' AND it THEN 'balance_transfer'
          WHEN k = 'credit' AND spread > 30 THEN 'one_card_wonder' WHEN k = 'credit' AND NOT bc AND spread < 15 AND r > 0.7::DOUBLE THEN 'cashback_architect' WHEN k = 'credit' AND NOT bc AND r > 0.8::DOUBLE THEN 'points_chaser'
          WHEN r >= 0.5::DOUBLE AND r < 0.72::DOUBLE AND n > 0 THEN 'safety_buffer' WHEN n > 0 AND a = 0 AND r < 0.8::DOUBLE THEN 'smooth_operator' WHEN i > 500000 AND r > 0.85::DOUBLE THEN 'flow_master'
          WHEN n > 0 AND r < 0.9::DOUBLE THEN 'savvy_spender' ELSE 'steady_builder' END AS personality FROM h"""


QUERIES = {
    "g01_over_budget": (lambda s, d: c.over_budget(_totals(s, d)), _one("over_budget")),
    "g02_category_spike": (lambda s, d: c.category_spike(m.category_history(_cats(s, d))), _one("category_spike")),
    "g03_merchant_spike": (lambda s, d: c.merchant_spike(m.merchant_totals(_base(s, d))), _one("merchant_spike")),
    "g04_large_transaction": (
        lambda s, d: c.large_transaction(m.top_expenses(m.analytic_base(ledgers.ledger_ev(s, d)), 10, m.large_threshold(ledgers.ledger_ev(s, d), 10_000))),
        f"""WITH {ledgers.SQL}, x AS (SELECT user_id, -amount_cents AS x, row_number() OVER (PARTITION BY user_id ORDER BY -amount_cents) AS k, count(*) OVER (PARTITION BY user_id) AS n
            FROM ledger_ev WHERE amount_cents < 0), t AS (SELECT user_id AS u, greatest(x, 10000) AS threshold_cents FROM x WHERE k = floor(n * 0.95::DOUBLE) + 1)
            SELECT user_id, CAST(year(tx_date) AS INT) AS year, CAST(month(tx_date) AS INT) AS month, 'large_transaction' AS card_type, merchant AS subject, -amount_cents AS value_cents, 2 AS priority, 'high' AS confidence
            FROM ledger_ev JOIN t ON user_id = u WHERE {KEEP} AND amount_cents < 0 AND -amount_cents > threshold_cents
            QUALIFY row_number() OVER (PARTITION BY user_id, year(tx_date), month(tx_date) ORDER BY amount_cents, tx_id) <= 3""",
    ),
    "g05_small_leaks": (
        lambda s, d: c.small_leaks(m.small_purchases(_few(s, d))[0]),
        FEW + "SELECT user_id, year, month, 'small_leaks' AS card_type, NULL::VARCHAR AS subject, total AS value_cents, 5 AS priority, 'high' AS confidence FROM fs WHERE n > 10 AND total > 15000",
    ),
    "g06_subscription_cards": (
        _subscription_cards,
        BOTH + """, g AS (SELECT user_id, count(*) AS n, CAST(sum(price_cents) AS BIGINT) AS total, count(*) FILTER (confidence = 'high') AS sure, arg_min(merchant, (-price_cents, merchant)) AS top FROM sb GROUP BY user_id)
        SELECT user_id, year, month, 'subscription_summary' AS card_type, top AS subject, total AS value_cents, 4 AS priority, CASE WHEN sure >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM lt JOIN g USING (user_id) WHERE n >= 2
        UNION ALL SELECT user_id, year, month, 'subscription_new', merchant, price_cents, 3, sb.confidence FROM lt JOIN sb USING (user_id) WHERE months = 2 AND sb.confidence IN ('high', 'medium')
        UNION ALL SELECT user_id, year, month, 'autopsy_subscription_creep', NULL, total, 5, CASE WHEN income_cents <= 0 THEN 'low' WHEN total * 100 > income_cents * 10 THEN 'high' WHEN total * 100 > income_cents * 5 THEN 'medium' ELSE 'low' END
          FROM lt JOIN g USING (user_id) WHERE n >= 3 AND total >= 3000""",
    ),
    "g08_trial_warning": (
        lambda s, d: c.trial_warning(r.trials(_trials(s, d), "2024-02-01", "2024-01-08")),
        TRIALS + """SELECT user_id, CAST(year(trial_date) AS INT) AS year, CAST(month(trial_date) AS INT) AS month, 'trial_warning' AS card_type, merchant AS subject, trial_cents AS value_cents, 2 AS priority, 'medium' AS confidence
          FROM t WHERE date_diff('day', DATE '2024-02-01', billing_date) BETWEEN 0 AND 3""",
    ),
    "g09_pace_cards": (
        lambda s, d: c.cash_flow_forecast(_paced(s, d)).unionByName(c.velocity(_paced(s, d))),
        BASE + f""", p AS (SELECT *, CAST(spending_cents AS DOUBLE) / 20 * 31 AS projected FROM totals WHERE year = 2001 AND month = 7)
        SELECT user_id, year, month, 'cash_flow_forecast' AS card_type, CASE WHEN projected > income_cents THEN 'over_pace' ELSE 'under_pace' END AS subject, {CUT.format("abs(projected - income_cents)")} AS value_cents, 4 AS priority, 'high' AS confidence
          FROM p WHERE income_cents > 0 AND abs(projected - income_cents) > income_cents * 0.1::DOUBLE
        UNION ALL SELECT user_id, year, month, 'autopsy_velocity', NULL, {CUT.format("projected")}, 4, CASE WHEN projected / greatest(spending_cents, 1) - 1 >= 0.5 THEN 'high' WHEN projected / greatest(spending_cents, 1) - 1 >= 0.3 THEN 'medium' ELSE 'low' END
          FROM p WHERE projected / greatest(spending_cents, 1) - 1 > 0.2::DOUBLE""",
    ),
    "g10_fix_opportunity": (
        _fixes,
        BOTH + f""", b AS (SELECT user_id, year, month, CASE WHEN category = 'Uncategorized' THEN 'Rent' ELSE 'Goods' END AS category, CASE WHEN amount_cents > 0 THEN CAST(floor(amount_cents / 20) AS BIGINT) ELSE amount_cents END AS c FROM base),
        bt AS (SELECT user_id, year, month, sum(c) AS net FROM b GROUP BY user_id, year, month QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY year DESC, month DESC) = 1), loss AS (SELECT * FROM bt WHERE net < 0),
        bc AS (SELECT user_id, year, month, category, sum(CASE WHEN c > 0 THEN c ELSE 0 END) AS inc, sum(CASE WHEN c < 0 THEN -c ELSE 0 END) AS sp FROM b GROUP BY ALL),
        bs AS (SELECT *, CAST(sp AS DOUBLE) / sum(sp) OVER (PARTITION BY user_id, year, month) AS share FROM bc),
        sx AS (SELECT user_id, merchant, price_cents * 10 AS price FROM sb),
        du AS (SELECT user_id, 'kind' || (price % 3) AS service, min(price) AS saving, arg_min(merchant, (price, merchant)) AS subject FROM sx WHERE price % 3 > 0 GROUP BY ALL HAVING count(*) >= 2),
        sc AS (SELECT * FROM (SELECT user_id, 1 AS kind, service AS place, subject, saving FROM du UNION ALL SELECT user_id, 2, lpad(CAST(1000000000000000 - price AS VARCHAR), 16, '0'), merchant, price FROM sx WHERE price > 5000)
               QUALIFY row_number() OVER (PARTITION BY user_id, subject ORDER BY kind, place) = 1),
        al AS (SELECT * FROM sc UNION ALL SELECT user_id, 3, printf('%.12f', 1 - share), category, {CUT.format("sp * 0.25::DOUBLE")} FROM bs JOIN loss USING (user_id, year, month) WHERE category = 'Goods' AND NOT (sp = 0 AND inc > 0) AND share > 0.4::DOUBLE),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY kind, place, subject) AS k FROM al),
        z AS (SELECT user_id, count(*) AS n, CAST(sum(saving) AS BIGINT) AS total, arg_min(subject, k) AS first FROM k WHERE k <= 3 GROUP BY user_id)
        SELECT user_id, year, month, 'fix_opportunity' AS card_type, first AS subject, total AS value_cents, 1 AS priority, CASE WHEN n >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM loss JOIN z USING (user_id)""",
    ),
    "g11_merchant_frequency": (
        lambda s, d: c.merchant_frequency(m.merchant_totals(_few(s, d))),
        FEW + """SELECT user_id, year, month, 'merchant_frequency' AS card_type, merchant AS subject, spent AS value_cents, 5 AS priority, CASE WHEN visits >= 15 THEN 'high' WHEN visits >= 10 THEN 'medium' ELSE 'low' END AS confidence
            FROM fm WHERE visits >= 8 QUALIFY row_number() OVER (PARTITION BY user_id, year, month ORDER BY visits DESC, merchant) = 1""",
    ),
    "g12_income_change": (lambda s, d: c.income_change(_totals(s, d)), _one("mom_income_change")),
    "g13_monthly_summary": (lambda s, d: c.monthly_summary(_totals(s, d)), _one("monthly_summary")),
    "g14_small_drain": (
        lambda s, d: c.small_drain(m.month_totals(_few(s, d)), m.small_purchases(_few(s, d))[0]),
        FEW + """SELECT user_id, year, month, 'autopsy_small_drain' AS card_type, NULL::VARCHAR AS subject, total AS value_cents, 4 AS priority, CASE WHEN total * 100 > spending * 15 THEN 'high' WHEN total * 100 > spending * 8 THEN 'medium' ELSE 'low' END AS confidence
            FROM fs JOIN ft USING (user_id, year, month) WHERE n >= 10 AND total >= 5000""",
    ),
    "g15_merchant_concentration": (
        lambda s, d: c.merchant_concentration(_totals(s, d), m.merchant_totals(_base(s, d))),
        CARDS + """SELECT user_id, year, month, 'autopsy_merchant_concentration' AS card_type, merchant AS subject, spent AS value_cents, 3 AS priority, CASE WHEN spent * 100 >= spending_cents * 30 THEN 'high' ELSE 'medium' END AS confidence
            FROM (SELECT * FROM merch WHERE spent > 0 QUALIFY row_number() OVER (PARTITION BY user_id, year, month ORDER BY spent DESC, merchant) = 1) JOIN totals USING (user_id, year, month) WHERE spent * 100 >= spending_cents * 20""",
    ),
    "g17_category_jump": (
        lambda s, d: c.category_jump(m.category_history(_cats(s, d))),
        BASE + f""", h AS (SELECT *, CAST(sum(spending_cents) OVER w AS DOUBLE) / CAST(nullif(count(*) OVER w, 0) AS DOUBLE) AS avg FROM cats WINDOW w AS (PARTITION BY user_id, category ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)),
        j AS (SELECT *, (spending_cents - avg) / avg AS rise FROM h WHERE avg > 0 AND spending_cents > 0)
        SELECT user_id, year, month, 'autopsy_category_spike' AS card_type, category AS subject, {CUT.format("spending_cents - avg")} AS value_cents, 3 AS priority, CASE WHEN rise >= 1 THEN 'high' WHEN rise >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS confidence
        FROM j WHERE rise >= 0.4::DOUBLE AND spending_cents - avg >= 3000 QUALIFY row_number() OVER (PARTITION BY user_id, year, month ORDER BY rise DESC, category) = 1""",
    ),
    "g19_storyline": (
        lambda s, d: c.storyline(_totals(s, d), m.concentration(_cats(s, d))),
        BASE + """SELECT t.user_id, t.year, t.month, 'monthly_storyline' AS card_type, top_category AS subject, net_cents AS value_cents, CASE WHEN net_cents < 0 THEN 2 ELSE 1 END AS priority, CASE WHEN income_cents > 0 THEN 'high' ELSE 'medium' END AS confidence
            FROM totals t LEFT JOIN tops p ON t.user_id = p.user_id AND t.year = p.year AND t.month = p.month WHERE spending_cents > 0""",
    ),
    "g19_storyline_text": (_told, TOLD),
    "g20_rank_and_cap": (
        lambda s, d: c.rank_and_cap(c.ledger_cards(m.month_sets(_base(s, d)))),
        CARDS + f"SELECT *, {RANK} AS rank FROM cards QUALIFY rank <= 8",
    ),
    "g20_kept_dismissals": (
        lambda s, d: c.kept_dismissals(c.rank_and_cap(c.income_change(_totals(s, d)).unionByName(c.monthly_summary(_totals(s, d)))), _stored(s, d)),
        CARDS + """, old AS (SELECT user_id, year, month, card_type, subject, value_cents + 1 AS value_cents, priority, confidence, month % 7 = 0 AS is_dismissed FROM cards WHERE card_type IN ('mom_income_change', 'over_budget')),
        new AS (SELECT user_id, year, month, card_type, subject, value_cents, priority, confidence FROM cards WHERE card_type IN ('mom_income_change', 'monthly_summary'))
        SELECT user_id, year, month, card_type, coalesce(n.subject, o.subject) AS subject, coalesce(n.value_cents, o.value_cents) AS value_cents, coalesce(n.priority, o.priority) AS priority, coalesce(n.confidence, o.confidence) AS confidence,
          coalesce(is_dismissed, false) AS is_dismissed FROM new n FULL JOIN old o USING (user_id, year, month, card_type)""",
    ),
    "g21_shown_cards": (
        lambda s, d: c.shown(_stored(s, d).withColumn("created_at", F.make_timestamp_ntz(years=F.col("year"), months=F.col("month"), days=F.lit(1), hours=F.lit(12), mins=F.col("priority") * 7, secs=F.lit(0))), F.lit("2001-03-01 13:10:00").cast("timestamp_ntz")).select(
            "user_id", "year", "month", "card_type", "place", "is_stale"),
        CARDS + """, old AS (SELECT * FROM cards WHERE card_type IN ('mom_income_change', 'over_budget') AND month % 7 <> 0)
        SELECT user_id, year, month, card_type, CAST(row_number() OVER (PARTITION BY user_id, year, month ORDER BY priority, card_type) AS INT) AS place,
          make_timestamp(year, month, 1, 12, max(priority) OVER (PARTITION BY user_id, year, month) * 7, 0) < TIMESTAMP '2001-03-01 12:10:00' AS is_stale FROM old""",
    ),
    "d15_month_pace": (
        lambda s, d: _paced(s, d).select("user_id", "year", "month", F.col("days_in_month").cast("long"), F.col("elapsed").cast("long"), m.half_up(F.col("daily_cents")).alias("daily_cents"), m.half_up(F.col("projected_cents")).alias("projected_cents")),
        BASE + f"""SELECT user_id, year, month, CAST(day(last_day(make_date(year, month, 1))) AS BIGINT) AS days_in_month, CASE WHEN year = 2001 AND month = 7 THEN 20 ELSE day(last_day(make_date(year, month, 1))) END::BIGINT AS elapsed,
            {CUT.format("CAST(spending_cents AS DOUBLE) / CASE WHEN year = 2001 AND month = 7 THEN 20 ELSE day(last_day(make_date(year, month, 1))) END")} AS daily_cents, CASE WHEN year = 2001 AND month = 7 THEN {CUT.format("CAST(spending_cents AS DOUBLE) / 20 * 31")} END AS projected_cents FROM totals""",
    ),
    "d15_metrics": (
        lambda s, d: _metrics(s, d).select(
            "user_id", "year", "month", "fixed_cents", "subscriptions", "discretionary_cents", "mean_cents", "small_count", "small_cents", "threshold_cents"),
        BOTH + """, fx AS (SELECT user_id, CAST(sum(price_cents) AS BIGINT) AS fixed_cents, count(*) AS subscriptions FROM sb WHERE confidence IN ('high', 'medium') GROUP BY user_id),
        sm AS (SELECT user_id, year, month, count(*) AS small_count, CAST(sum(-amount_cents) AS BIGINT) AS small_cents FROM base WHERE amount_cents < 0 AND amount_cents > -500000 GROUP BY ALL),
        th AS (SELECT user_id, greatest(50000, (list_sort(list(-amount_cents)))[CAST(floor(count(*) * 0.95::DOUBLE) AS INT) + 1]) AS threshold_cents FROM ledger_li WHERE amount_cents < 0 GROUP BY user_id)
        SELECT t.user_id, t.year, t.month, coalesce(fixed_cents, 0) AS fixed_cents, coalesce(subscriptions, 0) AS subscriptions, greatest(0, spending_cents - coalesce(fixed_cents, 0)) AS discretionary_cents,
          CAST(floor(CAST(spending_cents AS DOUBLE) / tx_count + 0.5) AS BIGINT) AS mean_cents, coalesce(small_count, 0) AS small_count, coalesce(small_cents, 0) AS small_cents, threshold_cents
        FROM totals t LEFT JOIN fx ON t.user_id = fx.user_id LEFT JOIN sm ON t.user_id = sm.user_id AND t.year = sm.year AND t.month = sm.month LEFT JOIN th ON t.user_id = th.user_id""",
    ),
    "d17_personality": (
        lambda s, d: m.personality(_signals(s, d)).select("user_id", "year", "month", "personality"),
        BASE + """, g AS (SELECT t.user_id, t.year, t.month, income_cents AS i, net_cents AS n, spending_cents AS s, top_share * 100 AS tp, second_share * 100 AS sp, t.month % 7 AS subs, t.year % 6 AS a,
            CASE WHEN t.month % 2 = 0 THEN 'bank' ELSE 'credit' END AS k, (t.user_id % 10) / 10::DOUBLE AS u, t.user_id % 3 = 0 AS it, t.user_id % 4 = 0 AS bc FROM totals t LEFT JOIN tops p ON t.user_id = p.user_id AND t.year = p.year AND t.month = p.month),
        """ + PERSONALITY,
    ),
    "d17_month_personality": (
        lambda s, d: m.personality(_month_signals(s, d)).select("user_id", "year", "month", "subscriptions", "anomalies", "statement_type", "interest", "personality"),
        BOTH + """, k AS (SELECT user_id, count(*) AS subs FROM sb GROUP BY user_id),
        st AS (SELECT o_custkey % 20 AS user_id, year(o_orderdate) AS year, month(o_orderdate) AS month, bool_or(l_partkey % 401 = 5) AS credit, bool_or(l_partkey % 401 <> 5 AND l_partkey % 311 = 7) AS interest FROM lines
          WHERE l_suppkey % 37 <> 0 AND l_suppkey % 41 <> 0 AND l_partkey % 53 <> 0 AND l_partkey % 59 <> 0 AND floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) <> 0 GROUP BY ALL),
        pa AS (SELECT a.user_id, a.year, a.month, a.spending_cents, list(b.spending_cents) AS past FROM cats a JOIN cats b ON a.user_id = b.user_id AND a.category = b.category AND b.mi < a.mi GROUP BY a.user_id, a.year, a.month, a.category, a.spending_cents HAVING count(*) >= 3),
        pm AS (SELECT *, list_median(past) AS med FROM pa), pd AS (SELECT *, list_median(list_transform(past, lambda v: abs(v - med))) AS mad FROM pm),
        costs AS (SELECT user_id, year, month, -amount_cents AS x, row_number() OVER (PARTITION BY user_id, year, month ORDER BY -amount_cents) AS r, count(*) OVER (PARTITION BY user_id, year, month) AS n FROM base WHERE amount_cents < 0),
        edge AS (SELECT user_id, year, month, greatest(50000, max(x) FILTER (r = floor(n * 0.95::DOUBLE) + 1)) AS e FROM costs GROUP BY ALL),
        al AS (SELECT user_id, year, month FROM pd WHERE mad > 0 AND 0.6745::DOUBLE * abs(spending_cents - med) / mad > 3.5 AND spending_cents > med
          UNION ALL SELECT DISTINCT user_id, year, month FROM costs JOIN edge USING (user_id, year, month) WHERE x > e
          UNION ALL SELECT user_id, year, month FROM (SELECT user_id, year, month, date_diff('day', lag(tx_date) OVER (PARTITION BY user_id, merchant, amount_cents ORDER BY tx_date, tx_id), tx_date) AS gap FROM base WHERE amount_cents < 0) WHERE gap <= 2),
        an AS (SELECT user_id, year, month, count(*) AS a FROM al GROUP BY ALL),
        g AS (SELECT t.user_id, t.year, t.month, income_cents AS i, net_cents AS n, spending_cents AS s, top_share * 100 AS tp, second_share * 100 AS sp, coalesce(subs, 0) AS subs, coalesce(a, 0) AS a, CASE WHEN credit THEN 'credit' ELSE 'unknown' END AS k,
            0.0::DOUBLE AS u, interest AS it, false AS bc FROM totals t LEFT JOIN tops p ON t.user_id = p.user_id AND t.year = p.year AND t.month = p.month LEFT JOIN k ON t.user_id = k.user_id
            LEFT JOIN st ON t.user_id = st.user_id AND t.year = st.year AND t.month = st.month LEFT JOIN an ON t.user_id = an.user_id AND t.year = an.year AND t.month = an.month),
        """ + PERSONALITY.replace("month, CASE WHEN i >=", "month, subs AS subscriptions, a AS anomalies, k AS statement_type, it AS interest, CASE WHEN i >=", 1),
    ),
    "d19_panel_insights": (
        lambda s, d: m.panel_insights(_totals(s, d), _cats(s, d), _base(s, d)),
        BASE + f""", j AS (SELECT t.*, top_category, top_share, top3_share, CAST(t.spending_cents - b.spending_cents AS DOUBLE) / nullif(b.spending_cents, 0) AS change FROM totals t LEFT JOIN totals b ON t.user_id = b.user_id AND t.mi = b.mi + 1
            LEFT JOIN tops p ON t.user_id = p.user_id AND t.year = p.year AND t.month = p.month)
, x AS (SELECT user_id, year(tx_date) AS year, month(tx_date) AS month, -amount_cents AS largest_cents, merchant AS largest_merchant FROM base WHERE amount_cents < 0 QUALIFY row_number() OVER (PARTITION BY user_id, year(tx_date), month(tx_date) ORDER BY amount_cents, tx_date, tx_id, merchant) = 1),
        n AS (SELECT user_id, year, month, count(*) AS n FROM cats WHERE spending_cents > 0 GROUP BY ALL),
        k AS (SELECT j.*, largest_cents, largest_merchant, n, CASE WHEN income_cents > 0 THEN {CUT.format("CAST(spending_cents AS DOUBLE) / income_cents * 100")} END AS ratio_percent, {CUT.format("change * 100")} AS pct FROM j JOIN x ON j.user_id = x.user_id AND j.year = x.year AND j.month = x.month JOIN n ON j.user_id = n.user_id AND j.year = n.year AND j.month = n.month)
        SELECT user_id, year, month, CASE WHEN top_share >= 0.15::DOUBLE THEN top_category END AS leading_category, CASE WHEN n >= 3 THEN {CUT.format("top3_share * 100")} END AS top3_percent, largest_merchant, largest_cents, ratio_percent,
          CASE WHEN ratio_percent IS NULL THEN 'no income' WHEN ratio_percent > 95 THEN 'over' WHEN ratio_percent > 80 THEN 'elevated' WHEN ratio_percent < 55 THEN 'strong' ELSE 'healthy' END AS ratio_band,
          CASE WHEN abs(pct) >= 10 THEN pct END AS change_percent FROM k""",
    ),
    "d26_merchant_visits": (
        lambda s, d: m.merchant_visits(_base(s, d), F.col("merchant").ilike("%e%")).withColumn("dates", F.array_join("dates", ",")),
        BASE + f""", v AS (SELECT user_id, CAST(year(tx_date) AS INT) AS year, CAST(month(tx_date) AS INT) AS month, merchant, count(*) AS visits, CAST(sum(-amount_cents) AS BIGINT) AS total_cents, string_agg(CAST(tx_date AS VARCHAR), ',' ORDER BY tx_date) AS dates, arg_min(category, (tx_date, tx_id, category)) AS category,
          any_value(day(last_day(tx_date))) AS days FROM base WHERE amount_cents < 0 AND merchant ILIKE '%e%' GROUP BY ALL)
        SELECT * EXCLUDE (days), {CUT.format("CAST(total_cents AS DOUBLE) / visits")} AS mean_cents, {CUT.format("visits / (CAST(days AS DOUBLE) / 7) * 10")} AS weekly_tenths FROM v""",
    ),
}
EVERY = " UNION ALL BY NAME ".join(f"SELECT * FROM ({sql})" for sql in (
    CARDS + "SELECT * FROM cards", *(QUERIES[k][1] for k in ("g06_subscription_cards", "g08_trial_warning", "g09_pace_cards", "g15_merchant_concentration", "g17_category_jump", "g19_storyline")),
    CARDS + """, x AS (SELECT user_id, -amount_cents AS x, row_number() OVER (PARTITION BY user_id ORDER BY -amount_cents) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ledger_li WHERE amount_cents < 0),
        th AS (SELECT user_id AS u, greatest(x, 50000) AS threshold_cents FROM x WHERE k = floor(n * 0.95::DOUBLE) + 1)
        SELECT user_id, CAST(year(tx_date) AS INT) AS year, CAST(month(tx_date) AS INT) AS month, 'large_transaction' AS card_type, merchant AS subject, -amount_cents AS value_cents, 2 AS priority, 'high' AS confidence FROM base JOIN th ON user_id = u
        WHERE amount_cents < 0 AND -amount_cents > threshold_cents QUALIFY row_number() OVER (PARTITION BY user_id, year(tx_date), month(tx_date) ORDER BY amount_cents, tx_id, merchant, tx_date, account_id) <= 3""",
    CARDS + """SELECT user_id, year, month, 'autopsy_small_drain' AS card_type, NULL::VARCHAR AS subject, total AS value_cents, 4 AS priority, CASE WHEN total * 100 > spending_cents * 15 THEN 'high' WHEN total * 100 > spending_cents * 8 THEN 'medium' ELSE 'low' END AS confidence
        FROM small JOIN totals USING (user_id, year, month) WHERE n >= 10 AND total >= 5000""",
    BOTH + f""", loss AS (SELECT user_id, year, month FROM lt WHERE net_cents < 0), bs AS (SELECT *, CAST(spending_cents AS DOUBLE) / sum(spending_cents) OVER (PARTITION BY user_id, year, month) AS share FROM cats),
        du AS (SELECT user_id, 'kind' || (price_cents % 3) AS service, min(price_cents) AS saving, arg_min(merchant, (price_cents, merchant)) AS subject FROM sb WHERE price_cents % 3 > 0 GROUP BY ALL HAVING count(*) >= 2),
        sc AS (SELECT * FROM (SELECT user_id, 1 AS kind, service AS place, subject, saving FROM du UNION ALL SELECT user_id, 2, lpad(CAST(1000000000000000 - price_cents AS VARCHAR), 16, '0'), merchant, price_cents FROM sb WHERE price_cents > 5000)
               QUALIFY row_number() OVER (PARTITION BY user_id, subject ORDER BY kind, place) = 1),
        al AS (SELECT * FROM sc UNION ALL SELECT user_id, 3, printf('%.12f', 1 - share), category, {CUT.format("spending_cents * 0.25::DOUBLE")} FROM bs JOIN loss USING (user_id, year, month) WHERE category NOT IN ('Housing', 'Rent', 'Mortgage', 'Insurance') AND NOT (spending_cents = 0 AND income_cents > 0) AND share > 0.4::DOUBLE),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY kind, place, subject) AS k FROM al),
        z AS (SELECT user_id, count(*) AS n, CAST(sum(saving) AS BIGINT) AS total, arg_min(subject, k) AS first FROM k WHERE k <= 3 GROUP BY user_id)
        SELECT user_id, year, month, 'fix_opportunity' AS card_type, first AS subject, total AS value_cents, 1 AS priority, CASE WHEN n >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM loss JOIN z USING (user_id)""",
))
QUERIES["g20_every_kind"] = (
    lambda s, d: c.rank_and_cap(_every_card(s, d)),
    f"""WITH every AS ({EVERY}), one AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY user_id, year, month, card_type ORDER BY priority, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, value_cents DESC, subject NULLS FIRST) = 1)
    SELECT *, {RANK} AS rank FROM one QUALIFY rank <= 8""",
)


def _signals(spark, d):
    """Months' totals with made-up signs of statements."""
    totals, tops = _totals(spark, d), m.concentration(_cats(spark, d))
    return totals.join(tops, ["user_id", "year", "month"], "left").select(
        "user_id", "year", "month", "income_cents", "spending_cents", "net_cents", (F.col("top_share") * 100).alias("top_percent"), (F.col("second_share") * 100).alias("second_percent"),
        (F.col("month") % 7).alias("subscriptions"), (F.col("year") % 6).alias("anomalies"), F.when(F.col("month") % 2 == 0, "bank").otherwise("credit").alias("statement_type"),
        ((F.col("user_id") % 10) / 10).alias("utilization"), (F.col("user_id") % 3 == 0).alias("interest"), (F.col("user_id") % 4 == 0).alias("balance_carried"),
    )
