"""Monthly analytics: totals, categories, top expenses, comparison, trends, scores.

Every transform covers all users and months at once, and groups by user and month.
Money is in whole cents until the last projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.scratch import written

MONTH = ["user_id", "year", "month"]


def half_up(value: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(value + 0.5).cast("long")


def analytic_base(
    ledger: DataFrame, transfers: bool = False, excluded: bool = False, duplicates: bool = False, foreign: bool = False, zero: bool = False
) -> DataFrame:
    """Rows that count, with year, month and a clean category. Each flag admits what is normally left out.

    A null flag counts as false; a blank category is Uncategorized.
    """
    keep = F.lit(True)
    for admitted, flag in ((transfers, "is_transfer"), (excluded, "is_excluded"), (duplicates, "is_duplicate"), (foreign, "is_foreign")):
        if not admitted:
            keep = keep & ~F.coalesce(F.col(flag), F.lit(False))
    if not zero:
        keep = keep & (F.col("amount_cents") != 0)
    return ledger.where(keep).withColumns({
        "year": F.year("tx_date"), "month": F.month("tx_date"),
        "category": display_category(F.col("app_category")),
    })


def display_category(raw: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(raw, r"^\s+|\s+$", ""), F.lit("")), F.lit("Uncategorized"))


def _income() -> Column:
    return F.sum(F.when(F.col("amount_cents") > 0, F.col("amount_cents")).otherwise(0))


def _spending() -> Column:
    return F.sum(F.when(F.col("amount_cents") < 0, -F.col("amount_cents")).otherwise(0))


def month_sets(base: DataFrame, below_cents: int = 1500, by: tuple[str, ...] = ("category", "merchant")) -> DataFrame:
    """base added up by month, by month and category and by month and merchant in one shuffle, as a small written table that totals, categories,
    merchants and small purchases are taken from. level: month, or the name of the second key."""
    x = F.col("amount_cents")
    small = (x < 0) & (x > -below_cents)
    level = F.coalesce(*(F.when(F.grouping(c) == 0, c) for c in by), F.lit("month"))
    sums = base.groupingSets([MONTH, *([*MONTH, c] for c in by)], *MONTH, *by).agg(
        level.alias("level"), _income().alias("income_cents"), _spending().alias("spending_cents"), F.count("*").alias("tx_count"), F.count_if(x > 0).alias("income_count"), F.count_if(x < 0).alias("visits"),
        F.min("tx_date").alias("first_date"), F.max("tx_date").alias("last_date"), F.count_if(small).alias("small_count"), F.sum(F.when(small, -x).otherwise(0)).alias("small_cents"),
    )
    return written(sums, "month-sets")


def totals_of(sets: DataFrame) -> DataFrame:
    """month_totals, from month_sets."""
    total = sets.where("level = 'month'").select(*MONTH, "income_cents", "spending_cents", (F.col("income_cents") - F.col("spending_cents")).alias("net_cents"), "tx_count", "income_count", "first_date", "last_date")
    return total.withColumn("is_partial", F.datediff("last_date", "first_date") + 1 < F.lit(0.9) * F.day(F.last_day("last_date")))


def categories_of(sets: DataFrame) -> DataFrame:
    """category_totals, from month_sets."""
    return _with_shares(sets.where("level = 'category'").select(*MONTH, "category", "income_cents", "spending_cents", "tx_count"))


def merchants_of(sets: DataFrame) -> DataFrame:
    """merchant_totals, from month_sets."""
    named = sets.where("level = 'merchant' AND visits > 0 AND coalesce(merchant, '') <> ''")
    return named.select(*MONTH, "merchant", F.col("spending_cents").alias("spent_cents"), "visits")


def small_of(sets: DataFrame) -> DataFrame:
    """Counts and totals of small purchases, from month_sets."""
    return sets.where("level = 'month' AND small_count > 0").select(*MONTH, F.col("small_count").alias("tx_count"), F.col("small_cents").alias("total_cents"))


def month_totals(base: DataFrame) -> DataFrame:
    """Income, spending, net, counts, first and last day; is_partial: the days seen are under 90 % of the month's."""
    totals = base.groupBy(*MONTH).agg(
        _income().alias("income_cents"), _spending().alias("spending_cents"), F.sum("amount_cents").alias("net_cents"),
        F.count("*").alias("tx_count"), F.count_if(F.col("amount_cents") > 0).alias("income_count"),
        F.min("tx_date").alias("first_date"), F.max("tx_date").alias("last_date"),
    )
    days = F.datediff("last_date", "first_date") + 1
    return totals.withColumn("is_partial", days < F.lit(0.9) * F.day(F.last_day("last_date")))


def category_totals(base: DataFrame) -> DataFrame:
    """Totals of each category and month; a category without spending but with income is income. share: of the month's spending."""
    return _with_shares(base.groupBy(*MONTH, "category").agg(_income().alias("income_cents"), _spending().alias("spending_cents"), F.count("*").alias("tx_count")))


def _with_shares(by: DataFrame) -> DataFrame:
    all_spending = F.sum("spending_cents").over(Window.partitionBy(*MONTH))
    is_income = (F.col("spending_cents") == 0) & (F.col("income_cents") > 0)
    return by.withColumns({
        "is_income": is_income,
        "total_cents": F.when(is_income, F.col("income_cents")).otherwise(F.col("spending_cents")),
        "share": F.when(all_spending > 0, F.col("spending_cents") / all_spending).otherwise(F.lit(0.0)),
    })


def merchant_totals(base: DataFrame) -> DataFrame:
    """Expenses of each merchant and month; merchants without a name are left out."""
    named = base.where((F.col("amount_cents") < 0) & (F.coalesce("merchant", F.lit("")) != ""))
    return named.groupBy(*MONTH, "merchant").agg(F.sum(-F.col("amount_cents")).alias("spent_cents"), F.count("*").alias("visits"))


def top_expenses(base: DataFrame, k: int = 5, threshold: DataFrame | None = None) -> DataFrame:
    """The k largest expenses of a month; with a threshold (user_id, threshold_cents) only those above it."""
    spent = base.where("amount_cents < 0")
    if threshold is not None:
        spent = spent.join(threshold, "user_id").where(-F.col("amount_cents") > F.col("threshold_cents"))
    rank = F.row_number().over(Window.partitionBy(*MONTH).orderBy("amount_cents", "tx_id", "merchant", "tx_date", "account_id"))
    return spent.withColumn("rank", rank).where(F.col("rank") <= k).select(*MONTH, "rank", "tx_id", "merchant", "amount_cents")


def large_threshold(ledger: DataFrame, floor_cents: int = 50_000) -> DataFrame:
    """For each user the element at 0-based position floor(0.95 n) of the ascending expenses, no less than the floor.

    Rows are counted by amount first, so a user's window has one row an amount.
    """
    spent = ledger.where("amount_cents < 0").groupBy("user_id", (-F.col("amount_cents")).alias("x")).agg(F.count("*").alias("k"))
    user = Window.partitionBy("user_id")
    ranked = spent.withColumns({"upto": F.sum("k").over(user.orderBy("x")), "n": F.sum("k").over(user)})
    at = ranked.where(F.col("upto") > F.floor(F.col("n") * F.lit(0.95))).groupBy("user_id").agg(F.min("x").alias("x"))
    return at.select("user_id", F.greatest("x", F.lit(floor_cents)).alias("threshold_cents"))


def month_index(year: str = "year", month: str = "month") -> Column:
    return F.col(year) * 12 + F.col(month) - 1


def rolling_average(totals: DataFrame, months: int = 3) -> DataFrame:
    """Mean spending of the months that exist among so many before; 0 if none."""
    frame = Window.partitionBy("user_id").orderBy("at").rangeBetween(-months, -1)
    spent, n = F.sum("spending_cents").over(frame), F.count("*").over(frame)
    return totals.withColumn("at", month_index()).select(
        *MONTH, F.when(n > 0, spent / n).otherwise(F.lit(0.0)).alias("avg_cents"), n.alias("months_found")
    )


def compare(categories: DataFrame) -> DataFrame:
    """Each category of a month against the month before; a category missing in one of them is 0 there.

    delta over 1 dollar only; the eight largest of a month by size, then by name.
    """
    now = categories.select("user_id", month_index().alias("at"), "category", F.col("spending_cents").alias("now_cents"))
    before = categories.select("user_id", (month_index() + 1).alias("at"), "category", F.col("spending_cents").alias("before_cents"))
    seen = now.select("user_id", "at").distinct()
    both = now.join(before.join(seen, ["user_id", "at"], "left_semi"), ["user_id", "at", "category"], "full").fillna(0, ["now_cents", "before_cents"])
    both = both.withColumn("delta_cents", F.col("now_cents") - F.col("before_cents")).where(F.abs("delta_cents") > 100)
    rank = F.row_number().over(Window.partitionBy("user_id", "at").orderBy(F.desc(F.abs("delta_cents")), "category"))
    return both.withColumn("rank", rank).where("rank <= 8").select(
        "user_id", F.floor(F.col("at") / 12).cast("int").alias("year"), (F.col("at") % 12 + 1).cast("int").alias("month"),
        "category", "now_cents", "before_cents", "delta_cents", "rank",
    )


def category_history(categories: DataFrame, months: int = 3) -> DataFrame:
    """Each category of a month with the mean of the trailing months in which it has rows, and the month before (null if absent)."""
    at = categories.withColumn("at", month_index())
    frame = Window.partitionBy("user_id", "category").orderBy("at").rangeBetween(-months, -1)
    one = Window.partitionBy("user_id", "category").orderBy("at").rangeBetween(-1, -1)
    return at.select(
        *MONTH, "category", "spending_cents", "tx_count",
        (F.sum("spending_cents").over(frame) / F.count("*").over(frame)).alias("avg_cents"),
        F.sum("spending_cents").over(one).alias("before_cents"),
    )


def small_purchases(base: DataFrame, below_cents: int = 1500, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(counts and totals a month, the k merchants seen most) of expenses under 15 dollars."""
    small = base.where((F.col("amount_cents") < 0) & (F.col("amount_cents") > -below_cents))
    totals = small.groupBy(*MONTH).agg(F.count("*").alias("tx_count"), F.sum(-F.col("amount_cents")).alias("total_cents"))
    by = small.groupBy(*MONTH, "merchant").agg(F.count("*").alias("visits"), F.sum(-F.col("amount_cents")).alias("spent_cents"))
    rank = F.row_number().over(Window.partitionBy(*MONTH).orderBy(F.desc("visits"), F.desc("spent_cents"), "merchant"))
    return totals, by.withColumn("rank", rank).where(F.col("rank") <= k)


def trends(totals: DataFrame, months: int = 12) -> DataFrame:
    """One row for each of the last so many calendar months of a user; null where there is no summary."""
    last = totals.groupBy("user_id").agg(F.max(month_index()).alias("last"))
    slots = last.select("user_id", F.explode(F.sequence(F.col("last") - (months - 1), F.col("last"))).alias("at"))
    known = totals.select("user_id", month_index().alias("at"), "income_cents", "spending_cents", "net_cents")
    return slots.join(known, ["user_id", "at"], "left").select(
        "user_id", F.floor(F.col("at") / 12).cast("int").alias("year"), (F.col("at") % 12 + 1).cast("int").alias("month"),
        "income_cents", "spending_cents", "net_cents",
    )


def positive_streak(totals: DataFrame) -> DataFrame:
    """Months in a row, back from the latest summary, with net >= 0. Gaps in the calendar are not looked at."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("year"), F.desc("month"))
    broken = F.sum(F.when(F.col("net_cents") < 0, 1).otherwise(0)).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return totals.withColumn("broken", broken).groupBy("user_id").agg(F.count_if(F.col("broken") == 0).alias("streak"))


def concentration(categories: DataFrame) -> DataFrame:
    """Largest, second and the three largest categories of a month by spending, as names and shares."""
    spent = categories.where("spending_cents > 0")
    rank = F.row_number().over(Window.partitionBy(*MONTH).orderBy(F.desc("spending_cents"), "category"))
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("category")))
    return spent.withColumn("rank", rank).groupBy(*MONTH).agg(
        at(1).alias("top_category"), at(2).alias("second_category"),
        (F.sum(F.when(F.col("rank") == 1, F.col("spending_cents"))) / F.sum("spending_cents")).alias("top_share"),
        (F.sum(F.when(F.col("rank") == 2, F.col("spending_cents"))) / F.sum("spending_cents")).alias("second_share"),
        (F.sum(F.when(F.col("rank") <= 3, F.col("spending_cents"))) / F.sum("spending_cents")).alias("top3_share"),
    )


# What descriptions on a credit card's statement say, and those of interest.
CREDIT_WORDS = "(?i)credit card payment|card payment|visa payment|mastercard|amex payment"
INTEREST_WORDS = "(?i)interest charge|finance charge|interest fee"


def statement_signs(base: DataFrame, text_col: str = "merchant") -> DataFrame:
    """(month, statement_type credit or unknown, interest_detected): what any description of a month says."""
    said = lambda words: F.coalesce(F.bool_or(F.col(text_col).rlike(words)), F.lit(False))
    return base.groupBy(*MONTH).agg(F.when(said(CREDIT_WORDS), "credit").otherwise("unknown").alias("statement_type"), said(INTEREST_WORDS).alias("interest_detected"))


def month_summary(ledger: DataFrame, text_col: str = "merchant") -> DataFrame:
    """Totals, average of the trailing quarter, leading categories with the first two's shares, the kind of statement and whether interest is charged."""
    base = analytic_base(ledger)
    totals = month_totals(base)
    return (
        totals.join(rolling_average(totals).drop("months_found"), MONTH)
        .join(concentration(category_totals(base)), MONTH, "left").join(statement_signs(base, text_col), MONTH)
    )


def health_score(totals: DataFrame, streaks: DataFrame, recurring: DataFrame, tops: DataFrame) -> DataFrame:
    """Five factors out of 100, weighted .35, .30, .15, .10, .10, and a label, for each month.

    recurring: user_id, recurring_cents. Months without income get the factors' fixed values.
    """
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(100), half_up(x)))
    income, spent = F.col("income_cents"), F.col("spending_cents")
    ratio = F.when(income > 0, spent / income).otherwise(F.lit(1.0))
    rate = F.when(income > 0, (income - spent) / income).otherwise(F.lit(0.0))
    share = F.col("recurring_cents") / income
    joined = totals.join(streaks, "user_id", "left").join(recurring, "user_id", "left").join(tops.select(*MONTH, "top_share"), MONTH, "left")
    joined = joined.fillna(0, ["streak", "recurring_cents"])
    scored = joined.withColumns({
        "spend_score": F.when(ratio <= 0.6, 100).otherwise(clamp((1 - (ratio - 0.6) / 0.4) * 100)),
        "savings_score": F.when(rate >= 0.2, 100).when(rate >= 0.1, clamp(50 + (rate - 0.1) / 0.1 * 50)).when(rate >= 0, clamp(rate / 0.1 * 50)).otherwise(0),
        "streak_score": clamp(F.least(F.col("streak"), F.lit(3)) / 3 * 100),
        "recurring_score": F.when(F.col("recurring_cents") == 0, 90).when(income <= 0, 80).when(share <= 0.05, 100).otherwise(clamp((1 - (share - 0.05) / 0.15) * 100)),
        "diversity_score": F.when(F.col("top_share").isNull(), 80).when(F.col("top_share") <= 0.3, 100).otherwise(clamp((1 - (F.col("top_share") * 100 - 30) / 50) * 100)),
    })
    total = half_up(
        (F.col("spend_score") * 35 + F.col("savings_score") * 30 + F.col("streak_score") * 15 + F.col("recurring_score") * 10 + F.col("diversity_score") * 10) / 100
    )
    label = F.when(total >= 80, "Excellent").when(total >= 60, "Good").when(total >= 40, "Fair").otherwise("Needs Work")
    return scored.select(
        *MONTH, *[F.col(f"{n}_score").cast("long").alias(f"{n}_score") for n in ("spend", "savings", "streak", "recurring", "diversity")],
        total.alias("score"), label.alias("label"),
    )


def analysis_gate(ledger: DataFrame) -> DataFrame:
    """A month is open for analysis once no row of it is uncategorized."""
    base = analytic_base(ledger, foreign=True)
    return base.groupBy(*MONTH).agg(
        F.count("*").alias("tx_count"), F.count_if(F.col("category") == "Uncategorized").alias("uncategorized"),
        F.min("tx_date").alias("first_date"), F.max("tx_date").alias("last_date"),
    ).withColumn("is_open", (F.col("tx_count") > 0) & (F.col("uncategorized") == 0))


def budget_status(categories: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets: user_id, category, budget_cents. Spent, remaining, percent and over for each month with a summary."""
    months = categories.select(*MONTH).distinct()
    spent = categories.select(*MONTH, "category", "spending_cents")
    return (
        months.join(budgets, "user_id").join(spent, [*MONTH, "category"], "left").fillna(0, ["spending_cents"])
        .select(
            *MONTH, "category", "budget_cents", "spending_cents", (F.col("budget_cents") - F.col("spending_cents")).alias("remaining_cents"),
            half_up(F.col("spending_cents") * 100 / F.col("budget_cents")).alias("percent"), (F.col("spending_cents") > F.col("budget_cents")).alias("is_over"),
        )
    )


def mom_badge(totals: DataFrame) -> DataFrame:
    """Whole percent against the calendar month before; null if that is missing or 0, or under 3 percent."""
    before = totals.select("user_id", (month_index() + 1).alias("at"), F.col("spending_cents").alias("before_cents"))
    pct = half_up((F.col("spending_cents") - F.col("before_cents")) * 100 / F.when(F.col("before_cents") > 0, F.col("before_cents")))
    return totals.withColumn("at", month_index()).join(before, ["user_id", "at"], "left").select(
        *MONTH, "spending_cents", "before_cents", F.when(F.abs(pct) >= 3, pct).alias("percent")
    )


def month_pace(totals: DataFrame, as_of: Column) -> DataFrame:
    """totals with days_in_month, elapsed, daily_cents and projected_cents: of the month of as_of its days so far count, and if it is partial
    its spending is carried on to its end; other months have passed."""
    days = F.day(F.last_day(F.make_date("year", "month", F.lit(1))))
    current = (F.col("year") == F.year(as_of)) & (F.col("month") == F.month(as_of))
    elapsed = F.when(current, F.day(as_of)).otherwise(F.col("days_in_month"))
    return totals.withColumn("days_in_month", days).withColumn("elapsed", elapsed).withColumn("daily_cents", F.col("spending_cents") / F.col("elapsed")).withColumn(
        "projected_cents", F.when(current & F.col("is_partial"), F.col("daily_cents") * F.col("days_in_month")))


def metrics(paced: DataFrame, subscribed: DataFrame, small: DataFrame, threshold: DataFrame) -> DataFrame:
    """What cards are made of, one row a month: pace, fixed costs (subscriptions of high or medium confidence), what is left to choose, the mean of all
    transactions, small purchases and the user's threshold of large ones."""
    fixed = subscribed.where("confidence IN ('high', 'medium')").groupBy("user_id").agg(F.sum("price_cents").alias("fixed_cents"), F.count("*").alias("subscriptions"))
    few = small.select(*MONTH, F.col("tx_count").alias("small_count"), F.col("total_cents").alias("small_cents"))
    joined = paced.join(fixed, "user_id", "left").join(few, MONTH, "left").join(threshold, "user_id", "left").fillna(0, ["fixed_cents", "subscriptions", "small_count", "small_cents"])
    return joined.withColumns({
        "discretionary_cents": F.greatest(F.lit(0), F.col("spending_cents") - F.col("fixed_cents")), "mean_cents": half_up(F.col("spending_cents") / F.col("tx_count")),
    })


def month_signals(totals: DataFrame, categories: DataFrame, signs: DataFrame, subscribed: DataFrame, alerts: DataFrame) -> DataFrame:
    """What a month's personality is told by: its totals, shares of its first two categories in percent, the user's subscriptions (a row each), its
    alerts (user_id, year, month; a row each) and statement_signs. Statements say nothing of a card's utilization or of a balance carried: null."""
    shares = concentration(categories).select(*MONTH, (F.col("top_share") * 100).alias("top_percent"), (F.col("second_share") * 100).alias("second_percent"))
    held = subscribed.groupBy("user_id").agg(F.count("*").alias("subscriptions"))
    warned = alerts.groupBy(*MONTH).agg(F.count("*").alias("anomalies"))
    rows = totals.select(*MONTH, "income_cents", "spending_cents", "net_cents").join(shares, MONTH, "left").join(signs, MONTH, "left").join(held, "user_id", "left").join(warned, MONTH, "left")
    return rows.fillna(0, ["subscriptions", "anomalies"]).fillna("unknown", ["statement_type"]).withColumnRenamed("interest_detected", "interest").withColumns(
        {"utilization": F.lit(None).cast("double"), "balance_carried": F.lit(None).cast("boolean")})


def personality(signals: DataFrame) -> DataFrame:
    """signals (income_cents, spending_cents, net_cents, top_percent, second_percent, subscriptions, anomalies, statement_type, utilization,
    interest, balance_carried) with personality: the first rule that holds. Without income the ratio is 1 and savings are 0."""
    income, net = F.col("income_cents"), F.col("net_cents")
    out = signals.withColumns({
        "__ratio": F.when(income > 0, F.col("spending_cents") / income).otherwise(F.lit(1.0)), "__saved": F.when(income > 0, net / income).otherwise(F.lit(0.0)),
        "__spread": F.coalesce("top_percent", F.lit(0.0)) - F.coalesce("second_percent", F.lit(0.0)),
    })
    ratio, saved, spread, odd = F.col("__ratio"), F.col("__saved"), F.col("__spread"), F.col("anomalies")
    bank, credit, carried = F.col("statement_type") == "bank", F.col("statement_type") == "credit", F.coalesce("balance_carried", F.lit(False))
    used, interest = F.coalesce("utilization", F.lit(0.0)), F.coalesce("interest", F.lit(False))
    # fixed values: names and bounds, in order
    rules = [
        ("quiet_millionaire", (income >= 1_000_000) & (ratio < 0.5) & (saved > 0.4)), ("strategic_deployer", ratio.between(0.85, 0.95) & (odd == 0) & (spread < 10)),
        ("full_send", ratio > 1.05), ("adrenaline_accountant", (odd >= 3) & (ratio > 0.88)), ("chaos_controller", (odd >= 5) & (net >= 0)),
        ("breakeven_poet", (income > 0) & (F.abs(net) < income * 0.03)), ("wire_dancer", (net > 0) & (income > 0) & (saved < 0.05)),
        ("big_ticket_player", F.coalesce("top_percent", F.lit(0.0)) > 50), ("subscription_collector", F.col("subscriptions") >= 5), ("low_key_saver", (ratio < 0.5) & (net > 0)),
        ("overdraft_artist", bank & ((net < 0) | ((odd > 1) & (ratio > 0.95)))), ("cash_keeper", bank & (ratio < 0.4)),
        ("direct_depositor", bank & (odd == 0) & (ratio >= 0.5) & (ratio < 0.75)), ("minimum_payer", credit & (used > 0.9)), ("utilization_king", credit & (used > 0.75)),
        ("revolving_door", credit & carried & interest), ("balance_transfer", credit & interest), ("one_card_wonder", credit & (spread > 30)),
        ("cashback_architect", credit & ~carried & (spread < 15) & (ratio > 0.7)), ("points_chaser", credit & ~carried & (ratio > 0.8)),
        ("safety_buffer", (ratio >= 0.5) & (ratio < 0.72) & (net > 0)), ("smooth_operator", (net > 0) & (odd == 0) & (ratio < 0.8)),
        ("flow_master", (income > 500_000) & (ratio > 0.85)), ("savvy_spender", (net > 0) & (ratio < 0.9)),
    ]
    named = F.coalesce(*(F.when(hit, name) for name, hit in rules), F.lit("steady_builder"))
    return out.withColumn("personality", named).drop("__ratio", "__saved", "__spread")


def panel_insights(totals: DataFrame, categories: DataFrame, base: DataFrame) -> DataFrame:
    """What a month's panel says: the leading category if it has 15 % or more, the share of three if there are three, the largest expense, the band of
    spending against income by whole percents, and spending's change by ten whole percents or more. Months without spending have no row."""
    expenses = base.where("amount_cents < 0").groupBy(*MONTH).agg(F.min_by(F.struct("merchant", (-F.col("amount_cents")).alias("cents")), F.struct("amount_cents", "tx_date", "tx_id", "merchant")).alias("largest"))
    third = categories.where("spending_cents > 0").groupBy(*MONTH).agg(F.count("*").alias("categories"))
    tops = concentration(categories)
    before = totals.select("user_id", (month_index() + 1).alias("at"), F.col("spending_cents").alias("before_cents"))
    joined = totals.withColumn("at", month_index()).join(before, ["user_id", "at"], "left").join(tops, MONTH, "left")
    ratio = F.when(F.col("income_cents") > 0, half_up(F.col("spending_cents") / F.col("income_cents") * 100))
    change = half_up((F.col("spending_cents") - F.col("before_cents")) / F.when(F.col("before_cents") > 0, F.col("before_cents")) * 100)
    return joined.join(expenses, MONTH).join(third, MONTH).select(
        *MONTH, F.when(F.col("top_share") >= 0.15, F.col("top_category")).alias("leading_category"), F.when(F.col("categories") >= 3, half_up(F.col("top3_share") * 100)).alias("top3_percent"),
        F.col("largest.merchant").alias("largest_merchant"), F.col("largest.cents").alias("largest_cents"), ratio.alias("ratio_percent"),
        F.when(ratio.isNull(), "no income").when(ratio > 95, "over").when(ratio > 80, "elevated").when(ratio < 55, "strong").otherwise("healthy").alias("ratio_band"),
        F.when(F.abs(change) >= 10, change).alias("change_percent"),
    )


def merchant_visits(base: DataFrame, asked: Column) -> DataFrame:
    """Visits a month of each user's merchants that asked picks: number, total, mean, tenths of visits a week of the whole month, the days in order, and
    the first visit's category."""
    spent = base.where((F.col("amount_cents") < 0) & asked)
    by = spent.groupBy(*MONTH, "merchant").agg(
        F.count("*").alias("visits"), F.sum(-F.col("amount_cents")).alias("total_cents"), F.sort_array(F.collect_list("tx_date")).alias("dates"), F.min_by("category", F.struct("tx_date", "tx_id", "category")).alias("category"),
    )
    weeks = F.day(F.last_day(F.make_date("year", "month", F.lit(1)))) / 7
    return by.withColumns({"mean_cents": half_up(F.col("total_cents") / F.col("visits")), "weekly_tenths": half_up(F.col("visits") / weeks * 10)})
