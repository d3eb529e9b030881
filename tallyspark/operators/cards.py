"""Insight cards: one filtered projection a kind, for all users and months, then ranked.

A card is (user_id, year, month, card_type, subject, value_cents, priority, confidence).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as f
from tallyspark.operators.months import MONTH, categories_of, category_history, concentration, half_up, merchants_of, month_index, small_of, totals_of

# Spending that cannot be acted on at once.
FIXED_COSTS = ["Housing", "Rent", "Mortgage", "Insurance"]


def _card(rows: DataFrame, kind: str, subject: Column, cents: Column, priority: int, confidence: Column) -> DataFrame:
    return rows.select(
        *MONTH, F.lit(kind).alias("card_type"), subject.alias("subject"), cents.cast("long").alias("value_cents"),
        F.lit(priority).alias("priority"), confidence.alias("confidence"),
    )


def _top(rows: DataFrame, *order: Column) -> DataFrame:
    """The first row of each month."""
    rank = F.row_number().over(Window.partitionBy(*MONTH).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def with_month_before(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows and before: value of the calendar month before, null if it has no row."""
    before = rows.select(*keys, (month_index() + 1).alias("__at"), F.col(value).alias("before"))
    return rows.withColumn("__at", month_index()).join(before, [*keys, "__at"], "left").drop("__at")


def over_budget(totals: DataFrame) -> DataFrame:
    over = totals.where("spending_cents > income_cents")
    sure = F.when(F.col("income_cents") > 0, "high").otherwise("medium")
    return _card(over, "over_budget", F.lit(None).cast("string"), F.col("spending_cents") - F.col("income_cents"), 1, sure)


def category_spike(history: DataFrame) -> DataFrame:
    """The category that grew most against the month before: by over 20 % and 50 dollars, with a trailing average above 0."""
    delta = F.col("spending_cents") - F.col("before_cents")
    grown = history.where(~F.col("category").isin(FIXED_COSTS) & (F.col("spending_cents") > 0) & (F.col("before_cents") > 0) & (F.col("avg_cents") > 0))
    grown = grown.withColumn("delta", delta).where((F.col("delta") > 5000) & (F.col("delta") * 100 > F.col("before_cents") * 20))
    return _card(_top(grown, F.desc("delta"), F.col("category")), "category_spike", F.col("category"), F.col("delta"), 2, F.lit("high"))


def merchant_spike(merchants: DataFrame) -> DataFrame:
    """The merchant that grew most: by over 100 dollars and 30 %; high if over 300 dollars."""
    both = with_month_before(merchants, ["user_id", "merchant"], "spent_cents").withColumn("delta", F.col("spent_cents") - F.col("before"))
    grown = both.where((F.col("delta") > 10_000) & (F.col("before") > 0) & (F.col("delta") * 100 > F.col("before") * 30))
    sure = F.when(F.col("delta") > 30_000, "high").otherwise("medium")
    return _card(_top(grown, F.desc("delta"), F.col("merchant")), "merchant_spike", F.col("merchant"), F.col("delta"), 3, sure)


def small_leaks(small: DataFrame) -> DataFrame:
    leaks = small.where("tx_count > 10 AND total_cents > 15000")
    return _card(leaks, "small_leaks", F.lit(None).cast("string"), F.col("total_cents"), 5, F.lit("high"))


def merchant_frequency(merchants: DataFrame) -> DataFrame:
    """The merchant visited most, at least eight times."""
    often = _top(merchants.where("visits >= 8"), F.desc("visits"), F.col("merchant"))
    sure = F.when(F.col("visits") >= 15, "high").when(F.col("visits") >= 10, "medium").otherwise("low")
    return _card(often, "merchant_frequency", F.col("merchant"), F.col("spent_cents"), 5, sure)


def income_change(totals: DataFrame) -> DataFrame:
    """Income differs by 200 dollars or more from the month before; high from 500."""
    both = with_month_before(totals, ["user_id"], "income_cents").withColumn("delta", F.col("income_cents") - F.col("before"))
    sure = F.when(F.abs("delta") >= 50_000, "high").otherwise("medium")
    return _card(both.where(F.abs("delta") >= 20_000), "mom_income_change", F.lit(None).cast("string"), F.col("delta"), 3, sure)


def monthly_summary(totals: DataFrame) -> DataFrame:
    return _card(totals.where("income_cents > 0 OR spending_cents > 0"), "monthly_summary", F.lit(None).cast("string"), F.col("net_cents"), 6, F.lit("high"))


def large_transaction(large: DataFrame, k: int = 3) -> DataFrame:
    """The month's largest expenses above the user's threshold (merchant, amount_cents, rank)."""
    return _card(large.where(F.col("rank") <= k), "large_transaction", F.col("merchant"), -F.col("amount_cents"), 2, F.lit("high"))


def _latest(totals: DataFrame) -> DataFrame:
    """The last month of each user."""
    return totals.groupBy("user_id").agg(F.max(F.struct("year", "month", "income_cents", "net_cents")).alias("m")).select("user_id", "m.*")


def subscription_summary(totals: DataFrame, subscribed: DataFrame) -> DataFrame:
    """Two subscriptions or more (user_id, merchant, price_cents, confidence), in each user's last month; high if three are."""
    by = subscribed.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("price_cents").alias("total"), F.count_if(F.col("confidence") == "high").alias("sure"), F.min_by("merchant", F.struct(-F.col("price_cents"), F.col("merchant"))).alias("top"))
    rows = _latest(totals).join(by.where("n >= 2"), "user_id")
    return _card(rows, "subscription_summary", F.col("top"), F.col("total"), 4, F.when(F.col("sure") >= 3, "high").otherwise("medium"))


def subscription_new(totals: DataFrame, subscribed: DataFrame) -> DataFrame:
    """Subscriptions seen in two months, but for those of low confidence."""
    rows = _latest(totals).join(subscribed.where("months = 2 AND confidence IN ('high', 'medium')"), "user_id")
    return _card(rows, "subscription_new", F.col("merchant"), F.col("price_cents"), 3, F.col("confidence"))


def subscription_creep(totals: DataFrame, subscribed: DataFrame) -> DataFrame:
    """Three subscriptions or more of 30 dollars together; how sure by their share of income."""
    by = subscribed.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("price_cents").alias("total"))
    rows = _latest(totals).join(by.where("n >= 3 AND total >= 3000"), "user_id")
    sure = F.when(F.col("total") * 100 > F.col("income_cents") * 10, "high").when(F.col("total") * 100 > F.col("income_cents") * 5, "medium").otherwise("low")
    return _card(rows, "autopsy_subscription_creep", F.lit(None).cast("string"), F.col("total"), 5, F.when(F.col("income_cents") > 0, sure).otherwise("low"))


def trial_warning(alerts: DataFrame) -> DataFrame:
    """Trials (user_id, merchant, trial_date, trial_cents, alert) that are about to be billed, in the month of the trial."""
    rows = alerts.where("alert").withColumns({"year": F.year("trial_date"), "month": F.month("trial_date")})
    return _card(rows, "trial_warning", F.col("merchant"), F.col("trial_cents"), 2, F.lit("medium"))


def cash_flow_forecast(paced: DataFrame) -> DataFrame:
    """A partial month whose projected spending is a tenth off its income, from its seventh day; high from the fifteenth."""
    off = F.col("projected_cents") - F.col("income_cents")
    rows = paced.where((F.col("elapsed") >= 7) & F.col("projected_cents").isNotNull() & (F.col("income_cents") > 0)).where(F.abs(off) > F.col("income_cents") * 0.1)
    return _card(rows, "cash_flow_forecast", F.when(off > 0, "over_pace").otherwise("under_pace"), half_up(F.abs(off)), 4, F.when(F.col("elapsed") >= 15, "high").otherwise("medium"))


def velocity(paced: DataFrame) -> DataFrame:
    """A partial month, from its fifth day, that will cost a fifth more than so far."""
    more = F.col("projected_cents") / F.greatest(F.col("spending_cents"), F.lit(1)) - 1
    rows = paced.where((F.col("elapsed") >= 5) & F.col("is_partial")).where(more > 0.2)
    sure = F.when(more >= 0.5, "high").when(more >= 0.3, "medium").otherwise("low")
    return _card(rows, "autopsy_velocity", F.lit(None).cast("string"), half_up(F.col("projected_cents")), 4, sure)


def fix_opportunity(totals: DataFrame, categories: DataFrame, subscribed: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Up to three savings for a last month with a loss: the cheapest of services of one kind (user_id, service, merchant, price_cents), subscriptions above
    50 dollars, a quarter of categories above 40 % of spending. A merchant counts once. value_cents: all of them a month."""
    loss = _latest(totals).where("net_cents < 0").select(*MONTH)
    cheapest = duplicates.groupBy("user_id", "service").agg(F.min(F.struct("price_cents", "merchant")).alias("c"), F.count("*").alias("n")).where("n >= 2")
    a = cheapest.select("user_id", F.lit(1).alias("kind"), F.col("service").alias("place"), F.col("c.merchant").alias("subject"), F.col("c.price_cents").alias("saving"))
    b = subscribed.where("price_cents > 5000").select("user_id", F.lit(2).alias("kind"), F.lpad((F.lit(10**15) - F.col("price_cents")).cast("string"), 16, "0").alias("place"), F.col("merchant").alias("subject"), F.col("price_cents").alias("saving"))
    services = a.unionByName(b)
    once = services.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "subject").orderBy("kind", "place"))).where("k = 1").drop("k")
    big = categories.where(~F.col("is_income") & ~F.col("category").isin(FIXED_COSTS) & (F.col("share") > 0.4)).join(loss, MONTH)
    c = big.select("user_id", F.lit(3).alias("kind"), F.format_string("%.12f", 1 - F.col("share")).alias("place"), F.col("category").alias("subject"), half_up(F.col("total_cents") * 0.25).alias("saving"))
    found = once.unionByName(c).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("kind", "place", "subject"))).where("k <= 3")
    by = found.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("saving").alias("total"), F.min_by("subject", "k").alias("first"))
    return _card(loss.join(by, "user_id"), "fix_opportunity", F.col("first"), F.col("total"), 1, F.when(F.col("n") >= 2, "high").otherwise("medium"))


def small_drain(totals: DataFrame, small: DataFrame) -> DataFrame:
    """Ten small purchases or more of 50 dollars together; how sure by their share of spending."""
    rows = totals.select(*MONTH, "spending_cents").join(small.where("tx_count >= 10 AND total_cents >= 5000"), MONTH)
    share = F.col("total_cents") * 100
    sure = F.when(share > F.col("spending_cents") * 15, "high").when(share > F.col("spending_cents") * 8, "medium").otherwise("low")
    return _card(rows, "autopsy_small_drain", F.lit(None).cast("string"), F.col("total_cents"), 4, sure)


def merchant_concentration(totals: DataFrame, merchants: DataFrame) -> DataFrame:
    """The merchant with most of the month's spending, if it has a fifth or more; high from three tenths."""
    top = _top(merchants.where("spent_cents > 0"), F.desc("spent_cents"), F.col("merchant"))
    rows = totals.select(*MONTH, "spending_cents").join(top, MONTH).where(F.col("spent_cents") * 100 >= F.col("spending_cents") * 20)
    return _card(rows, "autopsy_merchant_concentration", F.col("merchant"), F.col("spent_cents"), 3, F.when(F.col("spent_cents") * 100 >= F.col("spending_cents") * 30, "high").otherwise("medium"))


def category_jump(history: DataFrame) -> DataFrame:
    """The category furthest above its trailing average: by four tenths and 30 dollars at least."""
    delta = F.col("spending_cents") - F.col("avg_cents")
    rows = history.where((F.col("avg_cents") > 0) & (F.col("spending_cents") > 0)).withColumn("rise", delta / F.col("avg_cents")).where((F.col("rise") >= 0.4) & (delta >= 3000))
    sure = F.when(F.col("rise") >= 1, "high").when(F.col("rise") >= 0.6, "medium").otherwise("low")
    return _card(_top(rows, F.desc("rise"), F.col("category")), "autopsy_category_spike", F.col("category"), half_up(delta), 3, sure)


def storyline(totals: DataFrame, tops: DataFrame) -> DataFrame:
    """One narrative card a month with spending: first of all, or second if it ends with a loss."""
    rows = totals.where("spending_cents > 0").join(tops.select(*MONTH, "top_category"), MONTH, "left")
    made = _card(rows, "monthly_storyline", F.col("top_category"), F.col("net_cents"), 1, F.when(F.col("income_cents") > 0, "high").otherwise("medium"))
    return made.withColumn("priority", F.when(F.col("value_cents") < 0, 2).otherwise(1))


# The sentences of a month's storyline, and what its button says; {} stand for amounts, percents, names and counts.
TOLD = {
    "spent": "You spent {} this month.", "left": "You spent {} this month — {}% of income — leaving {} unspent.", "short": "You spent {} this month, {}% of income, with a {} shortfall.",
    "up": "That's up {}% from last month across tracked categories.", "down": "That's down {}% from last month across tracked categories.",
    "two": "The biggest drivers are {} ({}%) and {} ({}%).", "one": "{} makes up {}% of spending.",
    "new": "A new recurring charge appeared: {} at {}/month{}.", "more": " (and {} more)", "load": "{} active subscriptions are running in the background at {}/month.",
    "small": "{} small purchases quietly added up to {} — worth a look.",
    "over": "At {}/day you're on pace for {} — {} over income with {} days left.", "pace": "At this pace, projected month-end spend is {} with {} days remaining.",
    "lever": "To get back to positive, start with {} — it's your biggest lever.", "fixed": "Review your variable expense categories to find the easiest reductions.",
    "confirm": "Confirm whether the new recurring charge is expected and set to continue.", "audit": "Auditing even one unused subscription could free up meaningful annual savings.",
    "cut": "Cutting back on small daily purchases is the quickest win with the least sacrifice.", "saved": "You saved {}% this month — consider putting the surplus toward a specific goal.", "stable": "Your finances look stable this month.",
}
BUTTONS = {"default": "View transactions", "lever": "Review {}", "subscriptions": "Review subscriptions", "details": "View details"}


def storyline_text(paced: DataFrame, categories: DataFrame, subscribed: DataFrame, small: DataFrame) -> DataFrame:
    """What the storyline card of a month with spending says (summary), its button (action_label), and numbers, the amounts in it (label, value, field).

    paced: month_pace of the totals; categories: their category_totals; subscribed (user_id, merchant, price_cents, months, confidence): subscriptions, told of in each
    user's last month, of new ones (seen in two months) the dearest; small: tx_count and total_cents of small purchases. Categories of equal spending go by name.
    """
    dollars = lambda c: F.concat(F.lit("$"), F.format_number(half_up(F.abs(c) / 100), 0))
    text = lambda c: c.cast("string")
    told = lambda name, *values: f.filled(TOLD[name], *values)
    sure, new = F.col("confidence").isin("high", "medium"), F.col("months") == 2
    by_user = subscribed.groupBy("user_id").agg(
        F.count_if(sure).alias("subs"), F.sum(F.when(sure, F.col("price_cents"))).alias("subs_cents"), F.count_if(new).alias("new_subs"),
        F.min(F.when(new, F.struct((-F.col("price_cents")).alias("minus"), "merchant"))).alias("newest"),
    )
    held = _latest(paced).select(*MONTH).join(by_user, "user_id")
    tracked = with_month_before(categories, ["user_id", "category"], "total_cents").where(~F.col("is_income") & F.col("before").isNotNull())
    moved = tracked.groupBy(*MONTH).agg(F.count("*").alias("tracked"), F.sum("before").alias("was_cents"), F.sum("total_cents").alias("is_cents"))
    free = categories.where((F.col("spending_cents") > 0) & ~F.col("category").isin(FIXED_COSTS))
    lever = free.groupBy(*MONTH).agg(F.min_by("category", F.struct(-F.col("spending_cents"), F.col("category"))).alias("lever"))
    rows = paced.where("spending_cents > 0").join(concentration(categories), MONTH, "left").join(moved, MONTH, "left").join(lever, MONTH, "left").join(held, MONTH, "left")
    rows = rows.join(small.select(*MONTH, F.col("tx_count").alias("few"), F.col("total_cents").alias("few_cents")), MONTH, "left")
    rows = rows.fillna(0, ["tracked", "was_cents", "is_cents", "subs", "subs_cents", "new_subs", "few", "few_cents"])

    income, spent, net = F.col("income_cents"), F.col("spending_cents"), F.col("net_cents")
    of_income, saved = text(half_up(spent / F.nullif(income, F.lit(0)) * 100)), half_up(net / F.nullif(income, F.lit(0)) * 100)
    change = F.when((F.col("tracked") >= 2) & (F.col("was_cents") > 0), half_up((F.col("is_cents") - F.col("was_cents")) / F.col("was_cents") * 100))
    first, second = half_up(F.col("top_share") * 100), half_up(F.col("second_share") * 100)
    two = F.col("second_category").isNotNull()
    few, few_percent = F.col("few"), F.col("few_cents") / spent * 100
    newest, price = F.col("newest.merchant"), dollars(F.col("newest.minus"))
    more = F.when(F.col("new_subs") > 1, told("more", text(F.col("new_subs") - 1))).otherwise("")
    projected, left = F.col("projected_cents"), text(F.col("days_in_month") - F.col("elapsed"))
    foreseen = F.col("is_partial") & projected.isNotNull() & (F.col("elapsed") >= 5)
    is_new, is_load, is_small = F.col("new_subs") > 0, F.col("subs") >= 4, (few >= 10) & (few_percent >= 8)

    start = F.when((income > 0) & (net >= 0), told("left", dollars(spent), of_income, dollars(net))).when(income > 0, told("short", dollars(spent), of_income, dollars(net))).otherwise(told("spent", dollars(spent)))
    direction = F.when(change >= 5, told("up", text(change))).when(change <= -5, told("down", text(-change)))
    drivers = F.when(two, told("two", F.col("top_category"), text(first), F.col("second_category"), text(second))).otherwise(told("one", F.col("top_category"), text(first)))
    signal = F.when(is_new, told("new", newest, price, more)).when(is_load, told("load", text(F.col("subs")), dollars(F.col("subs_cents")))).when(is_small, told("small", text(few), dollars(F.col("few_cents"))))
    over = told("over", dollars(F.col("daily_cents")), dollars(projected), dollars(projected - income), left)
    ahead = F.when(foreseen, F.when((income > 0) & (projected > income), over).otherwise(told("pace", dollars(projected), left)))
    least = (few >= 15) & (few_percent >= 10)
    advice = (
        F.when(net < 0, F.coalesce(told("lever", F.col("lever")), F.lit(TOLD["fixed"]))).when(is_new, TOLD["confirm"]).when(F.col("subs") >= 5, TOLD["audit"]).when(least, TOLD["cut"])
        .when((income > 0) & (saved >= 20), told("saved", text(saved))).when(income > 0, TOLD["stable"])
    )
    button = (
        F.when(net < 0, F.coalesce(f.filled(BUTTONS["lever"], F.col("lever")), F.lit(BUTTONS["default"]))).when(is_new | (F.col("subs") >= 5), BUTTONS["subscriptions"])
        .when(least, BUTTONS["default"]).when(income > 0, BUTTONS["details"]).otherwise(BUTTONS["default"])
    )
    number = lambda when, label, value, field: F.when(when, F.struct(label.alias("label"), value.alias("value"), F.lit(field).alias("field")))
    percent = lambda c: F.concat(text(c), F.lit("%"))
    # fixed values: labels and fields of the numbers, in order
    numbers = F.array_compact(F.array(
        number(F.lit(True), F.lit("Total spending"), dollars(spent), "total_spending"), number(income > 0, F.lit("Net"), F.concat(F.when(net >= 0, "+").otherwise("-"), dollars(net)), "net"),
        number(first.isNotNull(), F.col("top_category"), percent(first), "top_cat_1_pct"), number(two, F.col("second_category"), percent(second), "top_cat_2_pct"),
        number(is_new, F.concat(F.lit("New: "), newest), F.concat(price, F.lit("/mo")), "new_sub"), number(~is_new & is_load, F.lit("Subscriptions/mo"), dollars(F.col("subs_cents")), "sub_total"),
        number(~is_new & ~is_load & is_small, F.lit("Small purchases"), dollars(F.col("few_cents")), "small_total"), number(foreseen, F.lit("Projected total"), dollars(projected), "projected"),
    ))
    return rows.select(*MONTH, F.concat_ws(" ", start, direction, drivers, signal, ahead, advice).alias("summary"), button.alias("action_label"), numbers.alias("numbers"))


def kept_dismissals(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new cards as they are stored: one of each kind a month, the last; one that was dismissed before stays so. Stored cards of other kinds stay."""
    key = [*MONTH, "card_type"]
    last = new.groupBy(*key).agg(F.max(F.struct("rank", "subject", "value_cents", "priority", "confidence")).alias("c")).select(*key, "c.*")
    before = stored.select(*key, F.struct("subject", "value_cents", "priority", "confidence", "is_dismissed").alias("was"))
    both = last.join(before, key, "full")
    of = lambda c: F.coalesce(F.col(c), F.col(f"was.{c}")).alias(c)
    return both.select(*key, of("subject"), of("value_cents"), of("priority"), of("confidence"), F.coalesce("was.is_dismissed", F.lit(False)).alias("is_dismissed"))


def shown(stored: DataFrame, as_of: Column, fresh_minutes: int = 60) -> DataFrame:
    """Cards that are not dismissed, by priority, with is_stale: the newest of the month is older than an hour."""
    open_cards = stored.where("NOT is_dismissed")
    month = Window.partitionBy(*MONTH)
    place = F.row_number().over(month.orderBy("priority", "card_type"))
    newest = F.max("created_at").over(month)
    return open_cards.withColumns({"place": place, "is_stale": newest < as_of - F.make_dt_interval(mins=F.lit(fresh_minutes))})


# The kinds of cards in the order in which they are made; of equal rank the earlier counts.
KINDS = [
    "over_budget", "category_spike", "merchant_spike", "large_transaction", "small_leaks", "subscription_summary", "subscription_new", "trial_warning", "cash_flow_forecast", "fix_opportunity", "merchant_frequency",
    "mom_income_change", "monthly_summary", "autopsy_small_drain", "autopsy_merchant_concentration", "autopsy_subscription_creep", "autopsy_category_spike", "autopsy_velocity", "monthly_storyline",
]


def rank_and_cap(cards: DataFrame, cap: int = 8) -> DataFrame:
    """The first card of each kind by priority and confidence, at most eight a month; rank from 1. Of a kind's equal cards the one of the largest value counts."""
    sure = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    made = F.array_position(F.array(*map(F.lit, KINDS)), F.col("card_type"))
    order = [F.col("priority"), sure, made, F.desc("value_cents"), F.col("subject")]
    # a kind's first card by an aggregate, which is combined before the shuffle
    first = cards.groupBy(*MONTH, "card_type").agg(F.min(F.struct("priority", sure.alias("sure"), (-F.col("value_cents")).alias("minus"), "subject", "confidence")).alias("c"))
    one = first.select(*MONTH, "card_type", "c.subject", (-F.col("c.minus")).alias("value_cents"), "c.priority", "c.confidence")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(*MONTH).orderBy(*order))).where(F.col("rank") <= cap)


def ledger_cards(sets: DataFrame) -> DataFrame:
    """The seven kinds that month_sets alone give."""
    totals, history, merchants, small = totals_of(sets), category_history(categories_of(sets)), merchants_of(sets), small_of(sets)
    kinds = [over_budget(totals), category_spike(history), merchant_spike(merchants), small_leaks(small), merchant_frequency(merchants), income_change(totals), monthly_summary(totals)]
    return reduce(DataFrame.unionByName, kinds)


def all_cards(sets: DataFrame, paced: DataFrame, large: DataFrame, subscribed: DataFrame, alerts: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Cards of all kinds. sets: month_sets of the ledger; paced: month_pace of its totals; large: its largest expenses (merchant, amount_cents, rank); subscribed:
    subscriptions; alerts: trials; duplicates: services of one kind (user_id, service, merchant, price_cents)."""
    totals, categories, merchants, small = totals_of(sets), categories_of(sets), merchants_of(sets), small_of(sets)
    kinds = [
        ledger_cards(sets), large_transaction(large), subscription_summary(totals, subscribed), subscription_new(totals, subscribed), trial_warning(alerts), cash_flow_forecast(paced),
        fix_opportunity(totals, categories, subscribed, duplicates), small_drain(totals, small), merchant_concentration(totals, merchants), subscription_creep(totals, subscribed),
        category_jump(category_history(categories)), velocity(paced), storyline(totals, concentration(categories)),
    ]
    return reduce(DataFrame.unionByName, kinds)
