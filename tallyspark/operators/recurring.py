"""Recurring charges: detection by interval and amount, subscriptions, trials, duplicates of a service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.months import half_up, month_index

KEY = ["user_id", "merchant"]


def interval_class(days: Column) -> Column:
    """weekly, biweekly, monthly, annual or null."""
    return (
        F.when(days.between(5, 9), "weekly").when(days.between(12, 16), "biweekly")
        .when(days.between(20, 40), "monthly").when(days.between(340, 400), "annual")
    )


def merchant_statistics(ledger: DataFrame) -> DataFrame:
    """For each user's merchant: count, mean and spread of amounts and intervals, months, longest run of months, usual category.

    Spreads are of the population, as percent of the mean; 0 for a single row.
    """
    spent = ledger.where(~F.coalesce("is_excluded", F.lit(False)) & (F.col("amount_cents") < 0) & (F.coalesce("merchant", F.lit("")) != ""))
    order = Window.partitionBy(*KEY).orderBy("tx_date", "tx_id")
    rows = spent.withColumns({"x": -F.col("amount_cents"), "gap": F.datediff("tx_date", F.lag("tx_date").over(order)), "at": month_index_of("tx_date")})
    stats = rows.groupBy(*KEY).agg(
        F.count("*").alias("n"), (F.sum("x") / F.count("*")).alias("mean_cents"), F.stddev_pop("x").alias("sd"),
        F.avg("gap").alias("mean_gap"), F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("gap_sd"),
        F.countDistinct("at").alias("months"), F.min("tx_date").alias("first_date"), F.max("tx_date").alias("last_date"),
    )
    stats = stats.withColumns({
        "cv": F.col("sd") / F.col("mean_cents") * 100,
        "gap_cv": F.when(F.col("mean_gap") > 0, F.col("gap_sd") / F.col("mean_gap") * 100).otherwise(F.lit(0.0)),
        "pattern": interval_class(F.col("mean_gap")),
    }).drop("sd", "gap_sd")
    # islands of months without a gap
    months = rows.select(*KEY, "at").distinct()
    island = F.col("at") - F.row_number().over(Window.partitionBy(*KEY).orderBy("at"))
    runs = months.withColumn("island", island).groupBy(*KEY, "island").agg(F.count("*").alias("run")).groupBy(*KEY).agg(F.max("run").alias("longest_run"))
    named = rows.where("app_category IS NOT NULL").groupBy(*KEY, "app_category").agg(F.count("*").alias("k"), F.min("tx_date").alias("since"))
    usual = named.groupBy(*KEY).agg(F.min_by("app_category", F.struct(-F.col("k"), F.col("since"), F.col("app_category"))).alias("usual_category"))
    return stats.join(runs, KEY).join(usual, KEY, "left")


def month_index_of(date: str) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


# Categories whose charges recur, and those of them that name a subscription the user knows of.
RECURRING_CATEGORIES = ["subscriptions", "entertainment", "utilities", "health", "insurance", "memberships", "housing", "loans", "internet", "phone", "cable", "recurring"]
KNOWN_CATEGORIES = ["subscriptions", "utilities", "insurance", "memberships", "housing", "loans", "internet", "phone", "cable", "recurring"]


def recurring_charges(ledger: DataFrame) -> DataFrame:
    """Layered detection: a recurring category, or a pattern with steady amounts and intervals."""
    s = merchant_statistics(ledger).where("mean_cents >= 200")
    in_category = F.coalesce(F.lower("usual_category").isin(RECURRING_CATEGORIES), F.lit(False))
    recurs = F.col("pattern").isNotNull() & (F.col("cv") <= 40) & ((F.col("cv") <= 15) | (F.col("gap_cv") <= 25))
    s = s.withColumns({"in_category": in_category, "recurs": F.coalesce(recurs, F.lit(False))})
    fits = F.when(F.col("in_category"), ~((F.col("cv") > 40) & (F.col("n") > 1))).otherwise(
        F.col("recurs") & F.coalesce(F.col("pattern").isin("monthly", "annual"), F.lit(False)) & (F.col("cv") <= 15)
    )
    score = (
        F.when(F.col("in_category"), 20).otherwise(0) + F.when(F.col("recurs"), 15).otherwise(0)
        + F.least(F.col("months") * 10, F.lit(30)) + half_up(F.greatest(F.lit(0.0), 15 - F.col("cv")) * 2)
        + F.when(F.col("cv") <= 15, 10).otherwise(0) + F.when(F.col("gap_cv") < 10, 10).otherwise(0)
    )
    run = F.when(F.coalesce(F.col("pattern") == "monthly", F.lit(False)), F.col("longest_run")).otherwise(F.col("n"))
    return s.where(fits).select(
        *KEY, "usual_category", "n", "months", half_up(F.col("mean_cents")).alias("mean_cents"), "pattern",
        F.when(F.col("cv") <= 15, "high").when(F.col("cv") <= 40, "variable").otherwise("low").alias("amount_kind"),
        F.least(F.lit(100), score).cast("long").alias("score"), run.alias("consecutive_months"),
        F.date_add("last_date", half_up(F.col("mean_gap")).cast("int")).alias("next_charge"),
    )


def recurring_list(ledger: DataFrame) -> DataFrame:
    """The plain list: mean of a dollar or more, score from months and steadiness, confidence from months."""
    s = merchant_statistics(ledger).where("mean_cents >= 100")
    score = 20 + F.least(F.col("months") * 10, F.lit(30)) + half_up(F.greatest(F.lit(0.0), 15 - F.col("cv")) * 2) + F.when(F.col("cv") <= 15, 10).otherwise(0)
    return s.select(
        *KEY, "n", "months", half_up(F.col("mean_cents")).alias("mean_cents"), F.least(F.lit(100), score).cast("long").alias("score"),
        F.when(F.col("months") >= 2, "high").otherwise("medium").alias("confidence"), "longest_run",
    )


NAME_SIGNALS = ["premium", "pro", "plus", "subscription", "monthly", "annual"]


def subscriptions(ledger: DataFrame, months: int = 12) -> DataFrame:
    """Merchants charged in two months or more of each user's last so many, at a steady price.

    The price of a month is its upper median. Steady: all within 5 % of the first month, or
    some consecutive pair is and the day of month spreads 3 days or less.
    """
    spent = ledger.where(~F.coalesce("is_excluded", F.lit(False)) & (F.col("amount_cents") < 0) & (F.coalesce("merchant", F.lit("")) != ""))
    rows = spent.withColumns({"x": -F.col("amount_cents"), "at": month_index_of("tx_date")})
    # one row a user, joined, so that no user's rows meet in one task
    last = rows.groupBy("user_id").agg(F.max("at").alias("last_at"))
    rows = rows.join(last, "user_id").where(F.col("at") > F.col("last_at") - months)
    in_month = Window.partitionBy(*KEY, "at").orderBy("x")
    placed = rows.withColumns({"k": F.row_number().over(in_month), "m": F.count("*").over(Window.partitionBy(*KEY, "at"))})
    monthly = placed.groupBy(*KEY, "at").agg(
        F.max(F.when(F.col("k") == F.floor(F.col("m") / 2) + 1, F.col("x"))).alias("price"), F.count("*").alias("n"),
        F.min(F.struct("tx_date", "tx_id")).alias("first"),
    ).withColumn("day", F.day("first.tx_date"))
    order = Window.partitionBy(*KEY).orderBy("at")
    seq = monthly.withColumns({
        "start": F.first("price").over(order), "before": F.lag("price").over(order),
        "newest": F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("at"))),
    })
    near = lambda a, b: F.abs(a - b) <= 0.05 * b
    by = seq.groupBy(*KEY).agg(
        F.count("*").alias("months"), F.sum("n").alias("n"), F.bool_and(near(F.col("price"), F.col("start"))).alias("all_near"),
        F.bool_or(F.coalesce(near(F.col("price"), F.col("before")), F.lit(False))).alias("pair_near"), F.stddev_pop("day").alias("day_sd"),
        F.max(F.when(F.col("newest") == 1, F.col("price"))).alias("price_cents"),
        F.avg(F.when(F.col("newest") > 1, F.col("price"))).alias("old_cents"),
        F.stddev_pop("price").alias("sd"), F.avg("price").alias("mean"), F.min("first.tx_date").alias("first_date"), F.max("at").alias("last_at"),
    )
    kept = by.where((F.col("months") >= 2) & (F.col("all_near") | (F.col("pair_near") & (F.col("day_sd") <= 3))))
    names = sum((F.when(F.contains(F.lower("merchant"), F.lit(w)), 4).otherwise(0) for w in NAME_SIGNALS), F.lit(0))
    frequency = F.when(F.col("n") >= 5, 40).when(F.col("n") == 4, 35).when(F.col("n") == 3, 30).when(F.col("n") == 2, 20).otherwise(0)
    score = F.least(F.lit(100), frequency + half_up(30 * F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mean") / 0.1))
                    + half_up(20 * F.greatest(F.lit(0.0), 1 - F.col("day_sd") / 5)) + F.least(F.lit(10), names))
    scored = kept.withColumn("score", score.cast("long"))
    rise = F.when(F.col("old_cents") > 0, (F.col("price_cents") - F.col("old_cents")) / F.col("old_cents"))
    return scored.select(
        *KEY, "months", "n", "price_cents", "score",
        F.when((F.col("months") >= 3) & (F.col("score") >= 65), "high").when((F.col("months") >= 2) & F.col("all_near") & (F.col("day_sd") <= 5), "medium").otherwise("low").alias("confidence"),
        (rise > 0.05).alias("price_increased"), F.when(rise > 0.05, half_up(rise * 1000) / 10).alias("increase_percent"), "first_date",
    )


def known_subscriptions(ledger: DataFrame) -> DataFrame:
    """Subscriptions of merchants that the user has an expense of in a category that names subscriptions, in any case."""
    chosen = ledger.where(F.lower("app_category").isin(KNOWN_CATEGORIES) & (F.col("amount_cents") < 0) & ~F.coalesce("is_excluded", F.lit(False)))
    return subscriptions(ledger).join(chosen.select(*KEY).distinct(), KEY, "left_semi")


# Words of trials.
TRIAL_KEYWORDS = ["trial", "free", "30day", "14day", "7day", "freetrial", "free trial"]


def trial_days(text: Column) -> Column:
    """How long a trial takes by its text in lower case: 7, 14 or else 30 days."""
    said = lambda *words: text.rlike("|".join(words))
    return F.when(said("7day", "7 day", "week"), 7).when(said("14day", "14 day", "two week"), 14).otherwise(30)


def trials(ledger: DataFrame, as_of: str, window_start: str) -> DataFrame:
    """The first trial charge of each merchant in the window, and what became of it within 45 days.

    A trial is a charge of 0 or of 0.99 to 1.99 by a merchant not seen before the window, or one whose
    text says so. A conversion is the merchant's first charge above 4.99 after it.
    """
    rows = ledger.where(~F.coalesce("is_excluded", F.lit(False)) & (F.col("amount_cents") <= 0)).withColumn("x", -F.col("amount_cents"))
    start, today = F.lit(window_start).cast("date"), F.lit(as_of).cast("date")
    known = rows.where(F.col("tx_date") < start).select(*KEY).distinct().withColumn("known", F.lit(True))
    fresh = rows.where(F.col("tx_date") >= start).join(known, KEY, "left")
    text = F.lower(F.concat_ws(" ", "merchant", *(c for c in ("description",) if c in ledger.columns)))
    cheap = (F.col("x") == 0) | F.col("x").between(99, 199)
    is_trial = (cheap & F.col("known").isNull()) | text.rlike("|".join(TRIAL_KEYWORDS))
    order = Window.partitionBy(*KEY).orderBy("tx_date", "tx_id")
    trial = fresh.where(is_trial).select(*KEY, "tx_date", "tx_id", "x", trial_days(text).alias("days")).withColumn("k", F.row_number().over(order)).where("k = 1")
    trial = trial.select(*KEY, F.col("tx_date").alias("trial_date"), F.col("x").alias("trial_cents"), F.expr("date_add(tx_date, days)").alias("billing_date"))
    paid = rows.where("x > 499").select(*KEY, "tx_date", "tx_id", "x")
    within = paid.join(trial, KEY).where((F.col("tx_date") > F.col("trial_date")) & (F.col("tx_date") <= F.date_add("trial_date", 45)))
    first = within.groupBy(*KEY).agg(F.min(F.struct("tx_date", "tx_id", "x")).alias("p"))
    return trial.join(first, KEY, "left").select(
        *KEY, "trial_date", "trial_cents", "billing_date", F.datediff("billing_date", today).between(0, 3).alias("alert"),
        F.col("p.tx_date").alias("converted_date"), F.col("p.x").alias("converted_cents"),
        F.when(F.col("p").isNotNull(), "converted").when(today > F.date_add("trial_date", 45), "expired").otherwise("pending").alias("status"),
    )


# Kinds of service in this order, and what names of their merchants hold.
SERVICES = {
    "Video Streaming": [
        "netflix", "hulu", "disney", "hbo", "max", "peacock", "paramount", "apple tv", "appletv", "amazon prime", "amazonprime", "youtube premium",
        "youtubepremium", "tubi", "fubo", "sling", "directv stream", "crunchyroll",
    ],
    "Music": [
        "spotify", "apple music", "applemusic", "tidal", "deezer", "pandora", "amazon music", "amazonmusic", "youtube music", "youtubemusic", "soundcloud", "qobuz",
    ],
    "Cloud Storage": [
        "icloud", "dropbox", "google one", "googleone", "google drive", "googledrive", "onedrive", "box.com", "backblaze", "carbonite", "idrive",
    ],
    "News/Magazine": [
        "nytimes", "new york times", "washington post", "wsj", "wall street journal", "the atlantic", "wired", "medium", "substack", "patreon", "economist",
        "bloomberg", "seekingalpha", "apple news",
    ],
    "Gaming": [
        "xbox game pass", "xboxgamepass", "playstation plus", "psplus", "nintendo", "ea play", "eaplay", "steam", "epic games", "epicgames", "twitch",
        "humble bundle", "humblebundle", "ubisoft", "gamepass",
    ],
    "Fitness": [
        "peloton", "beachbody", "noom", "myfitnesspal", "fitbit premium", "strava", "calm", "headspace", "whoop", "aaptiv", "openfit",
    ],
    "Software/Productivity": [
        "adobe", "microsoft 365", "microsoft365", "office 365", "office365", "google workspace", "googleworkspace", "notion", "slack", "zoom", "lastpass",
        "1password", "canva", "grammarly", "quickbooks", "freshbooks", "figma", "linear", "github", "gitlab",
    ],
}


def service_category(name: Column) -> Column:
    """The first kind that has a word in the name; null if none has."""
    lower = F.lower(name)
    out = None
    for kind, words in SERVICES.items():
        hit = lower.rlike("|".join(w.replace(".", r"\.") for w in words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def duplicate_services(subscribed: DataFrame) -> DataFrame:
    """Kinds of service that a user pays two merchants or more for."""
    return subscribed.withColumn("service", service_category(F.col("merchant"))).where("service IS NOT NULL").groupBy("user_id", "service").agg(
        F.count("*").alias("merchants"), F.sum("price_cents").alias("total_cents"), F.min("price_cents").alias("least_cents")
    ).where("merchants >= 2").withColumn("saving_cents", F.col("total_cents") - F.col("least_cents"))
