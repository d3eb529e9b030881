"""Reports on uploads: what a scan, an import and a first look at a file say; one row an upload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as f
from tallyspark.operators import staging
from tallyspark.operators.months import half_up

UPLOAD = "upload_id"


def _ranked(rows: DataFrame, name: str, order: list[Column], shown: list[str], most: int | None = None) -> DataFrame:
    """Each upload's rows in order as an array of structs."""
    placed = rows.withColumn("__k", F.row_number().over(Window.partitionBy(UPLOAD).orderBy(*order)))
    placed = placed.where(F.col("__k") <= most) if most else placed
    return placed.groupBy(UPLOAD).agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", *shown))), lambda x: F.struct(*(x[c].alias(c) for c in shown))).alias(name))


def scan_report(rows: DataFrame, issues: DataFrame, recurring: DataFrame, alerts: DataFrame, most: int = 10) -> DataFrame:
    """rows (upload_id, tx_id, merchant, category, amount_cents, fingerprint, is_possible_duplicate, balance_valid), issues (upload_id, severity), recurring charges
    (upload_id, merchant, mean_cents) and alerts (upload_id, kind, subject) to one row an upload: totals, duplicate groups, leading merchants and
    categories (a whole percent of spending each), balance breaks, issues by severity (errors high, warnings medium, others low), recurring charges,
    the largest first, with their sum, and alerts with their number."""
    spent = F.when(F.col("amount_cents") < 0, -F.col("amount_cents")).otherwise(0)
    same = F.when(F.col("is_possible_duplicate"), F.when(F.coalesce("fingerprint", F.lit("")) != "", F.col("fingerprint")).otherwise(F.concat(F.lit("tx"), F.col("tx_id").cast("string"))))
    totals = rows.groupBy(UPLOAD).agg(
        F.count("*").alias("tx_count"), F.sum(F.when(F.col("amount_cents") > 0, F.col("amount_cents")).otherwise(0)).alias("income_cents"), F.sum(spent).alias("spending_cents"),
        F.count_if(~F.col("balance_valid")).alias("balance_breaks"),
    ).withColumn("net_cents", F.col("income_cents") - F.col("spending_cents"))
    groups = rows.where("is_possible_duplicate").select(UPLOAD, same.alias("k")).distinct().groupBy(UPLOAD).agg(F.count("*").alias("duplicate_groups"))
    costs = rows.where("amount_cents < 0")
    merchants = costs.groupBy(UPLOAD, F.coalesce(F.nullif("merchant", F.lit("")), F.lit("Unknown")).alias("merchant")).agg(F.sum(spent).alias("cents"), F.count("*").alias("visits"))
    categories = costs.groupBy(UPLOAD, F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorized")).alias("category")).agg(F.sum(spent).alias("cents"))
    categories = categories.withColumn("percent", half_up(F.col("cents") * 100 / F.sum("cents").over(Window.partitionBy(UPLOAD))))
    found = issues.groupBy(UPLOAD).agg(
        F.count_if(F.upper("severity") == "ERROR").alias("high"), F.count_if(F.upper("severity") == "WARNING").alias("medium"), F.count_if(~F.upper("severity").isin("ERROR", "WARNING")).alias("low"))
    charged = recurring.groupBy(UPLOAD).agg(F.count("*").alias("recurring_count"), F.sum("mean_cents").alias("recurring_cents"))
    alerted = alerts.groupBy(UPLOAD).agg(F.count("*").alias("alert_count"))
    out = totals.join(groups, UPLOAD, "left").join(found, UPLOAD, "left").join(charged, UPLOAD, "left").join(alerted, UPLOAD, "left")
    out = out.fillna(0, ["duplicate_groups", "high", "medium", "low", "recurring_count", "recurring_cents", "alert_count"])
    out = out.join(_ranked(recurring, "recurring", [F.desc("mean_cents"), F.col("merchant")], ["merchant", "mean_cents"]), UPLOAD, "left")
    out = out.join(_ranked(alerts, "alerts", [F.col("kind"), F.col("subject")], ["kind", "subject"]), UPLOAD, "left")
    out = out.join(_ranked(merchants, "merchants", [F.desc("cents"), F.col("merchant")], ["merchant", "cents", "visits"], most), UPLOAD, "left")
    return out.join(_ranked(categories, "categories", [F.desc("cents"), F.col("category")], ["category", "cents", "percent"]), UPLOAD, "left")


# The sentences of a scan's summary; {} stand for a count with its noun, or an amount.
SAID = {
    "first": "This statement contains {} with {} in income and {} in spending, resulting in {}.", "recurring": "{} were detected totaling an estimated {} per month.",
    "flags": "The scan flagged {} that may need your review.", "top": "Your top merchant by spending was {} at {}.", "grave": "There {} that could affect accuracy.",
}


def _said(name: str, *values: Column) -> Column:
    return f.filled(SAID[name], *values)


def narrative(report: DataFrame) -> DataFrame:
    """scan_report with a text that says it."""
    several = lambda c, one, many: F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, one).otherwise(many))
    net = F.concat(F.when(F.col("net_cents") >= 0, "a surplus of ").otherwise("a deficit of "), f.money(F.abs("net_cents")))
    top = F.get("merchants", F.lit(0))
    flags = F.concat_ws(
        " and ", F.when(F.col("duplicate_groups") > 0, several("duplicate_groups", " possible duplicate", " possible duplicates")), F.when(F.col("alert_count") > 0, several("alert_count", " anomaly", " anomalies")))
    grave = F.concat(F.when(F.col("high") == 1, "is ").otherwise("are "), several("high", " high-severity ingestion issue", " high-severity ingestion issues"))
    return report.withColumn("narrative", F.concat_ws(
        " ", _said("first", several("tx_count", " transaction", " transactions"), f.money(F.col("income_cents")), f.money(F.col("spending_cents")), net),
        F.when(F.col("recurring_count") > 0, _said("recurring", several("recurring_count", " recurring subscription", " recurring subscriptions"), f.money(F.col("recurring_cents")))),
        F.when(flags != "", _said("flags", flags)), F.when(top.isNotNull(), _said("top", top["merchant"], f.money(top["cents"]))), F.when(F.col("high") > 0, _said("grave", grave)),
    ))


def import_report(rows: DataFrame) -> DataFrame:
    """Normalised rows (upload_id, status, amount, bank_category, row_hash) of each upload: counts, the sum of what was taken, bank categories. A line that the
    upload has before is rejected, as are rows without a date."""
    order = Window.partitionBy(UPLOAD, "row_hash").orderBy("parse_order")
    seen = rows.withColumn("again", F.row_number().over(order) > 1).withColumn("taken", (F.col("status") != "REJECTED") & ~F.col("again"))
    taken = F.col("taken")
    given = taken & (F.coalesce("bank_category", F.lit("")) != "")
    return seen.groupBy(UPLOAD).agg(
        F.count("*").alias("parsed"), F.count_if(taken).alias("committed"), F.count_if(~taken).alias("rejected"), F.count_if(taken & (F.col("status") == "UNRESOLVED")).alias("pending_review"),
        F.sum(F.when(taken, F.coalesce("amount_cents", F.lit(0)))).alias("committed_cents"), F.count_if(given).alias("with_category"),
        F.array_join(F.sort_array(F.collect_set(F.when(given, F.col("bank_category")))), ",").alias("bank_categories"),
    )


def snapshot(staged: DataFrame) -> DataFrame:
    """A first look at each upload: its leading merchant, largest purchase, vendors that recur; rows that are excluded or transfers are left out."""
    active = staging.with_convention(staged.where(~F.coalesce("status", F.lit("")).isin("excluded", "transfer")))
    spent = active.where(F.when(F.col("expenses_are_negative"), F.col("amount_cents") < 0).otherwise(F.col("amount_cents") > 0)).withColumn("x", F.abs("amount_cents"))
    named = spent.where(F.trim(F.coalesce("vendor_key", F.lit(""))) != "").groupBy(UPLOAD, "vendor_key").agg(F.sum("x").alias("total"), F.min_by("vendor_raw", "parse_order").alias("name"))
    top = named.groupBy(UPLOAD).agg(F.min_by(F.struct("name", "total"), F.struct(-F.col("total"), F.col("vendor_key"))).alias("t")).select(UPLOAD, F.col("t.name").alias("top_merchant"), F.col("t.total").alias("top_cents"))
    largest = spent.groupBy(UPLOAD).agg(F.max("x").alias("largest_cents"))
    often = staging.recurring_vendors(active).groupBy(UPLOAD).agg(F.count("*").alias("recurring"))
    out = active.groupBy(UPLOAD).agg(F.count("*").alias("tx_count")).join(top, UPLOAD, "left").join(largest, UPLOAD, "left").join(often, UPLOAD, "left")
    return out.fillna(0, ["recurring", "largest_cents"]).withColumn("few_transactions", F.col("tx_count") < 10)


# Kinds of commitments in this order, and words of those who are paid.
COMMITMENTS = {
    "loan": r"\b(loan|mort|bankoh|bnkoh|credit union|financing|lender|finance|lendin|capita|fcu|hfcu)\b",
    "utility": r"\b(spectrum|verizon|at&t|att|tmobile|t-mobile|t mobile|comcast|cox|xfinity|electric|power|water|sewer|gas co|utility|internet|cable|wireless|cellular|centurylink|frontier|hawaiian tel|meco|helco|hawaiian electric)\b",
    "streaming": r"\b(netflix|hulu|youtube|disney|spotify|apple tv|amazon prime|peacock|paramount|max|hbo|sling|fubo|tidal|pandora|audible|prime video|appletv|crunchyroll|dazn)\b",
    "membership": r"\b(gym|fitness|planet fitness|car wash|wash|costco|sam.?s|membership|club|association|anytime|equinox|ymca|crossfit|amazon|apple|google one)\b",
    "insurance": r"\b(insurance|insur|geico|allstate|state farm|progressive|nationwide|usaa|aaa|travelers|liberty mutual|farmers|hartford)\b",
}
# Categories of commitments.
CATEGORY_COMMITMENTS = {"loan": "loan|mortgage", "utility": "utility|phone|internet|cable", "streaming": "entertainment|streaming", "membership": "membership|subscription", "insurance": "insurance"}


def commitment(name: Column, category: Column) -> Column:
    """The kind of a recurring payment: by who is paid, else by its category, else other."""
    key, low = f.recurring_key(name), F.lower(category)
    by_name = [F.when(key.rlike(p), k) for k, p in COMMITMENTS.items()]
    return F.coalesce(*by_name, *(F.when(low.rlike(p), k) for k, p in CATEGORY_COMMITMENTS.items()), F.lit("other"))


def in_order(categories: DataFrame, configured: list[str], saved: DataFrame) -> DataFrame:
    """categories (category_id, name, user_id) with place: by the user's saved order (user_id, category_id, position), others after them by the configured one."""
    names = F.array(*(F.lit(n) for n in configured))
    joined = categories.join(saved, ["user_id", "category_id"], "left")
    at = F.when(F.array_contains(names, F.col("name")), F.array_position(names, F.col("name")) - 1).otherwise(99)
    order = Window.partitionBy("user_id").orderBy(F.coalesce("position", F.lit(9999)), at, "category_id")
    return joined.withColumn("place", F.row_number().over(order)).drop("position")


def audit_json(fields: Column, steps: Column) -> Column:
    """A row's raw fields and the steps that changed it, as JSON."""
    return F.to_json(F.struct(fields.alias("fields"), steps.alias("transformations")))


def staging_view(scrubbed: DataFrame, kind: str, value: str | None = None) -> DataFrame:
    """The rows of a review that a filter shows: category, merchant_type, canonical_merchant (with a value), recurring, transfer, income, needs_review."""
    tests = {
        "category": F.col("category") == value, "merchant_type": F.col("merchant_type") == value, "canonical_merchant": F.col("canonical") == value, "recurring": F.col("is_recurring"),
        "transfer": F.col("is_transfer"), "income": F.col("is_income"), "needs_review": F.array_contains("review_flags", "needs_manual_review"),
    }
    return scrubbed.where(tests[kind])
