"""Staging: uploads are scrubbed before they join the ledger; for all uploads at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators import dictionaries as d
from tallyspark.operators import word_lists as w
from tallyspark.operators.checks import is_transfer_description

UPLOAD = "upload_id"


def with_convention(rows: DataFrame) -> DataFrame:
    """rows with expenses_are_negative: more than half of the upload's amounts other than 0 are."""
    votes = rows.groupBy(UPLOAD).agg((F.count_if(F.col("amount_cents") < 0) * 2 > F.count_if(F.col("amount_cents") != 0)).alias("expenses_are_negative"))
    return rows.join(votes, UPLOAD)


def repeated(rows: DataFrame) -> DataFrame:
    """rows with is_duplicate: the upload has an earlier row of the same day, vendor and amount."""
    same = Window.partitionBy(UPLOAD, "tx_date", "vendor_key", "amount_cents").orderBy("parse_order")
    return rows.withColumn("is_duplicate", F.row_number().over(same) > 1)


def recurring_vendors(rows: DataFrame) -> DataFrame:
    """(upload_id, vendor_key) of vendors with two expenses or more, all within a tenth of the first."""
    spent = rows.where((F.trim(F.coalesce("vendor_key", F.lit(""))) != "") & F.when(F.col("expenses_are_negative"), F.col("amount_cents") < 0).otherwise(F.col("amount_cents") > 0))
    by = spent.groupBy(UPLOAD, "vendor_key").agg(
        F.count("*").alias("n"), F.min_by(F.abs("amount_cents"), "parse_order").alias("first"), F.min(F.abs("amount_cents")).alias("low"), F.max(F.abs("amount_cents")).alias("high")
    )
    near = (F.col("first") - F.col("low") <= F.col("first") * 0.1) & (F.col("high") - F.col("first") <= F.col("first") * 0.1)
    return by.where((F.col("n") >= 2) & near).select(UPLOAD, "vendor_key")


def suggestions(rows: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """rows (vendor_raw, bank_category, amount_cents, expenses_are_negative) with category, confidence, category_source.

    A transfer's words first, then the bank's category (medium if Other), then keywords, then income
    for money that comes in (low); else Uncategorized.
    """
    keywords = d.table_of(rows.sparkSession, w.rows(w.CATEGORY_KEYWORDS), "keyword_category string, keyword_confidence string") if keywords is None else keywords
    found = d.map_bank_category(d.first_match(rows, F.col("vendor_raw"), keywords, ["keyword_category", "keyword_confidence"]), F.col("bank_category"))
    comes_in = F.when(F.col("expenses_are_negative"), F.col("amount_cents") > 0).otherwise(F.col("amount_cents") <= 0)
    transfer, bank, word = is_transfer_description(F.col("vendor_raw")), F.col("bank_mapped").isNotNull(), F.col("keyword_category").isNotNull()
    pick = lambda a, b, c, e, g: F.when(transfer, a).when(bank, b).when(word, c).when(comes_in, e).otherwise(g)
    return found.withColumns({
        "category": pick(F.lit("Transfer"), F.col("bank_mapped"), F.col("keyword_category"), F.lit("Income"), F.lit("Uncategorized")),
        "confidence": pick(F.lit("high"), F.when(F.col("bank_mapped") == "Other", "medium").otherwise("high"), F.col("keyword_confidence"), F.lit("low"), F.lit("low")),
        "category_source": F.when(~transfer & bank, "bank").otherwise("engine"),
    }).drop("keyword_category", "keyword_confidence", "bank_mapped")


def scrub(rows: DataFrame, keywords: DataFrame | None = None, canonical: DataFrame | None = None) -> DataFrame:
    """Staged rows that are not excluded (upload_id, tx_id, tx_date, vendor_raw, vendor_key, amount_cents, bank_category, status, parse_order) with
    what the review shows: merchant, category, flags."""
    active = with_convention(rows.where(F.coalesce("status", F.lit("")) != "excluded"))
    often = recurring_vendors(active).withColumn("is_recurring", F.lit(True))
    seen = d.canonical_merchant(suggestions(repeated(active), keywords), F.col("vendor_raw"), canonical).join(often, [UPLOAD, "vendor_key"], "left")
    seen = seen.withColumns({
        "is_recurring": F.coalesce("is_recurring", F.lit(False)), "is_transfer": (F.col("category") == "Transfer") | (F.col("merchant_type") == "transfer"),
        "is_income": (F.col("category") == "Income") | (F.col("merchant_type") == "income"),
    })
    return seen.withColumn("review_flags", F.array_compact(F.array(
        F.when(F.col("has_aggregator"), "aggregator_prefix"), F.when(F.col("merchant_type") == "unknown", "unclear_merchant"), F.when(F.col("is_transfer"), "possible_transfer"),
        F.when(F.col("is_income"), "possible_income"), F.when((F.col("confidence") == "low") & ~F.col("is_transfer") & ~F.col("is_income"), "needs_manual_review"),
    )))


def summary(scrubbed: DataFrame, top: int = 6) -> DataFrame:
    """One row an upload: counts, recurring vendors, and its most frequent categories as category:count."""
    counted = scrubbed.groupBy(UPLOAD, "category").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(UPLOAD).orderBy(F.desc("n"), "category"))
    best = counted.withColumn("k", rank).where(F.col("k") <= top).groupBy(UPLOAD).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.concat_ws(":", "category", "n").alias("c")))), lambda x: x["c"]), ",").alias("top_categories")
    )
    sums = scrubbed.groupBy(UPLOAD).agg(
        F.count("*").alias("tx_count"), F.count_if("is_transfer").alias("transfers"), F.count_if("is_income").alias("incomes"), F.count_if(F.col("confidence") == "low").alias("needs_review"),
        F.count_if("is_duplicate").alias("duplicates"), F.countDistinct(F.when(F.col("is_recurring"), F.col("vendor_key"))).alias("recurring_vendors"),
    )
    return sums.join(best, UPLOAD)


def status_counts(rows: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy(UPLOAD).agg(F.count("*").alias("total"), one("uncategorized"), one("categorized"), one("excluded"))


def category_amounts(scrubbed: DataFrame) -> DataFrame:
    """Amounts without sign for each suggested category of an upload."""
    return scrubbed.groupBy(UPLOAD, "category").agg(F.sum(F.abs("amount_cents")).alias("total_cents"), F.count("*").alias("tx_count"))


def top_merchants(scrubbed: DataFrame, top: int = 5) -> DataFrame:
    counted = scrubbed.groupBy(UPLOAD, "canonical").agg(F.count("*").alias("tx_count"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(UPLOAD).orderBy(F.desc("tx_count"), "canonical"))).where(F.col("rank") <= top)


def committed(ledger: DataFrame, staged: DataFrame) -> DataFrame:
    """The ledger after a commit: staged rows (tx_id, status, category) exclude theirs or give them their category, as reviewed.

    Other rows stay as they are. Staged rows repeat no tx_id.
    """
    edits = staged.select(F.col("tx_id").alias("__t"), F.col("status").alias("__s"), F.col("category").alias("__c"))
    joined = ledger.join(edits, F.col("tx_id") == F.col("__t"), "left")
    given = F.coalesce(F.col("__s") == "categorized", F.lit(False))
    return joined.withColumns({
        "is_excluded": F.when(F.col("__s") == "excluded", True).otherwise(F.col("is_excluded")), "app_category": F.when(given, F.col("__c")).otherwise(F.col("app_category")),
        "reviewed": given, "is_transfer": F.when(given, F.col("__c") == "Transfer").otherwise(F.col("is_transfer")),
    }).drop("__t", "__s", "__c")


def apply_to_all(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """The ledger with edits (user_id, merchant, amount_cents, category) on all rows of the same merchant and amount; the last edit by
    edit_id counts."""
    last = edits.groupBy("user_id", "merchant", "amount_cents").agg(F.max_by("category", "edit_id").alias("__c"))
    out = ledger.join(last, ["user_id", "merchant", "amount_cents"], "left")
    return out.withColumns({"app_category": F.coalesce("__c", "app_category"), "edited": F.col("__c").isNotNull()}).drop("__c")


def removed_category(ledger: DataFrame, gone: Column, instead: str = "Other") -> DataFrame:
    """Rows of a category that is deleted fall to another."""
    return ledger.withColumn("app_category", F.when(gone, instead).otherwise(F.col("app_category")))
