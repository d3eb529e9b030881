"""Ordered dictionaries: tables of patterns, of any size, whose first match gives a value; met by distinct texts only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as f
from tallyspark.operators import word_lists as w
from tallyspark.operators.substrings import holding, with_words


def first_match(rows: DataFrame, text: Column, dictionary: DataFrame, values: list[str], regex: bool = False) -> DataFrame:
    """rows with the values of the first pattern, by rank, that the text holds in any case; null if it holds none, or is null.

    dictionary: rank, pattern, values; of any size. Patterns are expressions if regex, else parts of the text. Distinct
    texts meet the words of the patterns through an index; an expression without a sure word is tried on every distinct text.
    """
    keyed = rows.withColumn("__key", F.lower(text))
    asked = dictionary.select(F.col("rank").alias("__rank"), F.col("pattern").alias("__pattern"), *(F.col(v).alias(f"__{v}") for v in values))
    asked = with_words(asked, "__pattern", F.lit(regex))
    texts = keyed.select(F.col("__key").alias("text")).where("text IS NOT NULL").distinct()
    met = holding(texts, asked.select("word").distinct()).join(asked, "word")
    if regex:
        met = met.where(F.regexp_like(F.col("text"), F.concat(F.lit("(?i)"), F.col("__pattern"))))
    found = met.groupBy(F.col("text").alias("__of")).agg(F.min_by(F.struct(*(F.col(f"__{v}").alias(v) for v in values)), "__rank").alias("__v"))
    joined = keyed.join(found, F.col("__key") == F.col("__of"), "left")
    return joined.select(*(keyed[c] for c in rows.columns if c not in values), *(F.col(f"__v.{v}").alias(v) for v in values))


def table_of(spark: SparkSession, rows: list[tuple], values: str) -> DataFrame:
    """(pattern, *values) in order as a dictionary."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"rank int, pattern string, {values}")


# Some of the banks' own category names; a longer list is given as a table.
BANK_CATEGORIES = {
    "groceries": "Groceries", "food and drink": "Food & Dining", "restaurants": "Food & Dining", "gas": "Transport", "travel": "Travel",
    "health and wellness": "Health", "bills and utilities": "Utilities", "merchandise": "Shopping", "entertainment": "Entertainment", "fees and adjustments": "Fees & Charges",
    "automotive": "Transport", "education": "Education", "transfers": "Transfer", "other": "Other", "personal": "Other",
}
# The trait of the first category that is a matter of choice.
TRAITS = {
    "FOOD": "margin_eater", "GROCERY": "cash_casserole", "FAST_FOOD": "drive_thru_cfo", "ALCOHOL": "dollar_shots", "COFFEE": "daily_grind", "ENTERTAINMENT": "never_home",
    "SHOPPING": "delivery_doorstep", "HEALTH": "wellness_bill", "DIGITAL": "free_trial_life", "PERSONAL_CARE": "glowing_broke", "EDUCATION": "degree_debt", "TRAVEL": "mail_goes_home",
    "PETS": "corner_office", "TOBACCO": "burn_rate", "SOCIAL": "heaven_sent", "TRANSPORT": "currency_combustion", "BUSINESS": "grind_setter", "LIFESTYLE": "corner_office",
}
# Names of categories that say nothing.
NOISY_CATEGORIES = ["other", "uncategorized", "miscellaneous", "misc", "general", "transfer", "income", "unknown"]
# What payment services and banks put before a merchant's name.
AGGREGATORS = (
    r"(?i)^(paypal\s*\*|sq\s*\*|tst\s*\*|ach\s+(credit|debit)\s+|pos\s+(debit|purchase)\s+|visa\s+purchase\s+|checkcard\s+|debit\s+card\s+"
    r"|zelle\s+(payment\s+to|payment\s+from|to|from)\s+|venmo\s+payment\s+)"
)


def bank_category_key(raw: Column) -> Column:
    """Lower case, & as and, other signs as spaces."""
    return f.squeeze(F.regexp_replace(F.replace(F.lower(raw), F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s]", " "))


def map_bank_category(rows: DataFrame, raw: Column, exact: DataFrame | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """rows with bank_mapped: the category of a bank's category name, by its whole key, else by the first keyword in it, else null."""
    spark = rows.sparkSession
    exact = spark.createDataFrame(list(BANK_CATEGORIES.items()), "key string, category string") if exact is None else exact
    keywords = table_of(spark, w.rows(w.BANK_KEYWORDS), "category string") if keywords is None else keywords
    keyed = rows.drop("bank_mapped").withColumn("__bank_key", bank_category_key(raw))
    whole = exact.select(F.col("key").alias("__k"), F.col("category").alias("__whole"))
    found = first_match(keyed, F.col("__bank_key"), keywords.withColumnRenamed("category", "__part"), ["__part"])
    found = found.join(whole, F.col("__bank_key") == F.col("__k"), "left")
    return found.withColumn("bank_mapped", F.coalesce("__whole", "__part")).drop("__bank_key", "__k", "__whole", "__part")


def master_category(rows: DataFrame, name: Column, masters: DataFrame | None = None) -> DataFrame:
    """rows with master: the master key of a category's name; names that say nothing have none."""
    masters = table_of(rows.sparkSession, w.rows(w.MASTERS), "master string") if masters is None else masters
    low = f.squeeze(F.lower(name))
    return first_match(rows, F.when(~low.isin(NOISY_CATEGORIES), low), masters, ["master"])


def category_styles(rows: DataFrame, name: Column, styles: DataFrame | None = None) -> DataFrame:
    """rows with is_income, color, icon and master of a display category's name, as it is written; other names have the plain ones.

    styles: category, is_income, color, icon, master; without repeats, of any size. One join on the name.
    """
    fields = "category string, is_income boolean, color string, icon string, master string"
    styles = rows.sparkSession.createDataFrame(w.CATEGORY_STYLES, fields) if styles is None else styles
    new = ["is_income", "color", "icon", "master"]
    known = styles.select(F.col("category").alias("__name"), F.struct(*new).alias("__style"))
    plain = F.struct(*(F.lit(v).cast("boolean" if n == "is_income" else "string").alias(n) for n, v in zip(new, w.PLAIN_STYLE, strict=True)))
    joined = rows.drop(*new).withColumn("__of", name).join(known, F.col("__of") == F.col("__name"), "left")
    return joined.withColumn("__style", F.coalesce("__style", plain)).select(*(c for c in rows.columns if c not in new), *(F.col(f"__style.{n}").alias(n) for n in new))


def canonical_merchant(rows: DataFrame, raw: Column, canonical: DataFrame | None = None) -> DataFrame:
    """rows with canonical, merchant_type, merchant_confidence and has_aggregator.

    A payment service's prefix goes first. The first expression that matches names the merchant (high); else it is
    the display name, of unknown type (low).
    """
    canonical = table_of(rows.sparkSession, w.CANONICAL, "canonical string, merchant_type string") if canonical is None else canonical
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(text, AGGREGATORS, ""), r"^\s+|\s+$", "")
    named = rows.withColumns({"has_aggregator": F.coalesce(text.rlike(AGGREGATORS), F.lit(False)), "__bare": F.when(bare != "", bare).otherwise(text)})
    found = first_match(named, F.col("__bare"), canonical, ["canonical", "merchant_type"], regex=True)
    return found.withColumns({
        "merchant_confidence": F.when(F.col("canonical").isNotNull(), "high").otherwise("low"), "canonical": F.coalesce("canonical", f.normalize_merchant(F.col("__bare"))),
        "merchant_type": F.coalesce("merchant_type", F.lit("unknown")),
    }).drop("__bare")


def traits(categories: DataFrame, masters: DataFrame | None = None) -> DataFrame:
    """(user_id, year, month, trait): that of the largest category of a month (category, spending_cents) whose master is neither HOME nor FINANCIAL."""
    free = master_category(categories.where("spending_cents > 0"), F.col("category"), masters).where("master IS NOT NULL AND master NOT IN ('HOME', 'FINANCIAL')")
    named = F.create_map(*(F.lit(x) for pair in TRAITS.items() for x in pair))
    top = free.groupBy("user_id", "year", "month").agg(F.min_by("master", F.struct(-F.col("spending_cents"), F.col("category"))).alias("master"))
    return top.select("user_id", "year", "month", F.try_element_at(named, F.col("master")).alias("trait"))
