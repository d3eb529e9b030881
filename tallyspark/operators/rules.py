"""Categorization by rules that are data: matched against distinct texts or keys, never row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as f
from tallyspark.operators import dictionaries as d
from tallyspark.operators import word_lists as w
from tallyspark.operators.substrings import holding, with_words


def _met(texts: DataFrame, rules: DataFrame, scope: list[str]) -> DataFrame:
    """texts (scope, __text) with the rules (scope, match_type, match_value) that match them."""
    kind, low = F.col("match_type"), F.lower("__text")
    same = rules.where(kind == "exact").withColumn("__low", F.lower("match_value"))
    whole = texts.withColumn("__low", low).join(same, [*scope, "__low"]).drop("__low")
    part = with_words(rules.where(kind.isin("contains", "regex")), "match_value", kind == "regex")
    near = holding(texts.withColumn("text", low), part.select(*scope, "word").distinct(), scope, carried=["__text"]).join(part, [*scope, "word"])
    inside = (kind == "contains") | F.regexp_like(F.col("__text"), F.concat(F.lit("(?i)"), F.col("match_value")))
    return whole.unionByName(near.where(inside).drop("text", "word"))


def apply_ordered_rules(texts: DataFrame, rules: DataFrame, text_col: str = "description", user_col: str | None = None) -> DataFrame:
    """texts with category and rule_id of the first rule that matches; null if none does.

    rules: rule_id, match_type (exact, contains, regex), match_value, category, owner_rank
    (0: the user's own), priority (higher first). With user_col rules have owner_id too: a user's texts
    meet the user's own rules and those without an owner. Exact rules are joined by their text, the others by an
    index of their words; rules may be any number. All meet the distinct texts only. Null texts match nothing.
    """
    named = texts.where(F.col(text_col).isNotNull())
    kept = rules.select("rule_id", "match_type", "match_value", "category", "owner_rank", "priority", *(["owner_id"] if user_col else []))
    everyone = kept.where("owner_id IS NULL").drop("owner_id") if user_col else kept
    found = _met(named.select(F.col(text_col).alias("__text")).distinct(), everyone, [])
    best = F.min(F.struct("owner_rank", (-F.col("priority")).alias("order"), "rule_id", "category")).alias("__r")
    found = found.groupBy("__text").agg(best)
    if not user_col:
        joined = texts.join(found, F.col(text_col) == F.col("__text"), "left")
        first = F.col("__r")
    else:
        owned = kept.where("owner_id IS NOT NULL").withColumnRenamed("owner_id", "__user")
        mine = named.select(F.col(user_col).alias("__user"), F.col(text_col).alias("__text")).distinct()
        own = _met(mine, owned, ["__user"]).groupBy(F.col("__user").alias("__u"), F.col("__text").alias("__t")).agg(best.alias("__own"))
        joined = texts.join(found, F.col(text_col) == F.col("__text"), "left")
        joined = joined.join(own, (F.col(user_col) == F.col("__u")) & (F.col(text_col) == F.col("__t")), "left")
        first = F.least("__r", "__own")
    return joined.select(*[texts[c] for c in texts.columns], first["category"].alias("category"), first["rule_id"].alias("rule_id"))


def categorize(rows: DataFrame, rules: DataFrame, text_col: str = "description", amount_col: str = "amount_cents", keywords: DataFrame | None = None) -> DataFrame:
    """Rules first (confidence 1), then income for positive amounts (0.75), then keywords (0.85), else Other (0).

    keywords: rank, pattern, category; without them the staged rows' words are taken.
    """
    keywords = d.table_of(rows.sparkSession, w.rows(w.CATEGORY_KEYWORDS), "category string, sure string") if keywords is None else keywords
    found = apply_ordered_rules(rows, rules, text_col)
    found = d.first_match(found, F.col(text_col), keywords.withColumnRenamed("category", "keyword_category"), ["keyword_category"])
    paid, ruled, said = F.col(amount_col) > 0, F.col("rule_id").isNotNull(), F.col("keyword_category").isNotNull()
    return found.withColumns({
        "confidence": F.when(ruled, 1.0).when(paid, 0.75).when(said, 0.85).otherwise(0.0),
        "category": F.when(ruled, F.col("category")).when(paid, "Income").when(said, F.col("keyword_category")).otherwise("Other"),
    }).drop("keyword_category")


def weak_categories(ledger: DataFrame) -> DataFrame:
    """Rows to be categorized anew: not reviewed, and Other or given with a confidence below 0.6."""
    return ledger.where(~F.coalesce("reviewed", F.lit(False)) & ((F.col("category") == "Other") | (F.col("confidence") < 0.6)))


#: The system's rows are met in so many parts of the users.
PARTS = 64


def in_scope(dimension: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id of users, the dimension's columns): each user's own rows (owner_id) and the system's (owner_id null).

    Own rows are joined by their owner. Every user gets the system's: those are dealt to parts of the users, so
    that no task joins all users.
    """
    own = users.join(dimension, F.col("user_id") == F.col("owner_id"))
    system = dimension.where("owner_id IS NULL").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    given = users.withColumn("__part", F.pmod(F.hash("user_id"), F.lit(PARTS))).join(system, "__part").drop("__part")
    return own.unionByName(given.select(own.columns))


def _fits_amount(size: Column) -> Column:
    """Whether the rule's own test holds; rules of unknown types always do."""
    kind = F.col("match_type")
    return F.coalesce(
        F.when(kind == "vendor_exact_amount", F.col("amount_exact") == size).when(kind == "vendor_amount_range", size.between(F.col("amount_min"), F.col("amount_max")))
        .when(kind == "vendor_contains_text", (F.col("contains_text") != "") & F.contains(F.lower("description"), F.lower("contains_text")))
        .when(kind == "vendor_smart", (F.coalesce(F.size("learned"), F.lit(0)) <= 0) | F.array_contains("learned", size)).otherwise(True),
        F.lit(False),
    )


RULE = ["rule_id", "match_type", "priority", "category", "mode", "confidence", "amount_exact", "amount_min", "amount_max", "contains_text", "learned"]


def match_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(tx_id, status, rule_id, category, mode, confidence, reason) for each row (tx_id, user_id, account_id, vendor_key, amount_cents, description).

    rules: user_id, vendor_key, match_value, is_enabled, account_id (null: any), applies_to (debits, credits, both) and RULE. Of
    a vendor's rules the most specific counts, then the lowest priority; a next one as specific with another
    category is a conflict (needs_review). Only the first is then tested by amount or text: matched, or unmatched.
    """
    key = F.when(F.coalesce("vendor_key", F.lit("")) != "", F.col("vendor_key")).when(F.col("match_type") == "vendor_exact", F.col("match_value"))
    known = rules.where("is_enabled").select(F.col("user_id").alias("__u"), F.lower(key).alias("__key"), F.col("account_id").alias("__account"), "applies_to", *RULE)
    asked = rows.withColumn("__rule_key", f.rule_key(F.col("vendor_key")))
    way = F.when(F.col("applies_to") == "debits", F.col("amount_cents") < 0).when(F.col("applies_to") == "credits", F.col("amount_cents") > 0).otherwise(True)
    scope = F.col("__account").isNull() | (F.col("__account") == F.col("account_id"))
    found = asked.join(known, (F.col("user_id") == F.col("__u")) & (F.col("__rule_key") == F.col("__key"))).where(way & scope)
    found = found.withColumn("__score", f.rule_specificity(F.col("match_type")))
    # a transaction has few rules: two of its candidates are kept by an aggregate
    first = F.struct("__score", "priority", "rule_id", *[c for c in RULE if c not in ("priority", "rule_id")], _fits_amount(F.abs("amount_cents")).alias("fits"))
    two = found.groupBy("tx_id").agg(F.slice(F.sort_array(F.collect_list(first)), 1, 2).alias("r"))
    top, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    conflict = F.coalesce((top["__score"] == second["__score"]) & (top["category"] != second["category"]), F.lit(False))
    judged = two.select("tx_id", top.alias("t"), F.when(conflict, "needs_review").when(top["fits"], "matched").otherwise("unmatched").alias("status"))
    of = lambda c: F.when(F.col("status") == "matched", F.col(f"t.{c}")).alias(c)
    reason = F.when(F.col("status") == "matched", f.rule_reason(F.col("t.match_type"))).when(F.col("status") == "needs_review", "rule_conflict")
    judged = judged.select("tx_id", "status", of("rule_id"), of("category"), of("mode"), of("confidence"), reason.alias("reason"))
    return rows.select("tx_id").join(judged, "tx_id", "left").withColumn("status", F.coalesce("status", F.lit("unmatched")))


def dry_run(matched: DataFrame) -> DataFrame:
    """What a run of the rules would do with each row: auto for a rule that always applies with high confidence, else needs_review, or
    unmatched."""
    auto = (F.col("status") == "matched") & (F.col("mode") == "always") & (F.col("confidence") == "high")
    return matched.withColumn("outcome", F.when(F.coalesce(auto, F.lit(False)), "auto").when(F.col("status") == "unmatched", "unmatched").otherwise("needs_review"))


def apply_to_upload(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(tx_id, matches, outcome, rule_id, category) of rows (tx_id, user_id, account_id, vendor, amount_cents): one rule assigns (always) or asks, several
    conflict, none skips.

    rules: user_id, rule_id, match_type (vendor_exact, vendor_exact_amount, contains), value, account_id, amount_exact (signed), category, mode.
    Exact rules are joined by key; those by part, either way round, through indexes of each user's keys and values. Users may
    have any number of rules together.
    """
    keyed = rows.withColumn("__k", f.rule_key(F.col("vendor")))
    r = rules.select(F.col("user_id").alias("__u"), F.lower(F.trim("value")).alias("__v"), "rule_id", "match_type", F.col("account_id").alias("__a"), "amount_exact", "category", "mode")
    exact = keyed.join(r.where("match_type <> 'contains'"), (F.col("user_id") == F.col("__u")) & (F.col("__k") == F.col("__v"))).where(
        (F.col("match_type") == "vendor_exact") | (F.col("amount_exact") == F.col("amount_cents")))
    parts = r.where("match_type = 'contains'")
    keys, values = keyed.select("user_id", F.col("__k").alias("x")).distinct(), parts.select(F.col("__u").alias("user_id"), F.col("__v").alias("x")).distinct()
    pairs = [
        holding(a.withColumnRenamed("x", "text"), b.withColumnRenamed("x", "word"), ["user_id"], few).select(F.col("user_id").alias("__of"), F.col(k).alias("__key"), F.col(v).alias("__value"))
        for a, b, k, v, few in ((keys, values, "text", "word", True), (values, keys, "word", "text", False))
    ]
    part = pairs[0].unionByName(pairs[1]).distinct().join(parts, (F.col("__of") == F.col("__u")) & (F.col("__value") == F.col("__v"))).drop("__u", "__value")
    inside = keyed.join(part, (F.col("user_id") == F.col("__of")) & (F.col("__k") == F.col("__key"))).drop("__of", "__key")
    both = exact.drop("__u").unionByName(inside).where(F.col("__a").isNull() | (F.col("__a") == F.col("account_id")))
    by = both.groupBy("tx_id").agg(F.count("*").alias("matches"), F.min(F.struct("rule_id", "category", "mode")).alias("r"))
    one = F.col("matches") == 1
    outcome = F.when(~one, "conflict").when(F.col("r.mode") == "always", "assigned").when(F.col("r.mode") == "ask", "review").otherwise("skipped")
    by = by.select("tx_id", "matches", outcome.alias("outcome"), F.when(one, F.col("r.rule_id")).alias("rule_id"), F.when(one & (F.col("r.mode") == "always"), F.col("r.category")).alias("category"))
    return rows.select("tx_id").join(by, "tx_id", "left").withColumns({"matches": F.coalesce("matches", F.lit(0)), "outcome": F.coalesce("outcome", F.lit("skipped"))})


def preview(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """For each rule (rule_id, user_id, vendor_key, amount_exact, learned) how many rows it would meet: all of the vendor, those of its exact
    amount, those of learned amounts."""
    r = rules.select("rule_id", F.col("user_id").alias("__u"), F.lower("vendor_key").alias("__v"), "amount_exact", "learned")
    met = r.join(rows.withColumn("__k", f.rule_key(F.col("vendor"))), (F.col("user_id") == F.col("__u")) & (F.col("__k") == F.col("__v")), "left")
    size = F.abs("amount_cents")
    return met.groupBy("rule_id").agg(F.count("tx_id").alias("vendor_count"), F.count_if(size == F.col("amount_exact")).alias("exact_count"), F.count_if(F.array_contains("learned", size)).alias("smart_count"))


def apply_vendor_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (tx_id, account_id, vendor_key, amount_cents) that match rules of one category only.

    rules: rule_id, match_type (vendor_exact, vendor_exact_amount, vendor_smart), vendor_key,
    account_id (null: any), amount_cents, learned (amounts without sign; empty: any), category, mode.
    Returns tx_id, outcome (assigned, review, conflict), category (null at a conflict).
    """
    r = rules.select("rule_id", "match_type", F.col("vendor_key").alias("rk"), F.col("account_id").alias("ra"), F.col("amount_cents").alias("rc"), "learned", "category", "mode")
    fits = (
        F.when(F.col("match_type") == "vendor_exact", F.lit(True))
        .when(F.col("match_type") == "vendor_exact_amount", F.col("amount_cents") == F.col("rc"))
        .when(F.col("match_type") == "vendor_smart", (F.coalesce(F.size("learned"), F.lit(0)) <= 0) | F.array_contains("learned", F.abs("amount_cents")))
    )
    joined = rows.join(r, F.col("vendor_key") == F.col("rk")).where(fits & (F.col("ra").isNull() | (F.col("ra") == F.col("account_id"))))
    by = joined.groupBy("tx_id").agg(F.countDistinct("category").alias("n"), F.min("category").alias("one"), F.bool_and(F.col("mode") == "always").alias("always"))
    outcome = F.when(F.col("n") > 1, "conflict").when(F.col("always"), "assigned").otherwise("review")
    return by.select("tx_id", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("one")).alias("category"))
