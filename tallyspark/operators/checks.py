"""Integrity of a ledger: duplicates, balance chains, date order, transfers, anomalies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.scans import last_before, span_of


def duplicate_flags(rows: DataFrame, keys: list[str] = ["bank_id", "fingerprint"]) -> DataFrame:  # noqa: B006
    """rows (tx_id, account_id, upload_id, bank_id, fingerprint) with within_upload, cross_upload, confidence, duplicate_of.

    Pass A goes by the bank's id (confidence 1.0), pass B by the fingerprint (0.9) among rows that A
    did not flag. Empty and null keys match nothing, and their rows are dealt by tx_id, so they fill no
    one task. duplicate_of: the group's smallest tx_id.
    """
    out = rows.withColumns({
        "within_upload": F.lit(False), "cross_upload": F.lit(False), "duplicate_of": F.lit(None).cast(rows.schema["tx_id"].dataType), "confidence": F.lit(None).cast("double"),
    })
    for key, sure in zip(keys, (1.0, 0.9), strict=False):
        usable = (F.coalesce(F.col(key), F.lit("")) != "") & F.col("confidence").isNull()
        group = [F.col("account_id"), F.when(usable, F.col(key)), F.when(~usable, F.col("tx_id"))]
        within = F.count("*").over(Window.partitionBy(*group, "upload_id"))
        account = Window.partitionBy(*group)
        seen = out.withColumns({"__usable": usable, "__within": within}).withColumns({"__total": F.count("*").over(account), "__first": F.min("tx_id").over(account)})
        hit = F.col("__usable") & (F.col("__total") > 1)
        out = seen.withColumns({
            "within_upload": F.col("within_upload") | (F.col("__usable") & (F.col("__within") > 1)),
            "cross_upload": F.col("cross_upload") | (F.col("__usable") & (F.col("__total") > F.col("__within"))),
            "duplicate_of": F.coalesce("duplicate_of", F.when(hit, F.col("__first"))), "confidence": F.coalesce("confidence", F.when(hit, F.lit(sure))),
        }).drop("__usable", "__within", "__total", "__first")
    return out


def chain_after(rows: DataFrame, by: list[str], order: list[str], opening: str | None = None, span: Column | None = None) -> DataFrame:
    """Balance chain where a balance follows its row: expected = last known balance before + amount; the first has none.

    Rows without a balance have no expected_cents, and is_valid is null where nothing is expected. The actual balance always
    carries on. An account is worked in spans (months, unless told otherwise), so it may be of any length.
    """
    known = last_before(rows, by, order, {"__known": F.col("balance_cents")}, span_of(rows, order) if span is None else span)
    carried = F.coalesce("__known", opening) if opening else F.col("__known")
    return _expected(known, carried + F.col("amount_cents")).drop("__known")


def chain_before(rows: DataFrame, by: list[str], order: list[str], span: Column | None = None) -> DataFrame:
    """Balance chain where a balance stands before its row: expected = last known balance + the previous row's amount, which may have no balance."""
    values = {"__known": F.col("balance_cents"), "__prior": F.struct("amount_cents")}
    known = last_before(rows, by, order, values, span_of(rows, order) if span is None else span)
    return _expected(known, F.col("__known") + F.col("__prior.amount_cents")).drop("__known", "__prior")


def _expected(rows: DataFrame, expected: Column) -> DataFrame:
    expected = F.when(F.col("balance_cents").isNotNull(), expected)
    return rows.withColumns({"expected_cents": expected, "is_valid": F.col("balance_cents") == expected})


def chain_by_model(rows: DataFrame, by: list[str], order: list[str], opening: str | None = None, span: Column | None = None) -> DataFrame:
    """Rows (with model) as each file's own model chains them, in one pass. An opening balance counts for AFTER only: before a row the first
    balance is an anchor anyway."""
    values = {"__known": F.col("balance_cents"), "__prior": F.struct("amount_cents")}
    known = last_before(rows, by, order, values, span_of(rows, order) if span is None else span)
    after = (F.coalesce("__known", opening) if opening else F.col("__known")) + F.col("amount_cents")
    chosen = F.when(F.col("model") == "BEFORE", F.col("__known") + F.col("__prior.amount_cents")).otherwise(after)
    return _expected(known, chosen).drop("__known", "__prior")


def rechained_after(old: DataFrame, now: DataFrame, by: list[str], order: list[str], key: list[str], span: Column | None = None) -> DataFrame:
    """The chain of ``now`` from that of ``old``, whose rows (by key) have changed in places, such as by a choice of dates.

    Of each account what stands in spans before its first change stays as it was; the rest is chained anew, from the last balance
    before. old: a result of chain_after; now: all rows, without expected_cents and is_valid.
    """
    at = span_of(now, order) if span is None else span
    columns = now.columns
    side = lambda df, n: df.select(*by, *key, at.alias("__span"), F.lit(n).alias("__side"), F.struct(*(c for c in columns if c not in by + key)).alias("__row"))
    both = side(old.select(columns), 0).unionByName(side(now, 1)).groupBy(*by, *key).agg(F.min("__span").alias("__low"), F.count_if(F.col("__span").isNull()).alias("__none"), F.collect_set("__row").alias("__rows"), F.count("*").alias("__n"))
    # a row that is in both alike is one value twice; any other is a change
    changed = both.where((F.size("__rows") != 1) | (F.col("__n") != 2)).groupBy(*by).agg(F.min("__low").alias("__from"), F.max(F.col("__none") > 0).alias("__all"))
    first = changed.select(*(F.col(c).alias(f"__by_{c}") for c in by), "__from", "__all")
    meets = lambda df: df.withColumn("__span", at).join(first, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by)), "left")
    stays = F.col("__all").isNull() | (~F.col("__all") & F.coalesce(F.col("__span") < F.col("__from"), F.lit(True)))
    before, after = meets(old).where(stays), meets(now).where(~stays)
    last = before.where(F.col("__from").isNotNull() & F.col("balance_cents").isNotNull()).groupBy(*by).agg(F.max(F.struct(*order, "balance_cents"))["balance_cents"].alias("__opening"))
    names = last.select(*(F.col(c).alias(f"__of_{c}") for c in by), "__opening")
    opened = after.select(*columns).join(names, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by)), "left").select(*columns, "__opening")
    again = chain_after(opened, by, order, "__opening", span).drop("__opening")
    return before.select(*again.columns).unionByName(again)


def with_parse_order(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """rows with the parse_order of their raw rows (raw_id, parse_order); 0 where there is none."""
    return rows.join(raw.select("raw_id", "parse_order"), "raw_id", "left").withColumn("parse_order", F.coalesce("parse_order", F.lit(0)))


def export_direction(rows: DataFrame, by: list[str]) -> DataFrame:
    """ascending or descending: whether the first row of a file, in the order it was read, is older than the last. Equal or missing dates: ascending."""
    ends = rows.groupBy(*by).agg(F.min_by("tx_date", "parse_order").alias("first"), F.max_by("tx_date", "parse_order").alias("last"))
    return ends.select(*by, F.when(F.col("first") > F.col("last"), "descending").otherwise("ascending").alias("direction"))


def chronological(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with place, from 0: by the transaction's date, the posted date, the reference and the order read, which goes backwards in files that list the
    newest first. Missing values come first."""
    directed = rows.join(export_direction(rows, by), by)
    read = F.when(F.col("direction") == "descending", -F.col("parse_order")).otherwise(F.col("parse_order"))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    order = Window.partitionBy(*by).orderBy(empty("tx_date"), empty("posted_date"), empty("reference"), read)
    return directed.withColumn("place", F.row_number().over(order) - 1)


def reordered(placed: DataFrame, by: list[str]) -> DataFrame:
    """How many rows of each file do not stand where they were read."""
    read = F.row_number().over(Window.partitionBy(*by).orderBy("parse_order")) - 1
    return placed.withColumn("__read", read).groupBy(*by).agg(F.count_if(F.col("__read") != F.col("place")).alias("rows_reordered"), F.first("direction").alias("direction"))


def reconcile_totals(sums: DataFrame) -> DataFrame:
    """sums (credit_cents, debit_cents, net_cents, unresolved) of files with their statements' totals (total_credits, total_debits, opening, closing) and what of
    them agrees to the cent.

    Totals need both credits and debits, or both balances: without them a file is UNVERIFIABLE here. status: PASS, PASS_WITH_WARNINGS with unresolved
    rows, or FAIL. Debits are negative; a statement's debits come without sign.
    """
    both, ends = F.col("total_credits").isNotNull() & F.col("total_debits").isNotNull(), F.col("opening").isNotNull() & F.col("closing").isNotNull()
    checks = [F.when(both, F.col("credit_cents") == F.col("total_credits")), F.when(both, F.col("debit_cents") == -F.abs("total_debits")), F.when(ends, F.col("opening") + F.col("net_cents") == F.col("closing"))]
    good = F.forall(F.array_compact(F.array(*checks)), lambda x: x)
    discrepancy = F.when(ends, F.col("closing") - F.col("opening") - F.col("net_cents"))
    return sums.withColumns({
        "discrepancy_cents": discrepancy,
        "status": F.when(~(both | ends), "UNVERIFIABLE").when(~good, "FAIL").when(F.col("unresolved") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"),
    })


def balance_model(rows: DataFrame, by: list[str], order: list[str], pairs: int = 20) -> DataFrame:
    """One row for each file: AFTER or BEFORE by the mismatches of its first neighbouring rows with balances; AFTER, to be reviewed, on a tie or
    under two pairs. A winner with more than three mismatches in ten is to be reviewed too. Only a file's first rows are ordered in one task."""
    at = Window.partitionBy(*by).orderBy(*order)
    head = rows.where("balance_cents IS NOT NULL").withColumn("__k", F.row_number().over(at)).where(F.col("__k") <= pairs + 1)
    delta, prior = F.col("balance_cents") - F.lag("balance_cents").over(at), F.lag("amount_cents").over(at)
    seen = head.withColumns({"__delta": delta, "__prior": prior}).where("__k > 1")
    votes = seen.groupBy(*by).agg(
        F.count_if(F.col("__delta") == F.col("amount_cents")).alias("after_votes"), F.count_if(F.col("__delta") == F.col("__prior")).alias("before_votes"), F.count("*").alias("pairs"),
    )
    files = rows.select(*by).distinct()
    names = votes.select(*(F.col(c).alias(f"__by_{c}") for c in by), "after_votes", "before_votes", "pairs")
    every = files.join(names, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by)), "left").select(*by, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("after_votes", "before_votes", "pairs")))
    enough, tie = F.col("pairs") >= 2, F.col("after_votes") == F.col("before_votes")
    missed = F.col("pairs") - F.greatest("after_votes", "before_votes")
    return every.select(
        *by, "after_votes", "before_votes", "pairs", F.when(enough & (F.col("before_votes") > F.col("after_votes")), "BEFORE").otherwise("AFTER").alias("model"),
        (~enough | tie | (missed > F.col("pairs") * F.lit(0.3))).alias("needs_review"),
    )


def reconcile(rows: DataFrame, totals: DataFrame, by: list[str], order: list[str], span: Column | None = None) -> DataFrame:
    """One row for each file of rows (amount_cents, balance_cents, is_unresolved), checked against what its statement says.

    totals: total_credits, total_debits (without sign), opening, closing; all may be null, and a file may be missing. mode: STATEMENT_TOTALS if
    both totals or both balances are there, else RUNNING_BALANCE with two balances or more in the rows, else UNVERIFIABLE. The chain follows
    the file's own model. status: FAIL if anything does not agree to the cent, else PASS, or PASS_WITH_WARNINGS with unresolved rows.
    checks: how many were made, failed: how many of them did not agree. constant_offset: four breaks in five are off by
    what the first one is; break_percent: breaks of all rows, to a tenth.
    """
    says = totals.select(*(F.col(c).alias(f"__by_{c}") for c in by), "total_credits", "total_debits", "opening", "closing")
    same = lambda prefix: reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by))
    models = balance_model(rows, by, order).select(*(F.col(c).alias(f"__of_{c}") for c in by), "model", "needs_review")
    opened = rows.join(models, same("__of_")).join(says.select(*(f"__by_{c}" for c in by), "opening"), same("__by_"), "left").drop(*(f"__by_{c}" for c in by), *(f"__of_{c}" for c in by))
    chained = chain_by_model(opened, by, order, "opening", span)
    delta = F.when(~F.col("is_valid"), F.col("balance_cents") - F.col("expected_cents"))
    plus, minus = F.when(F.col("amount_cents") > 0, F.col("amount_cents")).otherwise(0), F.when(F.col("amount_cents") < 0, F.col("amount_cents")).otherwise(0)
    # breaks by how far they are off: a file has few such values, or else many that are no common one
    parts = chained.groupBy(*by, delta.alias("__delta")).agg(
        F.count("*").alias("n"), F.sum(plus).alias("plus"), F.sum(minus).alias("minus"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("breaks"), F.min(F.when(~F.col("is_valid"), F.struct(*order))).alias("__at"), F.count("balance_cents").alias("balances"), F.count_if("is_unresolved").alias("unresolved"),
        F.first("model").alias("model"), F.first("needs_review").alias("needs_review"),
    )
    sums = parts.groupBy(*by).agg(
        F.sum("n").alias("tx_count"), F.sum("plus").alias("credit_cents"), F.sum("minus").alias("debit_cents"), F.sum("valid").alias("valid"), F.sum("breaks").alias("breaks"),
        F.coalesce(F.min(F.when(F.col("__delta").isNotNull(), F.struct("__at", "__delta", "breaks")))["breaks"], F.lit(0)).alias("same_offset"), F.sum("balances").alias("balances"),
        F.sum("unresolved").alias("unresolved"), F.first("model").alias("model"), F.first("needs_review").alias("needs_review"),
    )
    known = sums.join(says, same("__by_"), "left")
    both, ends = F.col("total_credits").isNotNull() & F.col("total_debits").isNotNull(), F.col("opening").isNotNull() & F.col("closing").isNotNull()
    mode = F.when(both | ends, "STATEMENT_TOTALS").when(F.col("balances") >= 2, "RUNNING_BALANCE").otherwise("UNVERIFIABLE")
    chain = F.col("mode") == "RUNNING_BALANCE"
    agree = F.array_compact(F.array(
        F.when(both, F.col("credit_cents") == F.col("total_credits")), F.when(both, F.col("debit_cents") == -F.abs("total_debits")),
        F.when(ends, F.col("credit_cents") + F.col("debit_cents") == F.col("closing") - F.col("opening")), F.when(chain, F.col("breaks") == 0),
    ))
    checked = known.withColumn("mode", mode).withColumn("__agree", agree)
    failed = F.size(F.filter("__agree", lambda x: ~x))
    status = F.when(F.col("mode") == "UNVERIFIABLE", "UNVERIFIABLE").when(failed > 0, "FAIL").when(F.col("unresolved") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    of_chain = lambda c: F.when(chain, c)
    return checked.select(
        *by, "mode", status.alias("status"), F.size("__agree").alias("checks"), failed.alias("failed"), "tx_count", "credit_cents", "debit_cents", (F.col("credit_cents") + F.col("debit_cents")).alias("net_cents"),
        "balances", of_chain(F.col("model")).alias("model"), of_chain(F.col("needs_review")).alias("needs_review"), of_chain(F.col("valid")).alias("valid"), of_chain(F.col("breaks")).alias("breaks"),
        of_chain((F.col("breaks") > 0) & (F.col("same_offset") >= F.lit(0.8) * F.col("breaks"))).alias("constant_offset"),
        of_chain(F.floor(F.col("breaks") * 1000 / F.greatest("tx_count", F.lit(1)) + 0.5) / 10).alias("break_percent"),
    )


# What descriptions of transfers say.
TRANSFER_PATTERNS = [
    r"payment\s+thank\s+you", "autopay", r"auto\s+pay", r"credit\s+card\s+payment", r"card\s+payment", r"online\s+payment", r"bill\s+payment",
    r"bank\s+transfer", r"ach\s+transfer", r"wire\s+transfer", r"transfer\s+(to|from)", r"account\s+transfer",
]


def is_transfer_description(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?i)({'|'.join(TRANSFER_PATTERNS)})"), F.lit(False))


def transfer_pairs(ledger: DataFrame, days: int = 5, said: Column | None = None) -> DataFrame:
    """For each row that reads as a transfer, the first later row, within so many days, of another account of the
    user with the opposite amount to a cent. A partner may serve several rows. Rows that are transfers
    already, or excluded, take no part.

    The join is on user and the three possible amounts, so it stays an equi-join; the tolerance is
    then tested on doubles.
    """
    said = is_transfer_description(F.col("merchant")) if said is None else said
    for flag in ("is_transfer", "is_excluded"):
        if flag in ledger.columns:
            ledger = ledger.where(~F.coalesce(flag, F.lit(False)))
    left = ledger.where(said).select("user_id", "tx_id", "account_id", "tx_date", "amount_cents")
    left = left.withColumn("want", F.explode(F.array(-F.col("amount_cents") - 1, -F.col("amount_cents"), 1 - F.col("amount_cents"))))
    right = ledger.select(
        F.col("user_id").alias("u"), F.col("tx_id").alias("partner_id"), F.col("account_id").alias("partner_account"),
        F.col("tx_date").alias("partner_date"), F.col("amount_cents").alias("partner_cents"),
    )
    later = (F.col("partner_date") > F.col("tx_date")) | ((F.col("partner_date") == F.col("tx_date")) & (F.col("partner_id") > F.col("tx_id")))
    near = left.join(right, (F.col("user_id") == F.col("u")) & (F.col("want") == F.col("partner_cents"))).where(
        (F.col("account_id") != F.col("partner_account")) & later & (F.datediff("partner_date", "tx_date") <= days)
        & (F.abs(F.col("amount_cents") / 100 + F.col("partner_cents") / 100) <= 0.01)
    )
    first = near.groupBy("user_id", "tx_id").agg(F.min(F.struct("partner_date", "partner_id")).alias("p"))
    return first.select("user_id", "tx_id", F.col("p.partner_id").alias("partner_id"), F.col("p.partner_date").alias("partner_date"))


def repeats_within(ledger: DataFrame, days: int = 2, carried: list[str] | None = None) -> DataFrame:
    """Rows that repeat user, merchant and amount of a row at most so many days earlier; the nearest earlier decides. carried: columns of the
    ledger that are returned too, for a tx_id need not be of one row only."""
    at = Window.partitionBy("user_id", "merchant", "amount_cents").orderBy("tx_date", "tx_id")
    rows = ledger.where("amount_cents < 0").withColumns({"earlier_id": F.lag("tx_id").over(at), "gap": F.datediff("tx_date", F.lag("tx_date").over(at))})
    return rows.where(F.col("gap") <= days).select("user_id", "tx_id", "earlier_id", "merchant", "amount_cents", "gap", *(carried or []))


def same_amounts(ledger: DataFrame) -> DataFrame:
    """Amounts that a user has more than once."""
    return ledger.groupBy("user_id", "amount_cents").agg(F.count("*").alias("n"), F.min("tx_id").alias("first_id")).where("n > 1")


def category_spikes(categories: DataFrame, least_months: int = 3, limit: float = 3.5) -> DataFrame:
    """Months whose spending in a category is over the median of all earlier months by a modified z-score above the limit.

    A user's category has one number a month, so its history is a short array of a window, and
    both medians are taken from it where it is.
    """
    index = F.col("year") * 12 + F.col("month")
    past = F.collect_list("spending_cents").over(Window.partitionBy("user_id", "category").orderBy(index).rowsBetween(Window.unboundedPreceding, -1))
    key = ["user_id", "year", "month", "category", "spending_cents"]
    rows = categories.select(*key, past.alias("past")).where(F.size("past") >= least_months)
    rows = rows.withColumn("median_cents", median_of(F.col("past")))
    rows = rows.withColumn("mad_cents", median_of(F.transform("past", lambda x: F.abs(x - F.col("median_cents")))))
    z = F.when(F.col("mad_cents") > 0, F.lit(0.6745) * F.abs(F.col("spending_cents") - F.col("median_cents")) / F.col("mad_cents")).otherwise(F.lit(0.0))
    return rows.withColumn("z", z).where((F.col("z") > limit) & (F.col("spending_cents") > F.col("median_cents"))).select(*key, "median_cents", "mad_cents", "z")


def median_of(values: Column) -> Column:
    """The middle value of an array, or the mean of the two in the middle; null if it is empty."""
    ordered, half = F.sort_array(values), F.floor(F.size(values) / 2).cast("int")
    upper, lower = F.get(ordered, half).cast("double"), F.get(ordered, half - 1).cast("double")
    return F.when(F.size(values) % 2 == 1, upper).otherwise((lower + upper) / 2)


def large_anomalies(ledger: DataFrame, floor_cents: int = 50_000) -> DataFrame:
    """The first expense of each user's month above the month's 95th percentile of amounts, and above the floor.

    The percentile is the element at place floor(0.95 n) of the amounts in rising order.
    """
    month = ["user_id", F.year("tx_date").alias("year"), F.month("tx_date").alias("month")]
    rows = ledger.select(*month, "tx_id", "tx_date", "merchant", "amount_cents").where("amount_cents < 0")
    counted = rows.groupBy("user_id", "year", "month", F.abs("amount_cents").alias("x")).agg(F.count("*").alias("k"))
    at = Window.partitionBy("user_id", "year", "month")
    ranked = counted.withColumns({"upto": F.sum("k").over(at.orderBy("x")), "n": F.sum("k").over(at)})
    edge = ranked.where(F.col("upto") > F.floor(F.col("n") * 0.95)).groupBy("user_id", "year", "month").agg(F.greatest(F.min("x"), F.lit(floor_cents)).alias("threshold_cents"))
    over = rows.join(edge, ["user_id", "year", "month"]).where(-F.col("amount_cents") > F.col("threshold_cents"))
    first = over.groupBy("user_id", "year", "month", "threshold_cents").agg(F.min(F.struct("tx_date", "tx_id", "amount_cents", "merchant")).alias("t"))
    return first.select("user_id", "year", "month", "threshold_cents", "t.tx_date", "t.tx_id", "t.amount_cents", "t.merchant")


NUMERIC_DATE = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})\s*$"


def date_order(rows: DataFrame, by: list[str], banks: DataFrame | None = None) -> DataFrame:
    """MDY or DMY for each file's numeric dates (raw_date, parse_order): 1000 for an invalid date, 1 for a step back
    between neighbours that can be read. Dates in other forms count for nothing.

    banks: by, bank_order, bank_confidence (High, Medium) of the files whose bank is known. Without an
    ambiguous date the bank's order holds (95), else MDY (70). A bank known for sure holds if no date is invalid in
    its order (95). Else the lower sum wins if it is lower by ten, else the bank's order (60), else
    MDY (0), to be confirmed.
    """
    part = lambda k: F.regexp_extract("raw_date", NUMERIC_DATE, k)
    parts = rows.select(*by, "parse_order", F.col("raw_date").rlike(NUMERIC_DATE).alias("numeric"), part(1).alias("a"), part(2).alias("b"), F.regexp_replace(part(3), r"^(\d{2})$", "20$1").alias("y"))
    day = lambda m, d: F.concat("y", F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date")
    read = parts.select(*by, "parse_order", "numeric", day("a", "b").alias("mdy"), day("b", "a").alias("dmy"))
    before = Window.partitionBy(*by).orderBy("parse_order").rowsBetween(Window.unboundedPreceding, -1)
    seen = read.withColumns({f"{c}_before": F.last(c, ignorenulls=True).over(before) for c in ("mdy", "dmy")})
    invalid = lambda c: F.count_if(F.col("numeric") & F.col(c).isNull()).alias(f"{c}_invalid")
    steps = lambda c: F.count_if(F.coalesce(F.col(c) < F.col(f"{c}_before"), F.lit(False))).alias(f"{c}_steps")
    scored = seen.groupBy(*by).agg(
        invalid("mdy"), invalid("dmy"), steps("mdy"), steps("dmy"), F.count_if(F.coalesce(F.col("mdy") != F.col("dmy"), F.lit(False))).alias("ambiguous")
    )
    scored = scored.withColumns({f"{c}_cost": F.col(f"{c}_invalid") * 1000 + F.col(f"{c}_steps") for c in ("mdy", "dmy")})
    if banks is None:
        scored = scored.withColumns({"bank_order": F.lit(None).cast("string"), "bank_confidence": F.lit(None).cast("string")})
    else:
        scored = scored.join(banks.select(*by, "bank_order", "bank_confidence"), by, "left")
    known, bank = F.col("bank_order").isNotNull(), F.col("bank_order")
    of_bank = F.when(bank == "DMY", F.col("dmy_invalid")).otherwise(F.col("mdy_invalid"))
    sure = F.coalesce(known & (F.col("bank_confidence") == "High") & (of_bank == 0), F.lit(False))
    gap = F.abs(F.col("mdy_cost") - F.col("dmy_cost"))
    share = F.least(F.lit(99), F.floor(gap / F.greatest(F.lit(1), F.col("mdy_cost") + F.col("dmy_cost")) * 100 + 50 + 0.5)).cast("long")
    case = F.when(F.col("ambiguous") == 0, "clear").when(sure, "bank").when(gap >= 10, "scored").when(known, "close").otherwise("ask")
    lower = F.when(F.col("dmy_cost") < F.col("mdy_cost"), "DMY").otherwise("MDY")
    return scored.withColumn("case", case).select(
        *by, "mdy_cost", "dmy_cost", "ambiguous",
        F.when(F.col("case") == "scored", lower).otherwise(F.coalesce(bank, F.lit("MDY"))).alias("date_order"),
        F.when(F.col("case") == "clear", F.when(known, 95).otherwise(70)).when(F.col("case") == "bank", 95).when(F.col("case") == "scored", share)
        .when(F.col("case") == "close", 60).otherwise(0).cast("long").alias("confidence"),
        (F.col("case") == "ask").alias("needs_confirmation"),
    )
