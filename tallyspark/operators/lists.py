"""Lists of transactions: filters, pages, exports; every user's list at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as f
from tallyspark.operators.months import display_category
from tallyspark.operators.scans import placed

FLAGGED = ["UNRESOLVED", "WARNING"]
PAGE, UNCATEGORIZED_PAGE, EXPORT_ROWS, MONTH_ROWS = 500, 5000, 50_000, 500


def _in_month(year: int | None, month: int | None) -> Column:
    if not (year and month):
        return F.lit(True)
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    return (F.col("tx_date") >= first) & (F.col("tx_date") < F.add_months(first, 1))


def filtered(
    ledger: DataFrame, year: int | None = None, month: int | None = None, category: str | None = None, shown_category: str | None = None,
    search: str | None = None, max_cents: int | None = None, ingestion: str | None = None, uncategorized: bool = False,
) -> DataFrame:
    """Rows of the ledger (app_category, bank_category, override_category, category, description, merchant, status, is_possible_duplicate) that a list shows.

    Of search, shown_category and category only the first that is given counts. ingestion: flagged, duplicate or
    same-price (an amount that the user has more than once among the rows that the other filters leave).
    """
    keep = ~F.coalesce("is_excluded", F.lit(False)) & _in_month(year, month)
    if uncategorized:
        keep = keep & F.col("app_category").isNull() & ~F.coalesce("is_transfer", F.lit(False))
    if search:
        keep = keep & (F.contains("description", F.lit(search)) | F.contains("merchant", F.lit(search)))
    elif shown_category:
        keep = keep & ((F.col("app_category") == shown_category) | (F.col("app_category").isNull() & (F.col("bank_category") == shown_category)))
    elif category:
        keep = keep & ((F.col("override_category") == category) | (F.col("override_category").isNull() & (F.col("category") == category)))
    if max_cents is not None:
        keep = keep & (F.col("amount_cents") <= max_cents)
    rows = ledger.where(keep)
    if ingestion == "same-price":
        shared = rows.groupBy("user_id", "amount_cents").count().where("count > 1").select("user_id", "amount_cents")
        return rows.join(shared, ["user_id", "amount_cents"], "left_semi")
    if ingestion == "flagged":
        return rows.where(F.col("status").isin(FLAGGED))
    return rows.where("is_possible_duplicate") if ingestion == "duplicate" else rows


def paged(rows: DataFrame, sort_by: str = "date", descending: bool = True, page: int = 1, limit: int = 100, most: int = PAGE) -> DataFrame:
    """A page of each user's list, with place from 1. Ties go by tx_id."""
    by = F.col({"vendor": "merchant", "amount": "amount_cents"}.get(sort_by, "tx_date"))
    size = min(limit, most)
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(by.desc() if descending else by.asc(), "tx_id")))
    return placed.where(F.col("place").between((page - 1) * size + 1, page * size))


def queued(rows: DataFrame, sort_by: str = "date", descending: bool = True, columns: list[str] | None = None) -> DataFrame:
    """rows (user_id, tx_id, tx_date, amount_cents, merchant, description) with place, from 1, in each user's queue by date, amount or vendor.

    The vendor is the merchant, or the description if there is none, in any case; rows without either come last both ways. Ties go
    by date, newest first, then by tx_id. A user's queue may be of any length: it is placed in ranges. columns: those that are
    returned, user_id among them (all, unless told otherwise); of the others only what the order needs is read.
    """
    if sort_by == "vendor":
        merchant, said = (F.coalesce(c, F.lit("")) for c in ("merchant", "description"))
        vendor = F.lower(F.when(merchant != "", merchant).otherwise(said))
        keyed = rows.withColumns({"__empty": vendor == "", "__key": vendor})
    else:
        keyed = rows.withColumns({"__empty": F.lit(False), "__key": F.col("amount_cents" if sort_by == "amount" else "tx_date")})
    order = [F.col("__empty").asc(), F.col("__key").desc() if descending else F.col("__key").asc(), F.col("tx_date").desc(), F.col("tx_id").asc()]
    columns = columns or rows.columns
    needed = dict.fromkeys([*columns, "user_id", "tx_date", "tx_id", "__empty", "__key"])
    return placed(keyed.select(*needed), ["user_id"], order, columns=columns)


def counted(rows: DataFrame) -> DataFrame:
    """One row a user: all, flagged, possible duplicates, uncategorized, and rows whose amount the user has more than once."""
    amounts = rows.groupBy("user_id", "amount_cents").agg(
        F.count("*").alias("n"), F.count_if(F.col("status").isin(FLAGGED)).alias("flagged"), F.count_if("is_possible_duplicate").alias("duplicates"),
        F.count_if(F.col("app_category").isNull()).alias("uncategorized"),
    )
    sums = [F.sum(c).alias(c) for c in ("flagged", "duplicates", "uncategorized")]
    return amounts.groupBy("user_id").agg(F.sum("n").alias("total"), *sums, F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("same_price"))


def month_list(
    ledger: DataFrame, year: int, month: int, merchant: str | None = None, min_cents: int | None = None, max_cents: int | None = None, category: str | None = None
) -> DataFrame:
    """Each user's rows of a month in the order of days, 500 at most, and of those the ones of a category (in any case).

    min_cents and max_cents are of expenses without sign, and leave out income. Amounts come without sign.
    """
    keep = _in_month(year, month)
    for flag in ("is_excluded", "is_transfer", "is_duplicate"):
        keep = keep & ~F.coalesce(flag, F.lit(False))
    if merchant:
        keep = keep & F.contains(F.lower("merchant"), F.lit(merchant.lower()))
    if min_cents is not None:
        keep = keep & (F.col("amount_cents") <= -min_cents)
    if max_cents is not None:
        keep = keep & (F.col("amount_cents") >= -max_cents)
    first = paged(ledger.where(keep), descending=False, limit=MONTH_ROWS)
    rows = first.withColumn("shown_category", F.coalesce("override_category", "category", "app_category"))
    if category:
        rows = rows.where(F.lower("shown_category") == category.lower())
    name = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("merchant", "description")), F.lit(""))
    return rows.select("user_id", "tx_id", "tx_date", name.alias("merchant"), F.abs("amount_cents").alias("size_cents"), "shown_category")


def quoted(value: Column) -> Column:
    """A cell of a CSV line: in quotes if it holds a comma, a quote or a line's end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


# The columns of an export, in order.
EXPORT = [
    "Date", "Description", "Original Description", "Amount", "Currency", "Type", "Category", "Categorization Source", "Account", "Upload File", "Ingestion Status", "Is Pending", "Is Transfer",
    "Is Foreign Currency", "Foreign Currency", "Running Balance", "Check Number", "Bank Transaction ID",
]


def exported(ledger: DataFrame, accounts: DataFrame, uploads: DataFrame) -> DataFrame:
    """(user_id, place, EXPORT) for each user's newest 50,000 rows. accounts: account_id, account_name; uploads: upload_id, filename.

    ledger: what lists have, and description_raw, currency, source, is_pending, foreign_currency, balance_cents, check_number, bank_id. The
    category is the user's own, else the one given; null cells are empty.
    """
    joined = ledger.join(accounts, "account_id", "left").join(uploads, "upload_id", "left")
    newest = paged(joined, limit=EXPORT_ROWS, most=EXPORT_ROWS)
    transfer = F.coalesce("is_transfer", F.lit(False))
    cells = [
        F.col("tx_date"), F.coalesce(F.nullif("merchant", F.lit("")), "description"), F.col("description_raw"), f.from_cents(F.col("amount_cents")), F.col("currency"), f.transaction_type(F.col("amount_cents"), transfer),
        F.coalesce("override_category", "category"), F.when(F.col("override_category").isNotNull(), "user").otherwise(F.col("source")), F.col("account_name"), F.col("filename"), F.col("status"),
        F.coalesce("is_pending", F.lit(False)), transfer, F.coalesce("is_foreign", F.lit(False)), F.col("foreign_currency"), f.from_cents(F.col("balance_cents")), F.col("check_number"), F.col("bank_id"),
    ]
    return newest.select("user_id", "place", *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(cells, EXPORT, strict=True)))


def csv_lines(rows: DataFrame, columns: list[str] = EXPORT) -> DataFrame:
    """(user_id, place, line): rows as CSV lines; their file ends lines with CRLF."""
    return rows.select("user_id", "place", F.concat_ws(",", *(quoted(F.col(f"`{c}`")) for c in columns)).alias("line"))


def write_csv(rows: DataFrame, path: str, columns: list[str] = EXPORT) -> None:
    """A folder of CSV files for each user, in the order of the list, under a header. Lines end with CRLF, within cells too."""
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "place")
    ordered.select("user_id", *columns).write.partitionBy("user_id").mode("overwrite").csv(path, header=True, lineSep="\r\n", quote='"', escape='"', emptyValue="")


def newest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def upcoming(charges: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Recurring charges (user_id, merchant, mean_cents, next_charge, confidence, score) due within so many days, with days_left; not those of low confidence or
    a score under 40."""
    left = f.days_until(F.col("next_charge"), as_of)
    return charges.withColumn("days_left", left).where(left.between(0, days) & (F.col("confidence") != "low") & (F.col("score") >= 40))


def progress(ledger: DataFrame) -> DataFrame:
    """Categorization of each user's rows that are not excluded: unlocked once there are rows and none is without a category."""
    rows = ledger.where(~F.coalesce("is_excluded", F.lit(False)))
    by = rows.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(display_category(F.col("app_category")) == "Uncategorized").alias("uncategorized"))
    return by.withColumns({"percent": F.floor((F.col("total") - F.col("uncategorized")) * 100 / F.col("total") + 0.5).cast("long"), "is_unlocked": F.col("uncategorized") == 0})


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues (upload_id, issue_type, severity, resolved) of each upload by severity and kind: open and resolved."""
    return issues.groupBy("upload_id", "severity", "issue_type").agg(F.count_if(~F.col("resolved")).alias("open"), F.count_if("resolved").alias("resolved"))


def chosen_dates(rows: DataFrame, choice: Column) -> DataFrame:
    """Rows (date, date_status, option_a, option_b, status) with their ambiguous dates read month first (A) or day first (B); with the choice they
    are valid, without one they stay."""
    unsure, pick = F.col("date_status") == "AMBIGUOUS", F.when(choice == "A", F.col("option_a")).when(choice == "B", F.col("option_b"))
    now = unsure & pick.isNotNull()
    return rows.withColumns({
        "date": F.when(now, pick).otherwise(F.col("date")), "date_status": F.when(now, "RESOLVED").otherwise(F.col("date_status")),
        "status": F.when(now & (F.col("status") == "UNRESOLVED"), "VALID").otherwise(F.col("status")),
    })


def without(ledger: DataFrame, gone: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the ledger without the rows of deleted uploads or accounts, (user_id, year, month) of the summaries to compute anew)."""
    removed = ledger.join(gone, key, "left_semi")
    return ledger.join(gone, key, "left_anti"), removed.select("user_id", F.year("tx_date").alias("year"), F.month("tx_date").alias("month")).distinct()


def upserted(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """stored with the rows of new in place of those with the same key, and new's other rows."""
    return stored.join(new.select(*key), key, "left_anti").unionByName(new)


def matched_rows(staged: DataFrame, ledger: DataFrame) -> DataFrame:
    """(staged_id, tx_id) of the first ledger row of the same upload and day whose amount is a cent off at most."""
    asked = staged.select(F.col("tx_id").alias("staged_id"), F.col("upload_id").alias("__u"), F.col("tx_date").alias("__d"), F.col("amount_cents").alias("__c"))
    asked = asked.withColumn("__want", F.explode(F.array(F.col("__c") - 1, F.col("__c"), F.col("__c") + 1)))
    met = asked.join(ledger, (F.col("__u") == F.col("upload_id")) & (F.col("__d") == F.col("tx_date")) & (F.col("__want") == F.col("amount_cents")))
    return met.where(F.abs(F.col("__c") / 100 - F.col("amount_cents") / 100) <= 0.01).groupBy("staged_id").agg(F.min("tx_id").alias("tx_id"))


def chat_context(totals: DataFrame, merchants: DataFrame, comparison: DataFrame, budgets: DataFrame) -> DataFrame:
    """One row a month of what a question about it is answered from: its totals, ten merchants, changes and budgets, as JSON."""
    month = ["user_id", "year", "month"]
    listed = lambda df, name, *c: df.groupBy(*month).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*c)))).alias(name))
    top = newest(merchants, month, [F.desc("spent_cents"), F.col("merchant")], 10)
    parts = [listed(top, "merchants", "place", "merchant", "spent_cents"), listed(comparison, "changes", "rank", "category", "delta_cents"), listed(budgets, "budgets", "category", "budget_cents", "spending_cents")]
    out = totals.select(*month, "income_cents", "spending_cents", "net_cents")
    for part in parts:
        out = out.join(part, month, "left")
    return out
