"""Scalar functions on dates, amounts and names, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(text: Column) -> Column:
    """White space at the ends goes; runs of it become one space."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date")


# English month names; each has its first three letters too, and September four.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _month_number(name: Column) -> Column:
    names = {short: i + 1 for i, month in enumerate(MONTHS) for short in (month, month[:3])} | {"sept": 9}
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in (pair[0], str(pair[1]))))
    return F.coalesce(F.try_element_at(known, F.lower(name)), F.lit("0"))


def let(value: Column, body) -> Column:
    """body of the value, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_date(raw: Column, order: Column | None = None) -> Column:
    """struct(date, status, option_a, option_b) of a written date.

    Year first with - or / and two digits each, eight digits, month names before or after the day, then numeric
    dates: valid one way only, equal both ways, or by the file's order (MDY or DMY); else AMBIGUOUS with both
    readings. Empty is MISSING, anything else INVALID.
    """
    iso, flat = r"^(\d{4})(?:-(?=\d\d-)|/(?=\d\d/))(\d{2})[-/](\d{2})$", r"^(\d{4})(\d{2})(\d{2})$"
    named, named2 = r"^([A-Za-z]+)[\s/,-]+(\d{1,2})[\s,]+(\d{2,4})$", r"^(\d{1,2})[\s/-]+([A-Za-z]+)[\s/-]+(\d{2,4})$"
    numeric = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$"
    order = F.lit(None).cast("string") if order is None else order

    def parts(text: Column) -> Column:
        """The text's year, month and day as written, and for a numeric date those of the month-first reading."""
        g = lambda p, k: F.regexp_extract(text, p, k)
        of = lambda y, m, d, n: F.struct(y.alias("y"), m.alias("m"), d.alias("d"), F.lit(n).alias("numeric"), text.alias("text"))
        full = lambda y: F.lpad(F.regexp_replace(y, r"^(\d{2})$", "20$1"), 4, "0")
        nothing = F.lit(None).cast("string")
        return (
            F.when(text.rlike(numeric), of(full(g(numeric, 3)), g(numeric, 1), g(numeric, 2), True))
            .when(text.rlike(iso), of(g(iso, 1), g(iso, 2), g(iso, 3), False)).when(text.rlike(flat), of(g(flat, 1), g(flat, 2), g(flat, 3), False))
            .when(text.rlike(named), of(full(g(named, 3)), _month_number(g(named, 1)), g(named, 2), False))
            .when(text.rlike(named2), of(full(g(named2, 3)), _month_number(g(named2, 2)), g(named2, 1), False))
            .otherwise(of(nothing, nothing, nothing, False))
        )

    def readings(p: Column) -> Column:
        a = _day(p["y"], p["m"], p["d"])
        b = F.when(p["numeric"], _day(p["y"], p["d"], p["m"]))
        return F.struct(a.alias("a"), b.alias("b"), p["text"].alias("text"))

    def result(r: Column) -> Column:
        a, b = r["a"], r["b"]
        two = F.coalesce(a != b, F.lit(False))
        date = F.when(two, F.when(order == "MDY", a).when(order == "DMY", b)).otherwise(F.coalesce(a, b))
        unsure = two & date.isNull()
        status = (
            F.when(F.coalesce(r["text"], F.lit("")) == "", "MISSING").when(date.isNotNull(), "RESOLVED").when(unsure, "AMBIGUOUS").otherwise("INVALID")
        )
        return F.struct(date.alias("date"), status.alias("status"), F.when(unsure, a).alias("option_a"), F.when(unsure, b).alias("option_b"))

    return let(let(let(squeeze(raw), parts), readings), result)


# Currency signs that may stand before or after an amount, and their codes.
CURRENCY_SIGNS = {
    "R$": "BRL", "A$": "AUD", "C$": "CAD", "HK$": "HKD", "S$": "SGD", "NZ$": "NZD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₩": "KRW",
    "₽": "RUB", "฿": "THB", "₺": "TRY", "₴": "UAH", "₫": "VND", "₦": "NGN", "₱": "PHP", "₨": "PKR", "Rp": "IDR",
}
_SIGN = "(" + "|".join(s.replace("$", r"\$") for s in CURRENCY_SIGNS) + ")"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def currency_sign(raw: Column) -> Column:
    """The sign in front of an amount, else the one after it; the empty string if there is neither."""
    text = _trimmed(raw)
    front = F.regexp_extract(text, "^" + _SIGN, 1)
    return F.when(front != "", front).otherwise(F.regexp_extract(text, _SIGN + "$", 1))


def normalize_amount(raw: Column) -> Column:
    """decimal(18,2) of a written amount, null if it is none.

    In this order: a currency sign in front or behind goes, else a $ in front; parentheses or a trailing minus
    as negative; comma as decimal sign after dots, commas between thousands, comma before two last digits as
    decimal sign. A sign before the currency, as in -$5 or ($5), gives null. Powers of ten (1e5) and hexadecimal
    numbers (0x1F) count. Digits past the second are rounded, half away from zero.
    """

    def signed(text: Column) -> Column:
        bare = F.when(
            text.rlike(f"^{_SIGN}|{_SIGN}$"),
            F.when(text.rlike("^" + _SIGN), F.regexp_replace(text, rf"^{_SIGN}\s*", "")).otherwise(F.regexp_replace(text, rf"\s*{_SIGN}$", "")),
        ).otherwise(F.regexp_replace(text, r"^\$\s*", ""))
        return F.regexp_replace(F.regexp_replace(bare, r"^\((.+)\)$", "-$1"), r"^([^-].*)-$", "-$1")

    def plain(text: Column) -> Column:
        return (
            F.when(text.rlike(r"^-?\d{1,3}(\.\d{3})+,\d{1,2}$"), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(text.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(text, F.lit(","), F.lit("")))
            .when(text.rlike(r"^-?\d+,\d{2}$"), F.replace(text, F.lit(","), F.lit(".")))
            .otherwise(text)
        )

    def number(plain: Column) -> Column:
        hexed = F.when(plain.rlike("^0[xX][0-9a-fA-F]{1,12}$"), F.conv(F.substring(plain, 3, 12), 16, 10))
        raised = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d{1,3}$"), plain.try_cast("double"))
        return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("decimal(18,2)")).otherwise(F.coalesce(raised.try_cast("decimal(18,2)"), hexed.try_cast("decimal(18,2)")))

    return let(let(let(_trimmed(raw), signed), plain), number)


def to_cents(text: Column) -> Column:
    """Cents of a decimal string; digits past the second are cut off."""
    g = lambda k: F.regexp_extract(text, r"^([+-]?)(\d*)(?:\.(\d*))?$", k)
    value = F.concat(F.when(g(2) == "", "0").otherwise(g(2)), F.substring(F.rpad(g(3), 2, "0"), 1, 2)).try_cast("long")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.when(g(1) == "-", -value).otherwise(value))


def from_cents(cents: Column) -> Column:
    size = F.abs(cents)
    whole = F.concat(F.floor(size / 100).cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))
    return F.when(cents < 0, F.concat(F.lit("-"), whole)).otherwise(whole)


def amount_to_cents(amount: Column) -> Column:
    """Nearest cent, half towards plus infinity."""
    return F.floor(amount * 100 + 0.5).cast("long")


def normalize_description(raw: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"[\r\n]+", " ")
    return F.regexp_replace(text, r"[ \t]{2,}", " ")


def fingerprint(date: Column, amount: Column, description: Column, balance: Column) -> Column:
    parts = [F.coalesce(date.cast("string"), F.lit("NO_DATE")), F.coalesce(amount.cast("string"), F.lit("NO_AMOUNT")),
             F.lower(F.trim(F.coalesce(description, F.lit("")))), F.coalesce(balance.cast("string"), F.lit("NO_BALANCE"))]
    return F.sha2(F.concat_ws("|||", *parts), 256)


def row_hash(account: Column, line: Column) -> Column:
    return F.sha2(F.concat_ws("|", account, line), 256)


def vendor_key(raw: Column) -> Column:
    """Upper case letters, digits and single spaces, without a trailing number if three characters are left."""
    kept = squeeze(F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), r"[^A-Z0-9\s]", ""))
    short = F.trim(F.regexp_replace(kept, r"\s+\d+$", ""))
    return F.when(F.length(short) >= 3, short).otherwise(kept)


def rule_key(raw: Column) -> Column:
    return F.lower(vendor_key(raw))


# What banks put in front of a vendor's name.
VENDOR_PREFIXES = [
    "pos ", "ach ", "debit ", "credit ", "purchase ", r"tsq?\*", r"sq \*", r"sq\*", r"tst\*", "dda ", "wdrl ", "wd ", "chk ", "chkcd ", "preauth ",
    "preauthorized ", "online ", "recurring ",
]


def normalize_vendor(raw: Column) -> Column:
    """Lower case, without one prefix of a bank and without signs other than hyphens, 80 characters."""
    text = F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), f"^({'|'.join(VENDOR_PREFIXES)})", "")
    return F.substring(squeeze(F.regexp_replace(text, r"[^a-z0-9_\s-]", "")), 1, 80)


def upload_vendor(raw: Column) -> Column:
    """normalize_vendor without a trailing number if three characters are left."""
    key = normalize_vendor(raw)
    short = F.trim(F.regexp_replace(key, r"\s+\d+$", ""))
    return F.when(F.length(short) >= 3, short).otherwise(key)


def visited_merchant(raw: Column) -> Column:
    """Without a trailing store number, as in STARBUCKS #1234."""
    return squeeze(F.regexp_replace(raw, r"#\d+\s*$", ""))


# In this order, what card statements append, noise inside, and places at the end.
MERCHANT_TAILS = [r"\s+[a-z]{2}\s+date[\s\S]*", r"\s+date\s+[\dx/]+\s+xx\s+x[\s\S]*", r"\s+(type|co|id\d*):\s+[\s\S]*", r"\s+card\s+\d+[\s\S]*"]
MERCHANT_NOISE = [(r"\*+", " "), (r"#\s*\d+", ""), (r"\d{4,}", ""), (r"\b(debit|credit|purchase|pos|ach)\b", "")]
MERCHANT_PLACES = [r"\s+[a-z]{2}\s*$", r",\s*[a-z\s]+$"]


def normalize_merchant(raw: Column) -> Column:
    """Display name: card and transfer metadata, noise words, long numbers, a trailing state and city go; every word begins in upper case."""
    text = _trimmed(F.lower(raw))
    for pattern in MERCHANT_TAILS:
        text = _trimmed(F.regexp_replace(text, pattern, ""))
    for pattern, to in MERCHANT_NOISE:
        text = F.regexp_replace(text, pattern, to)
    text = squeeze(text)
    for pattern in MERCHANT_PLACES:
        text = _trimmed(F.regexp_replace(text, pattern, ""))
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")


# What banks put before and after the name of a recurring payee.
RECURRING_PREFIXES = [
    "payment to", "payments to", "transfer to", "ach payment to?", "ach pmt", "online pmt", "online payment", "pymt to", "pmt to", "bill pmt", "bill payment",
    "web pmnt", "autopay", "recurring pmt", "scheduled pmt", "checkcard", "pos purchase", "pos debit",
]
RECURRING_SUFFIXES = ["payment", "pymt", "pmt", "autopay", "billpay"]


def recurring_key(raw: Column) -> Column:
    text = F.regexp_replace(_trimmed(F.lower(F.coalesce(raw, F.lit("")))), rf"^({'|'.join(RECURRING_PREFIXES)})\s+", "")
    text = F.regexp_replace(text, rf"\s+({'|'.join(RECURRING_SUFFIXES)})$", "")
    return squeeze(F.regexp_replace(text, r"[^a-z0-9_\s-]", " "))


# Personal data and what is shown in its place, in this order.
REDACTIONS = [
    (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[CARD]"), (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"), (r"\b\d{9}\b", "[ACCOUNT]"), (r"\*{4}\d{4}", "[CARD]"),
]


def redact(text: Column, length: int | None = 200) -> Column:
    """Cards, telephone numbers, mail addresses and account numbers are masked; so many characters are shown, or all."""
    for pattern, shown in REDACTIONS:
        text = F.regexp_replace(text, pattern, F.lit(shown))
    return _trimmed(text) if length is None else F.substring(_trimmed(text), 1, length)


def ingestion_status(date_status: Column, amount: Column, pending: Column) -> Column:
    return (
        F.when(date_status.isin("MISSING", "INVALID"), "REJECTED").when(date_status == "AMBIGUOUS", "UNRESOLVED")
        .when(amount.isNull(), "UNRESOLVED").when(F.coalesce(pending, F.lit(False)), "WARNING").otherwise("VALID")
    )


def merge_debit_credit(debit: Column, credit: Column) -> Column:
    """Signed amount: a nonzero debit is negative and wins, else a nonzero credit; null if there is neither."""
    return F.when(F.coalesce(debit, F.lit(0)) != 0, -F.abs(debit)).when(F.coalesce(credit, F.lit(0)) != 0, F.abs(credit))


def enforce_sign(amount: Column, kind: Column) -> Column:
    word = F.lower(F.trim(kind))
    return F.when(word.isin("debit", "dr", "d"), -F.abs(amount)).when(word.isin("credit", "cr", "c"), F.abs(amount)).otherwise(amount)


def currency(raw: Column, code: Column) -> Column:
    """By the amount's sign, else a code of three letters, else USD."""
    signs = F.create_map(*(F.lit(x) for pair in CURRENCY_SIGNS.items() for x in pair))
    given = F.upper(_trimmed(code))
    return F.coalesce(F.try_element_at(signs, currency_sign(raw)), F.when(F.length(given) == 3, given), F.lit("USD"))


def money(cents: Column) -> Column:
    """$1,234.50, of a size with a minus in front if it is below 0."""
    whole = F.format_number(F.floor(F.abs(cents) / 100), 0)
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("$"), whole, F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))


def filled(sentence: str, *values: Column) -> Column:
    """sentence with a value for each {}; null if one of them is."""
    parts = sentence.split("{}")
    return F.concat(F.lit(parts[0]), *(x for value, part in zip(values, parts[1:], strict=True) for x in (value, F.lit(part))))


def first_present(fields: Column, keys: list[str]) -> Column:
    """The value of the first key that the map has, even if it is empty; else the empty string."""
    return F.coalesce(*[F.when(F.map_contains_key(fields, k), F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit(""))) for k in keys], F.lit(""))


def tolerant_json_array(text: Column, item: str) -> Column:
    """An array of items from JSON that may stand in code fences or be cut off: it is then closed after its last whole item."""
    body = F.regexp_replace(text, r"```(json)?", "")
    cut = F.concat(F.regexp_extract(body, r"(?s)^(.*\})\s*,", 1), F.lit("]"))
    return F.coalesce(F.from_json(body, f"array<{item}>", {"mode": "PERMISSIVE"}), F.from_json(cut, f"array<{item}>"))


def rule_specificity(match_type: Column) -> Column:
    """Lower is more specific."""
    return F.when(match_type == "vendor_exact_amount", 1).when(match_type.isin("vendor_amount_range", "vendor_smart"), 2).when(match_type == "vendor_contains_text", 3).otherwise(4)


def rule_reason(match_type: Column) -> Column:
    return (
        F.when(match_type == "vendor_exact_amount", "Vendor + Exact Amount").when(match_type == "vendor_amount_range", "Vendor + Amount Range")
        .when(match_type == "vendor_contains_text", "Vendor + Description").when(match_type == "vendor_smart", "Vendor + Smart Amounts").otherwise("Vendor only")
    )


def escalated(status: Column, suspicious: Column) -> Column:
    """VALID becomes WARNING; no other status changes."""
    return F.when((status == "VALID") & suspicious, "WARNING").otherwise(status)


def transaction_type(amount: Column, is_transfer: Column) -> Column:
    return F.when(is_transfer, "transfer").when(amount >= 0, "income").otherwise("expense")


def days_until(date: Column, as_of: Column) -> Column:
    return F.datediff(date, as_of)
