"""Exact decimals, money, quantities and price texts. Amounts are decimal strings or scaled integers, never floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions.steps import bound
from siteledger.functions.text import compact, let, trim_wide

SCALE = 1_000_000  # quantities are integers in millionths
# Digits after the point that a currency's minor unit has, spellings of currencies and of units.
MINOR_DIGITS = {"RUB": 2, "USD": 2, "EUR": 2, "GBP": 2, "JPY": 0}
CODES = "RUB|USD|EUR|GBP|JPY"
RUBLES = r"руб(?:\.|лей|ля)?|р\."
AMOUNT = r"\d[\d \u00A0\u202F]*(?:[.,]\d{1,6})?"
PRICED = rf"(?i)(?<![\d.,A-Za-z])({AMOUNT})\s*(?:{CODES}|₽|€|{RUBLES})(?=\s|$|/)"
UNIT = r"(?:/\s*|(?:^|\s)за\s+)(м²|м2|m2|м\.?(?:\s*кв\.)?|шт\.?|упак(?:овк[ауи])?\.?|комплект|пог\.?\s*м\.?)(?=\s|$|[.,;])"
SAFE_INTEGER = (1 << 53) - 1


def canonical(value: Column) -> Column:
    """Leading zeros of the whole part and trailing zeros of the fraction go."""
    whole, fraction = F.substring_index(value, ".", 1), F.when(value.contains("."), F.substring_index(value, ".", -1)).otherwise("")
    short = F.regexp_replace(fraction, "0+$", "")
    return F.concat(F.regexp_replace(whole, r"^0+(?=\d)", ""), F.when(short == "", F.lit("")).otherwise(F.concat(F.lit("."), short)))


def commerce_decimal(raw: Column, places: int = 6) -> Column:
    return let(trim_wide(raw), lambda value: _decimal(value, places))


def _decimal(value: Column, places: int) -> Column:
    fits = (F.length(value) <= 128) & value.rlike(rf"^(?:\d+|\d{{1,3}}(?:[ \u00A0\u202F]\d{{3}})+)(?:[.,]\d{{1,{places}}})?$")
    return F.when(fits, canonical(F.regexp_replace(F.regexp_replace(value, r"[ \u00A0\u202F]", ""), ",", ".")))


def scaled(decimal: Column, digits: int) -> Column:
    """The decimal string times 10**digits as a long; null if it does not fit or has more digits."""
    fraction = F.when(decimal.contains("."), F.substring_index(decimal, ".", -1)).otherwise("")
    joined = F.concat(F.substring_index(decimal, ".", 1), F.rpad(fraction, digits, "0")) if digits else F.substring_index(decimal, ".", 1)
    return F.when((F.length(fraction) <= digits) & decimal.isNotNull(), joined.try_cast("decimal(38,0)").try_cast("bigint"))


def quantity(raw: Column) -> Column:
    """A positive quantity of at most a million as a canonical decimal, else null."""
    value = commerce_decimal(raw)
    n = scaled(value, 6)
    return F.when((n > 0) & (n <= SCALE * SCALE), value)


def money(amount: Column, currency: Column) -> Column:
    """struct(decimal, currency, minor); minor is null for unknown currencies and what does not fit."""
    known = F.create_map(*[F.lit(x) for kv in MINOR_DIGITS.items() for x in kv])
    digits = F.try_element_at(known, currency)
    decimal = F.when(digits == 2, commerce_decimal(amount, 2)).when(digits == 0, commerce_decimal(amount, 1)).otherwise(commerce_decimal(amount, 6))
    ok = currency.rlike("^[A-Z]{3}$") & decimal.isNotNull() & ~(F.coalesce(digits == 0, F.lit(False)) & decimal.contains("."))
    minor = F.when(digits == 2, scaled(decimal, 2)).when(digits == 0, scaled(decimal, 0))
    return F.when(ok, F.struct(decimal.alias("decimal"), currency.alias("currency"), F.when(minor <= SAFE_INTEGER, minor).alias("minor")))


def currency_in(raw: Column) -> Column:
    """The one currency that a text names, else null."""
    found = F.regexp_extract_all(raw, F.lit(rf"(?i)(\b(?:{CODES})\b|₽|€|(?:{RUBLES})(?=\s|$|/))"), F.lit(1))
    codes = F.array_distinct(F.transform(found, lambda x: F.when(x.rlike(rf"(?i)^(?:{CODES})$"), F.upper(x)).when(x == "€", "EUR").otherwise("RUB")))
    return F.when(F.size(codes) == 1, F.element_at(codes, 1))


def _unit_name(text: Column) -> Column:
    unit = F.lower(text)
    return F.when(unit.rlike(r"^(м²|м2|m2|м\.?\s*кв\.)$"), "m2").when(unit.startswith("шт"), "piece").when(unit.startswith("упак"), "pack").when(unit.startswith("комплект"), "set").otherwise("m")


def units_in(raw: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit("(?iu)" + UNIT), F.lit(1)), _unit_name))


def unit_in(raw: Column) -> Column:
    found = F.regexp_extract(raw, "(?iu)" + UNIT, 1)
    return F.when(found != "", _unit_name(found))


def with_price(df: DataFrame, raw: Column, role: Column, currency_hint: Column, amount_hint: Column, unit_hint: Column, conditions: Column, name: str = "price") -> DataFrame:
    """Adds struct(role, status, money, maximum, unit, conditions, totals_eligible): a price text read against its metadata.

    | the text has | money | role |
    | --- | --- | --- |
    | one priced amount | that amount | as given, FROM after "from" |
    | none, but is a bare number | that number in the metadata's currency | as given |
    | two amounts with a dash | the first; the second is the maximum | RANGE |
    | several otherwise, or a minus | none | as given, for review |

    Metadata may supply a currency or unit that the text lacks; it never replaces what the text says: a difference is a
    condition, and a price with one is for review.
    """
    kept = df.columns
    c = lambda name: F.col(f"_price_{name}")
    step = lambda df, **columns: bound(df, **{f"_price_{name}": x for name, x in columns.items()})
    df = step(
        df,
        raw=raw,
        given=role,
        amounts=F.regexp_extract_all(raw, F.lit(PRICED), F.lit(1)),
        currency=currency_in(raw),
        currency_hint=F.upper(trim_wide(currency_hint)),
        amount_hint=commerce_decimal(amount_hint),
        has_amount_hint=amount_hint.isNotNull(),
        bare=commerce_decimal(raw),
        is_amount=commerce_decimal(raw, 2).isNotNull(),
        units=units_in(raw),
        unit=unit_in(raw),
        unit_hint=trim_wide(unit_hint),
        known=conditions,
    )
    n = F.size(c("amounts"))
    is_range = (n == 2) & c("raw").rlike("[–—-]")
    first, second = (trim_wide(F.try_element_at(c("amounts"), F.lit(i))) for i in (1, 2))
    df = step(df, n=n, is_range=is_range, negative=~is_range & c("raw").rlike(r"(?:^|\s)[−-]\s*\d"), first=first, second=second)
    df = step(df, visible=F.when(c("n") == 1, commerce_decimal(c("first"))).when(c("n") == 0, c("bare")), of=F.when(c("n") > 0, c("currency")).otherwise(F.coalesce(c("currency_hint"), c("currency"))))
    df = step(df, amount=F.when(c("is_range"), c("first")).when(~c("negative"), c("visible")), most=F.when(c("is_range"), c("second")))
    df = step(df, value=money(c("amount"), c("of")), maximum=money(c("most"), c("of")))
    conflicts = compact(
        F.when((c("n") > 0) & c("currency_hint").isNotNull() & ~c("currency_hint").eqNullSafe(c("currency")), F.lit("CURRENCY_CONFLICT")),
        F.when(c("has_amount_hint") & ~F.coalesce(c("amount_hint") == c("visible"), F.lit(False)), F.lit("AMOUNT_CONFLICT")),
        F.when(F.size(c("units")) > 1, F.lit("SEVERAL_UNITS")),
        F.when((c("unit_hint") != "") & (c("unit_hint") != c("unit")), F.lit("UNIT_CONFLICT")),
    )
    rest = c("raw")
    for read in (rf"(?i){AMOUNT}\s*(?:{CODES}|₽|€|{RUBLES})(?=\s|$|/)", "(?iu)" + UNIT, r"(?iu)(?:^|\s)(?:от|from|цена|price)(?=\s|$|:)", r"[\s\u00A0\u202F:;,.()–—-]"):
        rest = F.regexp_replace(rest, read, "")
    bare = c("currency_hint").isNotNull() & c("is_amount")
    what = F.when(c("is_range"), "RANGE").when(c("raw").rlike(r"(?iu)(?:^|\s)(?:от|from)(?=\s|\d|$)") & (c("given") != "OLD"), "FROM").otherwise(c("given"))
    df = step(df, role=what, conflicts=conflicts, leftover=F.when(~bare & (rest != ""), F.concat(F.lit("UNREAD_TEXT: "), c("raw"))), minor=c("value")["minor"])
    review = c("value").isNull() | (F.size(c("conflicts")) > 0) | ((c("n") > 1) & ~c("is_range")) | (c("role") == "UNKNOWN")
    df = step(df, review=review, unit_found=F.coalesce(c("unit"), c("unit_hint")), conditions=F.concat(c("known"), compact(c("leftover")), c("conflicts")))
    eligible = ~c("review") & (c("role") == "CURRENT") & c("minor").isNotNull() & c("unit_found").isNotNull() & (F.size(c("conditions")) == 0)
    found = F.struct(
        c("role").alias("role"),
        F.when(c("review"), "REQUIRES_REVIEW").otherwise("OBSERVED").alias("status"),
        c("value").alias("money"),
        c("maximum").alias("maximum"),
        c("unit_found").alias("unit"),
        c("conditions").alias("conditions"),
        F.coalesce(eligible, F.lit(False)).alias("totals_eligible"),
    )
    return df.select(*[F.col(f"`{c}`") for c in kept], found.alias(name))


def subtotal_minor(minor: Column, quantity_scaled: Column) -> Column:
    """Half-up: (minor * quantity + half) div 10**6, exact beyond 64 bits."""
    product = minor.cast("decimal(19,0)") * quantity_scaled.cast("decimal(19,0)") + F.lit(SCALE // 2).cast("decimal(19,0)")
    return F.floor(product / F.lit(SCALE).cast("decimal(19,0)")).cast("bigint")
