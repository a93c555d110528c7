"""Trade item numbers: check digits, kinds, restricted circulation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(code: Column) -> Column:
    return F.regexp_replace(F.coalesce(code, F.lit("")), "[^0-9]", "")


def check_digit_ok(code14: Column) -> Column:
    """Whether 14 digits end in their check digit (weights 3 and 1 from the left)."""
    at = F.sequence(F.lit(1), F.lit(14))
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + F.substring(code14, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    return F.when(code14.rlike("^[0-9]{14}$"), total % 10 == 0).otherwise(False)


def canonical_gtin(code: Column) -> Column:
    """14 digits of a valid 8, 12, 13 or 14-digit number, else null."""
    d = digits(code)
    c = F.when(F.length(d).isin(8, 12, 13, 14), F.lpad(d, 14, "0"))
    return F.when(check_digit_ok(c), c)


def gtin_kind(code14: Column) -> Column:
    """Kind of a canonical number, by its leading zeros however it was typed."""
    return (
        F.when(code14.isNull(), "invalid").when(~F.startswith(code14, F.lit("0")), "gtin_14").when(F.startswith(code14, F.lit("000000")), "ean_8")
        .when(F.startswith(code14, F.lit("00")), "upc_a").otherwise("ean_13")
    )


# Prefixes (of 13 digits) for use inside a shop or for coupons.
RESTRICTED = ((20, 29, "variable_measure_upc"), (40, 49, "company_upc"), (200, 299, "in_store"), (980, 999, "coupon"))


def restricted_reason(code14: Column) -> Column:
    """Why a canonical number is no identity: variable measure (indicator 9), short numbers
    that start with 0 or 2, and the prefixes of ``RESTRICTED``; null for global numbers."""
    prefix = F.substring(code14, 2, 3).cast("int")
    why = F.when(F.startswith(code14, F.lit("9")), "variable_measure").when(F.startswith(code14, F.lit("000000")), F.when(F.substring(code14, 7, 1).isin("0", "2"), "short_in_store"))
    for low, high, name in RESTRICTED:
        why = why.when(prefix.between(low, high), name)
    return why


def restricted(code14: Column) -> Column:
    return F.when(code14.isNotNull(), restricted_reason(code14).isNotNull())


def with_check_digit(body: Column) -> Column:
    """A code of 7 to 13 digits without its check digit, as a number of 14; null for others."""
    padded = F.lpad(body, 13, "0")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda acc, i: acc + F.substring(padded, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    return F.when(body.rlike("^[0-9]{7,13}$"), F.concat(padded, ((10 - total % 10) % 10).cast("string")))
