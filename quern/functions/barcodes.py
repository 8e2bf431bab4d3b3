"""Barcodes as Column expressions: check digits, restricted prefixes, expansion and one canonical form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First three digits of the 13-digit form, from and to, and the country whose office gives them out.
PREFIX_COUNTRIES = [(0, 19, "US"), (30, 39, "US"), (60, 139, "US"), (300, 379, "FR"), (400, 440, "DE"), (450, 459, "JP"), (490, 499, "JP"), (500, 509, "GB"), (690, 699, "CN"), (754, 755, "CA"), (760, 769, "CH"), (800, 839, "IT")]


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with `value` computed once however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def check_digit_of(body: Column) -> Column:
    """Modulo-10 digit after `body`, whose digits weigh 3 and 1 in turn from the right."""
    digits = F.split(F.reverse(body), "")
    weighed = F.zip_with(digits, F.sequence(F.lit(0), F.length(body) - 1), lambda d, k: d.cast("int") * F.when(k % 2 == 0, 3).otherwise(1))
    return (10 - F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10) % 10


def has_valid_check_digit(code: Column) -> Column:
    """Codes of fewer than eight digits have none."""
    body = F.substring(code, F.lit(1), F.length(code) - 1)
    return F.when(F.length(code) < 8, False).otherwise(check_digit_of(body) == F.right(code, F.lit(1)).cast("int"))


def expand_upc_e(code: Column) -> Column:
    """The twelve digits that an eight-digit zero-suppressed code stands for; null unless it begins with 0 or 1."""
    d = lambda a, n: F.substring(code, a, n)
    last = d(7, 1)
    middle = (
        F.when(last.isin("0", "1", "2"), F.concat(d(2, 2), last, F.lit("0000"), d(4, 3)))
        .when(last == "3", F.concat(d(2, 3), F.lit("00000"), d(5, 2)))
        .when(last == "4", F.concat(d(2, 4), F.lit("00000"), d(6, 1)))
        .otherwise(F.concat(d(2, 5), F.lit("0000"), last))
    )
    return F.when(code.rlike("^[01][0-9]{7}$"), F.concat(d(1, 1), middle, d(8, 1)))


def restricted(code13: Column) -> Column:
    """In-store and coupon ranges of the 13-digit form: 02, 04 and 200 to 299."""
    return (F.length(code13) == 13) & (code13.startswith("02") | code13.startswith("04") | code13.startswith("2"))


def normalize_barcode(raw: Column) -> Column:
    """struct(ok, code, reason) of whatever is written as a barcode.

    Only digits count. 14 digits lose a leading 0; 8 are read as a zero-suppressed code first, and as they stand if that fails; 9 to 11
    are padded if that makes them valid; 12 get a leading 0. The code has 13 or 8 digits; reason is null, or empty, bad_length, bad_check_digit or restricted.
    """

    def widened(bare: Column) -> Column:
        wide, padded = expand_upc_e(bare), F.lpad(bare, 13, "0")
        return (
            F.when((F.length(bare) == 8) & F.coalesce(has_valid_check_digit(wide), F.lit(False)), F.concat(F.lit("0"), wide))
            .when(F.length(bare).between(9, 11) & has_valid_check_digit(padded), padded)
            .when(F.length(bare) == 12, F.concat(F.lit("0"), bare))
            .otherwise(bare)
        )

    def judged(code: Column) -> Column:
        reason = F.when(code == "", "empty").when(~F.length(code).isin(8, 13), "bad_length").when(~has_valid_check_digit(code), "bad_check_digit").when(restricted(code), "restricted")
        return F.struct(reason.isNull().alias("ok"), F.when(reason.isNull(), code).alias("code"), reason.alias("reason"))

    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9]", "")
    bare = bind(digits, lambda d: F.when((F.length(d) == 14) & d.startswith("0"), F.substring(d, 2, 13)).otherwise(d))
    return bind(bind(bare, widened), judged)


def bare_form(code: Column) -> Column:
    """The code without any padding, which is the same for all of its forms."""
    return F.regexp_replace(code, "^0+", "")


def query_forms(code: Column) -> Column:
    """The zero-paddings under which another register may hold the code."""
    bare = bare_form(code)
    return F.filter(F.array_distinct(F.array(code, bare, F.lpad(bare, 12, "0"), F.lpad(bare, 13, "0"), F.lpad(bare, 14, "0"))), lambda c: c != "")


def country_of(code13: Column) -> Column:
    """Country whose office gave out the prefix of a 13-digit code, or null."""
    prefix = F.substring(code13, 1, 3).cast("int")
    return F.coalesce(*(F.when(prefix.between(a, b), name) for a, b, name in PREFIX_COUNTRIES))
