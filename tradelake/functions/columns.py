"""Column-level helpers: text cleaning, safe ratios, stable rounding, coercion.

All helpers return built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace, stripped at either end as Python's str.strip() does.
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: str | Column) -> Column:
    """Strip surrounding whitespace (tabs and newlines too); blank becomes NULL."""
    return F.nullif(F.btrim(col(c), F.lit(_WS)), F.lit(""))


def btrim_blank_null(c: str | Column) -> Column:
    """SQL ``NULLIF(btrim(x), '')``: trims spaces only."""
    return F.nullif(F.btrim(col(c)), F.lit(""))


def is_blank(c: str | Column) -> Column:
    """True when NULL or only spaces (SQL ``x IS NULL OR btrim(x) = ''``)."""
    return col(c).isNull() | (F.btrim(col(c)) == F.lit(""))


def as_double(c: str | Column) -> Column:
    return col(c).cast("double")


def pct_change(new: str | Column, base: str | Column) -> Column:
    """``(new - base) / base * 100``; NULL when either is NULL or base = 0.

    The difference is taken in the operands' own (exact decimal) type, the division in double.
    """
    new, base = col(new), col(base)
    return F.when(
        new.isNull() | base.isNull() | (base == 0), F.lit(None).cast("double")
    ).otherwise((new - base).cast("double") / base.cast("double") * F.lit(100))


def share_pct(part: str | Column, whole: str | Column) -> Column:
    """``part / whole * 100`` in double, NULL when whole is 0 or NULL."""
    part, whole = col(part), col(whole)
    return F.when(whole.isNull() | (whole == 0), F.lit(None).cast("double")).otherwise(
        part.cast("double") / whole.cast("double") * F.lit(100)
    )


def mean_of(c: str | Column) -> Column:
    """Aggregate mean as ``sum / count`` in double (exact sum, one rounding)."""
    c = col(c)
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def round_half_up(c: str | Column, digits: int) -> Column:
    """Half-up rounding of a double to ``digits`` places with plain IEEE steps:
    ``sign(x) * floor(|x| * 10^d + 0.5) / 10^d``.  From 2^52 on the sum is a whole number already,
    so ``floor`` (which returns a long) is only asked below."""
    c = col(c).cast("double")
    scale = float(10**digits)
    up = F.abs(c) * F.lit(scale) + F.lit(0.5)
    whole = F.when(up >= F.lit(float(2**52)), up).otherwise(F.floor(up).cast("double"))
    return F.signum(c) * whole / F.lit(scale)


def parsed_double(c: str | Column) -> Column:
    """Text to double; unparsable text and NaN become NULL, infinity stays."""
    v = F.btrim(col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(v), v)


def coerce_double(c: str | Column) -> Column:
    """Text to double; unparsable, NaN and infinite become NULL (see ``coercion_failed``)."""
    v = parsed_double(c)
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def coerce_decimal(c: str | Column, precision: int, scale: int) -> Column:
    """Decimal of a numeric text, NULL where it does not fit."""
    return coerce_double(c).try_cast(f"decimal({precision},{scale})")


def coerce_int(c: str | Column) -> Column:
    """Numeric text truncated toward zero (2.7 -> 2, -2.7 -> -2), NULL where it does not fit."""
    return coerce_double(c).try_cast("int")


def coercion_failed(c: str | Column, coerced: Column) -> Column:
    """A number that cannot be stored (infinite, too large): its file is rejected."""
    return parsed_double(c).isNotNull() & coerced.isNull()


def number_of(c: str | Column) -> Column:
    """Text to double in one evaluation; NaN and infinity stay (see ``fit_number``, ``number_lost``)."""
    return F.btrim(col(c).cast("string")).try_cast("double")


def fit_number(number: str | Column, dtype: str) -> Column:
    """``coerce_decimal`` / ``coerce_int`` of a number that ``number_of`` has parsed."""
    v = col(number)
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v).try_cast(dtype)


def number_lost(number: str | Column, fitted: str | Column) -> Column:
    """``coercion_failed`` of a number that ``number_of`` has parsed and its fitted value."""
    v = col(number)
    return v.isNotNull() & ~F.isnan(v) & col(fitted).isNull()


# Forms that exports write dates in besides ISO; tried in this order.
_DATE_FORMS = ["yyyy/MM/dd[ HH:mm[:ss]]", "dd.MM.yyyy[ HH:mm[:ss]]", "yyyyMMdd"]


def coerce_timestamp(c: str | Column) -> Column:
    """Text (or timestamp) to ``timestamp_ntz``; unparsable becomes NULL.  Besides ISO, dates with
    slashes (year first), dots (day first) and without separators."""
    text = F.btrim(col(c).cast("string"))
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    others = [F.try_to_timestamp(text, F.lit(form)) for form in _DATE_FORMS[:-1]]
    iso = F.when(~text.rlike(r"^\d+$"), text).try_cast("timestamp_ntz")
    return F.coalesce(iso, *[x.cast("timestamp_ntz") for x in (*others, compact)])
