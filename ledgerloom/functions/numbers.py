"""Exact integers and the few conversions out of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW = "decimal(38,0)"


def pow10(exponent: Column) -> Column:
    """10**exponent as an exact integer, for exponents from 0 to 30."""
    return F.rpad(F.lit("1"), (exponent + 1).cast("int"), "0").cast(RAW)


def to_raw_units(amount: Column, decimals: Column) -> Column:
    """Decimal-adjusted amount (a decimal or its text, up to 18 places) to smallest units.

    Done on the digits: the point moves right, missing places are zeros, further ones are cut.
    """
    text = amount.cast("decimal(38,18)").cast("string")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    bare = F.regexp_replace(text, "^-", "")
    whole, part = F.split_part(bare, F.lit("."), F.lit(1)), F.split_part(bare, F.lit("."), F.lit(2))
    return F.concat(sign, whole, F.rpad(part, decimals.cast("int"), "0")).cast(RAW)


def integer_text(text: Column) -> Column:
    """Text of an integer, perhaps with zero decimals, as an exact integer; anything else raises."""
    ok = text.rlike(r"^-?\d+(\.0+)?$")
    wrong = F.raise_error(F.concat(F.lit("not an integer: "), text)).cast(RAW)
    return F.when(text.isNull(), F.lit(None).cast(RAW)).when(ok, F.split_part(text, F.lit("."), F.lit(1)).cast(RAW)).otherwise(wrong)


def integer_text_or_zero(text: Column) -> Column:
    """The read side's lenient form: text that is no integer, or one of more than 38 digits, counts as 0."""
    return F.coalesce(F.when(text.rlike(r"^-?\d+$"), text.try_cast(RAW)), F.lit(0)).cast(RAW)


def tokens(raw: Column, decimals: Column) -> Column:
    """Smallest units to tokens: whole part and remainder converted apart, so no digit before the point is lost."""
    scale = pow10(decimals)
    rest = raw % scale
    whole = ((raw - rest) / scale).cast("double")
    return whole + rest.cast("double") / scale.cast("double")


def floor_div(x: Column, d: Column) -> Column:
    """floor(x / d) of exact integers, d above zero."""
    return ((x - F.pmod(x, d)) / d).cast(RAW)


def usd_micro(raw: Column, decimals: Column, nav: Column) -> Column:
    """Smallest units at a NAV, as whole millionths of a dollar, rounded half up once; the NAV counts to six places.

    Whole tokens and the rest are multiplied apart, so nothing passes 38 digits.
    """
    price = (nav.cast("decimal(18,6)") * F.lit(1_000_000)).cast("decimal(18,0)")
    scale = pow10(decimals)
    rest = F.pmod(raw, scale).cast(RAW)
    whole = ((raw - rest) / scale).cast(RAW)
    twice = (rest * price).cast(RAW) * F.lit(2).cast("decimal(1,0)")
    return ((whole * price).cast(RAW) + floor_div((twice.cast(RAW) + scale).cast(RAW), (scale * F.lit(2).cast("decimal(1,0)")).cast(RAW))).cast(RAW)


def dollars(micro: Column, digits: int = 2) -> Column:
    """Millionths of a dollar as a double, rounded half up to ``digits`` in integers."""
    step = 10 ** (6 - digits)
    whole = floor_div((micro + F.lit(step // 2).cast("decimal(7,0)")).cast(RAW), F.lit(step).cast(RAW))
    return whole.cast("double") / float(10**digits)


def permyriad(part: Column, whole: Column) -> Column:
    """floor(part * 10000 / whole) as a long for 0 <= part <= whole; 0 where whole is 0."""
    scaled = part * F.lit(10000).cast("decimal(5,0)")
    remainder = F.when(whole > 0, scaled % whole)
    return F.when(whole > 0, F.round(((scaled - remainder) / whole).cast("double")).cast("long")).otherwise(F.lit(0).cast("long"))


def half_up(x: Column, digits: int) -> Column:
    """Round half toward +infinity."""
    return F.floor(x * float(10**digits) + 0.5).cast("double") / float(10**digits)
