"""Exact arithmetic on scaled integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 12


def quotient(n: Column, d: Column, places: int = PLACES) -> Column:
    """n / d times 10**places, rounded half to even, as DECIMAL(38,0); n below 10**24, d positive, n / d below 10**20."""
    scaled = n.cast("decimal(24,0)") * F.lit(10**places).cast("decimal(13,0)")
    d = d.cast("decimal(24,0)")
    rest = scaled % d
    whole = ((scaled - rest) / d).cast("decimal(37,0)")
    up = (rest * 2 > d) | ((rest * 2 == d) & (whole % 2 == 1))
    return (whole + F.when(up, 1).otherwise(0)).cast("decimal(38,0)")


def decimal_text(x: Column) -> Column:
    """Fixed notation without trailing zeros."""
    s = x.cast("string")
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def scaled_text(x: Column, places: int = PLACES) -> Column:
    """Text of a non-negative integer that counts units of 10**-places."""
    digits = F.lpad(x.cast("string"), 40, "0")
    whole = F.regexp_replace(F.substring(digits, 1, 40 - places), "^0+(?=.)", "")
    return F.regexp_replace(F.concat(whole, F.lit("."), F.right(digits, F.lit(places))), r"\.?0+$", "")


#: Fixed value: the wire grammar of exact decimals.
DECIMAL = r"\A(0|[1-9][0-9]{0,39})(\.[0-9]{1,30})?\z"


def is_decimal(text: Column) -> Column:
    """Whether a string is an exact decimal of at most 40 digits."""
    return F.coalesce(F.regexp_like(text, F.lit(DECIMAL)) & (F.length(F.regexp_replace(text, r"\.", "")) <= 40), F.lit(False))


def timer_round(x: Column, resolution: Column) -> Column:
    """Nearest multiple of the resolution, halves up."""
    half = ((resolution - resolution % 2) / 2).cast("bigint")
    shifted = x + half
    return (shifted - shifted % resolution).cast("bigint")
