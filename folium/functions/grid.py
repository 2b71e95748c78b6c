"""Spreadsheet addresses, numbers, units and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_letters(index: Column) -> Column:
    """A, B, .. Z, AA .. XFD for 0 .. 16383."""
    at = lambda n: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (n % 26 + 1).cast("int"), F.lit(1))
    second, third = F.floor((index - 26) / 26), F.floor((index - 702) / 676)
    return F.concat(F.when(index >= 702, at(third)).otherwise(""), F.when(index >= 26, at(second)).otherwise(""), at(index))


def a1(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), (row + 1).cast("string"))


def _letters(ref: Column) -> Column:
    letters = F.upper(F.regexp_extract(ref, r"^([A-Za-z]{1,6})([0-9]{1,9})\z", 1))
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 64)


def a1_col(ref: Column) -> Column:
    """Column of an address from 0; 0 if malformed."""
    return F.greatest(_letters(ref) - 1, F.lit(0))


def a1_row(ref: Column) -> Column:
    digits = F.regexp_extract(ref, r"^([A-Za-z]{1,6})([0-9]{1,9})\z", 2)
    return F.when(digits == "", 0).otherwise(F.greatest(F.coalesce(digits.try_cast("long"), F.lit(1)) - 1, F.lit(0))).cast("long")


def number_text(value: Column) -> Column:
    """Integers without a point, others rounded to ten places, plain digits up to 1e15; empty if not finite."""
    rounded = F.floor(value * 1e10 + 0.5) / 1e10
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", rounded), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    whole = F.format_string("%.0f", value)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(~finite, "").when(value == F.floor(value), F.when(value == 0, "0").otherwise(whole)).otherwise(text)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def twips_px(twips: Column) -> Column:
    return half_up(twips * 96 / 1440)


def emu_px(emu: Column) -> Column:
    return half_up(emu / 9525)


def tint(hex_colour: Column, by: Column) -> Column:
    """RRGGBB lightened (by > 0) or darkened."""
    channel = lambda i: F.conv(F.substring(hex_colour, i, 2), 16, 10).cast("double")
    moved = lambda c: F.when(by < 0, c * (1 + by)).otherwise(c + (255 - c) * by)
    two = lambda c: F.lpad(F.lower(F.hex(F.least(F.greatest(half_up(moved(c)), F.lit(0)), F.lit(255)).cast("long"))), 2, "0")
    return F.concat(two(channel(1)), two(channel(3)), two(channel(5)))


def resolve_path(base: Column, target: Column) -> Column:
    """target from the folder of base, with . and .. taken up; a leading / starts at the root."""
    folder = F.regexp_extract(base, r"^(.*)/[^/]*$", 1)
    whole = F.when(target.startswith("/"), target).otherwise(F.concat(folder, F.lit("/"), target))
    step = lambda s, x: F.when((x == "") | (x == "."), s).when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x)))
    return F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")


def rels_path(part: Column) -> Column:
    return F.regexp_replace(part, r"^(.*?)([^/]*)$", "$1_rels/$2.rels")


def rk_number(rk: Column) -> Column:
    """Value of a 32-bit packed number given as long: bit 0 divides by 100, bit 1 marks a 30-bit integer."""
    signed = F.when(rk >= 2**31, rk - 2**32).otherwise(rk)
    whole = F.shiftright(signed, 2).cast("double")
    # The other form is the high half of a double: sign, exponent, and 18 bits of fraction.
    sign = F.when(rk >= 2**31, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(rk.cast("long"), 20).bitwiseAND(0x7FF), rk.cast("long").bitwiseAND(0xFFFFC) / F.lit(float(2**20))
    real = F.when(exponent == 0, sign * fraction * 2.0**-1022).otherwise(sign * (1 + fraction) * F.pow(F.lit(2.0), exponent - 1023))
    value = F.when(rk.cast("long").bitwiseAND(2) != 0, whole).otherwise(real)
    return F.when(rk.cast("long").bitwiseAND(1) != 0, value / 100).otherwise(value)
