"""JSON numbers of any size as strings that sort like the numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.binding import let

#: The text of a JSON number: sign, digits, digits below one, exponent.
NUMBER = re.compile(r"(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?\Z")
_FLIP = str.maketrans("0123456789", "9876543210")


def _exponent(value: int) -> str:
    """Sorts like the exponent: its sign, its number of digits, its digits; all mirrored below 0."""
    digits = str(abs(value))
    body = f"{len(digits):06d}{digits}"
    return "7" + body if value >= 0 else "3" + body.translate(_FLIP)


def order_key(text: str) -> str:
    """The key of a JSON number's text. Keys are equal where the numbers are (1, 1.0, 10e-1) and
    compare as bytes like the numbers do, whatever their size."""
    if not (m := NUMBER.match(text)):
        raise ValueError(f"not a JSON number: {text[:40]}")
    sign, whole, fraction, power = m[1], m[2], m[3] or "", int(m[4] or 0)
    digits = (whole + fraction).lstrip("0")
    if not digits:
        return "5"
    exponent = power + len(whole) - 1 - (len(whole + fraction) - len(digits))
    body = _exponent(exponent) + digits.rstrip("0")
    return "2" + body.translate(_FLIP) + "~" if sign else "8" + body


def order_key_of(text: Column) -> Column:
    """order_key() of a column; null where the text is no number. Exponents of more than 37 digits
    aren't told apart from each other."""
    shape = r"^(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?$"
    flip = lambda x: F.translate(x, "0123456789", "9876543210")

    def of_parts(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, shape, i)
        power = F.when(F.contains(F.lower(t), F.lit("e")), F.regexp_replace(part(4), r"^([+-]?)0+(?=\d)", "$1")).otherwise("0")
        return F.struct(part(1).alias("sign"), F.length(part(2)).alias("whole"), F.concat(part(2), part(3)).alias("every"), power.alias("power"))

    def of_digits(x: Column) -> Column:
        huge = F.rpad(F.regexp_extract(x["power"], "^(-?)", 1), 38, "9")
        power = F.when(F.length(x["power"]) > 37, huge).otherwise(x["power"]).cast("decimal(38,0)")
        return let(F.ltrim(x["every"], F.lit("0")), lambda digits: F.struct(x["sign"].alias("sign"), digits.alias("digits"), (power + x["whole"] - 1 - (F.length(x["every"]) - F.length(digits))).cast("decimal(38,0)").alias("exponent")))

    def of_exponent(x: Column) -> Column:
        size = let(F.abs(x["exponent"]).cast("string"), lambda n: F.concat(F.lpad(F.length(n).cast("string"), 6, "0"), n))
        body = F.concat(let(size, lambda n: F.when(x["exponent"] >= 0, F.concat(F.lit("7"), n)).otherwise(F.concat(F.lit("3"), flip(n)))), F.rtrim(x["digits"], F.lit("0")))
        return F.when(x["digits"] == "", "5").otherwise(let(body, lambda b: F.when(x["sign"] == "-", F.concat(F.lit("2"), flip(b), F.lit("~"))).otherwise(F.concat(F.lit("8"), b))))

    key = lambda t: let(of_parts(t), lambda x: let(of_digits(x), of_exponent))
    return let(text, lambda t: F.when(F.regexp_like(t, F.lit(shape)), key(t)))
