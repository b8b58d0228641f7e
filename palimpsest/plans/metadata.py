"""Values of JSON metadata as columns, with the exact text of numbers.

Spark's JSON functions turn numbers into doubles. So every string and number of a JSON text is
first made a string that tells them apart, by one regular expression: a string ends in a mark, a
number begins with one and doesn't end in it. Values then come from ``from_json`` over maps of
strings, where true, false, objects and arrays are their own JSON text and null is null.
"""

from __future__ import annotations

import json
from decimal import ROUND_FLOOR, Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.binding import let
from palimpsest.functions.numbers import NUMBER as _NUMBER
from palimpsest.functions.numbers import order_key, order_key_of

NULL, STRING, NUMBER, BOOLEAN, ARRAY, OBJECT = range(6)
#: Ends strings and begins numbers.
MARK = "\x01"


class Lexeme(str):
    """The text of a number."""


def strict_loads(text: str, depth: int = 64):
    """JSON with numbers as Lexeme; repeated keys, deep nesting and lone surrogates are errors."""

    def pairs(items):
        out = dict(items)
        if len(out) < len(items):
            raise ValueError("repeated property name")
        return out

    def checked(value, left: int) -> None:
        if left < 0:
            raise ValueError("nested too deeply")
        if isinstance(value, str):
            value.encode()
        elif isinstance(value, dict):
            for k, v in value.items():
                k.encode()
                checked(v, left - 1)
        elif isinstance(value, list):
            for v in value:
                checked(v, left - 1)

    def constant(name):
        raise ValueError(f"{name} is no JSON")

    out = json.loads(text, object_pairs_hook=pairs, parse_int=Lexeme, parse_float=Lexeme, parse_constant=constant)
    checked(out, depth)
    return out


def scalar(value) -> tuple[int, str | None, str | None]:
    """(kind, text, order key) of a JSON value."""
    if value is None:
        return NULL, None, None
    if isinstance(value, bool):
        return BOOLEAN, "true" if value else "false", None
    if isinstance(value, Lexeme):
        return NUMBER, None, order_key(value)
    if isinstance(value, str):
        return STRING, value, None
    return (ARRAY if isinstance(value, list) else OBJECT), None, None


def marked(text: Column) -> Column:
    """The JSON text with marks. Escaped quotes are written as code points first, so that a string
    ends at the next quote."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    return F.regexp_replace(plain, r'"([^"]*+)"|(-?\d++(?:\.\d++)?(?:[eE][+-]?\d++)?)', r'"$1\\u0001$2"')


def is_strict(text: Column, depth: int = 64) -> Column:
    """Whether a text may be stored as metadata: an object in valid JSON without repeated keys, nested
    at most so deeply. Null and blank texts stand for an empty object."""
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    steps = F.split(F.regexp_replace(F.regexp_replace(marked(text), '"[^"]*+"', ""), r"[^{}\[\]]", ""), "")
    level = lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))
    deepest = F.aggregate(steps, start, lambda s, c: let(s["at"] + level(c), lambda at: F.struct(at.alias("at"), F.greatest(s["most"], at).alias("most"))))["most"]
    blank = text.isNull() | ~text.rlike(r"\S")
    return blank | (whole & (deepest <= depth))


def value_at(text: Column, path: list[str]) -> Column:
    """The marked value at a path of keys, from marked(); null where it is null or isn't there."""
    def inside(key: str):
        return lambda t: F.from_json(F.when(F.ltrim(t).startswith("{"), t), "map<string,string>")[key + MARK]

    for key in path:
        text = let(text, inside(key))
    return text


def elements(value: Column) -> Column:
    """The marked elements of a value that is an array, else null."""
    return F.from_json(F.when(value.startswith("["), value), "array<string>")


def is_string(value: Column) -> Column:
    return value.endswith(MARK)


def string_of(value: Column) -> Column:
    return F.substring(value, 1, F.length(value) - 1)


#: A number of so many characters and no exponent is exact as a decimal of _SCALE digits below one.
_SHORT, _SCALE = 18, 18


def _floored(operand: str) -> tuple[Decimal | None, bool, int]:
    """A number's text rounded down to _SCALE digits below one, whether that is exact, and its sign;
    None where it is beyond all short numbers."""
    number = _NUMBER.fullmatch(operand)
    sign = -1 if number[1] else 1
    digits, power = (number[2] + (number[3] or "")).lstrip("0"), number[4] or "0"
    if not digits:
        return Decimal(0), True, 0
    lead = len(digits) - len(number[3] or "")  # digits before the point, without the exponent
    if len(power) > 6 or lead + int(power) > 19:
        return (None, False, sign) if not power.startswith("-") or lead + int(power[:7]) > 19 else (Decimal(0) if sign > 0 else Decimal(-1).scaleb(-_SCALE), False, sign)
    with localcontext() as context:
        context.prec = 2_000_000
        exact = Decimal(operand)
        down = exact.quantize(Decimal(1).scaleb(-_SCALE), rounding=ROUND_FLOOR)
        return down, down == exact, sign


def compare_number(value: Column, op: str, operand: str) -> Column:
    """Whether a value is a number that is eq, gt, gte, lt or lte another one, given by its text.
    Short numbers are compared as decimals, others by their order keys."""
    down, exact, sign = _floored(operand)
    tests = {"eq": Column.__eq__, "gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
    if down is None:  # beyond all short numbers
        short = lambda x: F.lit(op in (("lt", "lte") if sign > 0 else ("gt", "gte")))
    elif exact:
        short = lambda x: tests[op](x, F.lit(str(down)).cast(f"decimal(38,{_SCALE})"))
    else:  # no short number lies between the operand and its rounding
        rounded = {"gt": "gt", "gte": "gt", "lt": "lte", "lte": "lte"}.get(op)
        short = lambda x: tests[rounded](x, F.lit(str(down)).cast(f"decimal(38,{_SCALE})")) if rounded else F.lit(False)
    text = F.substring(value, 2, _SHORT + 1)
    is_short = (F.length(value) <= _SHORT + 1) & ~F.contains(F.lower(value), F.lit("e"))
    long = tests[op](order_key_of(F.substring(value, 2, F.length(value))), F.lit(order_key(operand)))
    return value.startswith(MARK) & ~is_string(value) & F.when(is_short, short(text.cast(f"decimal(38,{_SCALE})"))).otherwise(long)


def number_in(value: Column, operands: list[str]) -> Column:
    """Whether a value is a number that equals one of those given by their texts."""
    short = [str(down) for down, exact, _ in map(_floored, operands) if exact]
    is_short = (F.length(value) <= _SHORT + 1) & ~F.contains(F.lower(value), F.lit("e"))
    number = F.substring(value, 2, _SHORT + 1).cast(f"decimal(38,{_SCALE})")
    hit = number.isin([F.lit(x).cast(f"decimal(38,{_SCALE})") for x in short]) if short else F.lit(False)
    long = order_key_of(F.substring(value, 2, F.length(value))).isin([order_key(x) for x in operands])
    return value.startswith(MARK) & ~is_string(value) & F.when(is_short, hit).otherwise(long)


def marked_scalar(operand) -> str:
    """A string or a boolean as a marked value."""
    kind, text, _ = scalar(operand)
    return text + MARK if kind == STRING else text


def equal_to(value: Column, operand) -> Column:
    """Whether a marked value is the same as a scalar."""
    return compare_number(value, "eq", operand) if scalar(operand)[0] == NUMBER else value == marked_scalar(operand)
