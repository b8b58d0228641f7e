"""The filter language: a JSON object becomes one boolean column.

Logic is two-valued: an operator is false for a value that isn't set, ``ne`` and NOT are true. The
column may be null where it stands for false, which is the same to ``where``; only what is negated
is made false first, so that all other conditions can be pushed down to the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from decimal import Decimal, localcontext
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.binding import let
from palimpsest.functions.levels import LEVELS, level_name
from palimpsest.functions.text import upper
from palimpsest.plans.metadata import BOOLEAN, NUMBER, STRING, Lexeme, compare_number, elements, equal_to, is_string, marked, marked_scalar, number_in, scalar, strict_loads, string_of, value_at

#: Fixed: operator names, the longest list, and the format's largest count; field names below are too.
OPERATORS = ("gt", "gte", "lt", "lte", "ne", "in", "contains", "icontains")
ORDER = ("gt", "gte", "lt", "lte")
MOST_ITEMS = 1_000
#: Operands beyond this size are beyond every stored count.
_DECIMAL_LIMIT = 79228162514264337593543950335
_COUNT = re.compile(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\Z")
_TIMESTAMP = re.compile(r"(\d{4}-\d\d-\d\d)(?:T(\d\d:\d\d)(?::(\d\d)(?:\.(\d{1,7}))?)?(Z|[+-]\d\d:\d\d)?)?\Z", re.ASCII)


class FilterError(ValueError):
    """The filter is malformed, or an operand doesn't suit its field."""


@dataclass(frozen=True)
class Field:
    """A filterable field: its type (text, number, time, bool or meta) and its column. ``members``:
    the column is an array of struct(peer, active), and some active member has to match. With
    ``asked``, members are rows of their own: each test of a member's column is put there, and
    stands in the condition as a column of that number."""

    type: str
    column: str
    members: bool = False
    asked: list | None = None


_NAMED = {"id": Field("text", "name"), "created_at": Field("time", "created_at"), "metadata": Field("meta", "metadata")}
RESOURCES: dict[str, dict[str, Field]] = {
    "workspace": {**_NAMED, "name": Field("text", "name")},
    "peer": {**_NAMED, "peer_id": Field("text", "name")},
    "session": {**_NAMED, "session_id": Field("text", "name"), "is_active": Field("bool", "is_active"), "peer_id": Field("text", "members", members=True)},
    "message": {"id": Field("text", "id"), "session_id": Field("text", "session"), "peer_id": Field("text", "peer"), "content": Field("text", "content"), "token_count": Field("number", "token_count"), "created_at": Field("time", "created_at"), "metadata": Field("meta", "metadata")},
    # level is asked for by the library itself, by its wire name
    "conclusion": {"id": Field("text", "id"), "level": Field("level", "level"), "observer_id": Field("text", "observer"), "observed_id": Field("text", "observed"), "session_id": Field("text", "session"), "created_at": Field("time", "created_at")},
}


def compile_filter(request: str | None, resource: str, fields: dict[str, Field] | None = None) -> Column:
    """The condition of a filter's JSON text; null, blank, ``null`` and ``{}`` match all. Fields
    that the resource (or ``fields``) doesn't have are ignored."""
    if request is None or not request.strip():
        return F.lit(True)
    try:
        root = strict_loads(request)
    except ValueError as error:
        raise FilterError(f"no valid JSON: {error}") from error
    if root is None:
        return F.lit(True)
    if not isinstance(root, dict):
        raise FilterError("a filter is an object")
    return _object(root, RESOURCES[resource] if fields is None else fields)


#: The column of the answer to a test of members.
ASKED = "_asked{}"


def compile_session_filter(request: str | None) -> tuple[Column, list[Callable[[Column], Column]]]:
    """The condition of a filter on sessions, and the tests of active members' names that it needs
    the answers to, as columns ASKED by number: whether some active member passes."""
    asked: list[Callable[[Column], Column]] = []
    fields = RESOURCES["session"] | {"peer_id": Field("text", "peer", members=True, asked=asked)}
    return compile_filter(request, "session", fields), asked


def _all(parts: list[Column]) -> Column:
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def _any(parts: list[Column]) -> Column:
    return reduce(Column.__or__, parts) if parts else F.lit(False)


def _object(node: dict, fields: dict[str, Field]) -> Column:
    parts = []
    for key, value in node.items():
        if key in ("AND", "OR", "NOT"):
            if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
                raise FilterError(f"{key} takes a list of filter objects")
            children = [_object(x, fields) for x in value]
            parts.append(_all(children) if key == "AND" else _any(children) if key == "OR" else _not(_any(children)))
        elif key in fields:
            parts.append(_metadata(value, fields[key].column) if fields[key].type == "meta" else _field(key, fields[key], value))
    return _all(parts)


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _on(field: Field, test: Callable[[Column], Column]) -> Column:
    """Whether the field's value, or some active member, passes."""
    if field.type == "level":
        return test(level_name(F.col(field.column)))
    if not field.members:
        return test(F.col(field.column))
    if field.asked is not None:
        field.asked.append(test)
        return F.col(ASKED.format(len(field.asked) - 1))
    return F.exists(field.column, lambda x: x["active"] & _known(test(x["peer"])))


def _not(condition: Column) -> Column:
    return ~_known(condition)


def _unset(field: Field) -> Column:
    return _not(_on(field, Column.isNotNull)) if field.members else F.col(field.column).isNull()


def _field(name: str, field: Field, value) -> Column:
    if value is None:
        return _unset(field)
    if isinstance(value, list):
        return _in(name, field, value)
    if isinstance(value, dict):
        if not value:
            raise FilterError(f"{name}: an empty operator object")
        return _all([_operator(name, field, op, operand) for op, operand in value.items()])
    if value == "*" and not isinstance(value, Lexeme):
        return F.lit(True)
    return _compare(name, field, "eq", value)


def _operator(name: str, field: Field, op: str, operand) -> Column:
    if op not in OPERATORS:
        raise FilterError(f"{name}: unknown operator {op}")
    if (op == "in" and field.type == "bool") or ("contains" in op and field.type not in ("text", "level")) or (op in ORDER and field.type not in ("number", "time")):
        raise FilterError(f"{name}: {op} isn't for this field")
    if op == "in":
        if not isinstance(operand, list):
            raise FilterError(f"{name}: in takes a list")
        return _in(name, field, operand)
    if operand is None:
        if op == "ne":
            return _on(field, Column.isNotNull)
        raise FilterError(f"{name}: {op} doesn't take null")
    return _compare(name, field, op, operand)


def _in(name: str, field: Field, items: list) -> Column:
    if field.type == "bool":
        raise FilterError(f"{name}: no lists for this field")
    if len(items) > MOST_ITEMS:
        raise FilterError(f"{name}: a list of {len(items)} items")
    if any(x == "*" and not isinstance(x, Lexeme) for x in items):
        return F.lit(True)
    values = [_operand(name, field, x) for x in items if x is not None]
    literals = [v for v, beyond in values if not beyond]
    if field.type == "level":  # numbers are compared, so that the scan can skip
        return F.col(field.column).isin([LEVELS.index(x) for x in items if x in LEVELS])
    found = _on(field, lambda c: c.isin(literals)) if literals else F.lit(False)
    return found | _unset(field) if None in items else found


def _compare(name: str, field: Field, op: str, raw) -> Column:
    value, beyond = _operand(name, field, raw)
    if field.type == "level" and op in ("eq", "ne"):  # names of no level equal none
        same = F.col(field.column) == LEVELS.index(raw) if raw in LEVELS else F.lit(False)
        return ~same if op == "ne" else same
    if beyond and field.type == "number":  # every stored count lies on one side of it
        return F.lit(op == "ne" or op in (("lt", "lte") if beyond > 0 else ("gt", "gte")))
    if beyond:  # a time between two microseconds
        op = {"eq": "none", "ne": "all", "gte": "gt", "lt": "lte"}.get(op, op)
    tests = {
        "eq": lambda c: c == value, "ne": lambda c: c == value, "gt": lambda c: c > value, "gte": lambda c: c >= value, "lt": lambda c: c < value, "lte": lambda c: c <= value,
        "contains": lambda c: F.contains(c, value), "icontains": lambda c: F.contains(upper(c), upper(value)), "none": lambda c: F.lit(False),
    }
    if op == "all":
        return F.lit(True)
    return _not(_on(field, tests[op])) if op == "ne" else _on(field, tests[op])


def _operand(name: str, field: Field, raw) -> tuple[Column | None, int]:
    """The literal of an operand, and whether it lies beyond (1, -1: a count too large or too
    small; 1: a time with tenths of a microsecond, whose literal is cut)."""
    if field.type in ("text", "level") and isinstance(raw, str) and not isinstance(raw, Lexeme):
        return F.lit(str(raw)), 0
    if field.type == "bool" and isinstance(raw, bool):
        return F.lit(raw), 0
    if field.type == "number" and isinstance(raw, str) and (isinstance(raw, Lexeme) or re.fullmatch(r"[+-]?[0-9]+", raw)) and _COUNT.match(raw):
        return _count(name, raw)
    if field.type == "time" and isinstance(raw, str) and not isinstance(raw, Lexeme) and (m := _TIMESTAMP.match(raw)):
        return _time(name, m)
    raise FilterError(f"{name}: an operand of the wrong type")


def _count(name: str, raw: str) -> tuple[Column | None, int]:
    mantissa, _, power = raw.lower().partition("e")
    whole, _, fraction = mantissa.lstrip("+-").partition(".")
    digits = (whole + fraction).rstrip("0")
    sign = -1 if raw.startswith("-") else 1
    if not digits.strip("0"):
        return F.lit(Decimal(0)).cast("decimal(38,0)"), 0
    if len(digits) > len(whole) + int(power or 0):
        raise FilterError(f"{name}: not an integral number")
    if len(digits.lstrip("0")) > 60 or len(whole) + int(power or 0) > 60 + len(digits) - len(digits.lstrip("0")):
        return None, sign
    with localcontext() as context:
        context.prec = 200
        value = int(Decimal(raw))
    return (None, sign) if abs(value) > _DECIMAL_LIMIT else (F.lit(str(value)).cast("decimal(38,0)"), 0)


def _time(name: str, m: re.Match) -> tuple[Column, int]:
    date, minute, second, fraction, zone = m.groups()
    try:
        at = datetime.fromisoformat(f"{date}T{minute or '00:00'}:{second or '00'}{'+00:00' if zone in (None, 'Z') else zone}").astimezone(UTC)
    except (ValueError, OverflowError) as error:
        raise FilterError(f"{name}: no such time") from error
    tenths = int((fraction or "0").ljust(7, "0"))
    at += timedelta(microseconds=tenths // 10)
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz"), int(tenths % 10 > 0)


# Metadata: conditions over the JSON text.


def _metadata(value, column: str) -> Column:
    if value is None:
        return F.lit(False)
    if value == "*" and not isinstance(value, Lexeme):
        return F.lit(True)
    if not isinstance(value, dict):
        raise FilterError("metadata takes an object")
    parts = []
    for key, operand in value.items():
        if key == "contains":
            if not isinstance(operand, dict):
                raise FilterError("contains on metadata takes an object")
            parts.append(_all([_key(column, [k], v) for k, v in operand.items()]))
        elif key in OPERATORS:
            raise FilterError(f"{key} can't be applied to all metadata")
        else:
            parts.append(_key(column, [key], operand))
    return _all(parts)


def _entry(column: str, path: list[str], test: Callable[[Column], Column]) -> Column:
    return let(value_at(marked(F.col(column)), path), test)


def _holds(value: Column, operand) -> Column:
    return F.exists(elements(value), lambda x: _known(equal_to(x, operand)))


def _key(column: str, path: list[str], value) -> Column:
    """The condition on the value at a path, which is parsed once for all of its operators."""
    if isinstance(value, dict):
        operators = sum(k in OPERATORS for k in value)
        if not value or 0 < operators < len(value):
            raise FilterError(f"{path}: an empty object, or operators among keys")
        if not operators:
            return _all([_key(column, [*path, k], v) for k, v in value.items()])
        tests = [_key_operator(path, op, x) for op, x in value.items()]
        return _entry(column, path, lambda v: _all([_known(test(v)) for test in tests]))
    if value is None:
        return _entry(column, path, Column.isNull)
    if isinstance(value, list):
        if not value or len(value) > MOST_ITEMS:
            raise FilterError(f"{path}: a list of {len(value)} items")
        wanted = [_scalar(path, x) for x in value]
        return _entry(column, path, lambda v: _known(_all([_holds(v, w) for w in wanted])))
    if value == "*" and not isinstance(value, Lexeme):
        return _entry(column, path, Column.isNotNull)
    return _entry(column, path, lambda v: _known(equal_to(v, value)))


def _scalar(path: list[str], value, kinds: tuple[int, ...] = (STRING, NUMBER, BOOLEAN)):
    if scalar(value)[0] not in kinds:
        raise FilterError(f"{path}: an operand of the wrong type")
    return value


def _key_operator(path: list[str], op: str, operand) -> Callable[[Column], Column]:
    """The test of a marked value that an operator means."""
    if op == "ne":
        if operand is None:
            return Column.isNotNull
        wanted = _scalar(path, operand)
        return lambda v: _not(equal_to(v, wanted))
    if op == "in":
        if not isinstance(operand, list) or len(operand) > MOST_ITEMS:
            raise FilterError(f"{path}: in takes a list of up to {MOST_ITEMS} items")
        if any(x == "*" and not isinstance(x, Lexeme) for x in operand):
            return Column.isNotNull
        items = [_scalar(path, x) for x in operand if x is not None]
        numbers, others = [x for x in items if scalar(x)[0] == NUMBER], [marked_scalar(x) for x in items if scalar(x)[0] != NUMBER]

        def among(v: Column) -> Column:
            found = [number_in(v, numbers)] * bool(numbers) + [v.isin(others)] * bool(others) + [v.isNull()] * (None in operand)
            return _any([_known(x) for x in found])

        return among
    if op in ("contains", "icontains"):
        text = F.lit(str(_scalar(path, operand, (STRING,))))
        fold = upper if op == "icontains" else lambda c: c
        inside = lambda v: is_string(v) & F.contains(fold(string_of(v)), fold(text))
        listed = lambda v: F.exists(elements(v), lambda x: _known(is_string(x) & (fold(string_of(x)) == fold(text))))
        return lambda v: _known(inside(v)) | _known(listed(v))
    kind, text, _ = scalar(_scalar(path, operand, (NUMBER, STRING)))
    if kind == NUMBER:
        return lambda v: compare_number(v, op, operand)
    tests = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
    return lambda v: is_string(v) & tests[op](F.encode(string_of(v), "UTF-16BE"), F.encode(F.lit(text), "UTF-16BE"))
