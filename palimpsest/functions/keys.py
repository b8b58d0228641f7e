"""Keys, backoff, validation and layered configuration."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids: fixed format.
ID_PATTERN = r"\A[A-Za-z0-9_-]{1,512}\z"
_PLAIN = r"\A[A-Za-z0-9_-]{1,128}\z"
_EPOCH, _FIRST, _LAST = "1970-01-01 00:00:00", "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"
_SLOT = re.compile(r"\{\{([A-Za-z][A-Za-z0-9_]*)\}\}")


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike(ID_PATTERN), F.lit(False))


def valid_content(text: Column, most: int = 25_000) -> Column:
    """Not blank and at most so many code points."""
    return F.coalesce((F.length(text) <= most) & text.rlike(r"(?U)\S"), F.lit(False))


def key_part(value: Column) -> Column:
    """A component of a work unit key; one that is long or has other characters is hashed, by its
    UTF-16LE bytes."""
    return F.when(value.rlike(_PLAIN), value).otherwise(F.concat(F.lit("~"), F.substring(F.sha2(F.encode(value, "UTF-16LE"), 256), 1, 32)))


def work_unit_key(workspace: Column, session: Column, peer: Column) -> Column:
    """Items with this key are worked on one after the other."""
    return F.concat_ws(":", F.lit("representation"), key_part(workspace), key_part(session), key_part(peer))


def backoff_seconds(attempts: Column, first: float = 5.0, most: float = 300.0, jitter: float = 0.0, seed: int = 0) -> Column:
    """Doubles with each attempt up to ``most``; jitter is a share of it, either way."""
    base = F.least(F.lit(float(first)) * F.pow(F.lit(2.0), attempts - 1), F.lit(float(most)))
    return base * (1 + (F.rand(seed) * 2 - 1) * jitter) if jitter else base


def clamped_add(at: Column, microseconds: Column) -> Column:
    """A time (timestamp_ntz) some microseconds later, or earlier; beyond the years 1 to 9999 it is
    the first or the last time."""
    ntz = lambda x: F.to_timestamp_ntz(F.lit(x))
    since = lambda x: F.timestamp_diff("MICROSECOND", ntz(_EPOCH), x)
    later = since(at).cast("decimal(38,0)") + microseconds.cast("decimal(38,0)")
    kept = F.greatest(F.least(later, since(ntz(_LAST)).cast("decimal(38,0)")), since(ntz(_FIRST)).cast("decimal(38,0)"))
    return F.timestamp_add("MICROSECOND", kept.cast("bigint"), ntz(_EPOCH))


def public_id(*parts: Column) -> Column:
    """An id of 21 characters (A-Z, a-z, 0-9, _ and -) that follows from the parts."""
    named = F.to_json(F.array(*[p.cast("string") for p in parts]))
    return F.translate(F.substring(F.base64(F.unhex(F.sha2(named, 256))), 1, 21), "+/", "-_")


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template with its slots ``{{name}}`` filled in, once; what is filled in isn't looked at
    again. Raises ValueError where a slot has no value."""
    parts = _SLOT.split(template)
    if missing := sorted(set(parts[1::2]) - set(values)):
        raise ValueError(f"no values for {', '.join(missing)}")
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def resolve(*layers: tuple[str, Column]) -> Column:
    """The first layer (name, value) that is set, as struct(value, source); both null if none."""
    value = F.coalesce(*[c for _, c in layers])
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in layers])
    return F.struct(value.alias("value"), source.alias("source"))


def json_flag(raw: Column, key: str) -> Column:
    """A member of a JSON object if it is true or false, else null (not "true", not 1)."""
    found = F.try_parse_json(raw)
    return F.when(F.schema_of_variant(F.try_variant_get(found, f"$.{key}", "variant")) == "BOOLEAN", F.try_variant_get(found, f"$.{key}", "boolean"))


def canonical_json(text: str) -> str:
    """Object keys in ordinal order, number texts and repeated keys kept."""

    class Number(str):
        pass

    def write(value) -> str:
        if isinstance(value, Number):
            return str(value)
        if isinstance(value, tuple):
            pairs = sorted(value[0], key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
            return "{" + ",".join(f"{json.dumps(k)}:{write(v)}" for k, v in pairs) + "}"
        if isinstance(value, list):
            return "[" + ",".join(map(write, value)) + "]"
        return json.dumps(value)

    return write(json.loads(text, object_pairs_hook=lambda pairs: (pairs,), parse_int=Number, parse_float=Number))


def request_hash(method: str, route: str, values: list[str], body: str) -> str:
    """SHA-256 over length-prefixed parts, so that no two requests run together."""
    digest = hashlib.sha256()
    for part in (method, route, *values, canonical_json(body) if body else ""):
        raw = part.encode()
        digest.update(len(raw).to_bytes(8, "big") + raw)
    return digest.hexdigest()
