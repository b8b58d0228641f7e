"""Text functions of the deduplication and rendering steps."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Unicode normalization form C; Spark has no such function."""
    return F.pandas_udf(_nfc, "string")(text)


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def normalize(text: Column) -> Column:
    return collapse(nfc(text))


#: Letters whose full upper case is several characters, and the one that stands for each: that of
#: simple mapping, and the capital sharp s, which SQL's upper() gives.
_SIMPLE = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1} | {"ß": "ẞ"}
_SPECIAL = f"[{''.join(_SIMPLE)}]"
_PLAIN = re.compile(f"[^{_SPECIAL[1:]}+")


def upper(text: Column) -> Column:
    """Upper case by characters, each of which stays one; F.upper makes SS of ß."""
    parts = F.split(text, f"(?={_SPECIAL})|(?<={_SPECIAL})")
    mapped = F.transform(parts, lambda x: F.when(x.rlike(_SPECIAL), F.translate(x, "".join(_SIMPLE), "".join(_SIMPLE.values()))).otherwise(F.upper(x)))
    return F.when(text.rlike(_SPECIAL), F.array_join(mapped, "")).otherwise(F.upper(text))


def upper_of(text: str) -> str:
    """upper() inside a task."""
    return _PLAIN.sub(lambda x: x[0].upper(), text).translate(str.maketrans(_SIMPLE))


def words(text: Column) -> Column:
    """The distinct upper-case words: runs of letters and digits."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), upper))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def is_richer(text: Column, than: Column, size: Callable[[Column], Column] = utf16_length) -> Column:
    """Longer, and with all the words of the other."""
    return (size(text) > size(than)) & (F.size(F.array_except(words(than), words(text))) == 0)


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-16LE bytes, lower-case hex."""
    return F.sha2(F.encode(text, "UTF-16LE"), 256)


def bullet(text: Column) -> Column:
    """On one line: each line break becomes a space."""
    return F.regexp_replace(text, "\r\n|[\r\n\f\u0085\u2028\u2029]", " ")
