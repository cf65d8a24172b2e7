"""Strict JSON text checks that SQL functions cannot make: one Arrow UDF returning a defect code."""

from __future__ import annotations

import json
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# these helpers travel with the task, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Default parse limits and the largest safe integer.
MAXIMUM_BYTES = 131_072
MAXIMUM_DEPTH = 32
MAXIMUM_VALUES = 100_000
SAFE_INTEGER = 9007199254740991


class _Defect(Exception):
    pass


def _object(pairs):
    names = [name for name, _ in pairs]
    if len(set(names)) != len(names):
        raise _Defect("json.duplicate_key")
    return dict(pairs)


def _integer(text: str) -> int:
    if text == "-0" or len(text) > 17 or abs(int(text)) > SAFE_INTEGER:
        raise _Defect("json.non_integer_number")
    return int(text)


def _fraction(text: str):
    raise _Defect("json.non_integer_number")


def _constant(text: str):
    raise _Defect("json.literal")


def _decoder() -> json.JSONDecoder:
    return json.JSONDecoder(
        object_pairs_hook=_object, parse_int=_integer, parse_float=_fraction, parse_constant=_constant
    )


def _check_values(root) -> None:
    level, depth, seen = [root], 0, 0
    while level:
        seen += len(level)
        if seen > MAXIMUM_VALUES:
            raise _Defect("json.value_count")
        if depth > MAXIMUM_DEPTH:
            raise _Defect("json.depth")
        below = []
        for value in level:
            if isinstance(value, str):
                if any("\ud800" <= ch <= "\udfff" for ch in value):
                    raise _Defect("json.unpaired_surrogate")
                if not unicodedata.is_normalized("NFC", value):
                    raise _Defect("json.non_nfc_string")
            elif isinstance(value, dict):
                seen -= len(value)  # names are checked as strings but are not values
                below.extend(value)
                below.extend(value.values())
            elif isinstance(value, list):
                below.extend(value)
        level, depth = below, depth + 1


def _canonical(value) -> str:
    if isinstance(value, dict):
        names = sorted(value, key=lambda name: name.encode("utf-16-be"))
        return "{" + ",".join(_canonical(name) + ":" + _canonical(value[name]) for name in names) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def defect_code(text: str | None, decoder: json.JSONDecoder | None = None, maximum_bytes: int = MAXIMUM_BYTES) -> str | None:
    """The first defect of one JSON text, or None when it is canonical."""
    if text is None:
        return "json.input"
    if len(text.encode("utf-8", "surrogatepass")) > maximum_bytes:
        return "json.byte_length"
    if text.startswith("\ufeff"):
        return "json.bom"
    try:
        value, end = (decoder or _decoder()).raw_decode(text.lstrip(" \t\n\r"))
        if text.lstrip(" \t\n\r")[end:].strip(" \t\n\r"):
            return "json.trailing_data"
        _check_values(value)
    except _Defect as defect:
        return str(defect)
    except RecursionError:
        return "json.depth"
    except json.JSONDecodeError as error:
        if "control character" in error.msg:
            return "json.control_character"
        return "json.syntax"
    return None if _canonical(value) == text else "json.noncanonical"


@F.pandas_udf(StringType())
def json_defect(texts: pd.Series) -> pd.Series:
    decoder = _decoder()
    return texts.map(lambda text: defect_code(text, decoder))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC: Spark has no built-in normalisation."""
    return texts.map(lambda text: None if text is None else unicodedata.normalize("NFC", text))
