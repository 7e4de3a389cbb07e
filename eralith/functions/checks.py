"""Checks of arguments. Each returns the value, or raises with the argument's name."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame


def _fail(name: str, want: str, got: Any) -> None:
    raise ValueError(f"{name} must be {want}, not {got!r}")


def _sized(values: list, name: str, length: int | None, least: int | None) -> None:
    if length is not None and len(values) != length:
        _fail(name, f"of length {length}", len(values))
    if least is not None and len(values) < least:
        _fail(name, f"of length {least} or more", len(values))


def assert_class(x: Any, classes: type | tuple[type, ...], name: str = "x", null: bool = False) -> Any:
    if not (x is None and null) and not isinstance(x, classes):
        _fail(name, f"of {classes}", x)
    return x


def assert_character(x: Any, name: str = "x", length: int | None = None, least: int | None = None, null: bool = False, na: bool = False) -> Any:
    """A text or a list of texts."""
    if x is None and null:
        return x
    values = [x] if isinstance(x, str) or x is None else list(x) if isinstance(x, Iterable) else [x]
    if not all(isinstance(v, str) or (v is None and na) for v in values):
        _fail(name, "text", x)
    _sized(values, name, length, least)
    return x


def assert_choice(x: Any, choices: Sequence, name: str = "x", null: bool = False) -> Any:
    values = [] if x is None and null else x if isinstance(x, list | tuple) else [x]
    for v in values:
        if v not in choices:
            _fail(name, f"one of {', '.join(map(str, choices))}", v)
    return x


def assert_date(x: Any, name: str = "x", null: bool = False) -> Any:
    if not (x is None and null) and not isinstance(x, dt.date):
        _fail(name, "a date", x)
    return x


def assert_list(x: Any, name: str = "x", of: type | None = None, length: int | None = None, null: bool = False) -> Any:
    if x is None and null:
        return x
    if not isinstance(x, list | tuple) or (of is not None and not all(isinstance(v, of) for v in x)):
        _fail(name, f"a list of {of.__name__}" if of else "a list", x)
    _sized(list(x), name, length, None)
    return x


def assert_logical(x: Any, name: str = "x", null: bool = False) -> Any:
    if not (x is None and null) and not isinstance(x, bool):
        _fail(name, "true or false", x)
    return x


def assert_numeric(x: Any, name: str = "x", low: float = -math.inf, high: float = math.inf, integer: bool = False, null: bool = False) -> Any:
    values = [] if x is None and null else x if isinstance(x, list | tuple) else [x]
    for v in values:
        if isinstance(v, bool) or not isinstance(v, int | float) or not low <= v <= high or (integer and v != int(v)):
            _fail(name, f"{'an integer' if integer else 'a number'} from {low} to {high}", v)
    return x


def assert_true(x: bool, message: str = "must be true") -> None:
    if x is not True:
        raise ValueError(message)


def assert_table_columns(df: DataFrame, columns: Iterable[str], name: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df
