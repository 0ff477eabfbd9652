"""Queries over JSON documents: `.path`, `.path AS name`, `.path OP value`, joined by &.

Comparison follows SQL: a path that a document lacks satisfies no condition, and numbers compare as numbers, text as text. Values may be sums, differences or products of integers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.syntax import Json, PolicyError

_ITEM = re.compile(r"(?P<path>\.[\w.\[\]]*)(?:\s+(?:(?P<op>==|!=|<=|>=|<|>|=)\s+(?P<value>.+)|AS\s+(?P<name>\w+)))?", re.DOTALL)


def _value(text: str) -> object:
    text = text.strip()
    if re.fullmatch(r"\".*\"|'.*'", text, re.DOTALL):
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d+\.\d+", text):
        return float(text)
    parts = re.fullmatch(r"(-?\d+)((?:\s*[-+*]\s*\d+)+)", text)
    if not parts:
        raise PolicyError(f"no value: {text}")
    total, term = 0, int(parts[1])
    for op, number in re.findall(r"([-+*])\s*(\d+)", parts[2]):
        if op == "*":
            term *= int(number)
        else:
            total, term = total + term, int(op + number)
    return total + term


def parse_json_query(text: str) -> Json:
    """The outputs are the paths without a condition; without any, the whole document. Unnamed outputs are called after the last name of their path, two or more of them make one JSON object."""
    outputs, conditions, named = [], [], False
    for item in re.split(r"\s+&\s+", text.strip()):
        m = _ITEM.fullmatch(item.strip())
        if not m:
            raise PolicyError(f"no JSON query: {item}")
        if m["op"]:
            conditions.append((m["path"], "=" if m["op"] == "==" else m["op"], _value(m["value"])))
        else:
            named |= bool(m["name"])
            last = re.findall(r"\w+", m["path"])
            outputs.append((m["path"], m["name"] or (last[-1] if last else "document")))
    as_object = len(outputs) > 1 and not named
    return Json(tuple(outputs or [(".", "document")]), tuple(conditions), as_object)


def spark_path(path: str) -> str:
    return "$" + (path if path != "." else "")


def extract(document: Column, path: str) -> Column:
    """The value at a path as text (objects and arrays as JSON), null where it is missing."""
    return document if path == "." else F.get_json_object(document, spark_path(path))


def condition(document: Column, path: str, op: str, value: object) -> Column:
    got = extract(document, path)
    if isinstance(value, bool):
        got, value = got, str(value).lower()
    elif isinstance(value, (int, float)):
        got = got.try_cast("double")
    compare = {"=": got == value, "!=": got != value, "<": got < value, "<=": got <= value, ">": got > value, ">=": got >= value}
    return compare[op]


def outputs(query: Json, document: Column) -> list[Column]:
    if query.as_object:
        return [F.to_json(F.struct(*[extract(document, p).alias(n) for p, n in query.outputs])).alias("object")]
    return [extract(document, p).alias(n) for p, n in query.outputs]
