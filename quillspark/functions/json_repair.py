"""Repair of JSON that a model wrote nearly right: one pass over its tokens with a stack."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TOKEN = re.compile(r'"(?:[^"\\]|\\.|\\\Z)*+"?|\'(?:[^\'\\]|\\.|\\\Z)*+\'?|[\[\]{},:]|[^\s\[\]{},:"\']+', re.S)
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_CLOSES = {"}": "{", "]": "["}
_WORDS = {"true": "true", "false": "false", "null": "null", "True": "true", "False": "false", "None": "null", "undefined": "null", "NaN": "null"}
_CONTROLS = {i: f"\\u{i:04x}" for i in range(32)} | {10: "\\n", 13: "\\r", 9: "\\t"}


def _string(token: str) -> str:
    """A string token as JSON: its quotes doubled, closed, its control characters escaped."""
    quote, body = token[0], token[1:]
    closed = len(token) > 1 and token[-1] == quote and not (len(body) - len(body[:-1].rstrip("\\"))) % 2 == 0
    body = body[:-1] if closed else body[:-1] if (len(body) - len(body.rstrip("\\"))) % 2 else body
    if quote == "'":
        body = re.sub(r"\\(.)|(\")", lambda m: '\\"' if m[2] or m[1] == '"' else "'" if m[1] == "'" else m[0], body, flags=re.S)
    return '"' + body.translate(_CONTROLS) + '"'


def repair(raw: str | None) -> str | None:
    """The first object or array in a text, without fences, with the commas, quotes and closing
    brackets that are missing, and without those too many; null if there is none. Linear in the text."""
    start = re.search(r"[\[{]", raw or "")
    if not start:
        return None
    out: list[str] = []
    stack: list[str] = []
    last, comma = "", False  # kind of the last token that was put out: open, value, colon; a comma waits
    for m in _TOKEN.finditer(raw, start.start()):
        token = m.group()
        if token == ",":
            comma = last == "value"
        elif token == ":":
            if last == "value" and stack and stack[-1] == "{":
                out.append(":")
                last, comma = "colon", False
        elif token in _CLOSES:
            if _CLOSES[token] not in stack:
                continue
            while True:
                if last == "colon":
                    out.append("null")
                top = stack.pop()
                out.append("}" if top == "{" else "]")
                last, comma = "value", False
                if top == _CLOSES[token]:
                    break
            if not stack:
                break
        else:
            if last == "value":  # with its comma, or where one is missing
                out.append(",")
            comma = False
            if token in "[{":
                stack.append(token)
                out.append(token)
                last = "open"
                continue
            if token[0] in "\"'":
                out.append(_string(token))
            else:
                out.append(_WORDS.get(token) or (token if _NUMBER.fullmatch(token) else json.dumps(token, ensure_ascii=False)))
            last = "value"
    while stack:
        if last == "colon":
            out.append("null")
        out.append("}" if stack.pop() == "{" else "]")
        last = "value"
    return "".join(out)


@F.pandas_udf(StringType())
def _repaired(raw: pd.Series) -> pd.Series:
    return raw.map(repair, na_action="ignore")


def repaired(raw: Column) -> Column:
    """As ``repair``; null where the result still cannot be read."""
    found = _repaired(raw.cast("string"))
    return F.when(F.try_parse_json(found).isNotNull(), found)
