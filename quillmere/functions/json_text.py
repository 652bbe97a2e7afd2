"""JSON objects out of a model's prose (SC21): the one place where text needs a parser of its own."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCED = re.compile(r"\A\s*```(?:json)?(.*?)(?:```\s*)?\Z", re.DOTALL | re.IGNORECASE)
#: A whole string, one cut off at the end, or a bracket.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|"(?:[^"\\]|\\.)*\\?\Z|[{}\[\]]', re.DOTALL)
_CLOSE = {"{": "}", "[": "]"}


def completed(text: str) -> str:
    """A cut-off JSON text with its open string and brackets closed."""
    open_, tail = [], ""
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token in _CLOSE:
            open_.append(_CLOSE[token])
        elif token in "}]":
            if open_ and open_[-1] == token:
                open_.pop()
        elif m.end() == len(text) and (len(token) == 1 or not re.fullmatch(r'"(?:[^"\\]|\\.)*"', token, re.DOTALL)):
            tail = '""' if re.search(r'(?<!\\)(?:\\\\)*\\\Z', token) else '"'
    return text + tail + "".join(reversed(open_))


def first_object(text: str | None) -> str | None:
    """The first JSON object in a text, as compact JSON: whole if there is one, else completed; None if neither."""
    if not text:
        return None
    fenced = _FENCED.match(text)
    text = (fenced[1] if fenced else text).strip()
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text, m.start())
            return json.dumps(found, ensure_ascii=False)
        except json.JSONDecodeError:
            continue
    at = text.find("{")
    if at >= 0:
        try:
            found = json.loads(completed(text[at:]))
            return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None
        except json.JSONDecodeError:
            return None
    return None


@F.pandas_udf(StringType())
def _parsed(texts: pd.Series) -> pd.Series:
    return texts.map(first_object, na_action="ignore")


def parsed(text: Column) -> Column:
    """SC21 as a column; read it on with from_json."""
    return _parsed(text)
