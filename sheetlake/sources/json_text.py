"""Compact, readable JSON: a node stays on one line while that fits."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WIDTH = 200


def _line(x) -> str:
    if isinstance(x, dict) and x:
        return "{ " + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {_line(v)}" for k, v in x.items()) + " }"
    if isinstance(x, list):
        return "[" + ", ".join(map(_line, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def compact(x, indent: int = 2, depth: int = 0, width: int = WIDTH) -> str:
    line = _line(x)
    if not isinstance(x, (dict, list)) or not x or len(line) + indent * depth <= width:
        return line
    pad, end = " " * indent * (depth + 1), " " * indent * depth
    inner = [compact(v, indent, depth + 1, width) for v in (x.values() if isinstance(x, dict) else x)]
    if isinstance(x, dict):
        inner = [f"{json.dumps(k, ensure_ascii=False)}: {v}" for k, v in zip(x, inner)]
    a, b = "{}" if isinstance(x, dict) else "[]"
    return f"{a}\n" + ",\n".join(pad + v for v in inner) + f"\n{end}{b}"


@F.pandas_udf(StringType())
def compact_json(text: pd.Series) -> pd.Series:
    """JSON text laid out anew, with a newline at its end; null for null."""
    return text.map(lambda t: None if t is None else compact(json.loads(t)) + "\n")
