"""JSON out of model replies: fenced blocks, or the first balanced object."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def balanced_objects(text: str) -> Iterator[str]:
    """Top-level {...} spans; braces within strings don't count."""
    depth, start, quoted, escaped = 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                yield text[start : i + 1]


def find_json(text: str | None, key: str | None = None, last_fence: bool = False) -> str | None:
    """The first object that parses (and has ``key``): fenced ones (from the last, if asked) before bare ones."""
    if not text:
        return None
    fences = FENCE.findall(text)
    for candidate in [*(reversed(fences) if last_fence else fences), *balanced_objects(text)]:
        try:
            got = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(got, dict) and (key is None or key in got):
            return candidate.strip()
    return None


def recover_json(reply: Column | str, key: str | None = None, last_fence: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(replies: pd.Series) -> pd.Series:
        return replies.map(lambda t: find_json(t, key, last_fence))

    return run(reply)
