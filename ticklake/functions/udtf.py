"""Table functions."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.functions import udtf


@udtf(returnType="key string, value double")
class flatten_numbers:  # noqa: N801
    """Every numeric leaf of a JSON document with its dotted key; bad JSON has none."""

    def eval(self, doc: str) -> Iterator[tuple[str, float]]:
        try:
            open_: list[tuple[str, object]] = [("", json.loads(doc or "null"))]
        except ValueError:
            return
        while open_:
            key, value = open_.pop()
            if isinstance(value, bool):
                continue
            if isinstance(value, (int, float)):
                yield key, float(value)
            elif isinstance(value, (dict, list)):
                inner = value.items() if isinstance(value, dict) else enumerate(value)
                open_ += [(f"{key}.{k}" if key else str(k), v) for k, v in inner]
