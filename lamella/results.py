"""The results table: labelled rows of doubles whose columns come as measurements do.

A value goes to the lowest row of its label that has no value under its header, and a new row follows if there is none.
`Results` is that fold; `pivoted` is the same over a long DataFrame (label, seq, header, value), where the n-th value of a
header is in the row that the fold gives it.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Results:
    def __init__(self):
        self._lock, self._headers, self._rows = threading.Lock(), [], []

    def add(self, label: str, header: str, value: float) -> None:
        if value is None:
            raise TypeError("a value is needed")
        if not label or not header:
            raise ValueError("a label and a header are needed")
        with self._lock:
            if header not in self._headers:
                self._headers.append(header)
            free = next((r for name, r in reversed(self._rows) if name == label and header not in r), None)
            if free is None:
                free = {}
                self._rows.append((label, free))
            free[header] = float(value)

    def table(self) -> list[dict]:
        """A copy: label and every header, None where a row has no value."""
        with self._lock:
            return [{"label": name, **{h: r.get(h) for h in self._headers}} for name, r in self._rows]

    def has_data(self) -> bool:
        return bool(self._rows)

    def reset(self) -> None:
        with self._lock:
            self._headers, self._rows = [], []


def pivoted(values: DataFrame, headers: list[str]) -> DataFrame:
    """(label, row, headers): values (label, seq, header, value) with one value a label, header and row. Each measurement
    emits its headers together, so the n-th of each header stands in row n."""
    n = F.row_number().over(Window.partitionBy("label", "header").orderBy("seq"))
    return values.withColumn("row", n).groupBy("label", "row").pivot("header", headers).agg(F.first("value"))
