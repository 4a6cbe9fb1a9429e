"""Rows of a Spark result and of DuckDB, in a form that compares."""

from __future__ import annotations

import decimal
import math

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (np.isscalar(value) or value is pd.NaT or value is pd.NA) and pd.isna(value):
        return None
    if isinstance(value, (decimal.Decimal, float, np.floating)):
        v = float(value) + 0.0
        whole = abs(v) < 2**53 and abs(v - round(v)) <= 1e-12 * abs(v)  # a whole number is compared exactly
        return round(v) if whole else v
    if isinstance(value, (int, np.integer)) and not isinstance(value, bool):
        return int(value)
    return str(value)


class Row(tuple):
    """Equal to a row whose numbers are within 1e-9 of their size, or one step of the last decimal to which their column is rounded."""

    step: tuple[float, ...] = ()

    def __eq__(self, other) -> bool:
        same = lambda a, b, t: math.isclose(a, b, rel_tol=1e-9, abs_tol=t) if float in (type(a), type(b)) and a is not None and b is not None else a == b
        return len(self) == len(other) and all(same(a, b, t) for a, b, t in zip(self, other, self.step, strict=True))

    __hash__ = None


def _step(values: list) -> float:
    """A little over one of the last decimal, where a column is rounded to six or fewer."""
    digits = max((len(repr(v).partition(".")[2]) if "e" not in repr(v) else 99 for v in values if type(v) is float), default=0)
    return 1.1 * 10.0**-digits if digits <= 6 else 1e-12


def rows(df: pd.DataFrame) -> list[Row]:
    """Rows in an order of their exact values first and their floats, rounded, last."""
    df = df[sorted(df.columns)]
    found = [Row(plain(v) for v in r) for r in df.itertuples(index=False)]
    real = {i for r in found for i, v in enumerate(r) if type(v) is float}
    step = tuple(_step([r[i] for r in found]) if i in real else 0.0 for i in range(len(df.columns)))
    for r in found:
        r.step = step
    return sorted(found, key=lambda r: ([str(v) for i, v in enumerate(r) if i not in real], [(v is None, round(v or 0, 3)) for i, v in enumerate(r) if i in real], [(v is None, v or 0) for i, v in enumerate(r) if i in real]))
