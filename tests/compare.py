"""Rows of two engines in one form, in any order."""

import datetime
import decimal
import math

import numpy as np
import pandas as pd


def cell(x):
    if isinstance(x, (list, np.ndarray)):
        return str([cell(y) for y in x])
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, decimal.Decimal, np.integer, np.floating)):
        return f"{float(x):.9g}"
    if isinstance(x, (datetime.date, pd.Timestamp)):
        return pd.Timestamp(x).isoformat()
    return str(x)


def rows(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    return names, sorted(tuple(cell(x) for x in row) for row in frame[names].astype(object).itertuples(index=False))
