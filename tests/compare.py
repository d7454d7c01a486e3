"""Rows of two results as comparable values, columns by name, rows in any order."""

import numpy as np
import pandas as pd


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return [plain(v) for v in x]
    if x is None or x is pd.NA or isinstance(x, (float, np.floating)) and x != x:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating)):
        return round(float(x), 9)
    return x


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str([plain(v) for v in r]) for r in frame.astype(object)[columns].itertuples(index=False, name=None))
