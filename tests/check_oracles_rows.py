"""Rows of both engines in one comparable form."""

import math


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6f}"
    if isinstance(x, bool) or x is None:
        return str(x)
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)
