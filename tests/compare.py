"""Order-insensitive comparison of two result frames, strict on names, types and values."""

from __future__ import annotations

import math

import pandas as pd


def _kind(series: pd.Series) -> str:
    return str(series.dtype)


def _cell(value):
    if value is None or value is pd.NA:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if value is pd.NaT:
        return None
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value)
    return value


def _rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_cell(v) for v in row) for row in zip(*[df[c].tolist() for c in cols], strict=True)] if len(df) else []
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), repr(v)) for v in r))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    loose = [c for c in got.columns if _kind(got[c]) != _kind(want[c]) and not _same_kind(got[c], want[c])]
    if loose:
        return f"types {[(c, _kind(got[c]), _kind(want[c])) for c in loose]}"
    a, b = _rows(got), _rows(want)
    cols = sorted(got.columns)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if not _close(x, y)]
    if wrong:
        x, y = wrong[0]
        return f"{len(wrong)} of {len(a)} rows, e.g. {[(c, p, q) for c, p, q in zip(cols, x, y, strict=True) if not _close((p,), (q,))]}"
    return None


def _same_kind(a: pd.Series, b: pd.Series) -> bool:
    """Null-bearing integers turn into floats in pandas; dates differ only in resolution."""
    numeric = pd.api.types.is_numeric_dtype
    if numeric(a) and numeric(b):
        return a.isna().any() or b.isna().any() or pd.api.types.is_float_dtype(a) == pd.api.types.is_float_dtype(b)
    dates = ("datetime", "object")
    return any(str(a.dtype).startswith(d) for d in dates) and any(str(b.dtype).startswith(d) for d in dates) or len(a) == 0


def _close(x: tuple, y: tuple) -> bool:
    for p, q in zip(x, y, strict=True):
        if isinstance(p, float) and isinstance(q, float):
            if abs(p - q) > 1e-9 * max(1.0, abs(p), abs(q)):
                return False
        elif p != q:
            return False
    return True
