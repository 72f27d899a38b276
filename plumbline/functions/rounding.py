"""Rounding of statistics, in one place: half to even on the exact value of a double, as Python rounds."""

from __future__ import annotations

from collections.abc import Mapping


def rounded(value, digits: int | None):
    return round(value, digits) if digits is not None and isinstance(value, float) else value


def pct(part: float, whole: float, digits: int | None = 2) -> float:
    """part of whole in percent; 0 of nothing is 0."""
    return rounded(100 * part / whole, digits) if whole else 0.0


def rounded_row(row: Mapping, digits: Mapping[str, int | None]) -> dict:
    return {k: rounded(v, digits.get(k)) for k, v in row.items()}
