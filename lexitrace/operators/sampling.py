"""Where a file is sampled: fractions of its runtime, and windows in seconds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_points(n: int, margin_start: float = 0.10, margin_end: float | None = None) -> list[float]:
    """``n`` fractions, evenly spaced between the margins (0.45 at most each)."""
    inside = lambda m: min(0.45, max(0.0, m))
    low, high = inside(margin_start), 1.0 - inside(margin_start if margin_end is None else margin_end)
    if low >= high:
        low, high = 0.10, 0.90
    if n <= 1:
        return [round((low + high) / 2, 4)]
    return [round(low + (high - low) * k / (n - 1), 4) for k in range(n)]


def sample_points_column(n: Column, low: float = 0.10, high: float = 0.90) -> Column:
    """The same from a column of numbers."""
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.round(low + (high - low) * k / (n - 1), 4))
    return F.when(n > 1, at).otherwise(F.array(F.lit(round((low + high) / 2, 4))))


def parse_points(spec: str) -> list[float]:
    """Fractions from a list of fractions or per cents."""
    out = []
    for part in filter(None, re.split(r"[,\s;]+", spec)):
        value = float(part.rstrip("%"))
        out.append(value / 100 if part.endswith("%") or value > 1 else value)
    return out


def points_of(spec: Column) -> Column:
    """``parse_points`` of a column: array of fractions; null parts where one is no number."""
    parts = F.filter(F.split(spec, r"[,\s;]+"), lambda x: x != "")
    value = lambda x: F.regexp_replace(x, "%$", "").try_cast("double")
    return F.transform(parts, lambda x: F.when(x.endswith("%") | (value(x) > 1), value(x) / 100).otherwise(value(x)))


def sample_windows(duration: Column, points: Column, length: float) -> Column:
    """array of (start_s, len_s) inside the file, without repeats."""
    size = F.lit(float(length))

    def window(p: Column) -> Column:
        start = F.greatest(F.lit(0.0), F.least(duration - size, duration * p))
        return F.struct(F.round(start, 2).alias("start_s"), F.round(F.least(size, F.greatest(F.lit(1.0), duration - start)), 2).alias("len_s"))

    whole = F.array(F.struct(F.lit(0.0).alias("start_s"), size.alias("len_s")))
    found = F.array_distinct(F.filter(F.transform(points, window), lambda w: w["len_s"] >= 1.0))
    short = F.array(F.struct(F.lit(0.0).alias("start_s"), F.least(size, F.greatest(F.lit(1.0), duration)).alias("len_s")))
    return F.when(duration <= 0, whole).when(F.size(found) > 0, found).otherwise(short)
