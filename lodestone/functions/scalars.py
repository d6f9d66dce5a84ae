"""Scalar functions and small parsers."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import clamp


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit_clip(x: Column, edge: float = 1e-5) -> Column:
    x = clamp(x, edge, 1 - edge)
    return F.ln(x / (F.lit(1.0) - x))


def piecewise_linear(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Interpolation between knots, flat outside; x itself without knots."""
    if not knots:
        return x
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x < x1, F.lit(float(y0)) + (x - x0) / F.lit(x1 - x0 + 1e-12) * F.lit(float(y1 - y0)))
    return out.otherwise(F.lit(float(knots[-1][1])))


def piecewise_value(x: float, knots: list[tuple[float, float]]) -> float:
    if not knots:
        return x
    if x <= knots[0][0]:
        return knots[0][1]
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        if x < x1:
            return y0 + (x - x0) / (x1 - x0 + 1e-12) * (y1 - y0)
    return knots[-1][1]


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def number_list(text: Column, kind: str = "double") -> Column:
    """Numbers between commas or bars; empty parts are skipped."""
    parts = F.filter(F.transform(F.split(text, "[,|]"), trimmed), lambda x: x != "")
    return F.transform(parts, lambda x: x.try_cast(kind))


def parse_numbers(text: str, kind: type = float) -> list:
    return [kind(p) for p in re.split(r"[,|]", text) if p.strip()]


def name_list(text: str) -> list[str]:
    """Names between commas or blanks, each once, in order."""
    return list(dict.fromkeys(p for p in re.split(r"[,\s]+", text) if p))


def target_grid(text: str, default: float = 0.90) -> list[float]:
    """'a:step:b' as an inclusive range, counted in whole steps; a single value otherwise; the default when it can't be read."""
    try:
        parts = [float(p) for p in text.split(":")]
    except ValueError:
        return [default]
    if len(parts) == 1:
        return parts
    if len(parts) != 3:
        return [default]
    a, step, b = parts
    if abs(step) < 1e-15:
        return [a]
    a, b = min(a, b), max(a, b)
    n = math.floor((b - a) / abs(step) + 1e-9)
    return [a + i * abs(step) for i in range(n + 1)]


def solve_least(base: float, weight: float, knots: list[tuple[float, float]], target: float, low: float = 0.0, rounds: int = 24) -> float:
    """The least share in [low, 1] whose mapped, weighted value lifts base to target, by bisection; 1 where none does."""
    if weight <= 1e-12:
        return 1.0
    reached = lambda p: base + weight * piecewise_value(p, knots) >= target
    if not reached(1.0):
        return 1.0
    a, b = low, 1.0
    for _ in range(rounds):
        mid = (a + b) / 2
        a, b = (a, mid) if reached(mid) else (mid, b)
    return b
