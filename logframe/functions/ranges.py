"""Readable numeric ranges of an axis."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# How many ranges an axis aims for and may have at most.
TARGET_RANGES = 12
MAX_RANGES = 20


@dataclass(frozen=True)
class Ranges:
    """Equal ranges from ``start``; a ``step`` of 0 stands for one single value."""

    start: float
    step: float
    count: int

    def index(self, value: Column) -> Column:
        """Range a value falls in; values outside the span go to the first or last range."""
        if not self.step:
            return F.when(value.isNotNull(), 0)
        at = F.floor((value - self.start) / self.step)
        return F.greatest(F.lit(0), F.least(F.lit(self.count - 1), at)).cast("int")

    def bounds(self, index: int) -> tuple[float, float]:
        """Lower end, included, and upper end, excluded."""
        return self.start + index * self.step, self.start + (index + bool(self.step)) * self.step

    def label(self, index: int) -> str:
        low, high = map(number_label, self.bounds(index))
        return f"{low}–{high}" if self.step else low


def readable_ranges(low: float, high: float) -> Ranges:
    """Ranges that cover [low, high], with a width of 1, 2 or 5 times a power of ten."""
    if not high > low:
        return Ranges(low, 0.0, 1)
    width = (high - low) / TARGET_RANGES
    power = 10.0 ** math.floor(math.log10(width))
    step = power * next((m for m in (1, 2, 5) if width / power <= m), 10)
    start = math.floor(low / step) * step
    return Ranges(start, step, min(MAX_RANGES, math.floor((high - start) / step) + 1))


def number_label(x: float) -> str:
    """Grouped digits and at most two decimals, halves away from zero: ``1,200``, ``0.5``."""
    if not math.isfinite(x):
        return "—"
    cents = math.floor(abs(x) * 100 + 0.5) if abs(x) < 2**43 else abs(x) * 100
    text = f"{cents / 100:,.2f}".rstrip("0").rstrip(".")
    return f"-{text}" if math.copysign(1, x) < 0 else text
