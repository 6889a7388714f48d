"""The observation window: every date and span an operator needs, in one parameter object."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ObservationWindow:
    """Days ``start <= d < cutoff``; recencies count back from ``cutoff``.

    ``spans`` maps a column suffix to the length in days of a window that ends at the cutoff.
    ``segments`` are named calendar slices ``[from, to)``. ``full`` is the suffix of the whole window,
    ``recent`` and ``short`` the spans used by momentum features. ``silence`` is the run of inactive
    days that counts as lapsed; ``missing_days`` stands in for a recency that does not exist.
    """

    start: date
    cutoff: date
    spans: Mapping[str, int]
    segments: Sequence[tuple[str, date, date]] = ()
    full: str = "90d"
    recent: str = "30d"
    short: str = "7d"
    silence: int = 30
    missing_days: int = 120
    gap_lengths: Sequence[int] = (7, 14, 21)
    balance_weeks: Sequence[int] = (0, 4, 8, 10, 11, 12)
    recurrence_unit: str = "month"
    extra: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def quarter(cls, start: date = date(2024, 1, 1)) -> ObservationWindow:
        """A calendar quarter with nested 60/30/14/7/3-day windows and one segment per month."""
        edges = [date(start.year + (start.month - 1 + k) // 12, (start.month - 1 + k) % 12 + 1, 1) for k in range(4)]
        names = [edge.strftime("%b").lower() for edge in edges[:3]]
        return cls(
            start=start,
            cutoff=edges[3],
            spans={"60d": 60, "30d": 30, "14d": 14, "7d": 7, "3d": 3},
            segments=tuple(zip(names, edges[:3], edges[1:], strict=True)),
        )

    @property
    def days(self) -> int:
        return (self.cutoff - self.start).days

    @property
    def weeks(self) -> int:
        return self.days // 7

    def since(self, suffix: str) -> date:
        """First day of the nested window called ``suffix``."""
        return self.cutoff - timedelta(days=self.spans[suffix])

    def in_span(self, day: Column, suffix: str) -> Column:
        return day >= F.lit(self.since(suffix))

    def in_segment(self, day: Column, name: str) -> Column:
        low, high = next((a, b) for label, a, b in self.segments if label == name)
        return (day >= F.lit(low)) & (day < F.lit(high))

    def days_before_cutoff(self, day: Column) -> Column:
        return F.datediff(F.lit(self.cutoff), day)

    def day_index(self, day: Column) -> Column:
        return F.datediff(day, F.lit(self.start))

    def week_index(self, day: Column) -> Column:
        return F.floor(self.day_index(day) / 7).cast("int")

    def unit_index(self, day: Column, unit: str) -> Column:
        """Index of the calendar unit of ``day``, 0 for the one that holds ``start``."""
        if unit == "week":
            monday = self.start - timedelta(days=self.start.weekday())
            return F.floor(F.datediff(day, F.lit(monday)) / 7).cast("int")
        if unit == "month":
            return (F.year(day) - self.start.year) * 12 + F.month(day) - self.start.month
        if unit == "year":
            return F.year(day) - self.start.year
        raise ValueError(f"unit {unit!r} is not one of week, month, year")

    def units(self, unit: str) -> int:
        """How many calendar units the window touches."""
        last = self.cutoff - timedelta(days=1)
        if unit == "week":
            monday = self.start - timedelta(days=self.start.weekday())
            return (last - monday).days // 7 + 1
        if unit == "month":
            return (last.year - self.start.year) * 12 + last.month - self.start.month + 1
        return last.year - self.start.year + 1
