"""One explicit "now" per run, turned into whole-day predicates.

The reference compares DATE columns with a timestamp "now". A date is
promoted to midnight, so with a time of day after midnight:

  expiry > now               ->  expiry > d
  expiry BETWEEN now, now+n  ->  d < expiry <= d+n   (today excluded)
  expiry <= now+n            ->  expiry <= d+n
  sale_date >= now-n         ->  sale_date > d-n     (no upper bound)
  DATEDIFF(day, now, x)      ->  x - d (calendar-day boundaries)

At exactly midnight the lower bounds become inclusive. Every predicate is
a comparison of the raw column with a DATE literal, so it reaches the
Parquet scan as a pushed filter.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clock:
    as_of: _dt.datetime

    @classmethod
    def at(cls, value) -> "Clock":
        if isinstance(value, Clock):
            return value
        if isinstance(value, str):
            value = _dt.datetime.fromisoformat(value)
        elif isinstance(value, _dt.date) and not isinstance(value, _dt.datetime):
            value = _dt.datetime.combine(value, _dt.time())
        return cls(value)

    @classmethod
    def now(cls) -> "Clock":
        """The current time in UTC, read once."""
        return cls(_dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))

    @property
    def day(self) -> _dt.date:
        return self.as_of.date()

    @property
    def at_midnight(self) -> bool:
        return self.as_of.time() == _dt.time()

    def plus(self, days: int) -> _dt.date:
        return self.day + _dt.timedelta(days=days)

    def lit_day(self, offset: int = 0) -> Column:
        return F.lit(self.plus(offset))

    # -- predicates -------------------------------------------------------
    def after_now(self, c: Column) -> Column:
        """``c > now``."""
        return c > self.lit_day()

    def not_before(self, c: Column) -> Column:
        """``c >= now``."""
        return c >= self.lit_day() if self.at_midnight else c > self.lit_day()

    def within_next(self, c: Column, days: int) -> Column:
        """``c BETWEEN now AND now + days``."""
        return self.not_before(c) & (c <= self.lit_day(days))

    def not_after(self, c: Column, days: int) -> Column:
        """``c <= now + days`` (no lower bound)."""
        return c <= self.lit_day(days)

    def since(self, c: Column, days: int) -> Column:
        """``c >= now - days`` (no upper bound)."""
        return c >= self.lit_day(-days) if self.at_midnight else c > self.lit_day(-days)

    def days_until(self, c: Column) -> Column:
        """``DATEDIFF(day, now, c)`` as INT."""
        return F.datediff(c, self.lit_day()).cast("int")


# The pinned clock of the registered queries and tests; runs on a user's tables read the time.
DEFAULT_AS_OF = _dt.datetime(2001, 3, 1, 12, 0)
