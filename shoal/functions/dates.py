"""Size and date literals of the query language, resolved when a query is parsed."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone, tzinfo

from shoal.model import to_filetime

#: Units of sizes, in bytes, and the named ranges (fixed values).
UNITS = {"": 1, "b": 1}
UNITS |= {unit: 1024**power for power, letter in enumerate("kmgt", 1) for unit in (letter, letter + "b", letter + "ib")}
KIB, MIB = 1024, 1024**2
SIZES = {
    "tiny": (0, 10 * KIB),
    "small": (10 * KIB, 100 * KIB),
    "medium": (100 * KIB, MIB),
    "large": (MIB, 16 * MIB),
    "huge": (16 * MIB, 128 * MIB),
    "gigantic": (128 * MIB, None),
}
U64 = 2**64 - 1
MONTHS = [m.lower() for m in calendar.month_name][1:]
WEEKDAYS = [d.lower() for d in calendar.day_name]  # Monday first


@dataclass(frozen=True)
class Bounds:
    """A numeric condition: low and high, each with whether it is included."""

    low: int | None = None
    low_included: bool = True
    high: int | None = None
    high_included: bool = True
    never: bool = False


def number(text: str) -> int | None:
    if not re.fullmatch(r"[0-9]+", text):
        return None
    value = int(text)
    return value if value <= U64 else None


def size(text: str) -> int | None:
    m = re.fullmatch(r"([0-9]+)([a-z]*)", text.lower())
    if not m or m[2] not in UNITS:
        return None
    value = int(m[1]) * UNITS[m[2]]
    return value if value <= U64 else None


def compared(text: str, read) -> Bounds | None:
    """``=``, ``<``, ``<=``, ``>``, ``>=`` or nothing, then a value."""
    op, rest = re.match(r"(>=|<=|>|<|=)?(.*)", text, re.S).groups()
    value = read(rest) if rest else None
    if value is None:
        return None
    return {
        ">=": Bounds(low=value),
        ">": Bounds(low=value, low_included=False),
        "<=": Bounds(high=value),
        "<": Bounds(high=value, high_included=False),
    }.get(op, Bounds(low=value, high=value))


def ranged(text: str, read) -> Bounds | None:
    """``a..b``, or ``a-b`` at the first hyphen if there are no two dots."""
    mark = ".." if ".." in text else "-"
    low, found, high = text.partition(mark)
    if not found or not low or not high:
        return None
    a, b = read(low), read(high)
    return Bounds(low=a, high=b) if a is not None and b is not None and a <= b else None


def numeric(text: str) -> Bounds | None:
    return ranged(text, number) or compared(text, number)


def sizes(text: str) -> Bounds | None:
    word = text.lower()
    if word == "empty":
        return Bounds(low=0, high=0)
    if word in SIZES:
        low, high = SIZES[word]
        return Bounds(low=low, low_included=False, high=high)
    return ranged(text, size) or compared(text, size)


def _shift_months(day: date, months: int) -> date:
    at = day.year * 12 + day.month - 1 + months
    year, month = divmod(at, 12)
    return day.replace(year=year, month=month + 1, day=min(day.day, calendar.monthrange(year, month + 1)[1]))


class Dates:
    """Date literals at a fixed moment, time zone and first day of the week (0: Monday)."""

    def __init__(self, now: datetime, tz: tzinfo = timezone.utc, first_day_of_week: int = 0):
        self.now, self.tz, self.first = now.astimezone(tz), tz, first_day_of_week

    def _ticks(self, day: date, at: time = time()) -> int:
        return to_filetime(datetime.combine(day, at, self.tz))

    def _days(self, start: date, end: date) -> Bounds:
        return Bounds(low=self._ticks(start), high=self._ticks(end), high_included=False)

    def _rolling(self, moved: date, future: bool) -> Bounds:
        now, edge = to_filetime(self.now), self._ticks(moved, self.now.time())
        if future:
            return Bounds(low=now, high=edge, high_included=False)
        return Bounds(low=edge)

    def _period(self, unit: str) -> tuple[date, date, date]:
        """Starts of the last, this and the next period, and with the next one its end."""
        today = self.now.date()
        if unit == "week":
            this = today - timedelta(days=(today.weekday() - self.first) % 7)
            return this - timedelta(days=7), this, this + timedelta(days=7)
        if unit == "month":
            this = today.replace(day=1)
            return _shift_months(this, -1), this, _shift_months(this, 1)
        this = today.replace(month=1, day=1)
        return this.replace(year=this.year - 1), this, this.replace(year=this.year + 1)

    def _relative(self, word: str) -> Bounds | None:
        today, one = self.now.date(), timedelta(days=1)
        if word == "today":
            return self._days(today, today + one)
        if word == "yesterday":
            return self._days(today - one, today)
        if m := re.fullmatch(r"(this|current|last|prev|past|coming|next)(week|month|year)", word):
            last, this, after = self._period(m[2])
            if m[1] in ("this", "current"):
                return self._days(this, today + one)
            if m[1] in ("last", "prev"):
                return self._days(last, this)
            if m[1] == "past":
                back = {"week": today - 7 * one, "month": _shift_months(today, -1), "year": _shift_months(today, -12)}
                return self._rolling(back[m[2]], False)
            beyond = {"week": after + 7 * one, "month": _shift_months(after, 1), "year": after.replace(year=after.year + 1)}
            return self._days(after, beyond[m[2]])
        for i, name in enumerate(MONTHS):
            if word in (name, name[:3]):
                start = today.replace(month=i + 1, day=1)
                return self._days(start, _shift_months(start, 1))
        for i, name in enumerate(WEEKDAYS):
            if word in (name, name[:3]):
                start = self._period("week")[1] + timedelta(days=(i - self.first) % 7)
                return self._days(start, start + one)
        m = re.fullmatch(r"(coming|next|last|past|prev)([0-9]+)(years|months|weeks|days|hours|minutes|mins|seconds|secs)", word)
        if not m or not 0 < (n := int(m[2])) < 2**31:
            return None
        future = m[1] in ("coming", "next")
        step = n if future else -n
        if m[3] in ("years", "months"):
            return self._rolling(_shift_months(today, step * (12 if m[3] == "years" else 1)), future)
        if m[3] in ("weeks", "days"):
            return self._rolling(today + timedelta(days=step * (7 if m[3] == "weeks" else 1)), future)
        ticks = n * {"h": 3600, "m": 60, "s": 1}[m[3][0]] * 10_000_000
        now = to_filetime(self.now)
        if future:
            return Bounds(low=now, high=now + ticks, high_included=False)
        return Bounds(low=now - ticks) if ticks <= now else None

    def _point(self, text: str) -> int | None:
        m = re.match(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d))?", text)
        if not m or (len(text) > 10 and not m[4]):
            return None
        try:
            return self._ticks(date(int(m[1]), int(m[2]), int(m[3])), time(int(m[4] or 0), int(m[5] or 0)))
        except ValueError:
            return None

    def parse(self, text: str) -> Bounds | None:
        try:
            if found := self._relative(text.lower()):
                return found
            if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
                day = date(int(text[:4]), int(text[5:7]), int(text[8:]))
                return self._days(day, day + timedelta(days=1))
        except (ValueError, OverflowError):
            return None
        return compared(text, self._point)
