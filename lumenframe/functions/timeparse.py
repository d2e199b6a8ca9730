"""Ranges of time from everyday expressions, as two epoch seconds for a range filter."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

# Parts of a day as (first hour, last hour, last minute).
PARTS = {"morning": (6, 12, 0), "afternoon": (12, 17, 0), "evening": (17, 23, 59), "night": (17, 23, 59), "tonight": (17, 23, 59)}
UNITS = {"hour": 3600, "minute": 60, "min": 60, "day": 86400, "week": 604800}
CLOCK = re.compile(r"\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b")
HOURS_24 = re.compile(r"\b([01]?\d|2[0-3]):([0-5]\d)\b")


def time_of_day(expression: str) -> tuple[int, int] | None:
    """(hour, minute) named in the expression: 4pm, 3:30 pm, 15:30, midnight, noon."""
    m = CLOCK.search(expression)
    if m and 1 <= int(m[1]) <= 12 and int(m[2] or 0) < 60:
        return int(m[1]) % 12 + (12 if m[3] == "pm" else 0), int(m[2] or 0)
    m = HOURS_24.search(expression)
    if m:
        return int(m[1]), int(m[2])
    if re.search(r"\bmidnight\b", expression):
        return 0, 0
    return (12, 0) if re.search(r"\bnoon\b", expression) else None


def _part(day: datetime, name: str) -> tuple[datetime, datetime]:
    first, last, minute = PARTS[name]
    return day + timedelta(hours=first), day + timedelta(hours=last, minutes=minute)


def _hour_at(day: datetime, at: tuple[int, int]) -> tuple[datetime, datetime]:
    start = day + timedelta(hours=at[0], minutes=at[1])
    return start, start + timedelta(hours=1)


def _span(text: str, now: datetime, strict: bool) -> tuple[datetime, datetime]:
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    yesterday = today - timedelta(days=1)
    monday = today - timedelta(days=now.weekday())
    at = time_of_day(text)
    bare = text.removeprefix("this ")
    if bare in PARTS and bare != "night" and (bare != "tonight" or text == "tonight"):
        return _part(today, bare)
    if text == "today":
        return today, now
    if text.startswith("yesterday"):
        part = text.removeprefix("yesterday").strip()
        if part in PARTS and part != "tonight":
            return _part(yesterday, part)
        return _hour_at(yesterday, at) if part and at else (yesterday, today)
    if "last night" in text:
        if at:
            return _hour_at(today if at[0] == 0 else yesterday, at)
        return yesterday + timedelta(hours=20), today
    if text == "last week" and not strict:
        return monday - timedelta(weeks=1), monday
    if text.startswith("last "):
        words = text.split()
        count = int(words[1]) if len(words) > 2 and words[1].isdigit() else 1
        seconds = UNITS.get(words[2].rstrip("s")) if len(words) > 2 else None
        return now - timedelta(seconds=count * seconds if seconds else 3600), now
    if text == "this week":
        return monday, now
    return _hour_at(today, at) if at else (now - timedelta(hours=1), now)


def parse_natural_time(expression: str, now: float, strict: bool = False) -> tuple[float, float]:
    """(start, end) in epoch seconds, UTC; ``now`` is explicit. Unknown expressions mean the last hour.

    ``last week`` is Monday to Monday; with ``strict`` it is the last hour, as for any other ``last`` without a unit.
    """
    at = datetime.fromtimestamp(now, timezone.utc)
    start, end = _span(" ".join(expression.lower().split()), at, strict)
    return start.timestamp(), end.timestamp()
