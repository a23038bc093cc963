"""Resolution of report windows on the driver."""

from __future__ import annotations

import re
from datetime import datetime, time, timedelta, timezone

MAX_DAYS = 3650


def parse_bound(value: str, end_of_day: bool) -> datetime:
    """ISO date or datetime in UTC; a bare date as an upper bound means the end of that day."""
    text = value.strip()
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            day = datetime.fromisoformat(text)
            clock = time(23, 59, 59, 999999) if end_of_day else time(0, 0)
            return datetime.combine(day.date(), clock, timezone.utc)
        moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"not an ISO date or datetime: {value}") from None
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def resolve_window(
    date_from: str | None = None,
    date_to: str | None = None,
    days: int | None = None,
    default_days: int | None = None,
    now: datetime | None = None,
) -> tuple[datetime | None, datetime | None]:
    """``days`` back from now, or explicit bounds, never both; open when neither is given and no default is set."""
    if days is not None and (date_from or date_to):
        raise ValueError("use either days or date_from/date_to")
    if days is None and not date_from and not date_to:
        days = default_days
    if days is not None:
        if not 1 <= days <= MAX_DAYS:
            raise ValueError(f"days must be between 1 and {MAX_DAYS}")
        end = now or datetime.now(timezone.utc)
        return end - timedelta(days=days), end
    start = parse_bound(date_from, end_of_day=False) if date_from else None
    end = parse_bound(date_to, end_of_day=True) if date_to else None
    if start and end and start > end:
        raise ValueError("date_from must not be after date_to")
    return start, end
