"""Scores, ages, timestamps and metadata filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import let

DAY_MS = 86_400_000
# The metadata fields that may hold a document's time, first parseable wins.
TIME_FIELDS = ("last_edited_time", "updatedAt", "updated_at", "last_edited", "createdAt", "created_at", "created_time", "date", "last-reviewed")


def recency_boost(ts_ms: Column, now_ms: int, half_life_days: float = 90.0) -> Column:
    """1 for no time or a future one, else 1 / (1 + age / half-life)."""
    age = (F.lit(now_ms) - ts_ms) / F.lit(float(DAY_MS))
    return F.when(ts_ms.isNull() | (age <= 0), 1.0).otherwise(1.0 / (1.0 + age / F.lit(float(half_life_days))))


def relative_age(ts_ms: Column, now_ms: int) -> Column:
    days = F.floor((F.lit(now_ms) - ts_ms) / F.lit(float(DAY_MS)))
    months = F.floor(days / 30)
    return (
        F.when(ts_ms.isNull(), F.lit(None).cast("string")).when(ts_ms > now_ms, "just now").when(days == 0, "today").when(days < 30, F.concat(days.cast("string"), F.lit("d ago")))
        .when(months < 12, F.concat(months.cast("string"), F.lit("mo ago"))).otherwise(F.concat(F.floor(days / 365).cast("string"), F.lit("y ago")))
    )


def distance_score(distance: Column) -> Column:
    """max(0, 1 - d²/2), the cosine of unit vectors at that distance."""
    return F.greatest(F.lit(0.0), 1.0 - distance * distance / 2.0)


def recency_weighted(score: Column, boost: Column, weight: float) -> Column:
    return score * (1.0 - weight + weight * boost)


def parse_timestamp(value: Column) -> Column:
    """Milliseconds of a time given as text: seconds or milliseconds, ISO, or a mail date; null if none of them."""
    number = F.try_to_number(value, F.lit("9999999999999999")).cast("long")
    number = F.when(value.rlike(r"\A\d{1,16}\z"), number)
    iso = F.try_to_timestamp(value)
    mail = F.try_to_timestamp(F.regexp_replace(value, r"\A[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss xx"))
    return F.coalesce(F.when(number < 10**12, number * 1000).otherwise(number), F.when(value.rlike(r"\A\d{4}-"), F.unix_millis(iso)), F.unix_millis(mail))


def content_timestamp(metadata: Column, mtime_ms: Column) -> Column:
    """The first parseable time field of a JSON text, else the file's time, else null."""
    # Read once for a row; fields behind the first that can be parsed are not looked at.
    first = lambda fields: F.coalesce(*(let(F.try_element_at(fields, F.lit(k)), lambda v: F.when(v.isNotNull(), parse_timestamp(v))) for k in TIME_FIELDS))
    return F.coalesce(let(F.from_json(metadata, "map<string,string>"), first), F.floor(mtime_ms).cast("long"))


def matches_filters(metadata: Column, filters: dict[str, object] | None) -> Column:
    """Whether every field of `filters` equals the metadata's as lower-case text; a missing one never does; arrays count as comma-joined."""
    out = F.lit(True)
    for key, wanted in (filters or {}).items():
        raw = F.get_json_object(metadata, f"$['{key}']")
        joined = F.when(raw.startswith("["), F.array_join(F.from_json(raw, "array<string>"), ",")).otherwise(raw)
        said = str(wanted).lower() if not isinstance(wanted, bool) else str(wanted).lower()
        out = out & F.coalesce(F.lower(joined) == said, F.lit(False))
    return out


def parse_filter(text: str) -> tuple[str, str] | None:
    """`key=value`, cut at the first equals sign; None if there is none or no key."""
    key, sep, value = text.partition("=")
    return (key, value) if sep and key else None
