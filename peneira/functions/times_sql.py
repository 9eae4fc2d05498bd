"""Dates of clean ISO texts, ages and scores as native column expressions. now is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peneira.functions.text import fold

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?)?$"
DAY = 86_400


def iso_instant(text: Column) -> Column:
    """The instant of an ISO text, without a zone in UTC; null for anything else."""
    plain = F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    timed = F.regexp_replace(F.replace(plain, F.lit(","), F.lit(".")), r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(Z|[+-]\d{2}:\d{2})?$", "$1:00$2")
    full = F.regexp_replace(timed, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(Z|[+-]\d{2}:\d{2})?$", "$1:00$2")
    return F.when(plain.rlike(_ISO), F.try_to_timestamp(full))


def deadline_instant(text: Column) -> Column:
    """The end of a deadline: a date alone lasts to its last second at -03:00, a time without a zone is at -03:00."""
    plain = F.trim(text)
    dated = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(plain, F.lit("T23:59:59-03:00")))
    zoned = F.when(plain.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & (F.length(plain) > 10), plain).otherwise(F.concat(plain, F.lit("-03:00")))
    return iso_instant(F.coalesce(dated, zoned))


def age_days(instant: Column, now: Column) -> Column:
    """Fractional days from an instant to now."""
    return (F.unix_micros(now) - F.unix_micros(instant)) / F.lit(DAY * 1e6)


def recency_points(instant: Column, now: Column) -> Column:
    """Points for freshness: 10, 7, 4, 2 up to 3, 7, 14, 30 days; none for the future, older or unknown."""
    age = age_days(instant, now)
    out = F.when(age.isNull() | (age < 0), 0)
    for limit, points in ((3, 10), (7, 7), (14, 4), (30, 2)):
        out = out.when(age <= limit, points)
    return out.otherwise(0)


# Names of months, and units of an age with their seconds, as portals write them.
MONTH_NAMES = ["janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
AGE_UNITS = {
    60: ["minuto", "minutos", "minute", "minutes", "min"], 3600: ["hora", "horas", "hour", "hours", "h"], DAY: ["dia", "dias", "day", "days"],
    7 * DAY: ["semana", "semanas", "week", "weeks"], 30 * DAY: ["mes", "meses", "month", "months"],
}


def published_instant(text: Column, now: Column) -> Column:
    """When a portal says that a listing was published: an ISO text, a date with slashes, a long date, an age, today or
    yesterday, the first that is there. A date in the future, or one that doesn't exist, says nothing, nor does an age
    of nothing."""
    plain = fold(text)
    group = lambda pattern, i: F.regexp_extract(plain, pattern, i)
    slashed, long_, aged = r"(?<!\d)(\d{1,2})/(\d{1,2})/(\d{4})(?!\d)", rf"(\d{{1,2}}) de ({'|'.join(MONTH_NAMES)}) de (\d{{4}})", rf"(\d+)\s*({'|'.join(sorted((u for us in AGE_UNITS.values() for u in us), key=len, reverse=True))})(?!\w)"
    day = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd"))
    month = F.array_position(F.lit(MONTH_NAMES), group(long_, 2)).cast("string")
    seconds = F.create_map(*[F.lit(x) for s, us in AGE_UNITS.items() for u in us for x in (u, s)])
    count = group(aged, 1).try_cast("bigint")
    ago = lambda s: F.timestamp_micros(F.unix_micros(now) - s.cast("bigint") * 1_000_000)
    past = lambda t: F.when(t <= now, t)
    return (
        F.when(iso_instant(text).isNotNull(), past(iso_instant(text))).when(plain.rlike(_ISO), None).when(plain.rlike(slashed), past(day(group(slashed, 3), group(slashed, 2), group(slashed, 1))))
        .when(plain.rlike(long_), past(day(group(long_, 3), month, group(long_, 1)))).when(plain.rlike(aged), F.when(count > 0, ago(count * F.try_element_at(seconds, group(aged, 2)))))
        .when(plain.rlike(r"(?<!\w)hoje(?!\w)"), now).when(plain.rlike(r"(?<!\w)ontem(?!\w)"), ago(F.lit(DAY)))
    )


def portal_instant(text: Column) -> Column:
    """The instant an interface writes: ISO, or with slashes, the month first where that makes a date, else the day first;
    a date alone is midnight UTC, and dates in the future count."""
    plain = F.trim(text)
    tried = [F.try_to_timestamp(plain, F.lit(p)) for p in ("MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy")]
    padded = plain.rlike(r"^\d{2}/\d{2}/\d{4}( \d{2}:\d{2}:\d{2})?$")
    return F.coalesce(iso_instant(plain), F.when(padded, F.coalesce(*tried)))


def activity(published: Column, deadline: Column, observed: Column, now: Column, fresh_days: int = 7, link: Column | None = None, checked: Column | None = None) -> Column:
    """CLOSED, ACTIVE_CONFIRMED, ACTIVE_LISTED or UNKNOWN from what is known of a record at now. link and checked: what a
    check of its address gave (LIVE, DEAD) and when; a check of the last days counts before dates but the deadline."""
    recent = age_days(checked, now).between(0, fresh_days) if checked is not None else F.lit(False)
    seen = F.coalesce(recent, F.lit(False)) & F.lit(link is not None)
    state = link if link is not None else F.lit(None).cast("string")
    return (
        F.when(deadline < now, "CLOSED").when(seen & (state == "DEAD"), "CLOSED").when(seen & (state == "LIVE"), "ACTIVE_CONFIRMED").when(published > now, "UNKNOWN")
        .when(published.isNotNull() & deadline.isNotNull(), "ACTIVE_CONFIRMED")
        .when(age_days(observed, now).between(0, fresh_days), "ACTIVE_LISTED").otherwise("UNKNOWN")
    )
