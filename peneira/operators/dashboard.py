"""What a dashboard asks of records: quick filters, ages, activity, orders, the parts of a score, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.labels import boost, fit_points, fit_state, has_prefix
from peneira.functions.text import fold
from peneira.functions.times_sql import age_days, recency_points

# The order of states; the levels a quick filter knows; the zone in which a person gives dates.
STATE_ORDER = ["READY", "CONDITIONAL", "AMBIGUOUS", "OTHER_STACK", "EXCLUDE"]
QUICK_LEVELS = ["estagio", "junior"]
ZONE = "-03:00"
# The parts of a score with the labels that give them, and the other parts.
PARTS = {"Tecnologia": "TECH_MATCH:", "Nível": "SENIORITY_MATCH:", "Local": "LOCATION_MATCH:", "Modelo de trabalho": "WORKPLACE_MATCH:"}
REST, READY, BOOST, RECENT = "Outros critérios do perfil", "Mais compatível", "Diferenciais e empresa favorita", "Publicada recentemente"
# Names of levels and workplaces for people.
LEVEL_NAMES = {"estagio": "Estágio", "junior": "Júnior", "pleno": "Pleno", "senior": "Sênior"}
WORKPLACE_NAMES = {"REMOTE": "Remoto", "HYBRID": "Híbrido", "ONSITE": "Presencial"}
NOTHING = "—"


def _labels() -> Column:
    return F.coalesce("match_labels", F.array().cast("array<string>"))


def has_level(level: str) -> Column:
    return F.array_contains(_labels(), f"SENIORITY_MATCH:{level}") | F.coalesce(fold(F.col("seniority")) == level, F.lit(False))


def is_remote() -> Column:
    return F.coalesce(F.col("workplace_model") == "REMOTE", F.lit(False)) | F.arrays_overlap(_labels(), F.lit(["WORKPLACE_MATCH:REMOTE", "LOCATION_MATCH:remote_brazil"]))


def quick(rows: DataFrame, chosen: set[str], published: Column, now: Column, seen: DataFrame | None = None) -> DataFrame:
    """The rows that pass all quick filters chosen: unseen, remote, recent (seven days), and any of the levels chosen.

    seen: addresses already seen (canonical_url); without it, unseen are the
    records labelled as new. A null address was never seen.
    """
    out = rows
    if "remote" in chosen:
        out = out.where(is_remote())
    levels = [v for v in QUICK_LEVELS if v in chosen]
    if levels:
        hit = F.lit(False)
        for v in levels:
            hit = hit | has_level(v)
        out = out.where(hit)
    if "recent" in chosen:
        out = out.where(age_days(published, now).between(0, 7))
    if "unseen" in chosen:
        out = out.where(F.array_contains(_labels(), "STATUS:NEW")) if seen is None else out.join(seen.select("canonical_url").distinct(), "canonical_url", "left_anti").select(*rows.columns)
    return out


def aged(rows: DataFrame, published: Column, now: Column, days: float | None = None, undated: bool = False, first: str | None = None, last: str | None = None) -> DataFrame:
    """The rows of an age: undated ones, or of at most so many days, or of days from first to last, both in. A record dated
    in the future has no age yet."""
    if undated:
        return rows.where(published.isNull())
    out = rows.where(published.isNotNull() & (published <= now))
    if days:
        out = out.where(age_days(published, now) <= days)
    if first:
        out = out.where(published >= F.to_timestamp(F.lit(f"{first}T00:00:00{ZONE}")))
    if last:
        out = out.where(published <= F.to_timestamp(F.lit(f"{last}T23:59:59.999{ZONE}")))
    return out


ACTIVITY = {"closed": ["CLOSED"], "unproven": ["UNKNOWN"], "active": ["ACTIVE_CONFIRMED", "ACTIVE_LISTED"]}


def active(rows: DataFrame, activity: Column, choice: str = "active") -> DataFrame:
    """The rows of an activity: all, closed, unproven, or active as confirmed or listed."""
    return rows if choice == "all" else rows.where(activity.isin(ACTIVITY[choice]))


def order(how: str, published: Column, note: Column | None = None) -> list[Column]:
    """The order of a list: by fit (state, score, boost), by date then fit, or by an external note then fit; ties keep the
    caller's own last key. No score counts as less than any."""
    labels = _labels()
    rank = F.array_position(F.lit(STATE_ORDER), fit_state(labels))
    points = F.when(has_prefix(labels, "FIT_SCORE:"), fit_points(labels))
    fit = [rank.asc(), points.desc_nulls_last(), boost(labels).desc()]
    if how == "recent":
        return [published.desc_nulls_last(), *fit]
    return [F.coalesce(note, F.lit(-1)).desc(), *fit] if how == "score" else fit


def score_parts(published: Column, now: Column) -> Column:
    """(total, parts): a score taken apart into (label, points); what no label explains is one part, an excluded record and
    one without a score have none."""
    labels = _labels()
    points, state = fit_points(labels), fit_state(labels)
    named = F.filter(F.array(*[F.struct(F.lit(k).alias("label"), F.when(has_prefix(labels, p), 20).otherwise(0).alias("points")) for k, p in PARTS.items()]), lambda x: x["points"] > 0)
    rest = points * 20 - 20 * F.size(named)
    ready, extra, fresh = F.when(state == "READY", 10).otherwise(0), boost(labels), recency_points(published, now)
    more = F.filter(F.array(*[F.struct(F.lit(k).alias("label"), v.cast("int").alias("points")) for k, v in ((REST, rest), (READY, ready), (BOOST, extra), (RECENT, fresh))]), lambda x: x["points"] > 0)
    out = (state == "EXCLUDE") | (points < 0) | ~has_prefix(labels, "FIT_SCORE:")
    none = F.array().cast("array<struct<label:string,points:int>>")
    total = F.least(F.lit(100), points * 20 + ready + extra + fresh)
    return F.struct(F.when(out, 0).otherwise(total).cast("int").alias("total"), F.when(out, none).otherwise(F.concat(named, more)).alias("parts"))


def level_name(seniority: Column) -> Column:
    """The level for people: the level matched, else the source's own, else a dash."""
    names = F.create_map(*[F.lit(x) for pair in LEVEL_NAMES.items() for x in pair])
    matched = F.array_join(F.transform(F.filter(_labels(), lambda x: x.startswith("SENIORITY_MATCH:")), lambda x: F.coalesce(F.try_element_at(names, F.substring(x, 17, 100)), F.substring(x, 17, 100))), ", ")
    return F.coalesce(F.when(matched != "", matched), F.try_element_at(names, fold(seniority)), F.when(seniority != "", seniority), F.lit(NOTHING))


def workplace_name(workplace: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in WORKPLACE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, workplace), F.lit(NOTHING))


def by_source(counted: DataFrame) -> DataFrame:
    """(source, n) ordered by n, the most first; of equal ones by name."""
    return counted.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source")


def low_yield(yields: DataFrame, least: int = 5) -> DataFrame:
    """Sources of at least so many records none of which is useful."""
    return yields.where((F.col("useful") == 0) & (F.col("useful") + F.col("discarded") >= least))


def cleanup_summary(judged: DataFrame) -> DataFrame:
    """What a clean-up would do: records before and after, removed by reason. judged has reason, null for what stays."""
    return judged.groupBy().agg(F.count("*").alias("before"), F.count_if(F.col("reason").isNull()).alias("after"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("off_topic", "excluded", "expired", "stale", "user_discarded")])


def described(filters: dict[str, object]) -> dict[str, str]:
    """The filters of an export as a report tells them: those that are set, lists joined."""
    return {k: ", ".join(map(str, v)) if isinstance(v, (list, tuple, set)) else str(v) for k, v in filters.items() if v not in (None, "", (), [], {}, 0)}
