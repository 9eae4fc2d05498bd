"""The export filter, its score and its orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.labels import boost, fit_points, fit_state, off_topic, values_of
from peneira.functions.text import fold, fold_value
from peneira.functions.times_sql import age_days, recency_points


def score(published: Column, now: Column) -> Column:
    """0 to 100 from the labels and the age of a record; 0 for an excluded one."""
    labels = F.col("match_labels")
    state, points = fit_state(labels), fit_points(labels)
    total = points * 20 + F.when(state == "READY", 10).otherwise(0) + boost(labels) + recency_points(published, now)
    return F.when((state == "EXCLUDE") | (points < 0), 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), total)))


STATES = {"ready": ["READY"], "fit": ["READY", "CONDITIONAL"], "review": ["CONDITIONAL", "AMBIGUOUS"], "otherstack": ["OTHER_STACK"], "exclude": ["EXCLUDE"]}
SEARCHED = "title company location technologies match_labels description_summary requirements evidence_snippets seniority remote_scope".split()


def filtered(rows: DataFrame, published: Column, now: Column, *, text: str = "", source: str = "", match: str = "", min_score: int = 0, levels: tuple[str, ...] = (), workplaces: tuple[str, ...] = (), max_age_days: float | None = None, closed: Column | None = None) -> DataFrame:
    """The rows that pass every given condition; an empty one is no condition.

    A record without a date, or dated in the future, isn't recent. Off-topic
    records show only if asked for. Comparisons of columns come first so that
    they reach the scan; the text search over all fields comes last.
    """
    out = rows
    if source:
        out = out.where(F.col("source") == source)
    if workplaces:
        out = out.where(F.col("workplace_model").isin(*workplaces))
    if max_age_days is not None:
        out = out.where(age_days(published, now).between(0, max_age_days))
    if match in ("ready", "fit") and closed is not None:
        out = out.where(~F.coalesce(closed, F.lit(False)))
    if match == "offtopic":
        out = out.where(off_topic(F.col("match_labels")))
    elif match != "all":
        out = out.where(~off_topic(F.col("match_labels")))
    if match in STATES:
        out = out.where(fit_state(F.col("match_labels")).isin(*STATES[match]))
    if levels:
        out = out.where(F.lower("seniority").isin(*levels) | F.arrays_overlap(values_of(F.col("match_labels"), "SENIORITY_MATCH:"), F.array(*map(F.lit, levels))))
    if min_score:
        out = out.where(score(published, now) >= min_score)
    if text:
        document = fold(F.to_json(F.struct(*[F.col(c) for c in SEARCHED]), {"ignoreNullFields": "false"}))
        out = out.where(document.contains(fold_value(text)))
    return out


def ranked(rows: DataFrame, published: Column, now: Column, order: str, limit: int) -> DataFrame:
    """The first rows by score, newest first among equals, undated last. The limit is the page."""
    return rows.withColumn("score", score(published, now)).withColumn("published", published).orderBy(F.col("score").desc(), F.col("published").desc_nulls_last(), order).limit(limit)
