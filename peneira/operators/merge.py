"""Merging a run with earlier output: carry, prune, recover, undo, upsert. Every join is by a key that may be skewed or
null; builds are reduced to one row per key before they are joined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peneira.functions.labels import fit_state, off_topic


@dataclass(frozen=True)
class Rules:
    """What is discarded: off-topic, excluded and expired records, and those published more than so many days ago."""

    off_topic: bool = True
    excluded: bool = True
    expired: bool = True
    max_age_days: int | None = None


def row_key() -> Column:
    """The key of a saved record, never empty: address, else id in its source, else source, company, title and place."""
    return (
        F.when(F.coalesce("canonical_url", F.lit("")) != "", F.concat(F.lit("url:"), F.col("canonical_url")))
        .when(F.coalesce("source_job_id", F.lit("")) != "", F.concat(F.lit("id:"), F.col("source"), F.lit(":"), F.col("source_job_id")))
        .otherwise(F.concat(F.lit("fallback:"), F.lower(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("source", "company", "title", "location")]))))
    )


def url_text() -> Column:
    """The address as a key in which nulls are equal."""
    return F.coalesce("canonical_url", F.lit("None"))


def first_of(rows: DataFrame, key: Column, order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in order."""
    by = F.col(order).desc() if last else F.col(order)
    return rows.withColumn("k_", key).withColumn("r_", F.row_number().over(Window.partitionBy("k_").orderBy(by))).where("r_ = 1").drop("k_", "r_")


def carry(now: DataFrame, before: DataFrame, refreshed: list[str], partial: list[str], keep_urls: DataFrame, order: str) -> DataFrame:
    """The rows of an earlier run that stay beside those of now: not seen now, and tracked, or of a source that wasn't
    refreshed or only in part; of each key the first."""
    gone = before.withColumn("k_", row_key()).join(now.select(row_key().alias("k_")).distinct(), "k_", "left_anti").drop("k_")
    tracked = gone.withColumn("u_", url_text()).join(keep_urls.select(F.col("canonical_url").alias("u_"), F.lit(True).alias("t_")).distinct(), "u_", "left").drop("u_")
    stays = F.coalesce("t_", F.lit(False)) | F.col("source").isin(partial) | ~F.col("source").isin(refreshed)
    return first_of(tracked.where(stays).drop("t_"), row_key(), order)


def discard_reason(published: Column, deadline: Column, now: Column, rules: Rules = Rules()) -> Column:
    """The first reason to discard a record with match_labels, or null. Unknown dates discard nothing."""
    labels = F.col("match_labels")
    no = F.lit(False)
    return (
        F.when(off_topic(labels) if rules.off_topic else no, "off_topic")
        .when((fit_state(labels) == "EXCLUDE") if rules.excluded else no, "excluded")
        .when(F.coalesce(deadline < now, no) if rules.expired else no, "expired")
        .when(F.coalesce(published < now - F.make_dt_interval(F.lit(rules.max_age_days)), no) if rules.max_age_days is not None else no, "stale")
    )


def pruned(rows: DataFrame, reason: Column, keep_urls: DataFrame, remove_urls: DataFrame) -> DataFrame:
    """rows with a column reason, null for those that stay. What the user removed goes first, what they keep stays."""
    marks = remove_urls.select(F.col("canonical_url").alias("u_"), F.lit(2).alias("m_")).unionAll(keep_urls.select(F.col("canonical_url").alias("u_"), F.lit(1).alias("m_"))).groupBy("u_").agg(F.max("m_").alias("m_"))
    marked = rows.withColumn("u_", url_text()).join(marks, "u_", "left")
    return marked.withColumn("reason", F.when(F.col("m_") == 2, "user_discarded").when(F.col("m_") == 1, None).otherwise(reason)).drop("u_", "m_")


def restored(current: DataFrame, backup: DataFrame) -> DataFrame:
    """current and the rows of a backup whose address it doesn't have; null addresses are equal."""
    back = backup.withColumn("u_", url_text()).join(current.select(url_text().alias("u_")).distinct(), "u_", "left_anti").drop("u_")
    return current.unionByName(back)


def recovered(kept: DataFrame, discarded: DataFrame, reason: Column) -> DataFrame:
    """Discarded rows not in kept, with a column recovered: whether they pass the rules now."""
    return discarded.withColumn("k_", row_key()).join(kept.select(row_key().alias("k_")).distinct(), "k_", "left_anti").drop("k_").withColumn("recovered", reason.isNull())


def basket(discarded: DataFrame, order: str, limit: int = 20_000) -> DataFrame:
    """The last rows of the discarded ones, each key once at its first place. The limit is the basket's capacity."""
    return first_of(discarded, row_key(), order).orderBy(F.col(order).desc()).limit(limit)


def upserted(base: DataFrame, news: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """base with news merged by key: new keys inserted, fields updated where news has a value, the rest as it was;
    action tells which. News repeated for a key count once, the greatest values."""
    one = news.groupBy(key).agg(*[F.max(f).alias(f"n_{f}") for f in fields], F.lit(True).alias("n_"))
    full = base.withColumn("b_", F.lit(True)).join(one, key, "full")
    changed = F.coalesce(*[F.when(F.col(f"n_{f}").isNotNull() & ~F.col(f"n_{f}").eqNullSafe(F.col(f)), F.lit(True)) for f in fields], F.lit(False))
    action = F.when(F.col("b_").isNull(), "insert").when(F.col("n_").isNotNull() & changed, "update").otherwise("keep")
    rest = [c for c in base.columns if c != key and c not in fields]
    return full.select(key, *[F.coalesce(f"n_{f}", f).alias(f) for f in fields], *rest, action.alias("action"))


def link_labels_carried(now: DataFrame, before: DataFrame, order: str) -> DataFrame:
    """now with the LINK labels of the last earlier row of its address, where it has none of its own."""
    links = lambda c: F.filter(c, lambda x: x.startswith("LINK"))
    old = before.where("canonical_url is not null").groupBy("canonical_url").agg(F.max_by(links(F.col("match_labels")), order).alias("l_"))
    joined = now.join(old, "canonical_url", "left")
    take = (F.size(links(F.col("match_labels"))) == 0) & (F.size(F.coalesce("l_", F.array().cast("array<string>"))) > 0)
    return joined.withColumn("match_labels", F.when(take, F.array_sort(F.array_union("match_labels", "l_"))).otherwise(F.col("match_labels"))).drop("l_")


def selected(rows: DataFrame, urls: list[str]) -> DataFrame:
    """The rows of the given addresses with their position, in that order; the list comes from a request and is short.
    An address that no row has raises an error."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(urls)), "pos int, canonical_url string")
    one = first_of(rows.where(F.col("canonical_url").isin(urls)), F.col("canonical_url"), "rec_id")
    missing = wanted.join(one, "canonical_url", "left_anti").count()
    if missing:
        raise KeyError(f"{missing} of the addresses are not there")
    return wanted.join(one, "canonical_url").orderBy("pos")
