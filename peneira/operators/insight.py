"""Aggregations that answer the dashboard's and the evaluation's questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.labels import fit_state, off_topic
from peneira.functions.text import canonical_column


def category() -> Column:
    """OFF_TOPIC, else the state of the labels."""
    return F.when(off_topic(F.col("match_labels")), "OFF_TOPIC").otherwise(fit_state(F.col("match_labels")))


def status_fold(results: DataFrame) -> DataFrame:
    """One status per source from those of its queries (source, status, n, pages, has_more, warned)."""
    complete = F.col("status").isin("SUCCESS", "EMPTY")
    agg = results.groupBy("source").agg(
        F.bool_and(complete).alias("whole"), F.bool_or(F.col("status") == "AUTH_REQUIRED").alias("auth"), F.bool_or(F.col("status") == "BLOCKED").alias("blocked"),
        F.bool_or("warned").alias("warned"), F.sum("n").alias("records"), F.sum("pages").alias("pages"), F.bool_or("has_more").alias("has_more"), F.count("*").alias("queries"), F.min("status").alias("only"),
    )
    status = (
        F.when(F.col("queries") == 1, F.col("only")).when(F.col("whole") & F.col("warned"), "PARTIAL").when(F.col("whole") & (F.col("records") > 0), "SUCCESS").when(F.col("whole"), "EMPTY")
        .when(F.col("records") > 0, "PARTIAL").when(F.col("auth"), "AUTH_REQUIRED").when(F.col("blocked"), "BLOCKED").otherwise("ERROR")
    )
    return agg.select("source", status.alias("status"), "records", "pages", "has_more")


def top(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The k most common values with their counts; ties by the first appearance."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_"))
    return counted.orderBy(F.col("n").desc(), "first_", key).limit(k).select(key, "n", "first_")


def technology_insights(rows: DataFrame, known: list[str], order: str, limit: int = 20) -> DataFrame:
    """Technologies of records on topic that a profile lacks: of the most common ones those that occur twice or more.
    A technology counts once a record, in its canonical form."""
    on = rows.where(~off_topic(F.col("match_labels"))).select(order, F.explode("technologies").alias("t"))
    terms = on.select(order, canonical_column(F.col("t")).alias("term")).where(F.length("term").between(2, 40) & ~F.col("term").isin(known)).distinct()
    return top(terms, "term", order, limit).where("n >= 2").select("term", "n")


def signal_skew(rows: DataFrame, key: str, positive: Column, negative: Column, least: int = 2, limit: int = 8) -> DataFrame:
    """Values that lean to the positive side: at least so often there, less often on the other."""
    counted = rows.groupBy(key).agg(F.count_if(positive).alias("n"), F.count_if(negative).alias("other"))
    return counted.where((F.col("n") >= least) & (F.col("other") < F.col("n"))).orderBy(F.col("n").desc(), key).limit(limit)


def yields(tagged: DataFrame) -> DataFrame:
    """Kept, discarded and compatible records by source; tagged has reason and match_labels."""
    return tagged.groupBy("source").agg(
        F.count_if(F.col("reason").isNull()).alias("useful"), F.count_if(F.col("reason").isNotNull()).alias("discarded"),
        F.count_if(F.col("reason").isNull() & fit_state(F.col("match_labels")).isin("READY", "CONDITIONAL")).alias("compatible"),
    )


def transitions(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """How many keys changed from one category to another; both have (key, category), the last row of a key counts."""
    joined = before.select(key, F.col("category").alias("was")).join(after.select(key, F.col("category").alias("is")), key)
    return joined.where("was <> is").groupBy("was", "is").agg(F.count("*").alias("n"))


def confusion(predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Labelled against predicted categories of the keys in both."""
    return predicted.join(gold, key).groupBy("expected", "category").agg(F.count("*").alias("n"), F.count_if(F.col("expected") == F.col("category")).alias("correct"))
