"""Queries of the problems tagged llm. pN_found applies problem N's operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.llm import glyphs, history, mixing, names, near, packing, residue, splitting, survivor, tokens
from peneira.operators.components import connected
from peneira.operators.timestamps import instants
from peneira.session import released, staged, table


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near.near_duplicates(table(spark, sf_dir, "vacancy"), "rec_id", "title", "company", "description_summary")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vacancy rows that share at least 60 % of their distinct words."""
    return near.record_pairs(*_near(spark, sf_dir)).select(F.col("a").alias("rec_id_a"), F.col("b").alias("rec_id_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vacancy rows that hold residue text in title or description_summary."""
    rows = table(spark, sf_dir, "vacancy").select("rec_id", "title", "description_summary")
    return residue.flagged(rows, ["title", "description_summary"]).where("residue").select("rec_id")


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vacancy rows without residue text."""
    rows = table(spark, sf_dir, "vacancy").select("rec_id", "title", "description_summary")
    return residue.flagged(rows, ["title", "description_summary"]).where("not residue").select("rec_id")


def p3_plain_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain form of every value of vacancy.title, company and location."""
    return glyphs.consistent(table(spark, sf_dir, "vacancy"), "rec_id", ["title", "company", "location"]).select(F.col("row_id").alias("rec_id"), "field", "plain")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of vacancy.title, company and location that differ from their plain form."""
    return glyphs.consistent(table(spark, sf_dir, "vacancy"), "rec_id", ["title", "company", "location"], changed_only=True).select(F.col("row_id").alias("rec_id"), "field")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, root): the vacancy rows linked by p1 and the group each belongs to."""
    members, links = _near(spark, sf_dir)
    kept = staged(members, "members", by="class")
    roots = connected(links.select("a", "b"))
    released(members)
    several = kept.groupBy("class").agg(F.count("*").alias("n"))
    named = kept.join(roots.withColumnRenamed("node", "class"), "class", "left").join(several, "class")
    return named.where("root is not null or n > 1").select(F.col("rec").alias("rec_id"), F.coalesce("root", "class").alias("root"))


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dim = table(spark, sf_dir, "vacancy"), table(spark, sf_dir, "source_dim")
    members = staged(survivor.grouped(rows, _groups(spark, sf_dir)), "grouped")
    dated = instants(members, dim, "rec_id", {"published_at": False}, "observed_at")
    return survivor.survivors(survivor.measured(members, dated, dim))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each group of copies that no other one betters in source, date, text or place."""
    return _survivors(spark, sf_dir).where("whole is not null").select(F.col("whole").alias("rec_id"))


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one surviving record of each group of copies, built bundle by bundle."""
    bundles = {"origin": ["source", "source_job_id", "canonical_url"], "dated": ["published_at"], "text": ["title", "description_summary"], "place": ["location", "workplace_model", "remote_scope"]}
    return survivor.built(table(spark, sf_dir, "vacancy"), _survivors(spark, sf_dir), bundles)


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.deduplicated(table(spark, sf_dir, "vacancy"), table(spark, sf_dir, "incoming"), "rec_id", "batch_no")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """incoming rows that are the same listing as a row of vacancy or an earlier incoming row."""
    return _repeats(spark, sf_dir).select(F.col("rec").alias("rec_id"))


def p6_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truly new listings of incoming."""
    return table(spark, sf_dir, "incoming").join(_repeats(spark, sf_dir).select(F.col("rec").alias("rec_id")), "rec_id", "left_anti").select("rec_id", "batch_no")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of vacancy and search_profile that mean a company of company_ref and aren't written like it."""
    profiles = table(spark, sf_dir, "search_profile")
    told = table(spark, sf_dir, "vacancy").select(F.lit("company").alias("field"), F.col("rec_id").alias("row_id"), F.col("company").alias("spelled"))
    for field in ("excluded_companies", "favorite_companies"):
        told = told.unionAll(profiles.select(F.lit(field).alias("field"), F.col("profile_id").alias("row_id"), F.explode(field).alias("spelled")))
    return names.linked(told, table(spark, sf_dir, "company_ref"))


CONTAINER = 4096


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of 4,096 tokens, or of a smaller permitted size where its contents fit one."""
    return packing.packed(tokens.sized(table(spark, sf_dir, "documents"), "doc_id", "text"), (512, 1024, 2048, CONTAINER))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents larger than a container: those of which a second piece was packed."""
    return p8_containers(spark, sf_dir).where("piece = 1").select("doc_id")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = staged(tokens.sized(table(spark, sf_dir, "documents"), "doc_id", "text", ["source", "lang"]), "sized")
    tree = table(spark, sf_dir, "source_dim").select(F.col("code").alias("source"), F.col("kind").alias("domain"))
    return sized, mixing.leaf_report(sized, table(spark, sf_dir, "mix_target"), tree)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mixing.mixture(*_mix(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares the mixture reached, by source."""
    sized, report = _mix(spark, sf_dir)
    return mixing.shares(staged(mixing.mixture(sized, report), "mixture"), report)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that can't reach their weight even with every document used as often as allowed."""
    return p9_shares(spark, sf_dir).where("short").select("source")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document of more than 1,024 tokens."""
    return splitting.pieces(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of more than 1,024 tokens: those that came out in pieces."""
    return p10_pieces(spark, sf_dir).where("piece = 0").select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p2_found, p2_kept, p3_found, p3_plain_values, p4_found, p4_survivors, p6_found, p6_new, p7_found,
        p8_found, p8_containers, p9_found, p9_mixture, p9_shares, p10_found, p10_pieces,
    )
}
SQL: dict[str, str] = {}
