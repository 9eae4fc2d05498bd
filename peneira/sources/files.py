"""Files: JSON lines, gold labels, feeds, imports, side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.functions.text import clean_description, html_text
from peneira.functions.urls import canonical_url

TEXTS = "source source_job_id canonical_url title company description_summary seniority employment_type location workplace_model remote_scope published_at observed_at first_seen_at application_deadline collection_status content_hash identity_strength".split()
LISTS = "technologies requirements eligibility_notes evidence_snippets match_labels".split()
RECORD = ", ".join([*(f"{t} string" for t in TEXTS), *(f"{t} array<string>" for t in LISTS)])
CATEGORIES = ["READY", "CONDITIONAL", "AMBIGUOUS", "OTHER_STACK", "EXCLUDE", "OFF_TOPIC"]


def json_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records of a JSON-lines file: strict stops at an unreadable line, lenient leaves it out. Lines of nothing but spaces are no lines."""
    return spark.read.schema(RECORD).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """(url, expected) of a CSV with url and esperado, semicolons or commas, with or without a byte-order mark. Rows
    without either are no labels; an unknown category raises an error."""
    head = spark.read.text(path).limit(1).collect()
    first = head[0]["value"] if head else ""
    rows = spark.read.csv(path, header=True, sep=";" if first.count(";") >= first.count(",") else ",")
    for name in rows.columns:
        rows = rows.withColumnRenamed(name, name.lstrip("﻿").strip())
    labels = rows.select(F.trim("url").alias("url"), F.upper(F.trim("esperado")).alias("expected")).where("url <> '' and expected <> ''")
    bad = labels.where(~F.col("expected").isin(CATEGORIES)).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['expected']} is no category")
    return labels


def feed(spark: SparkSession, path: str, source: str, limit: int = 3000) -> DataFrame:
    """Records of RSS files. A file whose head declares a DOCTYPE or an entity is refused whole; items without a title or a
    secure address give none."""
    files = spark.read.format("binaryFile").load(path)
    safe = files.where(~F.lower(F.substring(F.decode("content", "UTF-8"), 1, 4096)).rlike("<!(doctype|entity)")).select("path")
    paths = [r["path"] for r in safe.collect()]  # one line for each file
    schema = "title string, link string, description string, category string, pubDate string, `content:encoded` string"
    if not paths:
        items = spark.createDataFrame([], schema)
    else:
        items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(",".join(paths))
    content = F.coalesce("`content:encoded`", F.lit(""))
    named = F.regexp_extract("title", r"^(.*\S)\s+na empresa\s+(\S.*)$", 1)
    by_title = F.regexp_extract("title", r"^(.*\S)\s+na empresa\s+(\S.*)$", 2)
    by_content = html_text(F.regexp_extract(content, r"(?i)Empresa:\s*(?:</?[^>]+>\s*)*([^<\n]+)", 1))
    return items.where("title <> '' and link like 'https://%'").select(
        F.lit(source).alias("source"), canonical_url(F.col("link")).alias("canonical_url"), html_text(F.when(named != "", named).otherwise(F.col("title"))).alias("title"),
        F.coalesce(by_content, html_text(by_title)).alias("company"), html_text(F.regexp_extract(content, r"(?i)Tipo:\s*(?:</?[^>]+>\s*)*([^<\n]+)", 1)).alias("employment_type"),
        F.substring(clean_description(html_text(F.col("description"))), 1, limit).alias("description_summary"),
        F.try_to_timestamp(F.regexp_replace(F.regexp_replace("pubDate", r"^\w{3},\s*", ""), r"\s(GMT|UT|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z")).alias("published"),
    )


def imported(text: DataFrame, value: str = "value") -> DataFrame:
    """(job_id, url, title, company) of lines that hold links to job pages; of repeated ids the most told. Other links and
    lines give nothing. A title is what stands before the link on its line."""
    links = text.select(F.explode(F.regexp_extract_all(value, F.lit(r"(https?://[^\s,;<>\"')]+)"), 1)).alias("url"), F.trim(F.regexp_replace(F.regexp_replace(value, r"https?://.*$", ""), r"[\s\-–—|•*·]+$", "")).alias("before"))
    number = F.coalesce(*[F.when(c != "", c) for c in (F.regexp_extract("url", r"/jobs/view/(?:[^/?#]*-)?(\d{6,})", 1), F.regexp_extract("url", r"[?&]currentJobId=(\d{6,})", 1))])
    slug = F.regexp_extract("url", r"/jobs/view/([^/?#]*?)-?\d{6,}", 1)
    words = F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))
    parts = F.split(words, " At ")
    rows = links.select(number.alias("job_id"), F.coalesce(F.when(F.col("before") != "", F.col("before")), F.when(slug != "", parts[0])).alias("title"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("company")).where("job_id is not null")
    return rows.groupBy("job_id").agg(F.max("title").alias("title"), F.max("company").alias("company")).select("job_id", F.concat(F.lit("https://www.linkedin.com/jobs/view/"), "job_id").alias("url"), "title", "company")


STATUSES = ["SAVED", "APPLIED", "INTERVIEW", "OFFER", "REJECTED", "DISCARDED"]


def checked(side: DataFrame, rule: Column, what: str) -> DataFrame:
    """A side table of which every row keeps a rule; else an error, and nothing of it is used."""
    bad = side.where(~F.coalesce(rule, F.lit(False))).limit(1).count()
    if bad:
        raise ValueError(f"{what}: a row breaks the contract")
    return side
