"""Items of JSON portals to records of the one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.text import clean_description, html_text
from peneira.functions.times_sql import iso_instant
from peneira.functions.urls import canonical_url


def item_path(item: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text; null where it isn't there."""
    return F.get_json_object(item, "$" + "".join(f".{p}" for p in path.split(".") if p))


def place(city: Column, state: Column) -> Column:
    """City and state with a comma; names in capitals get title case."""
    named = lambda c: F.when((c == F.upper(c)) & (F.length(c) > 2), F.initcap(c)).otherwise(c)
    return F.concat_ws(", ", F.when(city != "", named(city)), F.when(state != "", named(state)))


def records(items: DataFrame, fields: dict[str, Column], source: str | None = None, limit: int = 3000) -> DataFrame:
    """Records from columns of an item: title, url, and where known id, company, description, location, published,
    deadline, technologies, workplace. An item without a title or a secure address gives none. The description is cut
    at the limit of the schema."""
    col = lambda k: fields.get(k, F.lit(None).cast("string"))
    title = html_text(col("title"))
    out = items.select(
        (F.lit(source) if source else F.col("source")).alias("source"), F.when(col("id").cast("string") != "", col("id").cast("string")).alias("source_job_id"),
        canonical_url(col("url")).alias("canonical_url"), title.alias("title"), html_text(col("company")).alias("company"),
        F.substring(clean_description(html_text(col("description"))), 1, limit).alias("description_summary"), html_text(col("location")).alias("location"),
        F.coalesce(F.upper(col("workplace")), F.lit("UNKNOWN")).alias("workplace_model"), iso_instant(col("published")).alias("published"), iso_instant(col("deadline")).alias("deadline"),
    )
    return out.where(F.col("title").isNotNull() & F.col("canonical_url").startswith("https://"))


def first_reading(records_: DataFrame, order: str) -> DataFrame:
    """One record per id, or per address where there is no id: the first in order."""
    key = F.coalesce(F.concat(F.lit("id:"), "source_job_id"), F.concat(F.lit("url:"), "canonical_url"))
    return records_.withColumn("k_", key).groupBy("source", "k_").agg(F.min_by(F.struct(*records_.columns), order).alias("r_")).select("r_.*")


def page_urls(base: str, mode: str, pages: int, size: int = 1) -> list[str]:
    """Addresses of the pages of a source: offset, page0, page1 or single."""
    if mode == "single":
        return [base]
    join = "&" if "?" in base else "?"
    number = {"offset": lambda i: f"offset={i * size}", "page0": lambda i: f"page={i}", "page1": lambda i: f"page={i + 1}"}[mode]
    return [f"{base}{join}{number(i)}" for i in range(pages)]


def sweep(sources: DataFrame, terms: DataFrame, limit: int = 40) -> DataFrame:
    """Search addresses of every source for every term, in the terms' order, at most so many a source. Sources and terms
    are dimension tables; the limit is the request budget of a source."""
    from pyspark.sql import Window

    crossed = sources.where("enabled").select("code", "start_url").crossJoin(terms.select("pos", "term"))
    full = crossed.select("code", "pos", "term", F.concat("start_url", F.when(F.col("start_url").contains("?"), "&").otherwise("?"), F.lit("q="), F.url_encode("term")).alias("url"))
    return full.withColumn("r_", F.row_number().over(Window.partitionBy("code").orderBy("pos", "term"))).where(F.col("r_") <= limit).drop("r_")
