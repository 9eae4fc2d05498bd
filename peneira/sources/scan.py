"""What a scan of a source's pages amounts to: outcome codes, layouts by kind, search variants, plausibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peneira.functions.places import states_of
from peneira.functions.text import fold_value
from peneira.functions.urls import canonical_url
from peneira.operators.classify import LEVELS
from peneira.sources import html_lists

# Selectors of layouts. A kind may have several, the first that finds cards holds.
LAYOUTS = {
    "gupy": [
        {"card": "[data-testid='job-card']", "id": "::attr(data-job-id)", "title": "h2", "url": "a::attr(href)", "company": "[data-testid='company-name']", "location": "[data-testid='job-location']"},
        {"card": "#job-listing-results li", "title": "h3", "url": "a[href*='/job/']::attr(href)", "company": "p", "location": "[data-testid='job-location']"},
    ],
    "indeed": [
        {"card": ".job_seen_beacon", "id": "a::attr(data-jk)", "title": "h3 a span::attr(title)", "url": "a::attr(href)", "company": "[data-testid='company-name']", "location": "[data-testid='text-location']"},
        {"card": ".job_seen_beacon", "id": "a::attr(data-jk)", "title": "h2", "url": "a::attr(href)", "company": "[data-testid='company-name']", "location": "[data-testid='text-location']"},
    ],
    "dynamic": [{"card": "article[data-job-id], [data-job-id]", "id": "::attr(data-job-id)", "title": "h2", "url": "a::attr(href)", "company": ".company", "location": ".location"}],
}
# The alphabet of made-up ids, and others seen.
HEX = "0123456789abcdef"
MADE_UP = ["a1b2c3d4e5f67890", "f1e2d3c4b5a67890", "0f1e2d3c4b5a6978"]
# Workplaces as interfaces take them.
API_WORKPLACES = {"REMOTE": "remote", "HYBRID": "hybrid", "ONSITE": "on-site"}


def made_up(job_id: Column) -> Column:
    """Whether an id was made up: a known one, or the digits in order from any of them on, forwards or backwards."""
    low = F.lower(job_id)
    turned = (F.length(low) == len(HEX)) & (F.lit(HEX * 2).contains(low) | F.lit((HEX * 2)[::-1]).contains(low))
    return F.coalesce(turned | low.isin(MADE_UP), F.lit(False))


def records(pages: DataFrame, kind: str, selectors: dict[str, str] | None = None) -> DataFrame:
    """Cards of landed pages (url, html) of a source of a kind, as html_lists.list_records() gives them.

    generic pages need selectors; the other kinds have their layouts, of which
    every page takes the first that gives cards. Of gupy cards the date told
    on the card is in published; indeed's made-up ids give no record, and its
    addresses are those of the job itself.
    """
    layouts = [selectors] if selectors else LAYOUTS[kind]
    keep = {"summary": "::all"} if kind == "gupy" else {}
    out: DataFrame | None = None
    for i, layout in enumerate(layouts):
        got = html_lists.list_records(pages, {**layout, **keep}).withColumn("layout", F.lit(i))
        out = got if out is None else out.unionByName(got)
    best = Window.partitionBy("url")
    ranked = out.withColumn("first_", F.min(F.when(F.col("status") == "OK", F.col("layout"))).over(best))
    chosen = ranked.where(F.col("layout") == F.coalesce("first_", F.lit(len(layouts) - 1))).drop("first_", "layout")
    published = F.regexp_extract("summary", r"(?i)publicad[ao]\s+em\s*:?\s*(\d{2}/\d{2}/\d{4})", 1)
    dated = chosen.withColumn("published", F.when((published != "") & F.lit(kind == "gupy"), published))
    if kind == "indeed":
        host = F.regexp_extract("link", r"^(\w+://[^/?#]*)", 1)
        dated = dated.where(~made_up(F.col("source_job_id"))).withColumn("link", F.when(F.col("source_job_id") != "", F.concat(host, F.lit("/viewjob?jk="), "source_job_id")).otherwise(F.col("link")))
    return dated


def outcomes(pages: DataFrame, max_pages: int) -> DataFrame:
    """(source, status, stop_reason, pages, cards, records, has_more, warnings) of scans.

    pages: one row per page read, (source, page, url, next_url, cards, records,
    fetched, reason, empty, observable, relocated): fetched is SUCCESS or what
    the fetch ended with and reason its block, empty whether the page says that
    there is nothing, observable whether it would show a next page, relocated
    whether cards were found by likeness. A scan ends at its first page that
    is a stop; what was read before it counts, so a stop after records is
    PARTIAL. One window per source; nulls count as no.
    """
    w = Window.partitionBy("source").orderBy("page")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    no = F.lit(False)
    flag = lambda c: F.coalesce(F.col(c), no)
    told = pages.withColumn("earlier", F.coalesce(F.sum("records").over(before), F.lit(0))).withColumn("read", F.array_contains(F.collect_set("url").over(before), F.col("url"))).withColumn("n", F.row_number().over(w))
    cards, found = F.coalesce("cards", F.lit(0)), F.coalesce("records", F.lit(0))
    stop = (
        F.when(F.col("read"), "PAGINATION_LOOP").when(F.coalesce("fetched", F.lit("ERROR")) != "SUCCESS", F.coalesce("reason", F.lit("FETCH_ERROR")))
        .when((cards > 0) & (found == 0), "PARSE_ZERO_RECORDS").when((cards == 0) & (F.col("earlier") > 0), "EMPTY_PAGE_AFTER_RECORDS")
        .when(cards == 0, F.when(flag("empty"), "NO_RESULTS").otherwise("LAYOUT_CHANGED"))
        .when(F.col("next_url").isNull() & ~flag("observable"), "PAGINATION_UNVERIFIED").when((F.col("n") >= max_pages) & F.col("next_url").isNotNull(), "PAGE_LIMIT")
    )
    stopped = told.withColumn("stop", stop).withColumn("end", F.min(F.when(F.col("stop").isNotNull(), F.col("n"))).over(Window.partitionBy("source")))
    used = stopped.where(F.col("end").isNull() | (F.col("n") <= F.col("end")))
    loop = F.col("stop") == "PAGINATION_LOOP"
    one = used.groupBy("source").agg(
        F.max("stop").alias("stop"), F.max_by("fetched", "n").alias("fetched"), F.count_if(~F.coalesce(loop, no)).alias("pages"), F.sum(F.when(~F.coalesce(loop, no), cards)).alias("cards"),
        F.sum(F.when(~F.coalesce(loop, no), found)).alias("records"), F.max_by(F.col("next_url").isNotNull(), "n").alias("more"), F.bool_or(flag("relocated")).alias("relocated"),
    )
    some, s = F.col("records") > 0, F.col("stop")
    status = (
        F.when(s.isNull(), F.when(F.col("relocated") & some, "PARTIAL").when(some, "SUCCESS").otherwise("EMPTY")).when(s == "NO_RESULTS", "EMPTY").when(some, "PARTIAL")
        .when(s.isin("LOGIN_REQUIRED", "TWO_FACTOR"), "AUTH_REQUIRED").when(F.coalesce("fetched", F.lit("ERROR")) != "SUCCESS", F.coalesce("fetched", F.lit("ERROR"))).when(s.isin("PAGINATION_LOOP", "PAGE_LIMIT", "PAGINATION_UNVERIFIED"), "PARTIAL").otherwise("ERROR")
    )
    reason = F.when(s.isNull() & F.col("relocated") & some, "SELECTOR_RELOCATED").otherwise(s)
    fetched_some = (F.coalesce("fetched", F.lit("ERROR")) != "SUCCESS") & some
    more = F.when(s.isin("PAGINATION_LOOP", "PAGE_LIMIT", "PAGINATION_UNVERIFIED"), True).when(fetched_some, True).when(s.isin("PARSE_ZERO_RECORDS", "EMPTY_PAGE_AFTER_RECORDS"), F.col("more")).otherwise(no)
    warnings = F.when(F.col("relocated"), F.array(F.lit("SELECTOR_RELOCATED:card"))).otherwise(F.array().cast("array<string>"))
    return one.select("source", status.alias("status"), reason.alias("stop_reason"), "pages", "cards", "records", more.alias("has_more"), warnings.alias("warnings"))


def item_outcomes(scans: DataFrame) -> DataFrame:
    """scans (source, items, mapped, distinct_items, declared) of an interface with a column code: TOTAL_MISMATCH if it
    declares another total than came, PARSE_INCOMPLETE if items gave no record, else null."""
    code = F.when(F.col("declared") > F.col("distinct_items"), "TOTAL_MISMATCH").when(F.col("mapped") < F.col("items"), "PARSE_INCOMPLETE")
    return scans.withColumn("code", code)


def plausible(found: DataFrame, page_url: str, first_page: bool, says_empty: bool, least: int = 2, title: int = 4) -> bool:
    """Whether cards found by likeness (title, link) may be believed: on a first page that doesn't say it is empty, at least
    two with a real title that lead neither to a login nor to the list itself."""
    if not first_page or says_empty:
        return False
    path = lambda c: F.rtrim(F.regexp_extract(canonical_url(c), r"^[^:]+://([^?#]*)", 1), F.lit("/"))
    login = F.concat(F.lower(path(F.col("link"))), F.lit("/")).rlike("/(login|signin|sign-in|auth)/")
    good = found.where(~login & (path(F.col("link")) != path(F.lit(page_url))) & (F.length(F.trim("title")) >= title))
    return good.limit(least).count() >= least


def without_levels(term: str) -> str:
    """A search term without the words of a level; a term of nothing else stays."""
    return " ".join(w for w in term.split() if fold_value(w) not in LEVELS) or term


def variants(workplace_parameter: str | None, state_parameter: str | None, workplaces: list[str], scopes: list[str]) -> list[dict[str, str]]:
    """The filters an interface takes itself: each workplace, those on site and hybrid for each state of the scopes."""
    if not workplace_parameter:
        return [{}]
    states = states_of(scopes) if state_parameter else []
    out = []
    for w in workplaces:
        if w in API_WORKPLACES:
            where = [None] if w == "REMOTE" or not states else states
            out += [{workplace_parameter: API_WORKPLACES[w], **({state_parameter: s} if s else {})} for s in where]
    return out or [{}]


def with_defaults(rows: DataFrame, dim: DataFrame, title_patterns: dict[str, str] | None = None) -> DataFrame:
    """rows with what holds for a whole source: company cleaned, else by the title's pattern, else by the address; the
    workplace of the source where the record's is unknown.

    dim: (source, default_workplace), joined as its size allows; title_patterns:
    a pattern per source whose groups hold a company.
    """
    from peneira.functions.text import clean_company, company_from_title, company_from_url

    by_title = F.lit(None).cast("string")
    for source, pattern in (title_patterns or {}).items():
        by_title = F.when(F.col("source") == source, company_from_title(F.col("title"), pattern)).otherwise(by_title)
    one = dim.groupBy("source").agg(F.max("default_workplace").alias("w_"))
    out = rows.join(one, "source", "left")
    unknown = F.coalesce("workplace_model", F.lit("UNKNOWN")) == "UNKNOWN"
    filled = {"company": F.coalesce(clean_company(F.col("company")), by_title, company_from_url(F.col("canonical_url"))), "workplace_model": F.when(unknown & F.col("w_").isNotNull(), F.col("w_")).otherwise(F.col("workplace_model"))}
    return out.select(*[filled.get(c, F.col(c)).alias(c) for c in rows.columns])
