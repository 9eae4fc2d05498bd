"""Queries over the operators of lists, links and scans, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from peneira.functions import labels as L
from peneira.functions.search import progress, search_url
from peneira.functions.times_sql import activity, iso_instant, portal_instant, published_instant
from peneira.operators import dashboard, filters, insight, links, merge
from peneira.operators.classify import Profile, reclassified
from peneira.plans import reference as R
from peneira.session import spread, table
from peneira.sources import scan

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _in(column: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


_PAGE = R.FOLDED_WHOLE % "concat_ws(' ', title, description_summary)"


@query(f"""with p as (select rec_id, {_PAGE} as t from vacancy)
 select rec_id, case when {_in('t', links.ASKING)} then 'UNKNOWN' when {_in('t', links.GONE)} then 'DEAD' when {_in('t', links.JOB)} and {_in('t', links.DETAILS)} and {_in('t', links.APPLY)} then 'LIVE' else 'UNKNOWN' end as link from p""")
def link_status(spark, sf_dir):
    """what the text of each record would tell of its link, were it its page."""
    page = F.concat_ws(" ", "title", "description_summary")
    return spread(R.vacancy(spark, sf_dir).select("rec_id", "title", "description_summary")).select("rec_id", links.page_status(page, F.lit(None).cast("string")).alias("link"))


@query(f"""with p as (select {_PAGE} as t from vacancy), l as (select case when {_in('t', links.ASKING)} then 'UNKNOWN' when {_in('t', links.GONE)} then 'DEAD' when {_in('t', links.JOB)} and {_in('t', links.DETAILS)} and {_in('t', links.APPLY)} then 'LIVE' else 'UNKNOWN' end as link from p)
 select count(*) filter (link = 'LIVE') as live, count(*) filter (link = 'DEAD') as dead, count(*) filter (link = 'UNKNOWN') as unknown from l""")
def link_counts(spark, sf_dir):
    """Live, dead and unknown links."""
    return links.counts(link_status(spark, sf_dir))


@query("""with l as (select canonical_url as url, case when count(*) filter (rec_id % 3 = 0) > 0 then 'DEAD' when count(*) filter (rec_id % 3 = 1) > 0 then 'LIVE' else 'UNKNOWN' end as link from incoming where canonical_url is not null group by 1)
 select rec_id, case when link is null then match_labels else list_sort(list_distinct(list_concat(list_filter(coalesce(match_labels, []), lambda x: split_part(x, ':', 1) not in ('LINK', 'LINK_CHECKED_AT', 'LINK_CHECK_METHOD')), ['LINK:' || link, 'LINK_CHECKED_AT:2026-03-01', 'LINK_CHECK_METHOD:JOB_DETAIL_V2']))) end as match_labels from vacancy left join l on canonical_url = url""")
def link_relabel(spark, sf_dir):
    """Records with the link labels of a check."""
    state = F.when(F.col("rec_id") % 3 == 0, "DEAD").when(F.col("rec_id") % 3 == 1, "LIVE").otherwise("UNKNOWN")
    found = table(spark, sf_dir, "incoming").where("canonical_url is not null").select(F.col("canonical_url").alias("url"), state.alias("link"))
    return links.relabelled(R.vacancy(spark, sf_dir).select("rec_id", "canonical_url", "match_labels"), found, "2026-03-01").select("rec_id", "match_labels")


_AGE = f"(({R.NOW_US} - pub) / 86400000000.0)"


@query(f"""select rec_id from {R.WITH_PUB} where (coalesce(workplace_model = 'REMOTE', false) or list_has_any(coalesce(match_labels, []), ['WORKPLACE_MATCH:REMOTE', 'LOCATION_MATCH:remote_brazil']))
 and (list_contains(coalesce(match_labels, []), 'SENIORITY_MATCH:junior') or coalesce({R.FOLDED_WHOLE % 'seniority'} = 'junior', false)) and coalesce(canonical_url, '') not in (select coalesce(canonical_url, '-') from incoming)""")
def quick_filters(spark, sf_dir):
    """Unseen remote junior records."""
    return dashboard.quick(R.vacancy(spark, sf_dir), {"remote", "junior", "unseen"}, R.published(), R.now(), table(spark, sf_dir, "incoming").select("canonical_url")).select("rec_id")


@query(f"select rec_id from {R.WITH_PUB} where pub <= {R.NOW_US} and pub >= epoch_us(timestamptz '2025-11-01 00:00:00-03') and pub <= epoch_us(timestamptz '2026-01-31 23:59:59.999-03')")
def age_range(spark, sf_dir):
    """Records of days from and to, both in."""
    return dashboard.aged(R.vacancy(spark, sf_dir), R.published(), R.now(), first="2025-11-01", last="2026-01-31").select("rec_id")


@query(f"select count(*) filter (pub is null) as undated, count(*) filter (pub <= {R.NOW_US} and {_AGE} <= 30) as month, count(*) filter (pub > {R.NOW_US}) as future from {R.WITH_PUB}")
def age_counts(spark, sf_dir):
    """Records without a date, of the last thirty days, and dated in the future."""
    rows = R.vacancy(spark, sf_dir)
    undated, month = (dashboard.aged(rows, R.published(), R.now(), **k).agg(F.count("*").alias(n)) for n, k in (("undated", {"undated": True}), ("month", {"days": 30})))
    return undated.crossJoin(month).crossJoin(rows.agg(F.count_if(R.published() > R.now()).alias("future")))  # three single rows


_ACTIVITY = f"case when dead < {R.NOW_US} then 'CLOSED' when pub > {R.NOW_US} then 'UNKNOWN' when pub is not null and dead is not null then 'ACTIVE_CONFIRMED' when ({R.NOW_US} - obs) / 86400000000.0 between 0 and 7 then 'ACTIVE_LISTED' else 'UNKNOWN' end"


@query(f"select rec_id from {R.WITH_PUB} where {_ACTIVITY} in ('ACTIVE_CONFIRMED', 'ACTIVE_LISTED')")
def activity_filter(spark, sf_dir):
    """Records that are open, as confirmed or listed."""
    state = activity(R.published(), R.deadline(), iso_instant(F.col("observed_at")), R.now())
    return dashboard.active(R.vacancy(spark, sf_dir), state).select("rec_id")


_BOOST = "least(10, 5 * len(list_filter(coalesce(match_labels, []), lambda x: starts_with(x, 'BONUS_MATCH:')))) + case when len(list_filter(coalesce(match_labels, []), lambda x: starts_with(x, 'COMPANY_FAVORITE:'))) > 0 then 10 else 0 end"
_RANK = f"case {R.FIT} when 'READY' then 0 when 'CONDITIONAL' then 1 when 'AMBIGUOUS' then 2 when 'OTHER_STACK' then 3 else 4 end"
_HAS = "len(list_filter(coalesce(match_labels, []), lambda x: starts_with(x, '%s'))) > 0"


@query(f"select rec_id, row_number() over (partition by source order by {_RANK}, case when {_HAS % 'FIT_SCORE:'} then {R.POINTS} end desc nulls last, {_BOOST} desc, rec_id) as by_fit, row_number() over (partition by source order by pub desc nulls last, {_RANK}, case when {_HAS % 'FIT_SCORE:'} then {R.POINTS} end desc nulls last, {_BOOST} desc, rec_id) as by_date from {R.WITH_PUB}")
def dashboard_order(spark, sf_dir):
    """O3: the place of each record in its source's list, by fit and by date."""
    place = lambda how: F.row_number().over(Window.partitionBy("source").orderBy(*dashboard.order(how, R.published()), "rec_id")).cast("bigint")
    return R.vacancy(spark, sf_dir).select("rec_id", place("fit").alias("by_fit"), place("recent").alias("by_date"))


_NAMED = " + ".join(f"case when {_HAS % p} then 1 else 0 end" for p in dashboard.PARTS.values())
_OUT = f"({R.FIT} = 'EXCLUDE' or {R.POINTS} < 0 or not ({_HAS % 'FIT_SCORE:'}))"
_READY = f"case when {R.FIT} = 'READY' then 10 else 0 end"


@query(f"select rec_id, cast(case when {_OUT} then 0 else least(100, {R.POINTS} * 20 + {_READY} + {_BOOST} + {R.RECENCY}) end as integer) as total, cast(case when {_OUT} then 0 else ({_NAMED}) + (case when {R.POINTS} * 20 > 20 * ({_NAMED}) then 1 else 0 end) + (case when {_READY} > 0 then 1 else 0 end) + (case when {_BOOST} > 0 then 1 else 0 end) + (case when {R.RECENCY} > 0 then 1 else 0 end) end as integer) as parts from {R.WITH_PUB}")
def score_breakdown(spark, sf_dir):
    """each score, and the number of parts it is made of."""
    told = dashboard.score_parts(R.published(), R.now())
    return R.vacancy(spark, sf_dir).select("rec_id", told.alias("s")).select("rec_id", "s.total", F.size("s.parts").alias("parts"))


@query("select source, n, row_number() over (order by n desc, source) as place from (select source, count(*) as n from vacancy group by 1)")
def by_source_order(spark, sf_dir):
    """Sources by how many records they have, with their place."""
    counted = R.vacancy(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return dashboard.by_source(counted).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source")).cast("bigint"))  # one line a source


@query(f"with t as (select *, {R._REASON} as reason from {R.WITH_PUB}), y as (select source, count(*) filter (reason is null) as useful, count(*) filter (reason is not null) as discarded from t group by source) select source from y where useful * 4 < discarded")
def low_yield(spark, sf_dir):
    """Sources of whose records less than a fifth is useful; the warning itself asks for none."""
    yields = insight.yields(R.vacancy(spark, sf_dir).withColumn("reason", R._reason()))
    return yields.where("useful * 4 < discarded").unionByName(dashboard.low_yield(yields)).select("source").distinct()


@query(f"with t as (select *, {R._REASON} as reason from {R.WITH_PUB}) select count(*) as before, count(*) filter (reason is null) as after, count(*) filter (reason = 'off_topic') as off_topic, count(*) filter (reason = 'excluded') as excluded, count(*) filter (reason = 'expired') as expired, count(*) filter (reason = 'stale') as stale, count(*) filter (reason = 'user_discarded') as user_discarded from t")
def cleanup_summary(spark, sf_dir):
    """What a clean-up would remove."""
    none = R.vacancy(spark, sf_dir).select("canonical_url").where("false")
    return dashboard.cleanup_summary(merge.pruned(R.vacancy(spark, sf_dir), R._reason(), none, none))


@query(f"select count(*) as n from {R.WITH_PUB} where {R.SCORE} >= 20 and workplace_model = 'REMOTE' and not coalesce(list_contains(match_labels,'RELEVANCE:OFF_TOPIC'), false)")
def export_count(spark, sf_dir):
    """The size of an export."""
    got = filters.filtered(R.vacancy(spark, sf_dir), R.published(), R.now(), workplaces=("REMOTE",), min_score=20)
    return got.agg(F.count("*").alias("n"))


@query("""select row_id, case when regexp_matches(trim(updated_at), '^\\d{2}/\\d{2}/\\d{4}( \\d{2}:\\d{2}:\\d{2})?$') then epoch_us(coalesce(try_strptime(trim(updated_at), '%m/%d/%Y %H:%M:%S'), try_strptime(trim(updated_at), '%d/%m/%Y %H:%M:%S'), try_strptime(trim(updated_at), '%m/%d/%Y'), try_strptime(trim(updated_at), '%d/%m/%Y'))) else """ + R.sql_iso("updated_at") + """ end as updated_us from api_job""")
def portal_dates(spark, sf_dir):
    """instants as interfaces write them."""
    return table(spark, sf_dir, "api_job").select("row_id", F.unix_micros(portal_instant(F.col("updated_at"))).alias("updated_us"))


_PLAIN = R.FOLDED_WHOLE % "published_at"
_SLASH, _LONG = r"(^|[^0-9])(\d{1,2})/(\d{1,2})/(\d{4})($|[^0-9])", r"(\d{1,2}) de (janeiro|fevereiro|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro) de (\d{4})"
_UNITS = {"minutos": 60, "minutes": 60, "minuto": 60, "minute": 60, "min": 60, "semanas": 604800, "semana": 604800, "weeks": 604800, "week": 604800, "months": 2592000, "meses": 2592000, "month": 2592000, "horas": 3600, "hours": 3600, "hora": 3600, "hour": 3600, "dias": 86400, "days": 86400, "day": 86400, "dia": 86400, "mes": 2592000, "h": 3600}
_AGED = rf"(\d+)\s*({'|'.join(_UNITS)})($|[^\p{{L}}\p{{N}}_])"
_MONTHS = "list_position(['janeiro','fevereiro','marco','abril','maio','junho','julho','agosto','setembro','outubro','novembro','dezembro'], regexp_extract(t, '" + _LONG + "', 2))"


@query(f"""with p as (select rec_id, published_at, {R.sql_iso('published_at')} as iso, {_PLAIN} as t from vacancy),
 d as (select rec_id, case when iso is not null then iso when regexp_matches(trim(published_at), '^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ]\\d{{2}}(:\\d{{2}}(:\\d{{2}}([.,]\\d{{1,9}})?)?)?\\s*(Z|[+-]\\d{{2}}(:?\\d{{2}})?)?)?$') then null
  when regexp_matches(t, '{_SLASH}') then epoch_us(try_strptime(regexp_extract(t, '{_SLASH}', 2) || '/' || regexp_extract(t, '{_SLASH}', 3) || '/' || regexp_extract(t, '{_SLASH}', 4), '%d/%m/%Y'))
  when regexp_matches(t, '{_LONG}') then epoch_us(try_strptime(regexp_extract(t, '{_LONG}', 1) || '/' || {_MONTHS} || '/' || regexp_extract(t, '{_LONG}', 3), '%d/%m/%Y'))
  when regexp_matches(t, '{_AGED}') then case when cast(regexp_extract(t, '{_AGED}', 1) as bigint) > 0 then {R.NOW_US} - 1000000 * cast(regexp_extract(t, '{_AGED}', 1) as bigint) * case regexp_extract(t, '{_AGED}', 2) {' '.join(f"when '{u}' then {s}" for u, s in _UNITS.items())} end end
  when regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])hoje($|[^\\p{{L}}\\p{{N}}_])') then {R.NOW_US} when regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])ontem($|[^\\p{{L}}\\p{{N}}_])') then {R.NOW_US} - 86400000000 end as us from p)
 select rec_id, case when us <= {R.NOW_US} then us end as published_us from d""")
def published_dates(spark, sf_dir):
    """when portals say that listings were published."""
    return R.vacancy(spark, sf_dir).select("rec_id", F.unix_micros(published_instant(F.col("published_at"), R.now())).alias("published_us"))


@query("""with p as (select source, batch_no as page, count(*) as cards, count(title) as records, bool_or(collection_status = 'BLOCKED') as b from incoming group by 1, 2), n as (select *, row_number() over (partition by source order by page) as n, max(page) over (partition by source) as top from p),
 s as (select *, case when n >= 4 and page < top then 'PAGE_LIMIT' end as stop from n), e as (select *, min(case when stop is not null then n end) over (partition by source) as stop_at from s)
 select source, case when max(stop) is not null then 'PARTIAL' else 'SUCCESS' end as status, max(stop) as stop_reason, count(*) as pages, cast(sum(cards) as bigint) as cards, cast(sum(records) as bigint) as records, max(stop) is not null as has_more from e where stop_at is null or n <= stop_at group by source""")
def scan_outcomes(spark, sf_dir):
    """S2, 2.10: what the scan of each source comes to; batches are its pages, four of them the limit."""
    w = Window.partitionBy("source")
    pages = table(spark, sf_dir, "incoming").groupBy("source", F.col("batch_no").alias("page")).agg(F.count("*").alias("cards"), F.count("title").alias("records"))
    told = pages.withColumn("top", F.max("page").over(w)).select(
        "source", "page", F.concat_ws("?", "source", "page").alias("url"), F.when(F.col("page") < F.col("top"), F.concat_ws("?", "source", F.col("page") + 1)).alias("next_url"), "cards", "records",
        F.lit("SUCCESS").alias("fetched"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("empty"), F.lit(True).alias("observable"), F.lit(False).alias("relocated"),
    )
    return scan.outcomes(told, 4).drop("warnings")


@query("select rec_id, 'https://www.linkedin.com/jobs/search/?keywords=' || replace(replace(url_encode(company), '%20', '+'), '~', '~') || '&location=Brasil&f_E=2%2C3&f_TPR=r604800&sortBy=DD' as url from vacancy where regexp_matches(company, '^[A-Za-z0-9 ]+$')")
def search_links(spark, sf_dir):
    """A search for each company of plain letters."""
    rows = R.vacancy(spark, sf_dir).where(F.col("company").rlike("^[A-Za-z0-9 ]+$"))
    return rows.select("rec_id", search_url(F.col("company"), F.lit("Brasil"), levels=("junior",)).alias("url"))


_LINE = "lower(source) || ': ' || collection_status || '; pages=' || batch_no || '; cards=' || rec_id || '; records=1; stop=NO_RESULTS'"


@query("select rec_id, lower(source) as source, collection_status as status, batch_no as pages, cast(rec_id as integer) as cards from incoming where source is not null and collection_status is not null")
def progress_lines(spark, sf_dir):
    """the fields of lines that report a scan."""
    rows = table(spark, sf_dir, "incoming").where("source is not null and collection_status is not null")
    return rows.select("rec_id", progress(F.expr(_LINE)).alias("p")).select("rec_id", "p.source", "p.status", "p.pages", "p.cards")


@query()
def reclassified_records(spark, sf_dir):
    """2.9.2, P13, P14: stored records classified anew against another profile."""
    profile = Profile(technologies=["JavaScript", "SQL"], primary=["React"], levels=["pleno", "senior"], places=["MG", "rio-de-janeiro-rj"], workplaces=["ONSITE", "HYBRID"])
    return reclassified(spread(R.vacancy(spark, sf_dir)), profile).select("rec_id", "fit", "fit_score", "match_labels")


@query()
def told_reasons(spark, sf_dir):
    """Why records don't fit a profile, by how often each reason is told."""
    told = reclassified_records(spark, sf_dir).select("rec_id", F.explode(L.reasons(F.col("match_labels"))).alias("reason"))
    return insight.top(told, "reason", "rec_id", 50).select("reason", "n")


@query()
def source_defaults(spark, sf_dir):
    """Company and workplace as the source's defaults complete them."""
    dim = table(spark, sf_dir, "source_dim").select(F.col("code").alias("source"), F.when(F.col("kind") == "remote", "REMOTE").alias("default_workplace"))
    return scan.with_defaults(R.vacancy(spark, sf_dir), dim).select("rec_id", "company", "workplace_model")
