"""Queries over the operators of the reference's inventory, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from peneira.functions import labels as L
from peneira.functions.places import STATES, in_scope, workplace_text, workplaces
from peneira.functions.text import (
    clean_company, clean_description, clean_title, company_from_url, fold, folding, fold_value, has_term, html_text, slug, spreadsheet_safe,
)
from peneira.functions.times_sql import activity, deadline_instant, iso_instant
from peneira.functions.urls import canonical_url
from peneira.operators import filters, insight, merge, resolve, series
from peneira.operators.classify import Profile, classified
from peneira.session import spread, table
from peneira.sinks import publish
from peneira.sources import json_items
from peneira.sources.html_lists import job_id
from peneira.streaming.first_seen import stream_first_seen

NOW_TEXT = "2026-03-01 00:00:00"
REFRESHED = ["garimpo", "painelvagas", "trampolim", "mirante", "tagide"]
PARTIAL = ["mirante"]
TERMS = ["Python", "Node", "Júnior", "Kubernetes", "PostgreSQL", "JavaScript", "Power BI", ".NET"]


def now() -> Column:
    return F.lit(dt.datetime.fromisoformat(NOW_TEXT + "+00:00"))


def published() -> Column:
    return iso_instant(F.col("published_at"))


def deadline() -> Column:
    return deadline_instant(F.col("application_deadline"))


def vacancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vacancy")


def key_of() -> Column:
    return resolve.identity_key(*[F.col(c) for c in ("source", "source_job_id", "canonical_url", "company", "title", "location")])


# ---------------------------------------------------------------- SQL parts


def sql_iso(c: str) -> str:
    """DuckDB: microseconds of an ISO text, without a zone in UTC."""
    t = rf"regexp_replace(trim({c}), '([+-]\d{{2}})(\d{{2}})$', '\1:\2')"
    guard = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?)?$"
    full = rf"regexp_replace(replace({t}, ',', '.'), '^(\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}})(Z|[+-]\d{{2}}:\d{{2}})?$', '\1:00\2')"
    secs = rf"regexp_replace({full}, '^(\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}})(Z|[+-]\d{{2}}:\d{{2}})?$', '\1:00\2')"
    zoned = rf"case when length({secs}) > 10 and regexp_matches({secs}, '(Z|[+-]\d{{2}}:\d{{2}})$') then {secs} when length({secs}) = 10 then {secs} || ' 00:00:00+00' else {secs} || '+00' end"
    micro = rf"regexp_replace({zoned}, '(\.\d{{6}})\d+', '\1')"
    return f"case when regexp_matches({t}, '{guard}') then epoch_us(try_cast({micro} as timestamptz)) end"


def sql_deadline(c: str) -> str:
    dated = rf"case when regexp_matches(trim({c}), '^\d{{4}}-\d{{2}}-\d{{2}}$') then trim({c}) || 'T23:59:59-03:00' when regexp_matches(trim({c}), '(Z|[+-]\d{{2}}:?\d{{2}})$') and length(trim({c})) > 10 then trim({c}) else trim({c}) || '-03:00' end"
    return sql_iso(f"({dated})")


NOW_US = "epoch_us(timestamptz '2026-03-01 00:00:00+00')"
FIT = "case when list_contains(match_labels,'FIT:READY') then 'READY' when list_contains(match_labels,'FIT:CONDITIONAL') then 'CONDITIONAL' when list_contains(match_labels,'FIT:EXCLUDE') then 'EXCLUDE' when list_contains(match_labels,'FIT:OTHER_STACK') then 'OTHER_STACK' else 'AMBIGUOUS' end"
POINTS = r"coalesce(cast(substr(list_filter(match_labels, lambda x: regexp_matches(x, '^FIT_SCORE:-?\d+$'))[1], 11) as integer), 0)"
PUB_AGE = f"(({NOW_US} - pub) / 86400000000.0)"
RECENCY = f"case when pub is null or {PUB_AGE} < 0 then 0 when {PUB_AGE} <= 3 then 10 when {PUB_AGE} <= 7 then 7 when {PUB_AGE} <= 14 then 4 when {PUB_AGE} <= 30 then 2 else 0 end"
SCORE = f"case when {FIT} = 'EXCLUDE' or {POINTS} < 0 then 0 else least(100, greatest(0, {POINTS} * 20 + case when {FIT} = 'READY' then 10 else 0 end + {RECENCY})) end"
WITH_PUB = f"(select *, {sql_iso('published_at')} as pub, {sql_deadline('application_deadline')} as dead, {sql_iso('observed_at')} as obs from vacancy)"
DROPPED = "('apitoken','auth','authorization','iauid','jobboardsource','session','sessionid','token')"


def sql_url(c: str) -> str:
    form = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda i: f"regexp_extract(trim({c}), '{form}', {i})"
    name = "lower(split_part(p, '=', 1))"
    kept = f"list_filter(string_split({part(5)}, '&'), lambda p: p <> '' and not starts_with({name}, 'utm_') and {name} not in {DROPPED})"
    ordered = f"list_transform(list_sort(list_transform({kept}, lambda p: {{'n': {name}, 'v': substr(p, length({name}) + 2), 'p': p}})), lambda s: s.p)"
    port = f"case when {part(3)} = '' or (lower({part(1)}) = 'https' and {part(3)} = '443') or (lower({part(1)}) = 'http' and {part(3)} = '80') then '' else ':' || {part(3)} end"
    path = f"regexp_replace({part(4)}, '/+$', '')"
    full = f"lower({part(1)}) || '://' || lower({part(2)}) || {port} || case when {path} = '' then '/' else {path} end || case when len({ordered}) = 0 then '' else '?' || array_to_string({ordered}, '&') end"
    return f"case when coalesce({c}, '') = '' then '' when {part(2)} = '' then trim({c}) else {full} end"


IDENTITY = f"""case when trim(source_job_id) <> '' then 'SOURCE_JOB_ID|' || source || ':' || trim(source_job_id)
 when {sql_url('canonical_url')} <> '' then 'CANONICAL_URL|' || {sql_url('canonical_url')}
 else 'FALLBACK_HASH|' || sha256(lower(coalesce(company,'') || '|' || coalesce(title,'') || '|' || coalesce(location,''))) end"""
ROW_KEY = """case when coalesce(canonical_url,'') <> '' then 'url:' || canonical_url when coalesce(source_job_id,'') <> '' then 'id:' || source || ':' || source_job_id
 else 'fallback:' || lower(coalesce(source,'') || '|' || coalesce(company,'') || '|' || coalesce(title,'') || '|' || coalesce(location,'')) end"""
FOLDED = r"trim(regexp_replace(strip_accents(replace(replace(lower(%s), 'ß', 'ss'), '…', '...')), '\s+', ' ', 'g'))"

_FROM, _TO = (x.replace("'", "''") for x in folding())
# With the table of compatibility letters that DuckDB has no function for.
FOLDED_WHOLE = r"trim(regexp_replace(replace(replace(replace(replace(translate(lower(%s), '" + _FROM.replace("%", "%%") + "', '" + _TO.replace("%", "%%") + r"'), 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '…', '...'), '\s+', ' ', 'g'))"

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


# ---------------------------------------------------------------- scalar functions


@query(f"select rec_id, {FOLDED % 'description_summary'} as folded from vacancy where description_summary is not null")
def fold_text(spark, sf_dir):
    """Folded descriptions."""
    return spread(vacancy(spark, sf_dir).where("description_summary is not null").select("rec_id", "description_summary")).select("rec_id", fold(F.col("description_summary")).alias("folded"))


def _sql_term(alias: str) -> str:
    body = alias.replace(".", r"\.").replace(" ", r"[\s-]+").replace("#", "#")
    if len(alias) > 2:
        return rf"(^|[^\w]){body}($|[^\w])"
    return rf"(^|[^\w.#+-]){body}($|[^\w#+$.-]|[-.]($|[^\w]))"


_ALIASES = {"Python": ["python"], "Node": ["node", "node.js", "nodejs"], "Júnior": ["junior", "jr", "nivel 1", "entry level", "iniciante"], "Kubernetes": ["kubernetes", "k8s"], "PostgreSQL": ["postgresql", "postgres"], "JavaScript": ["javascript", "js"], "Power BI": ["power bi"], ".NET": [".net", "dotnet"]}


@query(" union all ".join(
    f"select '{t}' as term, count(*) as n from (select {FOLDED % 'description_summary'} as d from vacancy) where " + " or ".join(f"regexp_matches(d, '{_sql_term(a)}')" for a in aliases)
    for t, aliases in _ALIASES.items()
))
def term_match(spark, sf_dir):
    """Records that cite a term or one of its aliases as whole words."""
    text = spread(vacancy(spark, sf_dir).select("description_summary")).select(fold(F.col("description_summary")).alias("d"))
    counted = text.agg(*[F.count_if(has_term(F.col("d"), t)).alias(f"c{i}") for i, t in enumerate(TERMS)])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"c{i}").alias("n")) for i, t in enumerate(TERMS)])).alias("x")).select("x.*")


@query(f"select rec_id, {sql_url('canonical_url')} as url from vacancy union all select rec_id, {sql_url('canonical_url')} as url from incoming")
def canonical_urls(spark, sf_dir):
    """Addresses in canonical form."""
    both = vacancy(spark, sf_dir).select("rec_id", "canonical_url").unionAll(table(spark, sf_dir, "incoming").select("rec_id", "canonical_url"))
    return both.select("rec_id", canonical_url(F.col("canonical_url")).alias("url"))


@query(f"select rec_id, {IDENTITY} as identity from vacancy")
def identity_keys(spark, sf_dir):
    """The identity of each record."""
    return vacancy(spark, sf_dir).select("rec_id", key_of().alias("identity"))


@query(f"""select rec_id, {sql_iso('published_at')} as published_us, {sql_deadline('application_deadline')} as deadline_us from vacancy""")
def iso_dates(spark, sf_dir):
    """Instants of ISO texts and deadlines."""
    return vacancy(spark, sf_dir).select("rec_id", F.unix_micros(published()).alias("published_us"), F.unix_micros(deadline()).alias("deadline_us"))


@query(r"select row_id, nullif(trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(content,'&nbsp;',chr(160)),'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&#39;',''''),'&#x27;',''''),'&apos;',''''),'&ndash;','–'),'&mdash;','—'),'&bull;','•'),'&hellip;','…'),'&amp;','&'), '<[^>]+>', ' ', 'g'), '**', ''), '[\s' || chr(160) || ']+', ' ', 'g')), '') as text from api_job".replace('\\"', '"'))
def html_texts(spark, sf_dir):
    """plain text of HTML contents."""
    return table(spark, sf_dir, "api_job").select("row_id", html_text(F.col("content")).alias("text"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_path(spark, sf_dir):
    """a value at a dotted path."""
    return table(spark, sf_dir, "events").select("event_id", json_items.item_path(F.col("props"), "k").cast("bigint").alias("k"))


@query("select s_suppkey, case when regexp_matches(x, '^[=+\\-@\\t\\r]') then '''' || x else x end as cell from (select s_suppkey, case when s_suppkey % 5 = 0 then '=' || s_name when s_suppkey % 7 = 0 then '-' || s_name else s_name end as x from supplier)")
def csv_safe(spark, sf_dir):
    """Cells that no spreadsheet takes for formulas."""
    x = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("="), "s_name")).when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("-"), "s_name")).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", spreadsheet_safe(x).alias("cell"))


@query("select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def slugs(spark, sf_dir):
    """slugs."""
    return table(spark, sf_dir, "part").select("p_partkey", slug(F.col("p_name")).alias("slug"))


@query()
def clean_fields(spark, sf_dir):
    """Titles, companies and descriptions without the portals' noise; company by address."""
    c = F.col
    return vacancy(spark, sf_dir).select("rec_id", clean_title(c("title")).alias("title"), clean_company(c("company")).alias("company"), clean_description(c("description_summary")).alias("description"), company_from_url(c("canonical_url")).alias("by_url"))


@query(f"select rec_id, case when dead < {NOW_US} then 'CLOSED' when pub > {NOW_US} then 'UNKNOWN' when pub is not null and dead is not null then 'ACTIVE_CONFIRMED' when ({NOW_US} - obs) / 86400000000.0 between 0 and 7 then 'ACTIVE_LISTED' else 'UNKNOWN' end as activity from {WITH_PUB}")
def activity_state(spark, sf_dir):
    """whether a listing is open, as far as known."""
    return vacancy(spark, sf_dir).select("rec_id", activity(published(), deadline(), iso_instant(F.col("observed_at")), now()).alias("activity"))


@query(f"select rec_id, {SCORE} as score from {WITH_PUB}")
def recency_score(spark, sf_dir):
    """The score of each record."""
    return vacancy(spark, sf_dir).select("rec_id", filters.score(published(), now()).alias("score"))


# Places as words between single spaces: marks between city and state are spaces, other marks words of their own.
_WORDS = r"' ' || trim(regexp_replace(regexp_replace(regexp_replace(%s, '[\s,/-]+', ' ', 'g'), '([^\p{L}\p{N}\p{M}_ ])', ' \1 ', 'g'), ' +', ' ', 'g')) || ' '" % (FOLDED_WHOLE % "location")


@query(" union all ".join(f"select '{u}' as state, count(*) filter (contains(w, ' {u.lower()} ') or contains(w, ' {fold_value(n)} ')) as n from (select {_WORDS} as w from vacancy)" for u, n in STATES.items()))
def location_scope(spark, sf_dir):
    """Records whose place lies in a state."""
    text = vacancy(spark, sf_dir).select(fold(F.col("location")).alias("l"))
    counted = text.agg(*[F.count_if(in_scope(F.col("l"), n)).alias(u) for u, n in STATES.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(u).alias("state"), F.col(u).alias("n")) for u in STATES])).alias("x")).select("x.*")


_SPOKEN = FOLDED_WHOLE % "concat_ws(' ', title, location, description_summary)"
_WORK = {"HYBRID": "hibrido|hybrid", "REMOTE": "remoto|remota|remote|home[ -]+office|teletrabalho", "ONSITE": "presencial|on[ -]+site|onsite"}


@query("select rec_id, case when workplace_model in ('HYBRID','REMOTE','ONSITE') then [workplace_model] else list_filter([" + ", ".join(f"case when regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])({p})($|[^\\p{{L}}\\p{{N}}_])') then '{k}' end" for k, p in _WORK.items()) + f"], lambda x: x is not null) end as workplaces from (select *, {_SPOKEN} as t from vacancy)")
def inferred_workplaces(spark, sf_dir):
    """the declared workplace, or all the text tells."""
    text = workplace_text(F.col("title"), F.col("location"), F.col("description_summary"))
    return vacancy(spark, sf_dir).select("rec_id", workplaces(F.col("workplace_model"), text).alias("workplaces"))


@query("select rec_id, sha256(cast(to_json({'canonical_url': canonical_url, 'published_at': published_at, 'rec_id': rec_id, 'source': source}) as varchar)) as fingerprint from vacancy")
def row_fingerprint(spark, sf_dir):
    """K3: a hash of a row's canonical JSON, keys sorted."""
    rows = vacancy(spark, sf_dir).select("rec_id", "source", "published_at", "canonical_url")
    return publish.fingerprint(rows, "fingerprint").select("rec_id", "fingerprint")


# ---------------------------------------------------------------- joins, merges and resolution


@query(f"""with k as (select *, {ROW_KEY} as k from vacancy), n as (select distinct {ROW_KEY} as k from incoming),
 g as (select k.* from k where k not in (select k from n) and (source not in ('garimpo','painelvagas','trampolim','mirante','tagide') or source in ('mirante') or coalesce(canonical_url,'None') in (select canonical_url from incoming where batch_no = 1 and canonical_url is not null)))
 select min(rec_id) as rec_id from g group by k""")
def carry_unrefreshed(spark, sf_dir):
    """Earlier rows that stay beside a new run."""
    inc = table(spark, sf_dir, "incoming")
    return merge.carry(inc, vacancy(spark, sf_dir), REFRESHED, PARTIAL, inc.where("batch_no = 1 and canonical_url is not null"), "rec_id").select("rec_id")


_REASON = f"case when list_contains(match_labels,'RELEVANCE:OFF_TOPIC') then 'off_topic' when {FIT} = 'EXCLUDE' then 'excluded' when dead < {NOW_US} then 'expired' when pub < {NOW_US} - 90 * 86400000000 then 'stale' end"


def _reason() -> Column:
    return merge.discard_reason(published(), deadline(), now(), merge.Rules(max_age_days=90))


@query(f"select source, coalesce({_REASON}, 'kept') as reason, count(*) as n from {WITH_PUB} group by all")
def prune_reasons(spark, sf_dir):
    """Records by the first reason to discard them."""
    none = vacancy(spark, sf_dir).select("canonical_url").where("false")
    return merge.pruned(vacancy(spark, sf_dir), _reason(), none, none).groupBy("source", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"with t as (select *, {_REASON} as reason from {WITH_PUB}) select source, count(*) filter (reason is null) as useful, count(*) filter (reason is not null) as discarded, count(*) filter (reason is null and {FIT} in ('READY','CONDITIONAL')) as compatible from t group by source")
def source_yield(spark, sf_dir):
    """Kept, discarded and compatible records by source."""
    return insight.yields(vacancy(spark, sf_dir).withColumn("reason", _reason()))


@query("select rec_id from vacancy union all select rec_id from incoming where coalesce(canonical_url,'None') not in (select distinct coalesce(canonical_url,'None') from vacancy)")
def undo_restore(spark, sf_dir):
    """Rows of a backup come back unless their address is there."""
    cols = ["rec_id", "canonical_url"]
    return merge.restored(vacancy(spark, sf_dir).select(*cols), table(spark, sf_dir, "incoming").select(*cols)).select("rec_id")


@query(f"with d as (select *, {ROW_KEY} as k, {_REASON.replace('dead', 'dd').replace('pub ', 'pp ')} as reason from (select *, {sql_iso('published_at')} as pp, {sql_deadline('application_deadline')} as dd from incoming)) select rec_id, reason is null as recovered from d where k not in (select {ROW_KEY} from vacancy)")
def recover_discarded(spark, sf_dir):
    """Discarded rows that pass the rules now."""
    return merge.recovered(vacancy(spark, sf_dir), table(spark, sf_dir, "incoming"), _reason()).select("rec_id", "recovered")


@query("""with n as (select source || '|' || source_job_id as k, max(title) as t, max(location) as l from incoming where source_job_id is not null group by 1),
 b as (select source || '|' || source_job_id as k, max(title) as title, max(location) as location from vacancy where source_job_id is not null group by 1)
 select coalesce(b.k, n.k) as k, coalesce(n.t, b.title) as title, coalesce(n.l, b.location) as location,
 case when b.k is null then 'insert' when n.k is not null and ((n.t is not null and n.t is distinct from b.title) or (n.l is not null and n.l is distinct from b.location)) then 'update' else 'keep' end as action from b full join n on b.k = n.k""")
def upsert(spark, sf_dir):
    """An import merged into the records by key."""
    keyed = lambda df: df.where("source_job_id is not null").groupBy(F.concat_ws("|", "source", "source_job_id").alias("k")).agg(F.max("title").alias("title"), F.max("location").alias("location"))
    return merge.upserted(keyed(vacancy(spark, sf_dir)), keyed(table(spark, sf_dir, "incoming")), "k", ["title", "location"])


@query("select rec_id, weight, trust_rank, coalesce(default_country, 'none') as country from vacancy v left join mix_target m on v.source = m.source left join source_dim d on v.source = d.code")
def side_scores(spark, sf_dir):
    """Side tables joined to the records; their size decides how."""
    dim = table(spark, sf_dir, "source_dim").select(F.col("code").alias("source"), "trust_rank", "default_country")
    return vacancy(spark, sf_dir).select("rec_id", "source").join(table(spark, sf_dir, "mix_target"), "source", "left").join(dim, "source", "left").select("rec_id", "weight", "trust_rank", F.coalesce("default_country", F.lit("none")).alias("country"))


_FIVE = "select canonical_url from vacancy where canonical_url is not null group by 1 having count(*) = 1 order by 1 limit 5"


@query(f"with w as (select canonical_url, 4 - (row_number() over (order by canonical_url) - 1) as pos from ({_FIVE})) select cast(pos as integer) as pos, rec_id from w join vacancy using (canonical_url)")
def selection_join(spark, sf_dir):
    """Rows of a short list of addresses in the order of the request."""
    urls = [r[0] for r in vacancy(spark, sf_dir).where("canonical_url is not null").groupBy("canonical_url").count().where("count = 1").orderBy("canonical_url").limit(5).collect()]
    return merge.selected(vacancy(spark, sf_dir), urls[::-1]).select("pos", "rec_id")


@query("select code, level, row_number() over (partition by code order by prio, level) as place from source_dim cross join (values ('estagio', 1), ('junior', 2), ('pleno', 3), ('senior', 4)) l(level, prio)")
def term_grid(spark, sf_dir):
    """Every source with every level, ranked; both are dimension tables."""
    levels = spark.createDataFrame([("estagio", 1), ("junior", 2), ("pleno", 3), ("senior", 4)], "level string, prio int")
    return table(spark, sf_dir, "source_dim").select("code").crossJoin(levels).select("code", "level", F.row_number().over(Window.partitionBy("code").orderBy("prio", "level")).cast("bigint").alias("place"))


# The sequential rule row by row: a row is taken if neither its address nor its identity was taken before.
_EXACT = f"""with recursive k as (select rec_id, nullif({sql_url('canonical_url')}, '') as u, {IDENTITY} as i, source_job_id as job, row_number() over (order by rec_id) as n from vacancy),
 walk(n, rec_id, urls, ids, took) as (select cast(0 as bigint), cast(null as bigint), cast([] as varchar[]), cast([] as varchar[]), false
  union all select k.n, k.rec_id, case when t.took and k.u is not null then list_append(w.urls, k.u) else w.urls end, case when t.took then list_append(w.ids, k.i) else w.ids end, t.took
  from walk w join k on k.n = w.n + 1, lateral (select not coalesce(list_contains(w.urls, k.u), false) and not list_contains(w.ids, k.i) as took) t),
 taken as (select rec_id, took from walk where n > 0), owner as (select k.u, k.rec_id as owner, k.job as own from k join taken using (rec_id) where took and k.u is not null),
 judged as (select k.rec_id, o.owner, coalesce(k.rec_id > o.owner and k.job <> '' and o.own <> '' and k.job <> o.own, false) as later from k left join owner o on k.u = o.u),
 bad as (select distinct owner as rec_id from judged where later)
 select j.rec_id, t.took and b.rec_id is null as kept, j.later or b.rec_id is not null as conflict from judged j join taken t using (rec_id) left join bad b using (rec_id)"""


@query(_EXACT)
def exact_dedupe(spark, sf_dir):
    """What the sequential rule over addresses and identities keeps."""
    rows = vacancy(spark, sf_dir).select("rec_id", canonical_url(F.col("canonical_url")).alias("url_key"), key_of().alias("id_key"), F.col("source_job_id").alias("job"))
    return resolve.exact_duplicates(rows, "rec_id")


@query()
def repost_cluster(spark, sf_dir):
    """One record per meaning, with where else it was seen."""
    rows = spread(vacancy(spark, sf_dir).select("rec_id", "source", "title", "company", "location", "workplace_model", "published_at", "canonical_url", "match_labels"))
    best = F.when(F.lower("canonical_url").rlike(r"^https?://[^/]*gupy\.io"), 0).otherwise(1)
    return resolve.keep_one(resolve.semantic_clusters(rows, "rec_id"), "rec_id", published(), best).select("rec_id", "match_labels")


@query("select canonical_url, count(distinct source_job_id) as ids from vacancy where canonical_url is not null and source_job_id <> '' group by 1 having count(distinct source_job_id) > 1")
def id_conflict(spark, sf_dir):
    """Addresses under which several job ids come."""
    return vacancy(spark, sf_dir).where("canonical_url is not null and source_job_id <> ''").groupBy("canonical_url").agg(F.count_distinct("source_job_id").alias("ids")).where("ids > 1")


@query(f"with k as (select rec_id, {ROW_KEY} as k from vacancy) select min(rec_id) as rec_id from k group by k")
def in_order_distinct(spark, sf_dir):
    """The first row of each key."""
    return merge.first_of(vacancy(spark, sf_dir), merge.row_key(), "rec_id").select("rec_id")


@query(f"with k as (select rec_id, {ROW_KEY} as k from vacancy), f as (select min(rec_id) as rec_id from k group by k) select rec_id from f order by rec_id desc limit 20000")
def discarded_basket(spark, sf_dir):
    """The last 20,000 distinct rows, the capacity of the basket."""
    return merge.basket(vacancy(spark, sf_dir), "rec_id").select("rec_id")


# ---------------------------------------------------------------- filters and orders


@query(f"""select rec_id from {WITH_PUB} where workplace_model in ('REMOTE','HYBRID') and ({NOW_US} - pub) / 86400000000.0 between 0 and 60 and not coalesce(dead < {NOW_US}, false)
 and not coalesce(list_contains(match_labels,'RELEVANCE:OFF_TOPIC'), false) and {FIT} in ('READY','CONDITIONAL') and lower(seniority) in ('junior','pleno') and {SCORE} >= 20""")
def filter_multi(spark, sf_dir):
    """Many conditions at once."""
    got = filters.filtered(vacancy(spark, sf_dir), published(), now(), match="fit", workplaces=("REMOTE", "HYBRID"), levels=("junior", "pleno"), max_age_days=60, min_score=20, closed=deadline() < now())
    return got.select("rec_id")


@query(f"select rec_id, {SCORE} as score from {WITH_PUB} order by score desc, pub desc nulls last, rec_id limit 100")
def sort_multi(spark, sf_dir):
    """The first page by score and date; 100 is the page."""
    return filters.ranked(vacancy(spark, sf_dir), published(), now(), "rec_id", 100).select("rec_id", "score")


@query(f"""with r as (select rec_id, source, {FIT} as f, published_at from vacancy where not (coalesce(length(description_summary), 0) >= 1500 and published_at is not null and company is not null)),
 p as (select *, case f when 'READY' then 0 when 'CONDITIONAL' then 1 when 'AMBIGUOUS' then 2 end as priority, case when published_at is null then 0 else 1 end as penalty from r),
 t as (select *, row_number() over (partition by source order by rec_id) - 1 as turn from p where priority is not null)
 select rec_id, priority, turn from t order by priority, penalty, turn, rec_id limit 120""")
def round_robin_topk(spark, sf_dir):
    """The records whose details are fetched next; 120 is the budget."""
    needs = ~((F.coalesce(F.length("description_summary"), F.lit(0)) >= 1500) & F.col("published_at").isNotNull() & F.col("company").isNotNull())
    state = L.fit_state(F.col("match_labels"))
    got = series.round_robin(vacancy(spark, sf_dir).where(needs), "source", "rec_id", F.when(state == "READY", 0).when(state == "CONDITIONAL", 1).when(state == "AMBIGUOUS", 2), F.when(F.col("published_at").isNull(), 0).otherwise(1), 120)
    return got.select("rec_id", "priority", F.col("turn").cast("bigint").alias("turn"))


@query("select event_id, ts from events order by ts desc, event_id limit 200000")
def evicted_history(spark, sf_dir):
    """The newest 200,000 entries, the capacity of the history."""
    return series.evicted(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "ts")


# ---------------------------------------------------------------- aggregations


@query("""with q as (select source, collection_status as status, count(*) as n, count(distinct batch_no) as pages, max(batch_no) > 5 as has_more, false as warned from incoming group by 1, 2)
 select source, case when count(*) = 1 then min(status) when bool_and(status in ('SUCCESS','EMPTY')) then case when sum(n) > 0 then 'SUCCESS' else 'EMPTY' end when sum(n) > 0 then 'PARTIAL' when bool_or(status = 'AUTH_REQUIRED') then 'AUTH_REQUIRED' when bool_or(status = 'BLOCKED') then 'BLOCKED' else 'ERROR' end as status,
 cast(sum(n) as bigint) as records, cast(sum(pages) as bigint) as pages, bool_or(has_more) as has_more from q group by source""")
def status_fold(spark, sf_dir):
    """A1: many query outcomes to one per source."""
    q = table(spark, sf_dir, "incoming").groupBy("source", F.col("collection_status").alias("status")).agg(F.count("*").alias("n"), F.count_distinct("batch_no").alias("pages"), (F.max("batch_no") > 5).alias("has_more"), F.lit(False).alias("warned"))
    return insight.status_fold(q)


@query(f"select count(*) as total, count(distinct source) as sources, count(*) filter ({FIT} = 'READY') as ready, count(*) filter ({FIT} = 'CONDITIONAL') as conditional, count(*) filter ({FIT} = 'EXCLUDE') as excluded from vacancy")
def dashboard_summary(spark, sf_dir):
    """A2, A3, A10: totals of a run."""
    state = L.fit_state(F.col("match_labels"))
    return vacancy(spark, sf_dir).agg(F.count("*").alias("total"), F.count_distinct("source").alias("sources"), F.count_if(state == "READY").alias("ready"), F.count_if(state == "CONDITIONAL").alias("conditional"), F.count_if(state == "EXCLUDE").alias("excluded"))


@query("select count(*) filter (s = 'SUCCESS') as success, count(*) filter (s = 'PARTIAL') as partial_, count(*) filter (s not in ('SUCCESS','PARTIAL','EMPTY')) as other from (select collection_status as s from vacancy)")
def coverage_counts(spark, sf_dir):
    """Outcomes of a collection."""
    s = F.col("collection_status")
    return vacancy(spark, sf_dir).agg(F.count_if(s == "SUCCESS").alias("success"), F.count_if(s == "PARTIAL").alias("partial_"), F.count_if(~s.isin("SUCCESS", "PARTIAL", "EMPTY")).alias("other"))


@query(f"select source, {FIT} as category, count(*) as n from vacancy group by all")
def category_by_source(spark, sf_dir):
    """A4, A5: categories by source."""
    return vacancy(spark, sf_dir).groupBy("source", insight.category().alias("category")).agg(F.count("*").alias("n"))


@query(f"""with r as (select rec_id, case {FIT} when 'AMBIGUOUS' then 'poucos dados para avaliar' end as reason from vacancy) select reason, count(*) as n from r where reason is not null group by 1""")
def reasons_topk(spark, sf_dir):
    """The told reasons by how often they occur, all of them."""
    told = vacancy(spark, sf_dir).select("rec_id", F.explode(L.reasons(F.col("match_labels"))).alias("reason"))
    return insight.top(told, "reason", "rec_id", 50).select("reason", "n")


_CANON = "case lower(t) when 'node.js' then 'node' when 'k8s' then 'kubernetes' when 'postgres' then 'postgresql' when 'js' then 'javascript' when 'go' then 'golang' when 'springboot' then 'spring boot' when 'dotnet' then '.net' when 'csharp' then 'c#' else lower(t) end"


@query(f"with e as (select distinct rec_id, {_CANON} as term from (select rec_id, unnest(technologies) as t from vacancy)), c as (select term, count(*) as n, min(rec_id) as f from e where length(term) between 2 and 40 and term not in ('python','java') group by 1 order by n desc, f, term limit 20) select term, n from c where n >= 2")
def term_insights(spark, sf_dir):
    """Technologies a profile lacks, of the 20 most common."""
    return insight.technology_insights(vacancy(spark, sf_dir), ["python", "java"], "rec_id")


@query(f"with c as (select company, count(*) filter ({FIT} in ('READY','CONDITIONAL')) as n, count(*) filter ({FIT} = 'EXCLUDE') as other from vacancy where company is not null group by 1) select company, n, other from c where n >= 2 and other < n order by n desc, company limit 8")
def signal_skew(spark, sf_dir):
    """Companies that lean to one side; the report shows 8."""
    state = L.fit_state(F.col("match_labels"))
    return insight.signal_skew(vacancy(spark, sf_dir).where("company is not null"), "company", state.isin("READY", "CONDITIONAL"), state == "EXCLUDE")


@query("select event_type, count(*) as n from (select user_id, arg_max(event_type, {'t': ts, 'e': event_id}) as event_type from events group by 1) group by 1")
def funnel(spark, sf_dir):
    """How many keys are in each stage now."""
    return series.last_stage(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id").groupBy(F.col("stage").alias("event_type")).agg(F.count("*").alias("n"))


@query("select user_id, event_type, min(ts) as reached from events group by 1, 2")
def stage_dates(spark, sf_dir):
    """W6, ST8: when each stage was reached first."""
    return series.stage_dates(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query(f"""with a as (select canonical_url, arg_min({FIT}, rec_id) as was, arg_max({FIT}, rec_id) as now_ from vacancy where canonical_url is not null group by 1) select was, now_ as "is", count(*) as n from a where was <> now_ group by 1, 2""")
def category_transitions(spark, sf_dir):
    """How many addresses changed category between their first and last reading."""
    rows = vacancy(spark, sf_dir).where("canonical_url is not null").withColumn("c", insight.category())
    return insight.transitions(rows.groupBy("canonical_url").agg(F.min_by("c", "rec_id").alias("category")), rows.groupBy("canonical_url").agg(F.max_by("c", "rec_id").alias("category")), "canonical_url")


@query(f"""with p as (select source || '|' || source_job_id as k, arg_min({FIT}, rec_id) as category from vacancy where source_job_id is not null group by 1), g as (select source || '|' || source_job_id as k, arg_min({FIT}, rec_id) as expected from incoming where source_job_id is not null group by 1)
 select expected, category, count(*) as n, count(*) filter (expected = category) as correct from p join g using (k) group by 1, 2""")
def eval_confusion(spark, sf_dir):
    """Labelled against predicted categories."""
    keyed = lambda df, c: df.where("source_job_id is not null").groupBy(F.concat_ws("|", "source", "source_job_id").alias("k")).agg(F.min_by(insight.category(), "rec_id").alias(c))
    return insight.confusion(keyed(vacancy(spark, sf_dir), "category"), keyed(table(spark, sf_dir, "incoming"), "expected"), "k")


# ---------------------------------------------------------------- windows and state


_RUNS = "select source, cast(substr(observed_at, 1, 7) as varchar) as run, case when count(*) filter (collection_status = 'BLOCKED') * 10 > count(*) then 'BLOCKED' else 'SUCCESS' end as status, count(*) as n from vacancy group by 1, 2"


@query(f"""with r as ({_RUNS}), g as (select *, sum(case when status = 'SUCCESS' then 1 else 0 end) over (partition by source order by run) + case when status = 'SUCCESS' then 0 else 1 end as g from r),
 j as (select a.source, a.run, a.status, a.n, avg(b.n) as mean, count(b.n) as seen from g a left join g b on a.source = b.source and b.status = 'SUCCESS' and b.g between a.g - 10 and a.g - 1 group by a.source, a.run, a.status, a.n)
 select source, run, status, n, round(mean, 6) as mean, seen, case when seen >= 2 and mean > 0 and n = 0 then 'ZERO' when seen >= 2 and n < mean * 0.5 then 'DROP' end as warning from j""")
def count_anomaly(spark, sf_dir):
    """W1, ST2: runs whose count falls below half of the mean of the ten before."""
    blocked = F.count_if(F.col("collection_status") == "BLOCKED")
    runs = vacancy(spark, sf_dir).groupBy("source", F.substring("observed_at", 1, 7).alias("run")).agg(F.when(blocked * 10 > F.count("*"), "BLOCKED").otherwise("SUCCESS").alias("status"), F.count("*").alias("n"))
    return series.count_anomalies(runs).select("source", "run", "status", "n", F.round("mean", 6).alias("mean"), "seen", "warning")


@query(f"""with s as (select {IDENTITY} as identity, min(observed_at) as first_seen from vacancy group by 1), n as (select {IDENTITY} as identity, min(observed_at) as first_seen from incoming group by 1)
 select coalesce(n.identity, s.identity) as identity, least(n.first_seen, s.first_seen) as first_seen, s.first_seen is null as is_new from s full join n on s.identity = n.identity""")
def first_seen(spark, sf_dir):
    """W2, ST1, J16: when an identity was seen first, and which are new."""
    state = vacancy(spark, sf_dir).select(key_of().alias("identity"), "observed_at").groupBy("identity").agg(F.min("observed_at").alias("first_seen"))
    return series.first_seen(table(spark, sf_dir, "incoming").select(key_of().alias("identity"), "observed_at"), "identity", "observed_at", state)


@query("select n_nationkey, (row_number() over (order by n_nationkey) - 1) % 4 as worker from nation")
def worker_deal(spark, sf_dir):
    """The schedule of sources over workers."""
    return series.dealt(table(spark, sf_dir, "nation"), "n_nationkey", 4).select("n_nationkey", F.col("worker").cast("bigint").alias("worker"))


@query("select user_id, min(ts) as first_seen from events group by 1")
def stream_first_seen_events(spark, sf_dir):
    """ST1 as a stream: the first event of each key, by Structured Streaming over the events."""
    return stream_first_seen(spark, f"{sf_dir}/events.parquet", "user_id", "ts")


# ---------------------------------------------------------------- labels and sources


@query(r"select rec_id, list_filter(match_labels, lambda x: not regexp_matches(x, '^(FIT|FIT_SCORE|RELEVANCE|TECHNOLOGIES):')) as kept from vacancy")
def kept_labels(spark, sf_dir):
    """Labels that a new classification keeps."""
    return vacancy(spark, sf_dir).select("rec_id", L.without_classifier(F.col("match_labels")).alias("kept"))


@query(r"""with l as (select rec_id, list_filter(list_concat(coalesce(technologies, []), list_sort(list_transform(list_filter(coalesce(match_labels, []), lambda x: starts_with(x, 'TECH_MATCH:')), lambda x: substr(x, 12)))), lambda x: x is not null and x <> '') as e from vacancy)
 select rec_id, list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y)), lower(x)) = i) as technologies from l""")
def shown_technologies(spark, sf_dir):
    """technologies to show."""
    return vacancy(spark, sf_dir).select("rec_id", L.shown_technologies(F.col("technologies"), F.col("match_labels")).alias("technologies"))


@query(r"select count(*) filter (source is null or source = '') as no_source, count(*) filter (canonical_url is not null and not starts_with(canonical_url, 'https://')) as bad_url, count(*) filter (workplace_model not in ('REMOTE','HYBRID','ONSITE','UNKNOWN')) as bad_workplace, count(*) filter (not regexp_matches(coalesce(content_hash,''), '^[0-9a-f]{64}$')) as bad_hash from vacancy")
def schema_check(spark, sf_dir):
    """K4: violations of the schema's contract."""
    c = F.col
    return vacancy(spark, sf_dir).agg(
        F.count_if(c("source").isNull() | (c("source") == "")).alias("no_source"), F.count_if(~c("canonical_url").startswith("https://")).alias("bad_url"),
        F.count_if(~c("workplace_model").isin("REMOTE", "HYBRID", "ONSITE", "UNKNOWN")).alias("bad_workplace"), F.count_if(~F.coalesce(c("content_hash"), F.lit("")).rlike("^[0-9a-f]{64}$")).alias("bad_hash"),
    )


_HTML = "nullif(trim(regexp_replace(replace(regexp_replace(" + "replace(" * 12 + "%s" + "".join(f",'{e}',{c})" for e, c in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&#x27;", "chr(39)"), ("&apos;", "chr(39)"), ("&ndash;", "'–'"), ("&mdash;", "'—'"), ("&bull;", "'•'"), ("&hellip;", "'…'"), ("&amp;", "'&'"))) + r", '<[^>]+>', ' ', 'g'), '**', ''), '[\s' || chr(160) || ']+', ' ', 'g')), '')"


@query(f"""with r as (select source, cast(job_id as varchar) as source_job_id, {sql_url('absolute_url')} as canonical_url, {_HTML % 'title'} as title, {_HTML % 'company_name'} as company, {_HTML % 'location_name'} as location,
  {sql_iso('first_published')} as published_us, {sql_iso('updated_at')} as deadline_us from api_job),
 k as (select *, coalesce('id:' || source_job_id, 'url:' || canonical_url) as k from r where title is not null and starts_with(canonical_url, 'https://')), f as (select source, k, min(canonical_url) as canonical_url from k group by 1, 2)
 select k.source, k.source_job_id, min(k.canonical_url) as canonical_url, count(distinct (title, company, location, published_us, deadline_us)) as readings from k join f on k.source is not distinct from f.source and k.k = f.k and k.canonical_url = f.canonical_url group by k.source, k.source_job_id, k.k""")
def api_readings(spark, sf_dir):
    """How many different readings each item of a JSON portal has at the address its record is taken from."""
    items = table(spark, sf_dir, "api_job")
    c = F.col
    mapped = json_items.records(items, {"title": c("title"), "url": c("absolute_url"), "id": c("job_id"), "company": c("company_name"), "location": c("location_name"), "published": c("first_published"), "deadline": c("updated_at")})
    key = F.coalesce(F.concat(F.lit("id:"), "source_job_id"), F.concat(F.lit("url:"), "canonical_url"))
    first = json_items.first_reading(mapped, "canonical_url").select(F.col("source").alias("s"), key.alias("k"), F.col("canonical_url").alias("u"))
    told = mapped.withColumn("k", key).join(first, "k").where(c("source").eqNullSafe(c("s")) & (c("canonical_url") == c("u")))
    readings = F.countDistinct(F.struct(*[F.coalesce(c(x).cast("string"), F.lit("\u0000")) for x in ("title", "company", "location", "published", "deadline")]))
    return told.groupBy("source", "source_job_id", "k").agg(F.min("canonical_url").alias("canonical_url"), readings.alias("readings")).drop("k")


@query()
def api_records(spark, sf_dir):
    """Items of JSON portals as records, each id once."""
    items = table(spark, sf_dir, "api_job")
    c = F.col
    mapped = json_items.records(items, {"title": c("title"), "url": c("absolute_url"), "id": c("job_id"), "company": c("company_name"), "description": c("content"), "location": c("location_name"), "published": c("first_published"), "deadline": c("updated_at")})
    return json_items.first_reading(mapped, "canonical_url")


@query("select code, pos, term, url from (select code, pos, term, start_url || case when contains(start_url, '?') then '&' else '?' end || 'q=' || replace(term, ' ', '+') as url, row_number() over (partition by code order by pos, term) as r from source_dim cross join (values (0, 'python'), (1, 'java junior'), (2, 'dados')) t(pos, term) where enabled) where r <= 40")
def search_sweep(spark, sf_dir):
    """Search addresses of enabled sources; 40 requests a source is the budget."""
    terms = spark.createDataFrame([(0, "python"), (1, "java junior"), (2, "dados")], "pos int, term string")
    return json_items.sweep(table(spark, sf_dir, "source_dim"), terms)


PROFILE_TERMS = ["Python", "Java"]
FIT_PROFILE = Profile(technologies=PROFILE_TERMS, levels=["junior", "pleno"], places=["sao-paulo-sp", "Paraná", "brasil"], workplaces=["REMOTE", "HYBRID"], bonus=["Docker"])


@query(f"""with t as (select rec_id, {FOLDED % "description_summary"} as d from vacancy)
 select rec_id, coalesce(regexp_matches(d, '{_sql_term("python")}') or regexp_matches(d, '{_sql_term("java")}'), false) as core from t""")
def core_terms(spark, sf_dir):
    """2.9.1, rule 3: whether a record cites a core term of a profile."""
    d = fold(F.col("description_summary"))
    return vacancy(spark, sf_dir).select("rec_id", (has_term(d, PROFILE_TERMS[0]) | has_term(d, PROFILE_TERMS[1])).alias("core"))


@query()
def fit_case(spark, sf_dir):
    """2.9.1: records classified against a profile."""
    return classified(spread(vacancy(spark, sf_dir)), FIT_PROFILE).select("rec_id", "fit", "fit_score", "match_labels")


@query(r"""select rec_id, coalesce(nullif(regexp_extract(canonical_url, '(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})', 1), ''), nullif(regexp_extract(canonical_url, '[?&](?:jk|jobId|job_id)=([^&#]+)', 1), ''),
 nullif(string_split(regexp_replace(regexp_extract(canonical_url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '/')[-1], '')) as job_id from vacancy""")
def page_keys(spark, sf_dir):
    """The job id of an address."""
    return vacancy(spark, sf_dir).select("rec_id", job_id(F.col("canonical_url")).alias("job_id"))


@query("select source, count(*) as records from vacancy group by 1")
def run_report(spark, sf_dir):
    """The rows of a run's report."""
    return publish.run_report(vacancy(spark, sf_dir).withColumn("reason", _reason())).select("source", "records")


_SAFE = r"case when regexp_matches({c}, '^[=+\-@\t\r]') then '''' || {c} else {c} end"
_CELLS = ["title", "company", "location", "workplace_model", "published_at", "source", "canonical_url"]


@query("select rec_id, " + ", ".join(f"{_SAFE.format(c=c)} as {c}" for c in _CELLS) + f", {_SAFE.format(c='labels')} as match_labels from (select *, array_to_string(match_labels, ';') as labels from vacancy)")
def csv_view(spark, sf_dir):
    # K5: the eight cells of the plain CSV.
    rows = vacancy(spark, sf_dir).withColumn("key", F.col("rec_id"))
    return publish.csv_view(rows, ["rec_id"])


@query(f"select count(*) as rows, count(distinct coalesce(canonical_url,'None')) as addresses from vacancy where {FIT} in ('READY','CONDITIONAL') and not coalesce(list_contains(match_labels,'RELEVANCE:OFF_TOPIC'), false) and coalesce(canonical_url,'None') not in (select coalesce(canonical_url,'None') from incoming)")
def news_count(spark, sf_dir):
    """Fitting records whose address another table hasn't."""
    rows = vacancy(spark, sf_dir).where(~L.off_topic(F.col("match_labels")) & L.fit_state(F.col("match_labels")).isin("READY", "CONDITIONAL")).withColumn("u", merge.url_text())
    seen = table(spark, sf_dir, "incoming").select(merge.url_text().alias("u")).distinct()
    return rows.join(seen, "u", "left_anti").agg(F.count("*").alias("rows"), F.count_distinct("u").alias("addresses"))


@query("select source, count(*) as n from vacancy where published_at is null or company is null or coalesce(length(description_summary), 0) < 1500 group by 1")
def needs_detail(spark, sf_dir):
    """Records whose detail page would tell more, by source."""
    c = F.col
    needs = c("published_at").isNull() | c("company").isNull() | (F.coalesce(F.length("description_summary"), F.lit(0)) < 1500)
    return vacancy(spark, sf_dir).where(needs).groupBy("source").agg(F.count("*").alias("n"))


@query("select lang, kind, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by 1, 2")
def document_totals(spark, sf_dir):
    """A2 over the documents: texts and characters by language and kind."""
    return table(spark, sf_dir, "documents").groupBy("lang", "kind").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""select count(*) as rows, cast(coalesce(sum(cast('0x' || substr(md5(cast(to_json({'rec_id': rec_id, 'canonical_url': canonical_url, 'content_hash': content_hash}) as varchar)), 1, 15) as bigint)), 0) as varchar) as token from vacancy""")
def table_version(spark, sf_dir):
    """ST3-ST4: a token of a table's contents."""
    rows = vacancy(spark, sf_dir)
    return publish.version(rows, ["rec_id", "canonical_url", "content_hash"])
