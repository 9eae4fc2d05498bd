"""Whether a listing's page still stands: what landed responses tell, relabelling, counts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.labels import fit_state
from peneira.functions.text import fold, fold_value
from peneira.functions.times_sql import deadline_instant
from peneira.sources.html_lists import _postings, block_reason, select, tree

# Texts of pages that ask for something before they show anything; of pages whose listing is gone; that
# speak of a job; of its details; of applying for it.
ASKING = ["captcha", "confirme que voce e humano", "verify you are human", "faca login", "login para", "sign in to", "log in to", "acesso restrito"]
GONE = [
    "vaga nao encontrada", "vaga nao encontrada ou erro", "vaga expirada", "vaga encerrada", "esta vaga nao esta mais disponivel", "vaga removida", "vaga foi encerrada", "oferta expirada",
    "position has been filled", "position is no longer available", "job not found", "job no longer available", "this job is no longer available", "pagina nao encontrada", "page not found", "404 not found",
]
JOB = ["vaga", "job", "position", "oportunidade"]
DETAILS = ["requisitos", "responsabilidades", "requirements", "responsibilities", "qualificacoes"]
APPLY = ["candidate-se", "candidatar", "candidatura", "apply now", "apply for", "inscreva-se"]
# Last parts of paths that are a portal's front page or list, and parts of search pages.
FRONT = ["", "home", "index", "index.html", "index.php", "careers", "carreiras", "jobs", "vagas"]
SEARCH = ["search", "busca"]
# The prefixes of labels that a check writes anew.
LINK_PREFIXES = ["LINK:", "LINK_CHECKED_AT:", "LINK_CHECK_METHOD:"]
METHOD = "LINK_CHECK_METHOD:JOB_DETAIL_V2"


def _cites(folded: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | folded.contains(w)
    return out


def page_status(text: Column, title: Column) -> Column:
    """LIVE, DEAD or UNKNOWN by a page's visible text and the title it should show.

    A page that asks for a login or a proof tells nothing. It is dead if it says
    so; live only if it speaks of a job, its details and applying, and shows the
    title, where one is known.
    """
    plain = F.coalesce(fold(text), F.lit(""))
    titled = F.coalesce(plain.contains(fold(title)), F.lit(True)) | (F.coalesce(title, F.lit("")) == "")
    live = _cites(plain, JOB) & _cites(plain, DETAILS) & _cites(plain, APPLY) & titled
    return F.when(_cites(plain, ASKING), "UNKNOWN").when(_cites(plain, GONE), "DEAD").when(live, "LIVE").otherwise("UNKNOWN")


def embedded(html: str | None, title: str | None) -> tuple[str | None, str | None]:
    """(state, deadline) that data within a page tell: a portal's own record of the job, with its status and end, else
    whether there is a posting with title and description."""
    root, wanted = tree(html), fold_value(title)
    fits = lambda t: not wanted or wanted in fold_value(str(t or ""))
    load = lambda script: json.loads("".join(c for c in script.children if isinstance(c, str)))
    for script in select(root, "#__NEXT_DATA__"):
        try:
            job = load(script)["props"]["pageProps"]["job"]
        except (ValueError, TypeError, KeyError):
            continue
        if isinstance(job, dict) and "status" in job and fits(job.get("name") or job.get("title")):
            end = job.get("expiresAt")
            return ("LIVE" if job["status"] == "published" else "DEAD"), end if isinstance(end, str) else None
    for script in select(root, 'script[type="application/ld+json"]'):
        try:
            found = any(p.get("title") and p.get("description") and fits(p["title"]) for p in _postings(load(script)))
        except (ValueError, TypeError):
            continue
        if found:
            return "LIVE", None
    return None, None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column("html").to_pylist()
        told = [embedded(h, t) for h, t in zip(pages, batch.column("title").to_pylist())]
        texts = [tree(h).text() for h in pages]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("url", "title", "status", "final_url")], pa.array(texts, pa.string()), pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.string())],
            ["url", "title", "status", "final_url", "text", "told", "until"],
        )


def checked(responses: DataFrame, now: Column) -> DataFrame:
    """(url, link) of landed responses (url, title, status, final_url, html).

    Blocked pages, other statuses than 200, 404 and 410, and addresses that now
    lead to a front page or search tell nothing. What a page says comes before
    what its embedded data say; a record past its end is dead. Null pages are
    empty. Repeated rows give their rows again.
    """
    shape = "url string, title string, status int, final_url string, text string, told string, until string"
    read = responses.select("url", "title", F.col("status").cast("int").alias("status"), F.coalesce("final_url", "url").alias("final_url"), "html").mapInArrow(_read, shape)
    path = lambda c: F.rtrim(F.regexp_extract(c, r"^[^:]+://[^/?#]*([^?#]*)", 1), F.lit("/"))
    parts = F.filter(F.split(F.lower(path(F.col("final_url"))), "/"), lambda x: x != "")
    front = (F.size(parts) == 0) | F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).isin(FRONT) | F.arrays_overlap(parts, F.lit(SEARCH))
    said = page_status(F.col("text"), F.col("title"))
    over = F.coalesce(deadline_instant(F.col("until")) < now, F.lit(False))
    data = F.when(_cites(F.coalesce(fold(F.col("text")), F.lit("")), ASKING), "UNKNOWN").when(over, "DEAD").otherwise(F.coalesce("told", F.lit("UNKNOWN")))
    link = (
        F.when(block_reason(F.col("status"), F.col("final_url"), F.col("text")).isNotNull(), "UNKNOWN").when(F.col("status").isin(404, 410), "DEAD").when(F.coalesce(F.col("status"), F.lit(0)) != 200, "UNKNOWN")
        .when((path(F.col("url")) != path(F.col("final_url"))) & front, "UNKNOWN").when(said != "UNKNOWN", said).otherwise(data)
    )
    return read.select("url", link.alias("link"))


def candidates(rows: DataFrame, order: list[Column], limit: int = 80) -> DataFrame:
    """The fitting records whose links are checked next; the limit is the budget of a run."""
    fits = fit_state(F.coalesce("match_labels", F.array().cast("array<string>"))).isin("READY", "CONDITIONAL")
    return rows.where(fits & ~F.col("source").isin("indeed", "linkedin")).orderBy(*order).limit(limit)


def relabelled(rows: DataFrame, links: DataFrame, at: str) -> DataFrame:
    """rows whose address was checked with fresh link labels, others as they are. Of several results of an address the
    clearest counts: dead, then live."""
    one = links.groupBy(F.col("url").alias("canonical_url")).agg(F.min(F.struct(F.when(F.col("link") == "DEAD", 0).when(F.col("link") == "LIVE", 1).otherwise(2).alias("o"), "link")).alias("l_")).select("canonical_url", F.col("l_.link").alias("l_"))
    labels = F.coalesce("match_labels", F.array().cast("array<string>"))
    bare = F.filter(labels, lambda x: ~F.concat(F.substring_index(x, ":", 1), F.lit(":")).isin(LINK_PREFIXES))
    fresh = F.array_sort(F.array_distinct(F.concat(bare, F.array(F.concat(F.lit("LINK:"), "l_"), F.lit(f"LINK_CHECKED_AT:{at}"), F.lit(METHOD)))))
    out = rows.join(one, "canonical_url", "left")
    return out.withColumn("match_labels", F.when(F.col("l_").isNotNull(), fresh).otherwise(F.col("match_labels"))).select(*rows.columns)


def link_status(labels: Column) -> Column:
    """The state of the first link label, null if there is none."""
    return F.try_element_at(F.transform(F.filter(labels, lambda x: x.startswith("LINK:")), lambda x: F.substring(x, 6, 100)), F.lit(1))


def counts(links: DataFrame) -> DataFrame:
    """How many links are live, dead and unknown."""
    return links.agg(F.count_if(F.col("link") == "LIVE").alias("live"), F.count_if(F.col("link") == "DEAD").alias("dead"), F.count_if(F.col("link") == "UNKNOWN").alias("unknown"))
