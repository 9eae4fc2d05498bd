"""Search links for people and the lines a run reports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.functions.places import COUNTRY, NAMES, STATES, state_of
from peneira.functions.text import fold_value

# The parameters of the public search form.
BASE = "https://www.linkedin.com/jobs/search/"
PERIODS = {"day": "r86400", "week": "r604800", "month": "r2592000", "any": ""}
EXPERIENCE = {"estagio": ["1"], "junior": ["2", "3"], "pleno": ["3", "4"], "senior": ["4"]}
WORKPLACE_CODES = {"ONSITE": "1", "REMOTE": "2", "HYBRID": "3"}


def location_query(scope: str) -> str:
    """A scope as a search form takes it: city, state and country, in capitalized words."""
    words = [w for w in re.split(r"[-_\s]+", scope.strip()) if w]
    plain = fold_value(" ".join(words))
    state = state_of(scope)
    if not words or plain in COUNTRY or plain == f"remoto {COUNTRY[0]}":
        return "Brasil"
    if state is None:
        return ", ".join(w.capitalize() for w in words)
    # What is left of the scope before the state's own words is the city.
    own = next(k for k in range(len(words)) if NAMES.get(fold_value(" ".join(words[k:]))) == state)
    return ", ".join(x for x in (" ".join(w.capitalize() for w in words[:own]), STATES[state], "Brasil") if x)


def search_url(term: Column, location: Column, levels: Sequence[str] = (), workplaces: Sequence[str] = (), period: str = "week") -> Column:
    """The address of a search; filters that would take in everything are left out."""
    quoted = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    codes = sorted({x for v in levels for x in EXPERIENCE.get(v, [])})
    models = sorted({WORKPLACE_CODES[w] for w in workplaces if w in WORKPLACE_CODES})
    parts = [("f_E", "%2C".join(codes) if len(levels) < len(EXPERIENCE) else ""), ("f_WT", "%2C".join(models) if len(models) < len(WORKPLACE_CODES) else ""), ("f_TPR", PERIODS.get(period, PERIODS["week"])), ("sortBy", "DD")]
    return F.concat(F.lit(f"{BASE}?keywords="), quoted(term), F.lit("&location="), quoted(location), F.lit("".join(f"&{k}={v}" for k, v in parts if v)))


def search_plan(spark: SparkSession, terms: Sequence[str], scopes: Sequence[str], most_terms: int = 12, most_scopes: int = 3, **filters) -> DataFrame:  # noqa: ANN003
    """(term, location, url) of the first terms with the first places; the limits are those of the plan a person works through."""
    places = list(dict.fromkeys(map(location_query, scopes)))[:most_scopes] or ["Brasil"]
    rows = [(i, j, t, p) for i, t in enumerate(list(dict.fromkeys(terms))[:most_terms]) for j, p in enumerate(places)]
    plan = spark.createDataFrame(rows, "i int, j int, term string, location string")
    return plan.select("i", "j", "term", "location", search_url(F.col("term"), F.col("location"), **filters).alias("url")).orderBy("i", "j").drop("i", "j")


PROGRESS = r"^([a-z0-9-]+): ([A-Z_]+); pages=(\d+); cards=(\d+); records=(\d+); stop=([A-Z_]+)$"


def progress(line: Column) -> Column:
    """(source, status, pages, cards, records, stop_reason) of a line that reports a scan; null for any other line."""
    part = lambda i: F.regexp_extract(F.trim(line), PROGRESS, i)
    told = F.struct(part(1).alias("source"), part(2).alias("status"), *[part(i).cast("int").alias(n) for i, n in ((3, "pages"), (4, "cards"), (5, "records"))], part(6).alias("stop_reason"))
    return F.when(F.trim(line).rlike(PROGRESS), told)
