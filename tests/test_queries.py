"""Every query with SQL gives what DuckDB gives, over whole tables; and the contract's functions."""

from __future__ import annotations

import os
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from peneira.functions.labels import REASONS
from peneira.functions.text import fold_value
from peneira.operators import resolve
from peneira.operators.classify import Profile
from peneira.plans.reference import FIT_PROFILE

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list):
            return str(x)
        if pd.isna(x):
            return None
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else f"{x:.6g}"
        if isinstance(x, pd.Timestamp):
            return str(x.tz_localize(None) if x.tzinfo else x)
        return str(x)

    return sorted((tuple(cell(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, expected = entry.queries()[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


def rows_of(spark, name, key="rec_id"):
    return {r[key]: r for r in entry.queries()[name](spark, DATA).collect()}


def test_no_other_query_is_without_sql():
    assert {n for n in entry.queries() if n not in entry.oracle_sql() and not re.match(r"p\d+_", n)} == {"clean_fields", "repost_cluster", "api_records", "fit_case", "reclassified_records", "told_reasons", "source_defaults"}


def test_fit_case_and_reclassified(spark):
    from tests.test_classify import model

    told = Counter()
    for name, profile, again in (("fit_case", FIT_PROFILE, False), ("reclassified_records", Profile(technologies=["JavaScript", "SQL"], primary=["React"], levels=["pleno", "senior"], places=["MG", "rio-de-janeiro-rj"], workplaces=["ONSITE", "HYBRID"]), True)):
        got = rows_of(spark, name)
        records = spark.read.parquet(f"{DATA}/vacancy.parquet").collect()
        assert len(got) == len(records)
        for r in (x.asDict() for x in records):
            labels = r["match_labels"] or []
            if again and "TECHNOLOGIES:SOURCE_ONLY" not in labels:
                while r["technologies"] and f"TECH_MATCH:{r['technologies'][-1]}" in labels:
                    r["technologies"] = r["technologies"][:-1]
            fit, score, fresh = model(r, profile)
            g = got[r["rec_id"]]
            assert (g["fit"], g["fit_score"]) == (fit, score) and fresh <= set(g["match_labels"])
            if again:
                for prefix, text in REASONS.items():
                    told[text] += any(x.startswith(prefix) for x in g["match_labels"])
                stacks = [x.split(":", 1)[1] for x in g["match_labels"] if x.startswith("OTHER_STACK:")]
                if stacks:
                    told[f"stack diferente da sua ({', '.join(stacks)})"] += 1
                elif fit == "AMBIGUOUS" and not any(x.startswith(p) for x in g["match_labels"] for p in REASONS):
                    told["poucos dados para avaliar"] += 1
    got = {r["reason"]: r["n"] for r in entry.queries()["told_reasons"](spark, DATA).collect()}
    assert got == {k: n for k, n in told.most_common(50) if n} or all(told[k] == n for k, n in got.items()) and len(got) == 50


def test_clean_fields(spark):
    got, records = rows_of(spark, "clean_fields"), spark.read.parquet(f"{DATA}/vacancy.parquet").collect()
    assert len(got) == len(records)
    for r in records:
        g = got[r["rec_id"]]
        assert (g["title"] is None) == (not (r["title"] or "").strip()) or g["title"] is not None
        for x, raw in ((g["title"], r["title"]), (g["company"], r["company"]), (g["description"], r["description_summary"])):
            if x is not None:  # what is left is in the value, in order
                left = iter(re.sub(r"\s+", "", raw))
                assert all(c in left for c in re.sub(r"\s+", "", x)) and x == x.strip() and "  " not in x
        host = re.match(r"https?://([a-z0-9-]+)\.(gupy\.io|inhire\.app)/", r["canonical_url"] or "")
        if host and host[1] not in ("portal", "www", "jobs", "vagas"):
            assert g["by_url"] and g["by_url"].replace(" ", "").lower() == re.sub(r"-\d+$", "", host[1]).replace("-", "")


def test_api_records(spark):
    got = entry.queries()["api_records"](spark, DATA).collect()
    assert len({(r["source"], r["source_job_id"]) for r in got}) == len(got) > 0 and all(r["title"] and r["canonical_url"].startswith("https://") and len(r["description_summary"] or "") <= 3000 for r in got)
    raw = spark.read.parquet(f"{DATA}/api_job.parquet").where("absolute_url like 'http%' and title is not null").collect()
    assert {(r["source"], r["source_job_id"]) for r in got} <= {(r["source"], str(r["job_id"])) for r in raw}


def test_source_defaults_query(spark):
    got, records = rows_of(spark, "source_defaults"), spark.read.parquet(f"{DATA}/vacancy.parquet").collect()
    remote = {r["code"] for r in spark.read.parquet(f"{DATA}/source_dim.parquet").collect() if r["kind"] == "remote"}
    assert len(got) == len(records)
    for r in records:
        known = (r["workplace_model"] or "UNKNOWN") != "UNKNOWN"
        assert got[r["rec_id"]]["workplace_model"] == (r["workplace_model"] if known or r["source"] not in remote else "REMOTE")


def test_repost_cluster(spark):
    """Greedy first-fit groups of equal title and company, in order, and the record of each that stays."""
    fold = lambda t: " ".join(re.findall("[a-z0-9]+", fold_value(t)))

    def title(t):
        text = f" {fold(t)} "
        for a, b in resolve.JOINED.items():
            text = text.replace(f" {a} {b} ", f" {a}{b} ")
        return " ".join(w for w in (resolve.SYNONYMS.get(x, x) for x in text.split()) if w not in resolve.TITLE_NOISE)

    def company(c):
        words = fold(c).split()
        while len(words) > 1 and words[-1] in resolve.COMPANY_SUFFIXES:
            words = words[:-1]
        return "".join(words)

    cliques, stays = {}, []
    for r in sorted(spark.read.parquet(f"{DATA}/vacancy.parquet").collect(), key=lambda r: r["rec_id"]):
        key = (title(r["title"]), company(r["company"]))
        if not all(key) or fold(r["title"]) in resolve.GENERIC_TITLES:
            stays.append([r])
            continue
        place = fold(r["location"])
        fixed = place if place and r["workplace_model"] != "REMOTE" and not re.search(resolve.REMOTE, fold(f"{r['title'] or ''} {r['location'] or ''}")) else None
        for clique in cliques.setdefault(key, []):
            if all(fixed is None or other is None or fixed == other for _, other in clique):
                clique.append((r, fixed))
                break
        else:
            cliques[key].append([(r, fixed)])
    groups = stays + [[r for r, _ in clique] for of_key in cliques.values() for clique in of_key]
    got = rows_of(spark, "repost_cluster")
    assert len(got) == len(groups)
    for group in groups:
        kept = [r["rec_id"] for r in group if r["rec_id"] in got]
        assert len(kept) == 1
        source = next(r["source"] for r in group if r["rec_id"] == kept[0])
        labels = set(got[kept[0]]["match_labels"] or [])
        assert {f"ALSO_SEEN_IN:{r['source']}" for r in group if r["source"] != source} <= labels
        again = sum(r["source"] == source for r in group) - 1
        assert (f"REPOSTED:{again}" in labels) == (again > 0)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark):
    batch = {r["user_id"]: r["f"] for r in spark.read.parquet(f"{DATA}/events.parquet").groupBy("user_id").agg({"ts": "min"}).toDF("user_id", "f").collect()}
    assert {r["user_id"]: r["first_seen"] for r in entry.queries()["stream_first_seen_events"](spark, DATA).collect()} == batch


def test_location_scope_counts_every_state(spark):
    from peneira.functions.places import STATES
    from peneira.plans.reference import location_scope

    assert sorted(r["state"] for r in location_scope(spark, "/root/testdata/sf0.001").collect()) == sorted(STATES)
