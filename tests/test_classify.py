"""The classifier: hand-made cases, and all records of a table against a plain model record by record."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from peneira.functions.places import STATES, WORKPLACES, scope_of
from peneira.functions.text import canonical_term, fold_value, term_pattern
from peneira.operators import classify
from peneira.operators.classify import Profile

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "rec_id int, source string, title string, description_summary string, seniority string, location string, technologies array<string>, requirements array<string>, evidence_snippets array<string>, workplace_model string, remote_scope string, company string, match_labels array<string>, c_ string"


def has(text, term):
    return bool(re.search(term_pattern(term).replace("(?U)", ""), text or ""))


def word(text, names):
    return any(re.search(rf"(?<!\w){re.escape(n)}(?!\w)", text) for n in names)


def lies_in(place, scope):
    """A plain reading of in_scope() for scopes without a city cut short."""
    s = scope_of(scope)
    names = [s.state.lower(), *([fold_value(STATES[s.state])] if s.state in STATES else [])] if s.state else []
    if s.city:
        return bool(re.search(rf"(?<!\w){s.city}[\s,/-]+({'|'.join(names)})(?!\w)", place))
    if s.country:
        return has(place, s.term) or word(place, [*[u.lower() for u in STATES], *map(fold_value, STATES.values())])
    return word(place, names) if s.state else has(place, s.term)


def model(r, p: Profile, country="BR"):
    """State, score and labels of one record, condition by condition."""
    join = lambda *xs: fold_value(" ".join(x for x in xs if x))
    text = join(r["title"], r["description_summary"], r["seniority"], r["location"], *[" ".join(x for x in (r[k] or []) if x) for k in ("technologies", "requirements", "evidence_snippets")])
    level, place, scope, title = join(r["title"], r["seniority"]), fold_value(r["location"]), fold_value(r["remote_scope"]), fold_value(r["title"])
    out = set()
    tech = {t for x in p.technologies if has(text, t := canonical_term(x))}
    core = any(has(text, t) for t in p.core)
    out |= {f"TECH_MATCH:{t}" for t in tech}
    if p.primary and not core:
        out.add("PRIMARY_TECH_MISSING:" + ",".join(sorted(set(p.core))))
    wanted = {canonical_term(v) for v in p.levels}
    seen = {v for v in classify.LEVELS if has(level, v)} | ({"junior"} if re.search(r"(?<=\w )i(?=\s*(?:$|[-|,(]))", level) else set())
    low, high, sign = r"(?:junior|jr|estagio|estagiario|estagiaria)\.?", r"(?:pleno|pl)(?![\w/])", r"\s*(?:[/|,-]|\b(?:ou|e|a|ate)\b)\s*"
    wide = bool(seen & {"estagio", "junior"}) and bool(re.search(rf"(?<!\w){low}{sign}{high}|(?<!\w){high}{sign}{low}(?!\w)", level))
    hit = seen & wanted
    miss = set() if hit else {v for v in seen - wanted if not (v == "pleno" and wide)}
    barred = {t for x in p.excluded if (t := canonical_term(x)) not in wanted and has(level, t) and not (t == "pleno" and wide)}
    miss |= barred & set(classify.LEVELS)
    titles = barred - set(classify.LEVELS)
    out |= {f"SENIORITY_MATCH:{v}" for v in hit} | {f"SENIORITY_MISMATCH:{v}" for v in miss} | {f"TITLE_EXCLUDED:{t}" for t in titles} | ({"SENIORITY_UNCLEAR:range"} if wide else set())
    spoken = fold_value(" ".join(x for x in (r["title"], r["location"], r["description_summary"]) if x))
    work = {r["workplace_model"]} if r["workplace_model"] in WORKPLACES else {k for k, ws in WORKPLACES.items() if any(re.search(rf"(?<!\w){w.replace(' ', '[ -]+')}(?!\w)", spoken) for w in ws)}
    remote = "REMOTE" in work or any(has(place, m) for m in ("remoto", "remote", "home office"))
    brazil = lambda s: has(s, "brasil") or has(s, "brazil")

    def silent(s):
        if word(s, [*[u.lower() for u in STATES], *map(fold_value, STATES.values())]):
            return True
        for w in ["home office", "home-office", "remoto", "remota", "remote", "teletrabalho", *classify.NEUTRAL]:
            s = re.sub(rf"(?<!\w){w}(?!\w)", " ", s)
        return not re.sub(r"[\W\d_]+", "", s)

    here = remote and all(brazil(s) or silent(s) for s in (scope, place)) and not any(has(join(r["title"], r["description_summary"]), n) for n in classify.ABROAD) and (brazil(scope) or brazil(place) or country == "BR")
    anywhere = place in classify.ANYWHERE or classify.ANYWHERE_PHRASE in place
    told = place != "" and not anywhere
    places = {s for s in p.places if told and lies_in(place, s)}
    place_hit = bool(places) or here
    place_miss = told and not remote and not place_hit and place not in classify.UNTOLD
    settled = r["workplace_model"] if (r["workplace_model"] or "UNKNOWN") != "UNKNOWN" else next(iter(work)) if len(work) == 1 else None
    region = {w.lower() for w, ss in p.regions.items() if ss and settled == w and told and not any(lies_in(place, s) for s in ss)}
    out |= {f"LOCATION_MATCH:{s}" for s in places} | ({"LOCATION_MATCH:remote_brazil"} if here else set()) | ({"LOCATION_MISMATCH:outside_scope"} if place_miss else set()) | {f"REGION_MISMATCH:{w}" for w in region}
    out |= ({"LOCATION_UNCLEAR:remote_scope"} if remote and not here else set()) | ({"LOCATION_UNCLEAR:missing"} if not remote and not place else set()) | ({"LOCATION_UNCLEAR:multiple"} if place and anywhere else set())
    work_hit, asked = work & set(p.workplaces), bool(p.workplaces)
    if asked:
        out |= {f"WORKPLACE_MATCH:{w}" for w in work_hit} | ({"WORKPLACE_UNCLEAR:missing"} if not work else {"WORKPLACE_UNCLEAR:multiple"} if len(work) > 1 else set())
        out |= {f"WORKPLACE_MISMATCH:{w}" for w in work} if work and not work_hit else set()
    if (r["workplace_model"] or "UNKNOWN") == "UNKNOWN" and settled:
        out.add(f"WORKPLACE_INFERRED:{settled}")
    blocked = {t for x in p.blocked if has(text, t := canonical_term(x))}
    required = {t for x in p.required if has(text, t := canonical_term(x))}
    company = fold_value(r["company"])
    avoided = {n for x in p.excluded_companies if has(company, n := fold_value(x))}
    out |= {f"KEYWORD_BLOCKED:{t}" for t in blocked} | {f"KEYWORD_MATCH:{t}" for t in required} | ({"KEYWORD_MISSING:required"} if p.required and not required else set()) | {f"COMPANY_EXCLUDED:{n}" for n in avoided}
    out |= {f"COMPANY_FAVORITE:{n}" for x in p.favorite_companies if has(company, n := fold_value(x))} | {f"BONUS_MATCH:{t}" for x in p.bonus if has(text, t := canonical_term(x))}
    article = r["source"] in classify.ARTICLES
    score = bool(tech) + bool(hit) + place_hit + bool(work_hit)
    mine = {canonical_term(t) for t in p.primary or p.technologies}
    others = [s for s, ws in classify.STACKS.items() if not mine & {canonical_term(w) for w in (s, *ws)} and any(has(text, w) for w in ws)] if p.core else []
    sure = not asked or (bool(work_hit) and not (len(work) > 1 and work - set(p.workplaces)))
    if article:
        fit, score = "AMBIGUOUS", 0
        out.add("SOURCE_TYPE:CURATED_ARTICLE")
    elif miss or titles or place_miss or region or (asked and work and not work_hit) or blocked or avoided or (p.required and not required):
        fit, score = "EXCLUDE", -1
    elif core and hit and place_hit and sure and not wide:
        fit = "READY"
    elif core:
        fit = "CONDITIONAL"
    elif others:
        fit, score = "OTHER_STACK", score - bool(tech)
        out |= {f"OTHER_STACK:{s}" for s in others[:3]}
    else:
        fit = "AMBIGUOUS"

    def shows(t):
        t = re.sub(r"(?<!\w)redes sociais(?!\w)", " ", t)
        return word(t, classify.TECHNICAL) or any(re.search(rf"(?<!\w){b}", t) for b in classify.TECHNICAL_BEGINNINGS)

    if not core and not article and not shows(title) and not any(shows(fold_value(t)) for t in r["technologies"] or []):
        out.add("RELEVANCE:OFF_TOPIC")
    return fit, score, out | {f"FIT:{fit}", f"FIT_SCORE:{score}", "TECHNOLOGIES:SOURCE_ONLY"}


PROFILES = [
    Profile(technologies=["Java"], levels=["junior"]),
    Profile(technologies=["Python", "Docker", "Backend"], levels=["junior", "pleno"], places=["sao-paulo-sp", "Paraná", "brasil"], workplaces=["REMOTE", "HYBRID"], bonus=["Git"], regions={"HYBRID": ["SP"], "ONSITE": ["recife-pe"]}),
    Profile(technologies=["JavaScript", "SQL"], primary=["React"], levels=["pleno", "senior"], places=["MG", "rio-de-janeiro-rj"], excluded=["analista", "estagio"], required=["react", "node"], blocked=["cobol"], workplaces=["ONSITE"]),
]


def test_every_record_as_the_model(spark):
    rows = spark.read.parquet(f"{DATA}/vacancy.parquet")
    plain = rows.collect()
    for profile in PROFILES:
        got = {r["rec_id"]: r for r in classify.classified(rows, profile).collect()}
        own = {r["rec_id"]: set(r["match_labels"] or []) for r in rows.select("rec_id", F.expr("filter(match_labels, x -> false)").alias("match_labels")).collect()}
        assert len(got) == len(plain) == len(own)
        for r in plain:
            fit, score, labels = model(r, profile)
            g = got[r["rec_id"]]
            assert (g["fit"], g["fit_score"]) == (fit, score), (r["rec_id"], r["title"], r["location"], g["match_labels"], labels)
            assert labels <= set(g["match_labels"]), (r["rec_id"], labels - set(g["match_labels"]))
            fresh = {x for x in g["match_labels"] if x not in (r["match_labels"] or [])}
            assert fresh <= labels, (r["rec_id"], fresh - labels)


def record(i, title=None, text=None, source="s", seniority=None, place=None, tech=None, model_="UNKNOWN", scope=None, company=None, labels=None):
    return (i, source, title, text, seniority, place, tech, None, None, model_, scope, company, labels, "own")


def test_cases(spark):
    rows = [
        record(1, "Dev Java Júnior", "Vaga remota", labels=["EXTRACTION:X", "FIT:READY"]), record(2, "Dev Java Sênior"), record(3, "Dev PHP", "laravel"), record(4, model_=None), record(5, "Dev Java Jr/Pleno", place="Remoto"),
        record(6, "Cozinheiro", "restaurante"), record(7, "Dev Java Júnior", source="seja-trainee"), record(8, "Dev Java Júnior", "remote, Portugal"), record(9, "Analista de redes sociais"), record(10, "Programadora Java I", place="Brasil"),
    ]
    profile = Profile(technologies=["Java"], levels=["junior"])
    got = {r["rec_id"]: r for r in classify.classified(spark.createDataFrame(rows, SCHEMA), profile).collect()}
    assert {k: r["fit"] for k, r in got.items()} == {1: "READY", 2: "EXCLUDE", 3: "OTHER_STACK", 4: "AMBIGUOUS", 5: "CONDITIONAL", 6: "AMBIGUOUS", 7: "AMBIGUOUS", 8: "CONDITIONAL", 9: "AMBIGUOUS", 10: "CONDITIONAL"}
    assert "EXTRACTION:X" in got[1]["match_labels"] and got[1]["match_labels"].count("FIT:READY") == 1 and got[1]["c_"] == "own"
    assert got[1]["workplace_model"] == "REMOTE" and got[1]["seniority"] == "junior" and got[4]["workplace_model"] is None
    off = {k for k, r in got.items() if "RELEVANCE:OFF_TOPIC" in r["match_labels"]}
    assert off == {4, 6, 9} and "SENIORITY_UNCLEAR:range" in got[5]["match_labels"] and "LOCATION_UNCLEAR:remote_scope" in got[8]["match_labels"] and "LOCATION_UNCLEAR:multiple" in got[10]["match_labels"]
    assert classify.classified(spark.createDataFrame([], SCHEMA), profile).count() == 0


def test_reclassified_drops_guesses(spark):
    rows = spark.createDataFrame([record(1, "Dev", tech=["sql", "go", "java", "python"], labels=["TECH_MATCH:java", "TECH_MATCH:python"]), record(2, "Dev", tech=["java"], labels=["TECH_MATCH:java", "TECHNOLOGIES:SOURCE_ONLY"]), record(3, "Dev", tech=["java"], labels=["TECH_MATCH:java"])], SCHEMA)
    got = {r["rec_id"]: r["technologies"] for r in classify.reclassified(rows, Profile(technologies=["Java"])).collect()}
    assert got == {1: ["sql", "go"], 2: ["java"], 3: []}
