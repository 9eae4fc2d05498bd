"""Links, lists, scans, searches and publication on small hand-made tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from peneira.functions import search
from peneira.functions.times_sql import activity, portal_instant, published_instant
from peneira.operators import dashboard, links
from peneira.sinks import publish
from peneira.sources import scan

def NOW():  # noqa: N802
    return F.lit(dt.datetime(2026, 3, 1, tzinfo=dt.UTC))
FULL = "<p>Vaga Dev Java. Requisitos: Java. Candidate-se</p>"


def column(spark, values, f, kind="string"):
    return [r["o"] for r in spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_links(spark):
    data = lambda **k: '<script id="__NEXT_DATA__">{"props":{"pageProps":{"job":{"name":"Dev Java","status":"%s","expiresAt":"%s"}}}}</script>' % (k["status"], k["end"])
    posting = '<script type="application/ld+json">{"@type":"JobPosting","title":"Dev Java","description":"x"}</script>'
    cases = [
        ("a", "Dev Java", 200, None, FULL, "LIVE"), ("b", "Dev PHP", 200, None, FULL, "UNKNOWN"), ("c", None, 200, None, FULL, "LIVE"), ("d", "Dev Java", 404, None, FULL, "DEAD"), ("e", "x", 500, None, FULL, "UNKNOWN"),
        ("f", "Dev Java", 200, None, "<p>Vaga encerrada</p>", "DEAD"), ("g", "Dev Java", 200, None, "<p>Faça login</p>" + FULL, "UNKNOWN"), ("h", "Dev Java", 200, "https://x.example/vagas", FULL, "UNKNOWN"), ("i", "Dev Java", 200, "https://x.example/i?x=1", FULL, "LIVE"),
        ("j", "Dev Java", 200, None, data(status="published", end="2027-01-01"), "LIVE"), ("k", "Dev Java", 200, None, data(status="published", end="2026-01-01"), "DEAD"), ("l", "Dev Java", 200, None, data(status="closed", end=""), "DEAD"),
        ("m", "Dev PHP", 200, None, data(status="closed", end=""), "UNKNOWN"), ("n", "Dev Java", 200, None, posting, "LIVE"), ("o", "Dev PHP", 200, None, posting, "UNKNOWN"), ("p", None, None, None, None, "UNKNOWN"), ("q", "x", 200, None, "<p>login para ver</p>" + posting, "UNKNOWN"),
    ]
    rows = spark.createDataFrame([(f"https://x.example/{u}", t, s, f, h) for u, t, s, f, h, _ in cases], "url string, title string, status int, final_url string, html string")
    got = {r["url"][-1]: r["link"] for r in links.checked(rows, NOW()).collect()}
    assert got == {c[0]: c[5] for c in cases}
    old = spark.createDataFrame([(1, "u", ["LINK:LIVE", "FIT:READY"]), (2, "v", None), (3, None, ["X"])], "rec_id int, canonical_url string, match_labels array<string>")
    found = spark.createDataFrame([("u", "DEAD"), ("u", "LIVE"), ("v", "LIVE")], "url string, link string")
    out = {r["rec_id"]: r["match_labels"] for r in links.relabelled(old, found, "d").collect()}
    assert out == {1: ["FIT:READY", "LINK:DEAD", "LINK_CHECKED_AT:d", "LINK_CHECK_METHOD:JOB_DETAIL_V2"], 2: ["LINK:LIVE", "LINK_CHECKED_AT:d", "LINK_CHECK_METHOD:JOB_DETAIL_V2"], 3: ["X"]}
    assert [r["s"] for r in spark.createDataFrame([(["A", "LINK:DEAD"],), ([],)], "m array<string>").select(links.link_status(F.col("m")).alias("s")).collect()] == ["DEAD", None]
    assert links.checked(rows.limit(0), NOW()).count() == 0


def test_scans(spark):
    schema = "source string, page int, url string, next_url string, cards int, records int, fetched string, reason string, empty boolean, observable boolean, relocated boolean"
    page = lambda s, n, nxt=True, cards=5, records=5, fetched="SUCCESS", reason=None, empty=False, obs=True, rel=False, url=None: (s, n, url or f"{s}{n}", f"{s}{n + 1}" if nxt else None, cards, records, fetched, reason, empty, obs, rel)
    rows = [
        page("ok", 1), page("ok", 2, False), page("limit", 1), page("limit", 2), page("limit", 3), page("limit", 4, False), page("loop", 1), page("loop", 2, url="loop1"), page("zero", 1, records=0), page("zero2", 1), page("zero2", 2, records=0),
        page("none", 1, False, 0, 0, empty=True), page("moved", 1, False, 0, 0), page("after", 1), page("after", 2, False, 0, 0), page("blind", 1, False, obs=False), page("like", 1, False, rel=True),
        page("login", 1, False, None, None, "BLOCKED", "LOGIN_REQUIRED"), page("half", 1), page("half", 2, False, None, None, "ERROR"), page("down", 1, False, None, None, "ERROR"),
    ]
    got = {r["source"]: (r["status"], r["stop_reason"], r["pages"], r["records"], r["has_more"]) for r in scan.outcomes(spark.createDataFrame(rows, schema), 3).collect()}
    assert got == {
        "ok": ("SUCCESS", None, 2, 10, False), "limit": ("PARTIAL", "PAGE_LIMIT", 3, 15, True), "loop": ("PARTIAL", "PAGINATION_LOOP", 1, 5, True), "zero": ("ERROR", "PARSE_ZERO_RECORDS", 1, 0, True), "zero2": ("PARTIAL", "PARSE_ZERO_RECORDS", 2, 5, True),
        "none": ("EMPTY", "NO_RESULTS", 1, 0, False), "moved": ("ERROR", "LAYOUT_CHANGED", 1, 0, False), "after": ("PARTIAL", "EMPTY_PAGE_AFTER_RECORDS", 2, 5, False), "blind": ("PARTIAL", "PAGINATION_UNVERIFIED", 1, 5, True), "like": ("PARTIAL", "SELECTOR_RELOCATED", 1, 5, False),
        "login": ("AUTH_REQUIRED", "LOGIN_REQUIRED", 1, 0, False), "half": ("PARTIAL", "FETCH_ERROR", 2, 5, True), "down": ("ERROR", "FETCH_ERROR", 1, 0, False),
    }
    items = spark.createDataFrame([("a", 5, 5, 5, 9), ("b", 5, 4, 5, 5), ("c", 5, 5, 5, None)], "source string, items int, mapped int, distinct_items int, declared int")
    assert {r["source"]: r["code"] for r in scan.item_outcomes(items).collect()} == {"a": "TOTAL_MISMATCH", "b": "PARSE_INCOMPLETE", "c": None}
    found = spark.createDataFrame([("Dev Java", "https://x.example/1"), ("Dev PHP", "https://x.example/2"), ("Entrar", "https://x.example/login"), ("Lista", "https://x.example/jobs/")], "title string, link string")
    assert scan.plausible(found, "https://x.example/jobs", True, False) and not scan.plausible(found, "https://x.example/jobs", False, False) and not scan.plausible(found.limit(1), "https://x.example/jobs", True, False)
    assert scan.without_levels("java júnior") == "java" and scan.without_levels("Junior") == "Junior"
    assert scan.variants("w", "s", ["REMOTE", "HYBRID"], ["sp", "santa-catarina"]) == [{"w": "remote"}, {"w": "hybrid", "s": "São Paulo"}, {"w": "hybrid", "s": "Santa Catarina"}] and scan.variants(None, None, ["REMOTE"], []) == [{}]


def test_layouts(spark):
    gupy = '<ul id="job-listing-results"><li><h3>Dev Java</h3><a href="/job/7">x</a><p>Acme</p><span data-testid="job-location">Natal</span> Publicada em: 02/03/2026</li></ul>'
    old = '<div data-testid="job-card" data-job-id="9"><h2>Dev PHP</h2><a href="/job/9">x</a></div>'
    pages = spark.createDataFrame([("https://a.example/l", gupy), ("https://b.example/l", old), ("https://c.example/l", "<p>nada</p>")], "url string, html string")
    got = {r["url"][8]: (r["status"], r["title"], r["link"], r["company"], r["published"], r["source_job_id"]) for r in scan.records(pages, "gupy").collect()}
    assert got == {"a": ("OK", "Dev Java", "https://a.example/job/7", "Acme", "02/03/2026", None), "b": ("OK", "Dev PHP", "https://b.example/job/9", None, None, "9"), "c": ("LAYOUT_CHANGED", None, None, None, None, None)}
    card = lambda jk, t: f'<div class="job_seen_beacon"><h3><a data-jk="{jk}" href="/rc?jk={jk}&t=1"><span title="{t}">{t}</span></a></h3></div>'
    page = "".join(card(j, t) for j, t in (("0a1b2c3d4e5f6071", "Dev"), ("56789abcdef01234", "Falsa"), ("a1b2c3d4e5f67890", "Falsa"), ("43210fedcba98765", "Falsa")))
    one = scan.records(spark.createDataFrame([("https://i.example/jobs", page)], "url string, html string"), "indeed").collect()
    assert [(r["title"], r["link"]) for r in one] == [("Dev", "https://i.example/viewjob?jk=0a1b2c3d4e5f6071")]
    assert [r["title"] for r in scan.records(spark.createDataFrame([("https://d.example", '<article data-job-id="1"><h2>T</h2><a href="x">y</a></article>')], "url string, html string"), "dynamic").collect()] == ["T"]


def test_dates_and_activity(spark):
    at = lambda t: None if t is None else t.isoformat()
    texts = {"2026-02-01T10:00:00-03:00": "2026-02-01T13:00:00", "Publicada em 05/02/2026": "2026-02-05T00:00:00", "3 de fevereiro de 2026": "2026-02-03T00:00:00", "há 2 dias": "2026-02-27T00:00:00", "1 mês": "2026-01-30T00:00:00", "3 weeks ago": "2026-02-08T00:00:00", "hoje": "2026-03-01T00:00:00", "Ontem": "2026-02-28T00:00:00",
             "2027-01-01": None, "31/02/2026": None, "01/04/2026": None, "há 0 dias": None, "em breve": None, None: None}
    assert [at(x) for x in column(spark, list(texts), lambda c: published_instant(c, NOW()))] == list(texts.values())
    assert [at(x) for x in column(spark, ["02/03/2026", "13/03/2026", "2027-01-01T00:00:00Z", "02/03/2026 10:11:12", "x"], portal_instant)] == ["2026-02-03T00:00:00", "2026-03-13T00:00:00", "2027-01-01T00:00:00", "2026-02-03T10:11:12", None]
    rows = spark.createDataFrame([("LIVE", dt.datetime(2026, 2, 27)), ("DEAD", dt.datetime(2026, 2, 27)), ("DEAD", dt.datetime(2026, 1, 1)), (None, None)], "link string, at timestamp")
    none = F.lit(None).cast("timestamp")
    assert [r[0] for r in rows.select(activity(none, none, none, NOW(), link=F.col("link"), checked=F.col("at"))).collect()] == ["ACTIVE_CONFIRMED", "CLOSED", "UNKNOWN", "UNKNOWN"]


def test_searches(spark):
    assert [search.location_query(s) for s in ("sao-carlos-sp", "Santa Catarina", "brasil", "", "lisboa", "campo grande mato grosso do sul", "remoto-brasil")] == ["Sao Carlos, São Paulo, Brasil", "Santa Catarina, Brasil", "Brasil", "Brasil", "Lisboa", "Campo Grande, Mato Grosso do Sul, Brasil", "Brasil"]
    plan = search.search_plan(spark, ["java júnior", "java júnior", "c++ ~*"], ["sp"], levels=("junior", "pleno"), workplaces=("REMOTE",), period="day").collect()
    assert [r["url"] for r in plan] == [f"https://www.linkedin.com/jobs/search/?keywords={t}&location=S%C3%A3o+Paulo%2C+Brasil&f_E=2%2C3%2C4&f_WT=2&f_TPR=r86400&sortBy=DD" for t in ("java+j%C3%BAnior", "c%2B%2B+~%2A")]
    assert column(spark, ["x-1: SUCCESS; pages=2; cards=3; records=4; stop=NO_RESULTS", "x: y", None], search.progress)[0].asDict() == {"source": "x-1", "status": "SUCCESS", "pages": 2, "cards": 3, "records": 4, "stop_reason": "NO_RESULTS"}


REC = "rec_id bigint, source string, source_job_id string, canonical_url string, title string, company string, location string, remote_scope string, seniority string, workplace_model string, technologies array<string>, match_labels array<string>, published_at string, description_summary string, requirements array<string>, evidence_snippets array<string>"


def rec(i, url=None, labels=(), source="a", published="2026-02-28", title="t", seniority=None):
    return (i, source, str(i), url, title, "c|d", None, None, seniority, "REMOTE", ["Java"], list(labels), published, "d", [], [])


def test_dashboard(spark):
    rows = spark.createDataFrame([rec(1, "u1", ["FIT:READY", "FIT_SCORE:3", "TECH_MATCH:java", "SENIORITY_MATCH:junior", "BONUS_MATCH:x", "STATUS:NEW"]), rec(2, "u2", ["FIT:EXCLUDE", "FIT_SCORE:-1"], published=None, seniority="Júnior"), rec(3, None, [], published="2026-05-01"), rec(4, "u4", ["FIT:READY"], published="2025-01-01")], REC)
    at = F.to_timestamp("published_at")
    ids = lambda df: [r["rec_id"] for r in df.orderBy("rec_id").collect()]
    assert ids(dashboard.quick(rows, {"junior", "estagio"}, at, NOW())) == [1, 2] and ids(dashboard.quick(rows, {"recent"}, at, NOW())) == [1] and ids(dashboard.quick(rows, {"unseen"}, at, NOW())) == [1] and ids(dashboard.quick(rows, set(), at, NOW())) == [1, 2, 3, 4]
    assert ids(dashboard.quick(rows, {"unseen", "remote"}, at, NOW(), spark.createDataFrame([("u1",), ("u4",)], "canonical_url string"))) == [2, 3]
    assert ids(dashboard.aged(rows, at, NOW(), undated=True)) == [2] and ids(dashboard.aged(rows, at, NOW())) == [1, 4] and ids(dashboard.aged(rows, at, NOW(), days=30)) == [1]
    assert [r["rec_id"] for r in rows.orderBy(*dashboard.order("fit", at), "rec_id").collect()] == [1, 4, 3, 2] and [r["rec_id"] for r in rows.orderBy(*dashboard.order("recent", at), "rec_id").collect()] == [3, 1, 4, 2]
    assert [r["rec_id"] for r in rows.orderBy(*dashboard.order("score", at, F.when(F.col("rec_id") == 2, 50)), "rec_id").collect()][0] == 2
    parts = {r["rec_id"]: r["s"] for r in rows.select("rec_id", dashboard.score_parts(at, NOW()).alias("s")).collect()}
    assert parts[1]["total"] == 85 and [tuple(p) for p in parts[1]["parts"]] == [("Tecnologia", 20), ("Nível", 20), ("Outros critérios do perfil", 20), ("Mais compatível", 10), ("Diferenciais e empresa favorita", 5), ("Publicada recentemente", 10)]
    assert parts[2]["total"] == parts[4]["total"] == 0 and parts[2]["parts"] == []
    names = {r["rec_id"]: r["l"] for r in rows.select("rec_id", dashboard.level_name(F.col("seniority")).alias("l")).collect()}
    assert names == {1: "Júnior", 2: "Júnior", 3: "—", 4: "—"} and dashboard.described({"match": "fit", "levels": ("a", "b"), "text": "", "min": 0}) == {"match": "fit", "levels": "a, b"}
    yields = spark.createDataFrame([("a", 0, 5), ("b", 0, 4), ("c", 1, 9)], "source string, useful int, discarded int")
    assert [r["source"] for r in dashboard.low_yield(yields).collect()] == ["a"]


def test_publication(spark, tmp_path):
    rows = spark.createDataFrame([rec(1, "https://x.example/1", ["FIT:READY", "FIT_SCORE:3"], title="Dev | Java"), rec(2, "https://x.example/2", ["FIT:EXCLUDE", "FIT_SCORE:-1"]), rec(3, "https://x.example/3", ["RELEVANCE:OFF_TOPIC"])], REC)
    tracking = spark.createDataFrame([("https://x.example/1", "SAVED", "2026-01-01", "n"), ("https://x.example/2", "DISCARDED", "2026-01-01", None)], "canonical_url string, status string, updated_at string, note string")
    view = publish.review_view(rows, tracking, F.when(F.col("rec_id") == 1, 70).otherwise(0), "rec_id")
    lines = publish.review_text(view, {"match": "fit"}).splitlines()
    assert lines[-3].startswith("| 1 | 70 | Dev / Java [Salva] | c/d | — | Remoto | — | Java | 2026-02-28 | https://x.example/1 |") and len(lines) == 9
    files = publish.run_exports(rows, tracking, F.to_timestamp("published_at"), NOW(), str(tmp_path), "s")
    assert len(files) == 5 and (tmp_path / "melhores-vagas.xlsx").read_bytes()[:2] == b"PK" and "Dev | Java" in (tmp_path / "todas-de-ti-s.csv").read_text("utf-8-sig") and publish.run_exports(rows.limit(0), tracking, F.to_timestamp("published_at"), NOW(), str(tmp_path), "z") == []
    assert publish.column_names(28)[-3:] == ["Z", "AA", "AB"] and publish.column_names(703)[-1] == "AAA"
    assert publish.markdown_text("a*b  [c]") == "a\\*b \\[c\\]" and publish.markdown_text(None) == "—" and publish.markdown_link("https://x.example/a(b)") == "https://x.example/a%28b%29" and publish.markdown_link("javascript:x") is None
    none, path = rows.select("canonical_url").limit(0), str(tmp_path / "out")
    reason = F.when(F.array_contains("match_labels", "FIT:EXCLUDE"), "excluded")
    before = spark.createDataFrame([rec(7, "https://x.example/7", ["FIT:EXCLUDE"], source="p"), rec(8, "https://x.example/8", ["FIT:EXCLUDE"], source="q"), rec(9, "https://x.example/1", source="q")], REC)
    count, gone = publish.published(rows, before, path, ["a"], ["p"], none, none, reason, "rec_id", [publish.contract()["url"]])
    assert count == 3 and sorted(r["rec_id"] for r in spark.read.parquet(path).collect()) == [1, 3, 7] and sorted(r["rec_id"] for r in gone.collect()) == [2, 8]
    with pytest.raises(ValueError):
        publish.published(rows, before, path, ["a"], [], none, none, reason, "rec_id", [F.lit(False)])
    assert spark.read.parquet(path).count() == 3


def test_source_defaults(spark):
    rows = spark.createDataFrame([(1, "s", "#vem", "https://acme.gupy.io/job/1", "UNKNOWN", "x"), (2, "t", None, None, None, "Acme abre Programa"), (3, "u", "Vagas na Beta", None, "ONSITE", None)], "rec_id int, source string, company string, canonical_url string, workplace_model string, title string")
    dim = spark.createDataFrame([("s", "REMOTE"), ("u", "REMOTE"), ("u", None)], "source string, default_workplace string")
    got = {r["rec_id"]: (r["company"], r["workplace_model"]) for r in scan.with_defaults(rows, dim, {"t": r"^(\w+) abre"}).collect()}
    assert got == {1: ("Acme", "REMOTE"), 2: ("Acme", None), 3: ("Beta", "ONSITE")}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    from peneira.streaming.first_seen import stream_first_seen

    data, base = str(tmp_path / "in"), str(tmp_path / "state")
    write = lambda rows: spark.createDataFrame(rows, "k string, t int").coalesce(1).write.mode("append").parquet(data)
    state = lambda: {r["k"]: r["first_seen"] for r in stream_first_seen(spark, data, "k", "t", base).collect()}
    write([("a", 5), ("b", 3), ("a", 9), (None, 1)])
    assert state() == {"a": 5, "b": 3, None: 1} == state()
    write([("a", 2), ("c", 7), ("b", 8)])
    assert state() == {"a": 2, "b": 3, "c": 7, None: 1}
    parts = sorted(p.name for p in (tmp_path / "state" / "log").iterdir() if p.is_dir())
    assert len(parts) == 2 and spark.read.parquet(str(tmp_path / "state" / "log" / parts[1])).count() <= 3


def test_connected_groups_equal_a_plain_search(spark):
    import random

    from peneira.operators.components import connected

    rnd = random.Random(3)
    for edges in ([(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 130)], [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)], [(5, 5), (1, 2), (2, 1)], []):
        near: dict[int, set[int]] = {}
        for a, b in edges:
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        expected = {}
        for start in sorted(near):
            todo = [start] if start not in expected else []
            while todo:
                at = todo.pop()
                if at not in expected:
                    expected[at] = start
                    todo += near[at]
        got = connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
        assert len(got) == len(expected) and {r["node"]: r["root"] for r in got} == expected
