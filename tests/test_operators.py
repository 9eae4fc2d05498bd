"""Resolution, merging, windows, sources, sinks and streaming, against brute force where order matters."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from peneira.operators import classify, insight, merge, resolve, series
from peneira.operators.components import connected
from peneira.sinks import publish
from peneira.sources import files, html_lists, json_items


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    expected = {x: find(x) for x in list(parent)}
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == expected
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def sequential(rows):
    urls, keys, kept, conflict = {}, set(), {}, set()
    for ord_, url, key, job in sorted(rows):
        kept[ord_] = False
        if url and url in urls:
            first, own = urls[url]
            if own and job and own != job:
                kept[first] = False
                conflict |= {first, ord_}
            continue
        if key in keys:
            continue
        keys.add(key)
        kept[ord_] = True
        if url:
            urls[url] = (ord_, job)
    return kept, conflict


def test_exact_duplicates_replay_the_sequential_rule(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, "", *"abcdefg"]), rnd.choice("klmnopqrst"), rnd.choice([None, "1", "1", "2"])) for i in range(300)]
    kept, conflict = sequential([(o, u or None, k, j) for o, u, k, j in rows])
    got = resolve.exact_duplicates(spark.createDataFrame(rows, "ord_ bigint, url_key string, id_key string, job string"), "ord_").collect()
    assert {r["ord_"]: r["kept"] for r in got} == kept
    assert {r["ord_"] for r in got if r["conflict"]} == conflict


def first_fit(rows):
    cliques: list[list[tuple]] = []
    for row in sorted(rows):
        fixed = row[1] if row[1] and not row[2] else None
        for clique in cliques:
            if all(fixed is None or other is None or fixed == other for _, other in clique):
                clique.append((row[0], fixed))
                break
        else:
            cliques.append([(row[0], fixed)])
    return {frozenset(o for o, _ in c) for c in cliques}


def test_semantic_clusters_are_greedy_first_fit_cliques(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([None, "Natal", "Recife", "Belém"]), rnd.random() < 0.2) for i in range(60)]
    frame = spark.createDataFrame([(i, "s", "Dev Java", "Acme Ltda", p, "REMOTE" if r else "UNKNOWN") for i, p, r in rows] + [(99, "s", "PCD", "Acme", None, None), (100, "s", None, None, None, None)], "rec_id bigint, source string, title string, company string, location string, workplace_model string")
    got = resolve.semantic_clusters(frame, "rec_id").collect()
    groups: dict[str, set] = {}
    for r in got:
        if r["cluster"]:
            groups.setdefault(r["cluster"], set()).add(r["rec_id"])
    assert set(map(frozenset, groups.values())) == first_fit(rows)
    assert all(r["cluster"] is None for r in got if r["rec_id"] in (99, 100))


def test_keep_one(spark):
    rows = spark.createDataFrame(
        [(1, "a", "c", "2026-01-01", []), (2, "b", "c", None, None), (3, "a", "d", "2026-01-01", ["X"]), (4, "a", "d", "2026-02-01", []), (5, "a", None, None, ["Y"])],
        "rec_id bigint, source string, cluster string, at string, match_labels array<string>",
    )
    got = {r["rec_id"]: r["match_labels"] for r in resolve.keep_one(rows, "rec_id", F.to_timestamp("at"), F.lit(1)).collect()}
    assert got == {1: ["ALSO_SEEN_IN:b"], 4: ["REPOSTED:1"], 5: ["Y"]}


REC = "rec_id bigint, source string, source_job_id string, canonical_url string, title string, company string, location string, match_labels array<string>, published_at string"


def rec(i, source="a", job=None, url=None, labels=(), published=None):
    return (i, source, job, url, "t", "c", None, list(labels), published)


def test_carry_prune_restore(spark):
    before = spark.createDataFrame([rec(1, url="u1"), rec(2, url="u2"), rec(3, "b", url="u3"), rec(4, "b", url="u3"), rec(5, job="j"), rec(6, url="u6")], REC)
    now = spark.createDataFrame([rec(10, url="u1")], REC)
    keep = spark.createDataFrame([("u6",), ("u6",)], "canonical_url string")
    assert sorted(r["rec_id"] for r in merge.carry(now, before, ["a"], [], keep, "rec_id").collect()) == [3, 6]
    gone = spark.createDataFrame([("u1",)], "canonical_url string")
    judged = merge.pruned(spark.createDataFrame([rec(1, url="u1"), rec(2, url="u6", labels=["FIT:EXCLUDE"]), rec(3, labels=["FIT:EXCLUDE"]), rec(4, labels=["RELEVANCE:OFF_TOPIC", "FIT:EXCLUDE"]), rec(5)], REC), merge.discard_reason(F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"), F.current_timestamp()), keep, gone)
    assert {r["rec_id"]: r["reason"] for r in judged.collect()} == {1: "user_discarded", 2: None, 3: "excluded", 4: "off_topic", 5: None}
    back = merge.restored(spark.createDataFrame([rec(1, url=None)], REC), spark.createDataFrame([rec(2, url=None), rec(3, url="x")], REC))
    assert sorted(r["rec_id"] for r in back.collect()) == [1, 3]


def test_upsert_links_selection(spark):
    base = spark.createDataFrame([("a", "x", 1), ("b", None, 2)], "k string, v string, other int")
    news = spark.createDataFrame([("b", "y"), ("b", "y"), ("c", "z"), ("a", None)], "k string, v string")
    assert {(r["k"], r["v"], r["other"], r["action"]) for r in merge.upserted(base, news, "k", ["v"]).collect()} == {("a", "x", 1, "keep"), ("b", "y", 2, "update"), ("c", "z", None, "insert")}
    carried = merge.link_labels_carried(spark.createDataFrame([rec(1, url="u"), rec(2, url="v", labels=["LINK:DEAD"])], REC), spark.createDataFrame([rec(1, url="u", labels=["LINK:LIVE"]), rec(2, url="u", labels=["LINK:DEAD", "X"]), rec(3, url="v", labels=["LINK:LIVE"])], REC), "rec_id")
    assert {r["rec_id"]: r["match_labels"] for r in carried.collect()} == {1: ["LINK:DEAD"], 2: ["LINK:DEAD"]}
    rows = spark.createDataFrame([rec(1, url="u"), rec(2, url="v")], REC)
    assert [r["rec_id"] for r in merge.selected(rows, ["v", "u"]).collect()] == [2, 1]
    with pytest.raises(KeyError):
        merge.selected(rows, ["w"])


def test_count_anomalies_skip_failed_runs(spark):
    runs = [("s", i, "SUCCESS", 10) for i in range(3)] + [("s", 3, "ERROR", 0), ("s", 4, "SUCCESS", 4), ("s", 5, "SUCCESS", 0), ("t", 0, "SUCCESS", 5)]
    got = {(r["source"], r["run"]): (r["warning"], r["seen"]) for r in series.count_anomalies(spark.createDataFrame(runs, "source string, run int, status string, n int")).collect()}
    assert got[("s", 3)] == ("ZERO", 3) and got[("s", 4)] == ("DROP", 3) and got[("s", 5)] == ("ZERO", 4) and got[("s", 1)] == (None, 1) and got[("t", 0)] == (None, 0)


def test_first_seen_and_state(spark):
    events = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, t int")
    assert {tuple(r) for r in series.first_seen(events, "k", "t").collect()} == {("a", 1, False), ("b", 2, False)}
    state = spark.createDataFrame([("a", 0), ("z", 9)], "k string, first_seen int")
    assert {tuple(r) for r in series.first_seen(events, "k", "t", state).collect()} == {("a", 0, False), ("b", 2, True), ("z", 9, False)}


def test_status_fold(spark):
    rows = [("a", "SUCCESS", 1, 1, False, False), ("a", "EMPTY", 0, 1, False, False), ("b", "BLOCKED", 0, 0, False, False), ("b", "ERROR", 0, 0, False, False), ("c", "EMPTY", 0, 1, True, True), ("c", "EMPTY", 0, 1, True, False), ("d", "BLOCKED", 3, 1, False, False), ("d", "EMPTY", 0, 1, False, False)]
    got = insight.status_fold(spark.createDataFrame(rows, "source string, status string, n int, pages int, has_more boolean, warned boolean")).collect()
    assert {r["source"]: r["status"] for r in got} == {"a": "SUCCESS", "b": "BLOCKED", "c": "PARTIAL", "d": "PARTIAL"}


PAGE = """<html><head><title>x</title><script>var a='<div class=card>'</script></head><body>
<div class="card" data-id="7"><h2 class="t">Dev <b>Java</b></h2><a href="/job/7?x=1">go</a><span class="c">Acme</span></div>
<div class="card"><h2 class="t">No link</h2></div><div class="card off"><h2 class=t>B<a href='https://y.example/8'>z</a></div>
<a rel="next" href="?page=2">next</a></body></html>"""


def test_html_lists_and_details(spark):
    sel = {"card": "div.card", "title": ".t", "url": "a::attr(href)", "id": "::attr(data-id)", "company": "span.c", "next": "a[rel=next]::attr(href)", "empty": ".none"}
    pages = spark.createDataFrame([("https://x.example/list", PAGE), ("https://x.example/e", "<p class=none>nothing"), ("https://x.example/n", None)], "url string, html string")
    got = html_lists.list_records(pages, sel).orderBy("url", "pos").collect()
    assert [(r["status"], r["title"], r["link"]) for r in got] == [("NO_RESULTS", None, None), ("OK", "Dev Java", "https://x.example/job/7?x=1"), ("OK", "B z", "https://y.example/8"), ("LAYOUT_CHANGED", None, None)]
    assert got[1]["source_job_id"] == "7" and got[1]["company"] == "Acme" and got[1]["next"] == "https://x.example/list?page=2"
    page = '<script type="application/ld+json">{"@graph":[{"@type":["JobPosting"],"datePosted":"2026-01-01","hiringOrganization":{"name":"Acme"}}]}</script><time datetime="2025-01-01">x</time><noscript>no</noscript>Hello'
    d = html_lists.detail(page)
    assert (d["published"], d["company"], d["text"]) == ("2026-01-01", "Acme", "x Hello")
    assert html_lists.detail("<time datetime='2025-01-01'>")["published"] == "2025-01-01" and html_lists.detail(None)["text"] is None
    blocked = spark.createDataFrame([(429, "https://x/", ""), (200, "https://x/login", ""), (200, "https://x/a", "Não sou um robô"), (200, "https://x/a", "ok"), (200, "https://x/a", "código 2FA")], "s int, u string, t string")
    assert [r[0] for r in blocked.select(html_lists.block_reason(F.col("s"), F.col("u"), F.col("t"))).collect()] == ["RATE_LIMITED", "LOGIN_REQUIRED", "CAPTCHA", None, "TWO_FACTOR"]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source":"a","title":"x","technologies":["b"]}\n\nnot json\n')
    assert files.json_lines(spark, str(tmp_path / "a.jsonl"), strict=False).count() == 1
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "a.jsonl")).collect()
    (tmp_path / "gold.csv").write_text("﻿url;titulo;esperado\nhttps://a;x;ready\nhttps://b;y;\n")
    assert [tuple(r) for r in files.gold_labels(spark, str(tmp_path / "gold.csv")).collect()] == [("https://a", "READY")]
    (tmp_path / "bad.csv").write_text("url,esperado\nhttps://a,nope\n")
    with pytest.raises(ValueError):
        files.gold_labels(spark, str(tmp_path / "bad.csv"))
    item = "<item><title>Dev Java na empresa Acme</title><link>https://x.example/1?utm_source=a</link><description>&lt;p&gt;Oi&lt;/p&gt;</description><pubDate>Fri, 08 May 2026 01:39:38 -0300</pubDate></item><item><title>t</title><link>http://x</link></item>"
    (tmp_path / "ok.xml").write_text(f"<?xml version='1.0'?><rss><channel>{item}</channel></rss>")
    (tmp_path / "evil.xml").write_text(f"<?xml version='1.0'?><!DOCTYPE x><rss><channel>{item}</channel></rss>")
    got = files.feed(spark, str(tmp_path / "*.xml"), "s").collect()
    assert [(r["title"], r["company"], r["canonical_url"], r["description_summary"]) for r in got] == [("Dev Java", "Acme", "https://x.example/1", "Oi")]
    text = spark.createDataFrame([("Dev - https://www.linkedin.com/jobs/view/dev-java-at-acme-1234567/",), ("https://www.linkedin.com/jobs/search?currentJobId=7654321",), ("https://www.linkedin.com/in/me",), (None,), ("x https://www.linkedin.com/jobs/view/1234567",)], "value string")
    assert {(r["job_id"], r["company"]) for r in files.imported(text).collect()} == {("1234567", "Acme"), ("7654321", None)}
    side = spark.createDataFrame([("u", "SAVED"), ("v", "x")], "u string, status string")
    with pytest.raises(ValueError):
        files.checked(side, F.col("status").isin(files.STATUSES), "tracking")


def test_json_items(spark):
    items = spark.createDataFrame([("s", '{"a":{"t":"<b>Dev</b>"},"u":"https://x.example/1","id":5}', 1), ("s", '{"a":{"t":""},"u":"https://x.example/2"}', 2), ("s", '{"a":{"t":"Dev"},"u":"ftp://x"}', 3), ("s", '{"a":{"t":"Dev"},"u":"https://x.example/1","id":5}', 4)], "source string, item string, n int")
    p = lambda path: json_items.item_path(F.col("item"), path)
    got = json_items.records(items, {"title": p("a.t"), "url": p("u"), "id": p("id")})
    assert got.count() == 2 and json_items.first_reading(got, "canonical_url").count() == 1
    assert json_items.page_urls("https://x?a=1", "offset", 2, 10) == ["https://x?a=1&offset=0", "https://x?a=1&offset=10"]


def test_publishing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=x|y"), (2, None)], "i int, t string")
    path = str(tmp_path / "table")
    assert publish.swap(rows, path, [F.col("i") > 0]) == 2 and publish.swap(rows.limit(1), path) == 1
    with pytest.raises(ValueError):
        publish.swap(rows, path, [F.col("i") > 1])
    assert spark.read.parquet(path).count() == 1
    tokens = {publish.version(x, ["i", "t"]).first()["token"] for x in (rows, rows.orderBy(F.col("i").desc()), rows.limit(1), rows.limit(0))}
    assert len(tokens) == 3 and "0" in tokens
    assert publish.fingerprint(rows).select("content_hash").distinct().count() == 2
    full = spark.createDataFrame([rec(1, url="u", labels=["FIT:READY"])], REC).selectExpr("*", "'REMOTE' workplace_model", "null seniority", "array('Java') technologies", "'Brasil' remote_scope")
    tracking = spark.createDataFrame([("u", "SAVED", "=n", "2026"), ("u", "APPLIED", "-n", "2027")], "canonical_url string, status string, note string, updated_at string")
    view = publish.export_view(full, tracking)
    assert view.collect()[0]["tracking"] == "APPLIED" and view.collect()[0]["note"] == "'-n" and view.collect()[0]["location"] == "Brasil"
    assert publish.people_csv(view).startswith(b"\xef\xbb\xbffit;") and "| READY |" in publish.markdown(view, "Jobs", {"a": "b"})
    live = full.withColumn("match_labels", F.array(F.lit("FIT:READY"), F.lit("LINK:LIVE")))
    assert publish.verified(full.unionByName(live)).count() == 1
    import io
    import zipfile

    assert "xl/worksheets/sheet2.xml" in zipfile.ZipFile(io.BytesIO(publish.xlsx(view, {"a": "b"}))).namelist()
