"""Packing, mixing, splitting."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peneira.llm import mixing, packing, queries, splitting, tokens

DATA = "/root/testdata/sf0.001"


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=20))
def test_plan_places_every_item_once(sizes):
    entries, containers = packing.best_fit_plan(sizes, (8, 16, 32, 64))
    total = sum(s * n for s, n in sizes.items())
    assert (containers[:, 1] * containers[:, 2]).sum() == total and (containers[:, 1] <= containers[:, 0]).all()
    filled: dict[int, int] = {}
    for size, n in sizes.items():
        own = [e for e in entries.tolist() if e[0] == size]
        ranks = sorted((e[1], e[1] + e[2]) for e in own)
        assert sum(b - a for a, b in ranks) == n and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:]))
        for _, first, count, each, start, _ in own:
            for r in range(count):
                filled[start + r // each] = filled.get(start + r // each, 0) + size
    assert all(v <= 64 for v in filled.values()) and len(filled) == containers[:, 2].sum()


def test_plan_is_as_good_as_best_fit_decreasing():
    rnd = random.Random(1)
    for _ in range(100):
        sizes = {rnd.randint(1, 64): rnd.randint(0, 30) for _ in range(15)}
        bins: list[int] = []
        for x in sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True):
            fit = [i for i, b in enumerate(bins) if b >= x]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= x
            else:
                bins.append(64 - x)
        assert packing.best_fit_plan(sizes, (64,))[1][:, 2].sum() <= len(bins) + 1


def test_capacities_are_chosen_by_what_fills_them():
    """A container is opened in the size that costs least for what is left, at no cost beside the capacity without waste."""
    entries, containers = packing.best_fit_plan({700: 3, 300: 2}, (512, 1024, 4096), overhead=0)
    assert (containers[:, 0] * containers[:, 2]).sum() == 3072 and entries[:, 5].max() == 1024
    rnd = random.Random(3)
    for _ in range(40):
        sizes = {rnd.randint(1, 64): rnd.randint(1, 4) for _ in range(6)}
        several, one = (packing.best_fit_plan(sizes, c, overhead=0)[1] for c in ((16, 32, 64), (64,)))
        assert (several[:, 0] * several[:, 2]).sum() <= (one[:, 0] * one[:, 2]).sum()


def test_packed_operator(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([0, 5, 40, 100, 700, 4096, 9000])) for i in range(400)] + [(5, 40), (5, 40)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id bigint, tokens bigint").withColumn("piece", F.lit(1)).repartition(7)).collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["container"], []).append(r)
    assert all(sum(r["size"] for r in rs) <= rs[0]["capacity"] <= 4096 and len({r["capacity"] for r in rs}) == 1 for rs in by.values())
    assert sum(r["size"] for r in got) == sum(t for _, t in rows)
    assert {r["doc_id"] for r in got if r["piece"] > 0} == {i for i, t in rows if t > 4096}
    used = sum(r["capacity"] for rs in by.values() for r in rs[:1])
    assert used <= 1.01 * sum(t for _, t in rows) + 4096
    assert packing.packed(spark.createDataFrame([], "doc_id bigint, tokens bigint")).count() == 0


def test_budgets_settle_shortages_near_first():
    leaves = [(("a", "pt", "1"), 0.2, 5.0, 20.0), (("a", "pt", "2"), 0.2, 30.0, 20.0), (("a", "en", "3"), 0.2, 100.0, 20.0), (("b", "pt", "4"), 0.4, 100.0, 40.0)]
    assert mixing.budgets(leaves) == pytest.approx([5, 30, 25, 40])
    assert mixing.budgets([(("a", "x", "1"), 1.0, 3.0, 10.0)]) == [3.0] and mixing.budgets([]) == []
    assert sum(mixing.budgets([((d, d, str(i)), 0.1, 50.0 * (i % 3), 10.0) for i, d in enumerate("aabbccddee")])) == pytest.approx(100)


def mix(spark, docs, targets, tree=()):
    sized = spark.createDataFrame([(*d, (None, "pt", "en")[d[0] % 7 % 3]) for d in docs], "doc_id bigint, tokens bigint, source string, lang string")
    report = mixing.leaf_report(sized, spark.createDataFrame(targets, "source string, weight double, max_repeat int"), spark.createDataFrame(list(tree), "source string, domain string"))
    return report, mixing.mixture(sized, report)


def test_mixture(spark):
    rnd = random.Random(8)
    docs = [(i, rnd.randint(1, 50), "big" if i % 3 else "small") for i in range(3000)] + [(9001, 10, None), (9002, 7, "other"), (1, 5, "big"), (9003, 0, "big")]
    report, mixed = mix(spark, docs, [("big", 0.3, 2), ("small", 0.65, 2), ("none", 0.05, 3)], [("big", "d"), ("small", None)])
    leaves = report.collect()
    assert len(leaves) == 7 and {r["language"] for r in leaves} == {"", "pt", "en"}
    rows = {s: {"short": any(r["short"] for r in leaves if r["source"] == s)} | {k: sum(r[k] for r in leaves if r["source"] == s) for k in ("tokens", "budget", "target")} for s in ("big", "small", "none")}
    for r in leaves:  # every language of a source gives its share of what the source is to give
        assert r["target"] == pytest.approx(rows[r["source"]]["target"] * (r["tokens"] / rows[r["source"]]["tokens"] if rows[r["source"]]["tokens"] else 1))
    total = sum(t for _, t, _ in docs)
    assert {k for k, r in rows.items() if r["short"]} == {"none"} | ({"small"} if 2 * rows["small"]["tokens"] < 0.65 * total else set())
    got = mixed.collect()
    assert max(r["times"] for r in got) <= 2 and len(got) == len({(r["doc_id"], r["source"], r["tokens"]) for r in got})
    used = {s: sum(r["tokens"] * r["times"] for r in got if r["source"] == s) for s in ("big", "small")}
    assert all(abs(used[s] - rows[s]["budget"]) <= 150 for s in used)
    assert abs(sum(used.values()) - total) <= 200
    again = {(r["doc_id"], r["times"]) for r in mix(spark, docs[::-1], [("big", 0.3, 2), ("small", 0.65, 2), ("none", 0.05, 3)], [("big", "d"), ("small", None)])[1].collect()}
    assert again == {(r["doc_id"], r["times"]) for r in got}
    empty, none = mix(spark, [], [("a", 1.0, 1)])
    assert none.count() == 0 and empty.collect()[0]["tokens"] == 0


def test_shares_on_data(spark):
    got = queries.p9_shares(spark, DATA).collect()
    assert abs(sum(r["reached"] for r in got) - 1) < 1e-6 and {r["source"] for r in got if r["short"]} == {r["source"] for r in queries.p9_found(spark, DATA).collect()}


@pytest.mark.parametrize("text", ["a" * 9000, "ab " * 5000, "é" * 5000, "日本語テキスト" * 1500, " " * 4000, "x.\n" * 3000, "🚀" * 2000, "\n" * 3000, "<p>Oi tudo bem.</p>" * 900, "Uma frase sobre dados e testes. Outra frase qualquer! " * 300])
def test_pieces(text):
    limits = splitting.Limits()
    enc = tokens.encoder()
    got = splitting.split(text, limits)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(len(enc.encode_ordinary(text[a:b])) == n <= limits.size for a, b, n, _ in got)
    for (a, b, _, _), (c, d, _, _) in zip(got, got[1:]):
        assert a < c < b < d
        assert limits.overlap - 3 <= len(enc.encode_ordinary(text[c:b])) <= limits.overlap + 6
    rebuilt = text[got[0][0] : got[0][1]] + "".join(text[b0:b1] for (_, b0, _, _), (_, b1, _, _) in zip(got, got[1:]))
    assert rebuilt == text


def test_cuts_fall_between_topics():
    rnd = random.Random(3)
    topics = [[f"{t}{i}" for i in range(30)] for t in ("peixe", "carro", "livro")]
    part = lambda t: " ".join("Temos " + " ".join(rnd.choice(t) for _ in range(8)) + "." for _ in range(25))
    text = " ".join(part(t) for t in topics)
    limits = splitting.Limits(size=900, overlap=20)
    cut = splitting.split(text, limits)
    ends = [b for _, b, _, kind in cut if kind == "sentence"]
    assert ends and all(text[e - 1] == "." for e in ends)
    # The first cut lies where the topic changes, if that is within reach.
    change = text.index("carro")
    assert min(abs(e - change) for e in ends) < 250


def test_pieces_operator(spark):
    rows = spark.createDataFrame([(1, "Frase curta. " * 900, "x"), (2, None, "x"), (3, "", "x"), (4, "curto", "x"), (1, "Frase curta. " * 900, "y")], "doc_id bigint, text string, piece string")
    got = splitting.pieces(rows, "doc_id", "text").collect()
    assert {r["doc_id"] for r in got} == {1} and sum(r["piece"] == 0 for r in got) == 2 and all(r["cut"] in ("sentence", "end") for r in got)
    assert splitting.pieces(rows.limit(0), "doc_id", "text").count() == 0
    many = {r["doc_id"]: r["tokens"] for r in tokens.sized(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text").collect()}
    assert {r["doc_id"] for r in queries.p10_found(spark, DATA).collect()} == {k for k, n in many.items() if n > 1024}
    assert {r["doc_id"] for r in queries.p8_found(spark, DATA).collect()} == {k for k, n in many.items() if n > 4096}
