"""Near duplicates, survivors, history, names: against brute force on small tables."""

from __future__ import annotations

import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from peneira.llm import history, names, near, queries, survivor

DATA = "/root/testdata/sf0.001"
VACANCY = "rec_id bigint, title string, company string, description_summary string"


def words(*texts):
    flat = unicodedata.normalize("NFKD", " ".join(t for t in texts if t).casefold())
    return set(re.findall(r"[^\W_]+", "".join(c for c in flat if not unicodedata.combining(c))))


def corpus(n, seed):
    """Records of sentences with rare names, and edited copies of some."""
    rnd = random.Random(seed)
    common = ["vaga", "para", "time", "de", "dados", "com", "foco", "em", "qualidade", "e", "revisão", "testes", "projeto", "novo", "cliente"]
    out = []
    for i in range(n):
        if out and rnd.random() < 0.4:
            _, t, c, d = rnd.choice(out)
            w = d.split()
            for _ in range(rnd.randint(0, 6)):
                k = rnd.randrange(len(w))
                w[k : k + rnd.randint(0, 1)] = [rnd.choice(common)]
            if rnd.random() < 0.3:
                k = rnd.randrange(len(w))
                w = w[k:] + w[:k]
            out.append((i, t, c if rnd.random() < 0.8 else None, " ".join(w)))
        else:
            d = " ".join(rnd.choice(common) if rnd.random() < 0.7 else f"nome{rnd.randrange(400)}" for _ in range(rnd.choice([6, 20, 60])))
            out.append((i, f"dev {rnd.choice(['java', 'php'])}", f"empresa {rnd.randrange(9)}", d))
    return out + [(n, "x", "y", None), (n + 1, None, None, ""), (n + 2, "x", "y", "Acesso negado."), (n + 3, "x", "y", "Acesso negado.")]


@pytest.mark.parametrize("settings", [near.Settings(), near.Settings(block=3, slice_bits=2)])
def test_near_duplicates_find_all_pairs(spark, settings):
    rows = corpus(150, 11)
    rows += [(1000 + i, *rows[0][1:]) for i in range(12)]  # a hot group of copies
    sets = {r[0]: words(*r[1:]) for r in rows if r[3] and "negado" not in r[3]}
    ids = sorted(sets)
    expected = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) and sets[a] | sets[b]}
    frame = spark.createDataFrame(rows, VACANCY).withColumn("class", F.lit(1)).withColumn("words", F.lit("x"))
    got = {(r["a"], r["b"]) for r in near.record_pairs(*near.near_duplicates(frame, "rec_id", "title", "company", "description_summary", settings)).collect()}
    assert got <= expected
    assert len(got) >= 0.98 * len(expected), sorted(expected - got)[:5]


def test_near_duplicates_empty(spark):
    members, links = near.near_duplicates(spark.createDataFrame([], VACANCY), "rec_id", "title", "company", "description_summary")
    assert members.count() == links.count() == 0


def test_found_pairs_equal_brute_force_on_data(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/vacancy.parquet").select("rec_id", "title", "company", "description_summary").collect()]
    bad = {r["rec_id"] for r in queries.p2_found(spark, DATA).collect()}
    from tests.llm.test_text import plain

    sets = {r[0]: words(*plain(*r[1:])) for r in rows if r[3] is not None and r[0] not in bad}
    ids = sorted(sets)
    expected = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in queries.p1_found(spark, DATA).collect()} == expected and expected


SCORED = "root bigint, rec_id bigint, rank bigint, seen bigint, chars bigint, placed boolean, place string"


def test_survivors(spark):
    rows = [
        (1, 1, 1, 5, 9, True, "x"), (1, 2, 1, 5, 9, True, "y"), (1, 3, 2, 4, 8, False, None),  # two qualify: the lower
        (2, 4, 1, 1, 1, False, None), (2, 5, 3, 2, 1, True, "x"), (2, 6, 2, 1, 7, True, "z"),
        (3, 7, 1, 1, 1, True, "x"), (3, 8, 2, 9, 9, True, "y"), (4, 9, 1, 0, 0, False, None), (4, 10, 1, 0, 0, False, None),
    ]
    got = {r["root"]: r for r in survivor.survivors(spark.createDataFrame(rows, SCORED)).collect()}
    assert {k: r["whole"] for k, r in got.items()} == {1: 1, 2: None, 3: None, 4: 9}
    assert (got[2]["origin"], got[2]["dated"], got[2]["text"], got[2]["place"]) == (4, 5, 6, 6)
    assert (got[3]["origin"], got[3]["dated"], got[3]["text"], got[3]["place"]) == (7, 8, 8, 7)
    assert survivor.survivors(spark.createDataFrame([], SCORED)).count() == 0


def brute_choice(options):
    """The best choice by trying all: least lack of place, rank, age, shortness, disagreement, rank of the place and number of records."""
    best = None
    somewhere = any(o.place is not None for o in options)
    for o, d, t, g in itertools.product(options, repeat=4):
        if (somewhere and g.place is None) or (not somewhere and g.rec != o.rec) or o.place not in (None, g.place):
            continue
        astray = sum(x.place not in (None, g.place) for x in (d, t))
        choice = (int(not somewhere), o.rank, d.age, t.short, astray, g.rank, len({o.rec, d.rec, t.rec, g.rec}))
        best = choice if best is None else min(best, choice)
    return best


def test_branch_and_bound_is_optimal():
    rnd = random.Random(2)
    for _ in range(400):
        c = [survivor.Option(rnd.randint(1, 3), -rnd.randint(0, 3), -rnd.randint(0, 3), i, rnd.choice([None, "a", "b", "c"])) for i in range(rnd.randint(1, 7))]
        got = survivor.branch_and_bound(c)
        assert got[:7] == brute_choice(c)
        by = {o.rec: o for o in c}
        o, d, t, g = (by[r] for r in got[7:])
        assert o.place in (None, g.place) and (d.age, t.short) == survivor.bounds(c)[2:]


def test_survivors_of_random_groups(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        place = rnd.choice([None, "a", "b", "c", "d", "e"])
        rows.append((i // 6 if i < 480 else 999, i, rnd.randint(1, 2), rnd.randint(0, 1), rnd.randint(0, 2), place is not None, place))
    frame = spark.createDataFrame(rows + rows[:50], SCORED)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for options in (4096, 2):  # one task a group, and groups over several tasks
        got = {r["root"]: r for r in survivor.survivors(frame, options).collect()}
        assert set(got) == set(groups)
        for root, members in groups.items():
            unbettered = [r[1] for r in members if not any(o[2] < r[2] or o[3] > r[3] or o[4] > r[4] or o[5] > r[5] for o in members)]
            assert got[root]["whole"] == min(unbettered, default=None)
            by = {r[1]: r for r in members}
            assert by[got[root]["dated"]][3] == max(r[3] for r in members) and by[got[root]["text"]][4] == max(r[4] for r in members)
            place = by[got[root]["place"]][6]
            assert by[got[root]["origin"]][6] in (None, place) and (place is not None) == any(r[5] for r in members)


def test_built_record(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "Natal")], "rec_id bigint, source string, location string")
    chosen = spark.createDataFrame([(1, 1, 1, 1, 2)], "root bigint, origin bigint, dated bigint, text bigint, place bigint")
    assert [tuple(r) for r in survivor.built(rows, chosen, {"origin": ["source"], "place": ["location"]}).collect()] == [(1, "a", "Natal")]


KEYS = "rec_id bigint, source string, source_job_id string, canonical_url string, content_hash string, batch_no int"
H = "ab" * 32


def test_history(spark):
    old = spark.createDataFrame([(1, "s", "123456", "https://x.example/job/123456", None), (2, "s", None, "https://x.example/v?jk=abcd1234ef567890", H), (9000, "t", "77", None, None), (3, None, None, None, None)], "rec_id bigint, source string, source_job_id string, canonical_url string, content_hash string")
    new = [
        (100, "s", " JOB-123456 ", None, None, 1), (101, "t", "123456", None, None, 1), (102, "s", None, "http://www.X.example:80/job//123456/?utm_source=a#top", None, 1),
        (103, "s", None, "https://x.example/v?jk=abcd1234ef567890&token=1", None, 1), (104, "z", None, None, "SHA256:" + H.upper(), 2), (105, "s", "N/A", "https://x.example/busca?pagina=1", None, 2),
        (106, "s", "n/a", "https://x.example/busca?pagina=1", "0" * 64, 2), (107, "s", "999.0", None, None, 2), (108, "s", "s:999", "https://x.example/job/5551212", None, 2),
        (109, "q", None, "https://x.example/job/5551212", None, 3), (110, "t", "0077", None, None, 3), (111, None, None, None, None, 3), (112, "t", "#77", None, None, 3),
    ]
    frame = spark.createDataFrame(new, KEYS).withColumn("band", F.lit(1)).withColumn("bucket", F.lit("x"))
    got = {r["rec"] for r in history.deduplicated(old, frame, "rec_id", "batch_no").collect()}
    assert got == {100, 102, 103, 104, 108, 109, 110, 112}
    assert history.deduplicated(old, frame.limit(0), "rec_id", "batch_no").count() == 0
    assert {r["rec"] for r in history.deduplicated(old.limit(0), frame, "rec_id", "batch_no").collect()} == {108, 109, 112}


def test_history_by_batches(spark, tmp_path):
    """Batches one by one against the store give what all at once give; near-equal texts are found by band and signature."""
    text = lambda i: f"https://portal.example/empresa-de-tecnologia-e-dados/vagas/analista-de-sistemas-pleno-{i:09d}-sao-paulo"
    cols = "rec_id bigint, source string, source_job_id string, canonical_url string, content_hash string, batch_no int"
    rnd = random.Random(4)
    rows = [(i, "s", None, text(rnd.randrange(120)), None, i // 50) for i in range(200)]
    frame = spark.createDataFrame(rows, cols)
    expected, seen = {}, {}
    for i, _, _, url, _, _ in rows:
        if url in seen:
            expected[i] = seen[url]
        seen.setdefault(url, i)
    whole = {r["rec"]: r["first"] for r in history.deduplicated(frame.limit(0), frame, "rec_id", "batch_no").collect()}
    assert whole == expected
    store, found = history.Store(spark, str(tmp_path / "store")), {}
    for number in range(4):
        keys = history.identity_keys(frame.where(F.col("batch_no") == number), "rec_id", F.lit(number))
        buckets = [r["bucket"] for r in keys.select("bucket").distinct().collect()]
        store.append(keys)
        found |= {r["rec"]: r["first"] for r in store.probe(keys, buckets).collect()}
    assert found == expected
    one = history.identity_keys(frame.where("rec_id = 7"), "rec_id", F.lit(99))
    buckets = [r["bucket"] for r in one.select("bucket").distinct().collect()]
    folders = {r[0].rsplit("/", 2)[1] for r in store.matching(buckets).select(F.input_file_name()).distinct().collect()}
    assert len(buckets) <= history.BANDS and folders == {f"bucket={b}" for b in buckets}
    near = spark.createDataFrame([(1000, "s", None, text(5) + "-vaga-nova-aberta", None, 9), (1001, "s", None, "https://outro.example/job/777777777", None, 9)], cols)
    store.append(history.identity_keys(spark.createDataFrame([(500, "s", None, text(5) + "-vaga-nova-abertas", None, 8)], cols), "rec_id", F.lit(8)))
    keys = history.identity_keys(near, "rec_id", F.lit(9))
    assert store.probe(keys, list(range(history.BUCKETS))).count() == 0
    assert {r["rec"] for r in store.probe(keys, list(range(history.BUCKETS)), 0.75).collect()} <= {1000}


def test_minwise_equals_brute_force():
    texts = ["abcdefg", "abc", "xabcdefgx", "é", "abcdefg"]
    import pyarrow as pa

    from peneira.llm.glyphs import code_points

    got = history.minwise(*code_points(pa.array(texts)))
    assert (got[0] == got[4]).all() and not (got[0] == got[1]).any()
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    grams = lambda t: [t[i : i + 4] for i in range(len(t) - 3)]
    rnd, miss = random.Random(1), []
    for _ in range(60):
        a = "".join(rnd.choice("abcdefghij") for _ in range(40))
        b = a[:20] + "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 15)))
        x, y = history.minwise(*code_points(pa.array([a, b])))
        miss.append((x == y).mean() - share(grams(a), grams(b)))
    assert abs(sum(miss) / len(miss)) < 0.05


REF = [(1, "Zataris Consultoria EIRELI"), (2, "Zataris Energia"), (3, "Banco Tigatem"), (4, "Instituto Tocrinur de Digital S.A."), (5, "Lucrigraris Engenharia Ltda."), (6, "Tozamim Saúde e Serviços EIRELI"), (7, "Sapeprand Telecom")] + [
    (10 + i, f"{w} {s}") for i, (w, s) in enumerate((w, s) for w in ("Velarar", "Nojagask", "Medoxax", "Rorezil", "Pefexath", "Gutusano") for s in ("Consultoria", "Energia", "Digital", "Engenharia", "Telecom"))
]


@pytest.mark.parametrize(("text", "company"), [
    ("zataris consultoria", 1), ("Consultoria, Zataris", 1), ("Zatrais Consultoria S/A", 1), ("Zataris Cons.", 1), ("ZatarisEnergia", 2), ("Vagas na Tigatem 2026", 3), ("#VemX Banco Tigatem | trabalhe conosco", 3), ("Tigatem", 3),
    ("Tig Atem", 3), ("Instituto Tocrinur de Digital - Filial Natal, RN", 4), ("Tocrizinha", 4), ("I.T.D.", 4), ("Lucrigraris Engenharia (unidade 3)", 5), ("Grupo Sapeprand", 7), ("Ｓａｐｅｐｒａｎｄ Telecom", 7), ("Tozamim Sde. e Serviços", 6),
    ("Zataris", None), ("Zataris Logística", None), ("Вектор Плюс", None), ("", None), ("Energia", None), ("Desconhecida SA", None), ("S.A.", None), ("2026", None),
])
def test_names(text, company):
    from tests.llm.test_text import plain

    got = names.Book(REF).read(plain(text)[0])
    assert (got[1] if got and got[1] >= 0 else None) == company


def test_very_long_names():
    assert names.Book(REF).read("abc " * 50_000) is None and names.Book(REF).read("x" * 500_000) is None


def test_trie_matches_brute_force():
    rnd = random.Random(4)
    words_ = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(150)})
    trie = names.Trie(words_)

    def osa(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    for _ in range(60):
        q = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 6)))
        for k in (0, 1, 2):
            assert dict(trie.near(q, k)) == {w: osa(q, w) for w in words_ if osa(q, w) <= k}, (q, k)


def test_linked_operator_and_shards(spark):
    off = spark.createDataFrame(REF, "company_id bigint, name string").withColumn("spelled", F.lit("x"))
    told = spark.createDataFrame([("company", 1, "zataris consultoria"), ("company", 1, "zataris consultoria"), ("company", 2, "Banco Tigatem"), ("fav", 3, None), ("fav", 4, "Tigatem"), ("fav", 5, "Zataris")], "field string, row_id bigint, spelled string")
    assert sorted((r["row_id"], r["company_id"]) for r in names.linked(told, off).collect()) == [(1, 1), (1, 1), (4, 3)]
    few = names.matched(told.select("spelled").where("spelled is not null").distinct(), off, shard=10)
    assert {(r["spelled"], r["company_id"]) for r in few.collect()} >= {("zataris consultoria", 1), ("Tigatem", 3), ("Banco Tigatem", 3)}
    assert names.linked(told.limit(0), off).count() == 0 and names.linked(told, off.limit(0)).count() == 0


def test_names_of_many_words(spark):
    official = [(1, "Companhia Paranaense Zalver Distribuição Energia Elétrica Serviços Gerais"), (2, "Zalver Gás"), (3, "Um Dois Dois Tres Morvanel Cinco Seis")]
    book = names.Book(official)
    assert book.read("servicos gerais energia eletrica distribuicao zalver paranaense") [1] == 1
    assert book.read("distrib. zalvre paranaense servicos energia gerais eletrica")[1] == 1
    assert book.read("seis morvanel dois um dois")[1] == 3 and book.read("dois dois dois morvanel") is None


def test_shards_read_alike(spark):
    """Words count as common over all shards: one book and many read the same."""
    heads = ["Zataris", "Velarar", "Nojagask", "Medoxax", "Rorezil", "Pefexath", "Gutusano", "Tocrinur"]
    off = spark.createDataFrame([(i * 10 + j, f"{h} {t}") for i, h in enumerate(heads) for j, t in enumerate(("Consultoria", "Energia", "Digital", "Engenharia", "Telecom", "Norte"))], "company_id bigint, name string")
    told = spark.createDataFrame([(x,) for x in ("Consultoria", "zataris energia", "Energia Zataris", "Zatrais Digital", "Telecom", "Medoxax", "rorezil norte ltda", "Norte")], "spelled string")
    whole, cut = ({tuple(r) for r in names.matched(told, off, shard=n).collect()} for n in (1000, 7))
    assert whole == cut and len(whole) == 4


def linked(spark, rows):
    frame = spark.createDataFrame([(i, None, None, t) for i, t in enumerate(rows)], VACANCY)
    return {(r["a"], r["b"]) for r in near.record_pairs(*near.near_duplicates(frame, "rec_id", "title", "company", "description_summary")).collect()}


def alike(rows):
    sets = [words(t) for t in rows]
    return {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def test_hot_family_with_own_words(spark):
    rnd = random.Random(5)
    base, rows = [f"comum{i}" for i in range(80)], []
    for i in range(200):
        w = list(base)
        for k in range(4):
            w.insert(rnd.randrange(len(w)), f"proprio{i}x{k}")
        rows.append(" ".join(w))
    expected = alike(rows)
    assert len(expected) == 19900 and linked(spark, rows) == expected


def test_a_run_is_searched_whatever_its_words_count(spark):
    run = " ".join(f"comum{i}" for i in range(8))
    rows = [(i, None, None, " ".join(f"outro{i}x{k}" for k in range(90)) + " " + run) for i in range(12)]
    frame = spark.createDataFrame(rows, VACANCY)
    index, seen, _ = near.corpus_counts(frame, ["title", "company", "description_summary"])
    places = [set(r["places"]) for r in near.prepared(frame, "rec_id", "title", "company", "description_summary", (index, seen * 0 + 10**6, 10**7), near.Settings()).collect()]
    assert all(a & b for a in places for b in places)


def test_same_words_in_another_order(spark):
    rnd, rows = random.Random(9), []
    for i in range(6):
        rest = [f"palavra{i}x{k}" for k in range(150)]
        run, other = [f"trecho{i}x{k}" for k in range(8)], list(rest)
        rnd.shuffle(other)
        rows += [" ".join([*run, *rest, f"so{i}a"]), " ".join([f"so{i}b", *other, *run])]
    assert linked(spark, rows) == alike(rows) == {(2 * i, 2 * i + 1) for i in range(6)}


def test_short_record_in_a_longer_one(spark):
    rnd, rows = random.Random(3), []
    for i in range(5):
        own = [f"curto{i}x{k}" for k in range(26)]
        more = own + [f"longo{i}x{k}" for k in range(17)]
        rnd.shuffle(more)
        rows += [" ".join(own), " ".join(more)]
    assert linked(spark, rows) == alike(rows) == {(2 * i, 2 * i + 1) for i in range(5)}


def test_long_records_without_a_common_run(spark):
    """the same words in quite another order, and every other word one's own: no two common words stand together."""
    rnd, rows = random.Random(4), []
    for i in range(8):
        own = [f"longa{i}x{k}" for k in range(90)]
        other, mixed = rnd.sample(own, 68), rnd.sample(own, 70)
        rows += [" ".join(own), " ".join(w for k, w in enumerate(other) for w in ([w, f"so{i}x{k}"] if k % 3 == 0 else [w])), " ".join(w for k, w in enumerate(mixed) for w in ([w, f"ja{i}x{k}"] if k % 4 == 0 else [w]))]
    expected = alike(rows)
    assert len(expected) >= 16 and linked(spark, rows) == expected


@pytest.mark.parametrize("block", [16384, 40])
def test_frequent_words_share_lists_and_lose_no_pair(spark, block):
    """records of two vocabularies of frequent words and some of both, in any order, as one block and as many."""
    rnd, rows = random.Random(6), []
    for i in range(400):
        vocabulary = [f"{'ab'[i % 2]}{k}" for k in range(110)] if i % 40 else [f"{c}{k}" for c in "ab" for k in range(55)]
        rows.append(" ".join(rnd.sample(vocabulary, rnd.randint(70, 84)) + [f"so{i}"]))
    settings, expected = near.Settings(block=block), alike(rows)
    frame = spark.createDataFrame([(i, None, None, t) for i, t in enumerate(rows)], VACANCY)
    members, links = near.near_duplicates(frame, "rec_id", "title", "company", "description_summary", settings)
    assert len(expected) > 1000 and {(r["a"], r["b"]) for r in near.record_pairs(members, links).collect()} == expected


@pytest.mark.parametrize("block", [16384, 3])
def test_a_task_holds_one_fragment(spark, monkeypatch, block):
    """what a task reads at once is one fragment and a few pairs of blocks, however few partitions a shuffle has."""
    rows = [(i, None, None, " ".join(f"w{k}" for k in range(i % 40, i % 40 + 60))) for i in range(120)]
    seen, kept = [], near.staged
    monkeypatch.setattr(near, "staged", lambda df, name, **more: (seen.append(df.rdd.getNumPartitions()) if name == "likely" else None) or kept(df, name, **more))
    members, links = near.near_duplicates(spark.createDataFrame(rows, VACANCY), "rec_id", "title", "company", "description_summary", near.Settings(block=block, slice_bits=1))
    assert seen[0] > 10 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r["a"], r["b"]) for r in near.record_pairs(members, links).collect()} == alike([r[3] for r in rows])


def fragment_lines(n, places, seed=1):
    """Lines of one fragment as _dealt gives them: n classes, every one in each of the places."""
    import numpy as np

    rnd = np.random.default_rng(seed)
    kind, size, bits = np.arange(n, dtype=np.int64), np.full(n, 90, np.int32), rnd.integers(0, 2**63, (n, near.BITS // 64), dtype=np.uint64)
    for k in range(0, n, 1000):
        own = np.arange(k, min(k + 1000, n))
        at = np.tile(np.arange(len(own), dtype=np.uint16), places)
        place = np.repeat(np.arange(places, dtype=np.uint32), len(own))
        yield [7, *[x.tobytes() for x in (kind[own], size[own], bits[own], place, at)]]


def in_fragment(lines, settings):
    import pyarrow as pa

    names, kinds = ["fragment", "kind", "size", "bits", "place", "at"], [pa.int32()] + [pa.binary()] * 5
    return near._pairs_in_fragments(settings)(iter([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), kinds)], names)]))


def test_a_long_list_gives_each_block_once(spark):
    """What leaves a fragment for a list longer than a block is in proportion to the list, in batches of a block."""
    n, one = 6400, 12 + near.BITS // 8
    got = list(in_fragment(list(fragment_lines(n, 1)), near.Settings(block=100)))
    sent = [sum(len(x) for c in b.columns if str(c.type) == "binary" for x in c.to_pylist() if x) for b in got]
    assert sum(sent) == n * one and max(sent) <= one * n // near.CUTS and len(sent) == near.CUTS


def test_a_fragment_gives_its_pairs_out_in_pieces(monkeypatch):
    """Pairs of a fragment are held up to a bound, and what is given out in pieces sums to the same counts."""
    from collections import Counter

    lines = [[f, kind, size, bytes(len(bits)), place, at] for f, kind, size, bits, place, at in fragment_lines(120, 2)]
    whole = Counter({(a, b): n for x in in_fragment(lines, near.Settings()) for a, b, n in zip(*[c.to_pylist() for c in x.columns[:3]])})
    monkeypatch.setattr(near, "HELD", 1000)
    cut = list(in_fragment(lines, near.Settings(block=16384)))
    total = Counter()
    for x in cut:
        for a, b, n in zip(*[c.to_pylist() for c in x.columns[:3]]):
            total[a, b] += n
    assert total == whole and len(whole) == 120 * 119 // 2 and len(cut) > 1
