"""Plain forms, words, residue."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peneira.llm import glyphs, residue
from peneira.llm.words import hash_words, word_hashes


def plain(*texts):
    return glyphs.fold_column(pa.array(list(texts), pa.string()))[0].to_pylist()


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Ｆｕｌｌ－ｗｉｄｔｈ", "Full-width"), ("São", "São"), ("ção", "ção"), ("a​b­c﻿", "abc"), ("a b c　d", "a b c d"), ("a‑b‐c", "a-b-c"),
        ("Dеѕіgnеr dе Рrоdutо", "Designer de Produto"), ("Вектор Плюс", "Вектор Плюс"), ("Ορίζοντας", "Ορίζοντας"), ("ѕΑР Dev", "sAP Dev"), ("РНР", "РНР"), ("aﬁrmativa", "afirmativa"), ("𝐀𝐝𝐦", "Adm"),
        ("🚀 Acme", "🚀 Acme"), ("👩‍💻", "👩‍💻"), ("❤️", "❤️"), ("r‍‍‍x", "rx"), ("a – b", "a – b"), ("a  b", "a  b"), ("", ""), ("각", "각"), ("각", "각"), ("q̣̇", "q̣̇"),
    ],
)
def test_plain_form(text, expected):
    assert plain(text, None, text) == [expected, None, expected]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cf", "Co", "Cn"], max_codepoint=0x1FFFF), max_size=12), min_size=1, max_size=5))
def test_agrees_with_nfkc_outside_look_alikes(texts):
    def odd(t):
        full = unicodedata.normalize("NFKD", t)
        return any(c in glyphs.LOOKALIKES or c in glyphs.HYPHENS or c in glyphs.INVISIBLE or glyphs.SELECTORS[0] <= ord(c) < glyphs.SELECTORS[1] or unicodedata.category(c) == "Zs" for c in t + full)

    keep = [t for t in texts if not odd(t)]
    assert plain(*keep) == [unicodedata.normalize("NFKC", t) for t in keep]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=15), max_size=6))
def test_plain_form_is_stable_and_rows_keep_apart(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    once = plain(*texts)
    assert [plain(t)[0] for t in texts] == once
    assert plain(*once) == once


def test_code_points_of_all_planes():
    england = "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f"
    texts = ["Dev\U000e0061 Java", "Ana\U000e0100lista", "\U00030000\U00031350 ﬁm", england, "a\U0010fffdb\u200b", "\U000e0001x"]
    assert plain(*texts) == ["Dev Java", "Analista", "\U00030000\U00031350 fim", england, "a\U0010fffdb", "x"]


def test_long_rows_and_many_marks():
    long = "a" + "́" * 5000
    assert plain(long, "x" * 1_000_000)[1] == "x" * 1_000_000 and plain(long)[0].startswith("á")


def test_consistent_operator(spark):
    rows = spark.createDataFrame([(1, "São", None, "a"), (1, "São", None, "a"), (2, "", "x y", "b")], "rec_id bigint, title string, company string, field string")
    got = sorted((r["row_id"], r["field"], r["plain"], r["changed"]) for r in glyphs.consistent(rows, "rec_id", ["title", "company"]).collect())
    assert got == [(1, "title", "São", True), (1, "title", "São", True), (2, "company", "x y", True), (2, "title", "", False)]
    assert glyphs.consistent(rows, "rec_id", ["title"], True).count() == 2 and glyphs.consistent(rows.limit(0), "rec_id", ["title"]).count() == 0


def test_words():
    same = hash_words(["Ação-Rápida, já!", "ACAO rapida JA", "ação RÁPIDA ja", "ação rápida"])
    assert same[0] == same[1] == same[2] and len(same[0]) == 3 and same[3] == same[0][:2]
    assert hash_words(["", "...", "a_b"]) == [[], [], hash_words(["a b"])[0]]
    row, h = word_hashes(pa.array(["a b", None, "", "b a"], pa.string()))
    assert row.tolist() == [0, 0, 3, 3] and h[0] == h[3] and h[1] == h[2]
    assert len(set(hash_words([" ".join(f"w{i}" for i in range(50_000))])[0])) == 50_000


INDEX = residue.Index({}, 1000)


@pytest.mark.parametrize("text", [
    "{{ salario }}", "Vaga de <%= cargo %>", "Buscamos {titulo} para o time", "404 Not Found Ref 7583", "Acesso negado. Ray 123", "Erro 404 - página não encontrada. Voltar ao início",
    "Please enable JavaScript and cookies to continue Thanks.", "Lorem ipsum dolor sit amet. Você vai criar telas.", "[INSERIR CARGO]", "inclusive nos [PREENCHER] fins de trimestre", "null null 9", "???", "xxxx", "undefined O squad conta com você",
    "Faça login para continuar asdf asdf qwer asdf 17", "Boa vaga para você. Sua sessão expirou, faça login novamente.", "Título da vaga", "A preencher pelo RH", "[object Object] 5435295 O squad conta", "Just a moment... checking your browser [12]", "%LOCATION%", "&lt;titulo&gt;",
])
def test_residue(text):
    assert INDEX.is_residue(text)


@pytest.mark.parametrize("text", [
    "", "Analista de Testes JavaScript", "Espera-se saber tratar erro 404 e página não encontrada no portal X.", "Analisar respostas 403 e acesso negado nos registros do X.", "Handle access denied tickets for X.",
    "Você vai criar modelos de e-mail com marcadores como {{nome}} no motor X.", "Cuidar de templates Y e variáveis ${ambiente} do pipeline X.", "Replace lorem ipsum copy in the X mockups.", "É preciso dominar JavaScript habilitado no navegador.",
    "[Urgente] Analista de Dados", "Analista [compras]", "Desenvolvedor C# 100% home office", "Vaga 5% a 10%", "You will write mail templates with tags such as {{name}} for X.", "Acessar a página de erros da equipe",
])
def test_no_residue(text):
    assert not INDEX.is_residue(text)


def test_very_long_texts():
    assert INDEX.is_residue("bla " * 30_000 + "bla.") and not INDEX.is_residue("de dados " * 100_000)


def test_flagged_operator(spark):
    rows = spark.createDataFrame([(1, "Dev", "Acesso negado."), (2, None, None), (3, "{{cargo}}", ""), (3, "{{cargo}}", ""), (4, "Dev", "texto " * 20_000 + ". {{x}}")], "rec_id bigint, title string, body string")
    assert sorted((r["rec_id"], r["residue"]) for r in residue.flagged(rows, ["title", "body"]).collect()) == [(1, True), (2, False), (3, True), (3, True), (4, True)]
    assert residue.flagged(rows.limit(0), ["title", "body"]).count() == 0
    counts, total = residue.word_counts(rows, ["title", "body"])
    assert total == 5 and counts["acesso"] == 1 and counts["texto"] == 1


@pytest.mark.parametrize("text", [
    "Sobre a empresa: lorem ipsum dolor sit amet", "Analista de Sistemas – página não encontrada", "Vaga em Recife, acesso negado", 'Descrição "texto de exemplo"', "Requisitos/lorem ipsum",
    "Somos uma empresa lorem ipsum dolor sit amet líder no setor", "O candidato deve ative o JavaScript no seu navegador e ter boa comunicação",
])
def test_residue_within_a_passage(text):
    assert INDEX.is_residue(text)


def test_wordings_outside_the_list():
    from tests.llm import heldout

    told, clean = heldout.RESIDUE.strip().splitlines(), heldout.CLEAN.strip().splitlines()
    assert sum(INDEX.is_residue(plain(t)[0]) for t in told) >= 0.7 * len(told)
    assert not any(INDEX.is_residue(plain(t)[0]) for t in clean)
