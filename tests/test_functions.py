"""Text, addresses, labels, places."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peneira.functions import labels, places
from peneira.functions.text import (
    clean_company, clean_description, clean_title, company_from_title, company_from_url, fold, fold_exact, fold_value, has_term, html_text, slug, spreadsheet_safe, term_pattern,
)
from peneira.functions.times_sql import deadline_instant, iso_instant
from peneira.functions.urls import canonical_url


def apply(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["o"] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_fold(spark):
    values = ["Ação Rápida", "STRAẞE straße", "  a\t b\n", None, "", "Ｆｕｌｌ ﬁn", "São Paulo"]
    expected = ["acao rapida", "strasse strasse", "a b", None, "", "full fin", "sao paulo"]
    assert apply(spark, fold, values) == expected
    assert [v if v is None else v for v in apply(spark, fold_exact, values)] == expected


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=20), min_size=1, max_size=20))
def test_native_fold_is_exact_on_latin(spark, values):
    keep = [v for v in values if not set(v) & set("ŉĲĳǄǅǆǇǈǉǊǋǌǱǲǳĿŀİſ¼½¾´¨¯¸˘ \x7f\x85\xad") and not any(0x80 <= ord(c) < 0xA1 for c in v)]
    if keep:
        assert apply(spark, fold, keep) == [fold_value(v) for v in keep]


def test_terms(spark):
    texts = ["node.js e java", "javascript avancado", "goiania - go", "backend em go", "usa c# e .net", "back-end java", "go-live amanha", "r$ 100", None]
    assert apply(spark, lambda c: has_term(c, "Java"), texts) == [True, False, False, False, False, True, False, False, False]
    assert apply(spark, lambda c: has_term(c, "golang"), texts) == [False, False, False, True, False, False, False, False, False]
    assert apply(spark, lambda c: has_term(c, "js"), texts)[0] is False and apply(spark, lambda c: has_term(c, "C#"), texts)[4] is True
    assert apply(spark, lambda c: has_term(c, "back end"), texts)[5] is True
    assert term_pattern("") == "(?!)"


def test_titles_and_descriptions(spark):
    assert apply(spark, clean_title, ["[Job-32006] Dev Java", "Técnica - 386089", "Dev (Cód. 123)", "Nova Analista", "Nova Scotia Dev", "Dev | Empresa X", "Dev | Júnior", None, " "]) == [
        "Dev Java", "Técnica", "Dev", "Analista", "Nova Scotia Dev", "Dev", "Dev | Júnior", None, None]
    assert apply(spark, clean_description, ["Voltar B Engenheiro de software. Salvar vaga", "Texto (function(){x})", "Bom. Pronto para este desafio? Clique", None]) == ["Engenheiro de software.", "Texto", "Bom.", None]
    assert apply(spark, html_text, ["<p>a&nbsp;&amp; b</p>**c**", None, "<br>"]) == ["a & b c", None, None]


def test_companies(spark):
    assert apply(spark, clean_company, ["🚀 Carreiras Acme 2027", "Vagas na Acme | trabalhe conosco", "VENHA SER #TIME", "A", None, "Somos Educação", "Acme Brasil"]) == ["Acme", "Acme", None, None, None, "Somos Educação", "Acme Brasil"]
    assert apply(spark, company_from_url, ["https://fcamara.gupy.io/job/1", "https://jobs.lever.co/my-co-12/x", "https://www.gupy.io/", None]) == ["Fcamara", "My Co", None, None]
    assert apply(spark, spreadsheet_safe, ["=1+1", "-x", "ok", None, ""]) == ["'=1+1", "'-x", "ok", None, ""]
    assert apply(spark, slug, ["Ação & Cia!", None]) == ["acao-cia", None]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTPS://Vagas.Example:443/a/?b=2&UTM_Source=x&A=1&token=9#top", "https://vagas.example/a?A=1&b=2"),
        ("http://x.example:8080", "http://x.example:8080/"), ("http://x.example:80/", "http://x.example/"), (None, ""), ("", ""), (" junk ", "junk"),
    ],
)
def test_canonical_url(spark, url, expected):
    assert apply(spark, canonical_url, [url]) == [expected]


def test_dates(spark):
    got = apply(spark, lambda c: F.unix_micros(iso_instant(c)), ["2026-01-01", "2026-01-01T10Z", "2026-01-01T10:00:00.5+0100", "2026-13-01", "ontem", None])
    assert got == [1_767_225_600_000_000, 1_767_261_600_000_000, 1_767_258_000_500_000, None, None, None]
    assert apply(spark, lambda c: F.unix_micros(deadline_instant(c)), ["2026-01-01", "2026-01-01T10:00:00", None]) == [1_767_322_799_000_000, 1_767_272_400_000_000, None]


def test_labels(spark):
    rows = spark.createDataFrame([(["FIT:READY", "FIT:EXCLUDE", "FIT_SCORE:3", "BONUS_MATCH:a", "BONUS_MATCH:b", "BONUS_MATCH:c", "TECH_MATCH:java"], ["Java", "SQL", None]), ([], []), (None, None)], "m array<string>, t array<string>")
    m = F.col("m")
    got = rows.select(labels.fit_state(m).alias("f"), labels.fit_points(m).alias("p"), labels.boost(m).alias("b"), labels.shown_technologies(F.col("t"), m).alias("t"), labels.reasons(m).alias("r")).collect()
    assert [r["f"] for r in got] == ["READY", "AMBIGUOUS", "AMBIGUOUS"] and [r["p"] for r in got] == [3, 0, 0]
    assert got[0]["b"] == 10 and got[0]["t"] == ["Java", "SQL"] and got[1]["r"] == ["poucos dados para avaliar"]


def test_places(spark):
    assert places.states_of(["sao-carlos-sp", "santa-catarina", "sc", "brasil", "Rio de Janeiro"]) == ["São Paulo", "Santa Catarina", "Rio de Janeiro"]
    folded = ["sao paulo, sp", "sao pau... - sp", "curitiba, pr", "brasil", "", None]
    assert apply(spark, lambda c: places.in_scope(c, "sao-paulo-sp"), folded) == [True, True, False, False, False, False]
    assert apply(spark, lambda c: places.in_scope(c, "Paraná"), folded)[2] is True
    assert apply(spark, lambda c: places.in_scope(c, "brasil"), folded)[:4] == [True, True, True, True]
    assert apply(spark, lambda c: F.array_join(places.workplaces(F.lit("UNKNOWN"), c), ","), ["hibrido ou remoto", "presencial", ""]) == ["HYBRID,REMOTE", "ONSITE", ""]


def test_cleaned_names(spark):
    titles = {
        "Nova Desenvolvedor Java Júnior": "Desenvolvedor Java Júnior", "Desenvolvedor Java Júnior Nova": "Desenvolvedor Java Júnior", "  Desenvolvedor   Java \n Júnior  ": "Desenvolvedor Java Júnior",
        "Desenvolvedor Java Júnior | Acme Tecnologia": "Desenvolvedor Java Júnior", "Estágio em TI | Vaga afirmativa": "Estágio em TI", "Novo": "Novo", "Desenvolvedor Java | Júnior": "Desenvolvedor Java | Júnior",
        "Backend Java | Estágio": "Backend Java | Estágio", "Analista de Sistemas Novo Mundo": "Analista de Sistemas Novo Mundo", "Java Developer Nova Scotia": "Java Developer Nova Scotia", "Nova Scotia Java Júnior": "Nova Scotia Java Júnior",
        "[x] Dev": "[x] Dev", "[12]": "[12]", "Dev (ref. A-9)": "Dev", "Dev (remoto)": "Dev (remoto)", "Dev -123456": "Dev", "Dev | Nível 1": "Dev | Nível 1", "| Dev": "| Dev", "Dev | a | b": "Dev",
    }
    assert apply(spark, clean_title, list(titles)) == list(titles.values())
    names = {
        "Carreiras SoftExpert": "SoftExpert", "Neogrid Carreiras": "Neogrid", "Vagas na Tokenlab": "Tokenlab", "Vagas Instituto de Pesquisas Eldorado": "Instituto de Pesquisas Eldorado", "Leite de Rosas | Trabalhe Conosco": "Leite de Rosas",
        "Logo Programa de Estágio Base e Flowa 2027": "Base e Flowa", "Programa de Estágio | Tecon Suape": "Tecon Suape", "Bauducco #vemparaBauducco": "Bauducco", "Tahto - Staff e Executivo #VemSerTahto": "Tahto - Staff e Executivo",
        "Somos BHS 💚": "BHS", "Venha Ser Consultoria": "Venha Ser Consultoria", "Acme Ltda": "Acme Ltda", "CI&T": "CI&T", "VENHA SER #SANGUELARANJA 🧡🚀": None, "#sejaveriter": None, "   ": None,
        "Vagas na Carreiras Vagas Carreiras Vagas na Programa de Trainee Acme 2025 2026 2027 2028 carreiras trabalhe conosco": "Acme", "Vagas 2026": None, "2026": None, "– Acme |": "Acme",
    }
    assert apply(spark, clean_company, list(names)) == list(names.values())
    pattern = r"^(\w+) abre Programa|Trainee (\w+) 20"
    assert apply(spark, lambda c: company_from_title(c, pattern), ["Ingredion abre Programa de Estágio 2027", "R$ 10.000: Trainee Praso 2027 aceita", "Acompanhe: vagas", None]) == ["Ingredion", "Praso", None, None]
    texts = {
        "Que tal compartilhar esta vaga? Email WhatsApp X (Twitter) Copiar link Somos a Acme": "Somos a Acme", "Boa vaga. Dicas importantes: leia. Fim": "Boa vaga.", "Texto .classe { color: red } resto": "Texto", "Voltar QA Sênior": "QA Sênior",
        "Use window.open com cuidado": "Use window.open com cuidado", "x window.foo = 3": "x", "compartilhar vaga": None, "Salvar vaga Quero essa vaga Dev": "Dev",
    }
    assert apply(spark, clean_description, list(texts)) == list(texts.values())


def test_scopes(spark):
    assert [places.state_of(s) for s in ("sao-carlos-sp", "sc", "santa-catarina", "Campo Grande, Mato Grosso do Sul", "brasil", "", "Pará de Minas", "remoto brasil", "porto alegre rs")] == ["SP", "SC", "SC", "MS", None, None, None, None, "RS"]
    folded = ["campinas - sp, brasil", "campinas/sao paulo", "campinas (sp)", "campinas", "americampinas, sp", "camp..., sp", "remoto", "rio grande do sul", "lisboa"]
    assert apply(spark, lambda c: places.in_scope(c, "campinas-sp"), folded) == [True, True, False, False, False, True, False, False, False]
    assert apply(spark, lambda c: places.in_scope(c, "brazil"), folded) == [True, True, True, False, True, True, False, True, False]
    assert apply(spark, lambda c: places.in_scope(c, "rs"), folded) == [False] * 7 + [True, False]
    assert apply(spark, lambda c: places.in_scope(c, "Lisboa"), folded)[-1] is True and not any(apply(spark, lambda c: places.in_scope(c, ""), folded))


def test_duplicate_keys(spark):
    from peneira.operators.resolve import company_key, title_key

    assert apply(spark, title_key, ["Desenvolvedora Back End Jr (Remoto)", "Dev Backend Junior", "Full Stack", "back front end", None]) == ["desenvolvedor backend junior", "desenvolvedor backend junior", "fullstack", "back frontend", ""]
    assert apply(spark, company_key, ["Baires Dev", "BairesDev LTDA", "Acme do Brasil S.A.", "SA", "Brasil Brasil", None]) == ["bairesdev", "bairesdev", "acme", "sa", "brasil", ""]
