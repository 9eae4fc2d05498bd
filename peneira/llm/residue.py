"""Template residue, filler, error pages and script notices (p2).

Labelled exemplars of residue are indexed by their words. A pass over the
corpus counts in how many records each indexed word occurs; these counts give
the TF-IDF weights. A text is looked up in the inverted index word by word;
only texts that hold an anchor, one of the heaviest words of an exemplar, are
scored. There, passage windows as long as the exemplar are compared by TF-IDF
containment, both of the exemplar in the window and of the window in the
exemplar; a window covered to a high degree is residue. Exemplars of texts that
speak about such things as part of the work compete for the same place.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.llm.glyphs import fold_column
from peneira.llm.words import hash_words, word_hashes

# Labelled exemplars of residue. A number stands for any number, {x} for any unfilled placeholder.
RESIDUE = """
{x}
[inserir cargo]
[inserir texto]
[inserir descrição]
[insert title]
[insert text here]
[preencher]
[nome da empresa]
[nome do cargo]
[company name]
[job title]
[your company]
[insertar cargo]
[nombre de la empresa]
[rellenar]
nome do cargo aqui
título da vaga
título da vaga aqui
título de exemplo
título del puesto
título do cargo
sem título
sin título
no title
untitled
untitled position
untitled job
job title here
your title here
insert job title
insert description here
add your description here
job description goes here
lorem ipsum
lorem ipsum dolor sit amet
lorem ipsum dolor sit amet, consectetur adipiscing elit
dolor sit amet consectetur, sed do eiusmod tempor incididunt
ut labore et dolore magna aliqua
sample job post - do not publish
sample text
this is a test
test job please ignore
teste de publicação, favor ignorar
teste teste teste
test test test
prueba prueba prueba
texto texto texto texto
texto de exemplo
texto de ejemplo
bla bla bla bla
blah blah blah
asdf asdf qwer asdf
asdf asdf
qwerty qwerty
xxxx
xxxxx xxxxx xxxx xxxxxxx
aaaaaa bbbbbb cccccc
???
a preencher pelo RH
a definir pelo RH
por completar por RRHH
TBD
TBD - to be filled by HR
to be filled by HR
to be defined
descrição da vaga aqui
descrição da vaga
insira a descrição
insira aqui a descrição da vaga
escreva aqui o texto do anúncio
escriba aquí el texto del aviso
escriba aquí la descripción
descripción del puesto aquí
null
null null
undefined
undefined undefined
none
NaN
NaN - undefined
#REF!
#N/A
[object Object]
404 not found
page not found
error 404: page not found
oops! that page can't be found
that page can't be found
the page you requested could not be found
erro 404 - página não encontrada
página não encontrada
error 404: la página no existe
página no encontrada
la página no existe
403 forbidden
forbidden
401 unauthorized
access denied
acesso negado
acceso denegado
you don't have permission to view this page
você não tem permissão para ver esta página
no tiene permiso para ver esta página
500 internal server error
internal server error
erro interno do servidor
error interno del servidor
502 bad gateway
bad gateway
503 service temporarily unavailable
503 service unavailable
service unavailable
serviço indisponível
servicio no disponible
504 gateway time-out
gateway timeout
429 too many requests
fatal error: uncaught exception on line 42
warning: mysql_fetch failed
traceback (most recent call last): KeyError
TypeError: cannot read properties of undefined
an unexpected error occurred, please try again later
something went wrong
ocorreu um erro inesperado, tente de novo mais tarde
ocorreu um erro, tente novamente
ha ocurrido un error, intente más tarde
session expired, please sign in
your session has expired
sua sessão expirou, faça login novamente
su sesión ha expirado
please sign in to continue
please log in to view this job
faça login para continuar
faça login para ver a vaga
inicie sesión para ver la oferta
inicie sesión para continuar
this job is no longer available
this position has been closed
vaga não disponível ou removida do ar
esta vaga não está mais disponível
vaga encerrada
esta oferta ya no está disponible
carregando
loading
cargando
just a moment checking your browser
just a moment
checking your browser
checking your browser before accessing
verificando se você é humano
verify you are human
complete the captcha to proceed
confirme que não é um robô para seguir
confirme que no es un robot
comprobando su conexión segura
checking if the site connection is secure
please enable JavaScript and cookies to continue
you need to enable JavaScript to run this app
please enable cookies
this page requires scripting to be turned on
this site requires JavaScript to work
habilite o JavaScript para ver esta página
ative o JavaScript no seu navegador
ative os scripts do navegador e recarregue
este site precisa de JavaScript para funcionar
su navegador no admite scripts; active JavaScript
su navegador no admite JavaScript
active JavaScript para continuar
este sitio necesita JavaScript
we use cookies to improve your experience
este site usa cookies
"""

# More exemplars by rule: each line joins every phrase before the bar with every phrase after it.
COMBINED = """
the page, this page, the requested page, the page you are looking for, the requested URL | not found, was not found, could not be found, does not exist, doesn't exist, is not available, has been moved
a página solicitada, a página que você procura, esta página, o conteúdo solicitado, o endereço solicitado | não existe, não foi encontrada, não foi encontrado, não está disponível, foi movida, foi removida
la página solicitada, la página que busca, esta página, el contenido solicitado | no existe, no fue encontrada, no se encuentra disponible, no está disponible, ha sido movida
error 500, error 502, error 503, error | internal server error, service unavailable, server error, temporarily unavailable
erro 500, erro 503, erro | serviço indisponível, erro interno, servidor indisponível, temporariamente indisponível
you are not authorized to, you do not have permission to, you are not allowed to | access this page, view this page, view this content, access this resource
você não tem permissão para, você não tem autorização para, você não está autorizado a | acessar esta página, acessar este conteúdo, ver esta página, ver este conteúdo
no tiene permiso para, no está autorizado a, no tiene autorización para | acceder a esta página, ver esta página, ver este contenido
access to this page, access to this site, your access | has been denied, is denied, has been blocked, is restricted
o acesso, seu acesso, acesso | foi negado, foi bloqueado, está bloqueado, não autorizado
please enable, you must enable, enable, please turn on, turn on, activate | JavaScript, JavaScript in your browser, JavaScript to continue, JavaScript to view this page, scripts in your browser
habilite, ative, é preciso habilitar, é necessário ativar, você precisa habilitar | o JavaScript, o JavaScript do navegador, o JavaScript para continuar, o JavaScript para ver o conteúdo, os scripts do navegador
habilite, active, debe habilitar, es necesario activar | JavaScript, JavaScript en su navegador, JavaScript para continuar, los scripts del navegador
JavaScript | is disabled in your browser, is turned off, is required to view this page, must be enabled, está desativado no seu navegador, está desabilitado, é necessário para ver esta página, está deshabilitado en su navegador, es necesario para ver esta página
your browser, seu navegador, su navegador | does not support JavaScript, has JavaScript disabled, não suporta JavaScript, está com JavaScript desabilitado, no es compatible con JavaScript, tiene JavaScript deshabilitado
this site, this page, this application | requires JavaScript, needs JavaScript, requires cookies
este site, esta página, este aplicativo | requer JavaScript, precisa de JavaScript, exige JavaScript
este sitio, esta página | requiere JavaScript, necesita JavaScript
this job, this position, this vacancy, this job posting | has expired, is closed, is no longer available, has been filled, has been removed, is no longer active
esta vaga, esta oportunidade, o anúncio | expirou, foi encerrada, foi encerrado, não está disponível, foi removida, já foi preenchida
esta oferta, esta vacante, el aviso | ha expirado, está cerrada, ya no está disponible, fue eliminada
your session, sua sessão, su sesión | has timed out, expired, expirou, foi encerrada, ha caducado, ha finalizado
please log in, log in, sign in, please sign in | to view this page, to see this job, to access this content, to apply
faça login, faça o login, entre na sua conta, acesse sua conta | para ver esta vaga, para visualizar a vaga, para acessar o conteúdo
inicie sesión, ingrese a su cuenta | para ver esta vacante, para acceder al contenido
insert, enter, type, add, write, paste | job title here, job description here, the description here, company name here, text here, location here
insira, digite, escreva, informe, coloque | o título da vaga, a descrição da vaga, a descrição aqui, o texto aqui, o nome da empresa, o título aqui
escriba, ingrese, inserte, complete | el título del puesto, la descripción aquí, el nombre de la empresa, el texto aquí, la descripción del puesto
sample, example, dummy, placeholder | text, description, job, title
texto, descrição, vaga, título | de teste, de exemplo, padrão, provisória
texto, descripción, aviso | de prueba, de ejemplo, de relleno
please complete, complete, please solve | the captcha, the security check, the verification
verify, please verify, confirm, please confirm | you are human, you are not a robot
confirme que, verifique se, prove que | você é humano, você não é um robô, não é um robô
verificando, checking, comprobando | seu navegador, a conexão, your connection, the connection, su navegador
an error occurred, an error has occurred, something went wrong | while loading the page, while processing your request, please try again, try again later
ocorreu um erro, houve um erro | ao carregar a página, ao processar a solicitação, tente novamente mais tarde, inesperado
ha ocurrido un error, se produjo un error | al cargar la página, al procesar la solicitud, inténtelo de nuevo
too many requests, muitas requisições, demasiadas solicitudes | please try again later, tente novamente mais tarde, intente más tarde
loading, carregando, cargando, please wait, aguarde | please wait, content, o conteúdo, a página, por favor
this website uses cookies, we use cookies, usamos cookies, utilizamos cookies | to improve your experience, to personalize content, para melhorar sua experiência, para mejorar su experiencia
to be defined, to be confirmed, to be announced | by HR, by the recruiter, later
a definir, a confirmar, a preencher | pelo recrutador, pela empresa, pelo RH
[nome da, [nome do, [título da, [descrição da | empresa], cidade], candidato], vaga]
[company, [job, [city, [candidate | name], title], description]
fatal error, parse error, uncaught exception, syntax error | on line 12, in file on line 12, undefined function on line 12
"""

# Labelled exemplars of texts in which such words belong to the work.
WORK = """
marcadores como {x}
marcadores {x}
com marcadores como {x} no motor
variáveis {x}
e variáveis {x} do pipeline
templates e variáveis {x}
tags such as {x}
mail templates with tags such as {x}
campos como {x}
plantillas con campos como {x}
placeholders such as {x}
variables such as {x}
variables como {x}
chaves como {x}
sintaxe {x}
textos de preenchimento lorem ipsum deixados no site
replace lorem ipsum copy in the mockups
tratar erro 404 e página não encontrada no portal
errores 404 y páginas caídas del sitio
track 404 and 503 errors on the site
respostas 403 e acesso negado nos registros
handle access denied tickets
dominar JavaScript habilitado no navegador e acessibilidade
solid JavaScript is required, enable teams
se pide JavaScript avanzado
"""

PLACEHOLDER = "‹slot›"
COVER, PRECISE, WORKS = 0.8, 0.7, 0.7
# Containment where a window begins after a mark but not at a passage; words of an exemplar that counts within a sentence.
MARKED, WITHIN = 0.95, 4

_NAME = r"[\w.\- ]{1,40}"
_SLOT = (
    rf"\{{\{{[{{#/]?\s*{_NAME}\s*\}}?\}}\}}|[$#]\{{\s*{_NAME}\s*\}}|\{{%-?\s*{_NAME}\s*-?%\}}|<%[=-]?\s*{_NAME}\s*%>|<<\s*{_NAME}\s*>>|&lt;\s*[a-zA-Z_][\w.]*\s*&gt;"
    rf"|<[a-zA-Z_]+[._]?[\w.]*>|\[\[\s*{_NAME}\s*\]\]|__[A-Za-z][\w.]*?__|@@[\w.]+@@|%[A-Za-z_][A-Za-z_.]*[A-Za-z_]%|\{{\s*[a-zA-Z_][\w.]*\s*\}}"
)
_TOKEN = re.compile(rf"(?P<slot>{_SLOT})|(?P<cell>#[A-Z/]{{2,5}}[!?]|#N/A|#NAME\?|#DIV/0!)|(?P<ask>\?{{2,}})|(?P<word>[^\W_]+)")
_STOP = re.compile(r"[.!?…>|\n\r;•](?:\s|$)|[.…]{2,}|\n|^\s*[-•*(\[>]+\s*$")
_PAUSE = re.compile(r"[^\w\s]|\n")


class Text:
    """The tokens of one text, which of them begin a passage and after which of them one may end."""

    def __init__(self, text: str):
        self.tokens: list[str] = []
        self.begins: list[bool] = []
        self.ends: list[bool] = []
        self.opened: list[bool] = []
        self.marked: list[bool] = []
        last = 0
        for found in _TOKEN.finditer(text):
            gap, raw, kind = text[last : found.start()], found[0], found.lastgroup
            first, single = not self.tokens, gap == " "
            self.begins.append(first or (not single and bool(_STOP.search(gap))))
            self.opened.append(gap[-1:] in ("[", "("))
            self.marked.append(first or (not single and bool(_PAUSE.search(gap))))
            if not first:
                self.ends.append((not single and bool(_PAUSE.search(gap))) or kind != "word" or not raw[0].islower())
            self.tokens.append(PLACEHOLDER if kind == "slot" else raw.lower() if kind == "cell" else "‹ask›" if kind == "ask" else plain_word(raw))
            last = found.end()
        if self.tokens:
            self.ends.append(True)


@lru_cache(maxsize=1 << 15)
def plain_word(raw: str) -> str:
    word = "".join(c for c in unicodedata.normalize("NFKD", raw.casefold()) if not unicodedata.combining(c))
    if word.isdigit():
        return "‹number›"
    if len(word) >= 3 and len(set(word)) == 1:
        return "‹same›"
    return word


def combined(block: str = COMBINED) -> str:
    """The lines that the rule makes of the combinations."""
    out = []
    for line in block.strip().splitlines():
        heads, tails = (part.split(", ") for part in line.strip().split(" | "))
        out += [f"{a.strip()} {b.strip()}" for a in heads for b in tails]
    return "\n".join(out)


def _lines(block: str) -> list[list[str]]:
    out = []
    for line in block.strip().splitlines():
        text = Text(line.replace("{x}", "{{x}}"))
        out.append((["‹open›", *text.tokens] if line.startswith("[") and "object" not in line else text.tokens))
    return out


SPECIAL = {PLACEHOLDER, "‹number›", "‹same›", "‹ask›", "‹open›"}


class Index:
    """The exemplars with their weights, and the inverted index from words to exemplars."""

    def __init__(self, counts: dict[str, int], total: int):
        self.counts, self.total = counts, total
        self._idf: dict[str, float] = {}
        self.residue = [(e, self.weigh(e)) for e in _lines(RESIDUE + combined())]
        self.work = [(e, self.weigh(e)) for e in _lines(WORK)]
        self.by_word: dict[str, list[int]] = defaultdict(list)
        self.offsets: list[dict[str, list[int]]] = []
        self.parts = [[(w, self.idf(w)) for w in e] for e, _ in self.residue]
        for i, (e, weight) in enumerate(self.residue):
            left = weight
            bare = e[1:] if e[0] == "‹open›" else e
            self.offsets.append({w: [k for k, x in enumerate(bare) if x == w] for w in bare})
            for w in sorted(set(e), key=lambda w: -self.idf(w)):  # any match of COVER holds one of these
                self.by_word[w].append(i)
                left -= self.idf(w) * e.count(w)
                if left < COVER * weight - 1e-9:
                    break

    def idf(self, word: str) -> float:
        known = self._idf.get(word)
        if known is None:
            if word in SPECIAL:
                known = {"‹number›": 0.5, "‹open›": 0.5}.get(word, math.log1p(max(self.total, 99)))
            else:
                known = math.log1p(max(self.total, 99) / (1 + self.counts[word])) if word in self.counts else math.log(101)
            if word in self.counts or word in SPECIAL:
                self._idf[word] = known
        return known

    def weigh(self, tokens: list[str]) -> float:
        return sum(map(self.idf, tokens))

    def shared(self, a: list[str], b: list[str]) -> float:
        return sum(self.idf(w) * n for w, n in (Counter(a) & Counter(b)).items())

    def is_residue(self, text: str) -> bool:
        """Whether a passage window of the text is covered by an exemplar of residue and belongs to no exemplar of work.

        The index gives, for every word of the text, the exemplars it anchors;
        windows begin where such a word would stand in its exemplar."""
        seen = Text(text)
        present = {*seen.tokens, "‹open›"}
        could = {i for t in present for i in self.by_word.get(t, ())}
        could = {i for i in could if sum([x for w, x in self.parts[i] if w in present]) >= COVER * self.residue[i][1]}
        if not could:
            return False
        starts: dict[int, set[int]] = {}
        for at, token in enumerate(seen.tokens):
            for i in self.by_word.get(token, ()):
                if i in could:
                    for place in self.offsets[i][token]:
                        # One word more or less may stand before the anchor than in the exemplar.
                        for begin in (at - place - 1, at - place, at - place + 1):
                            if 0 <= begin <= at:
                                starts.setdefault(begin, set()).add(i)
        return any(self._matches(seen, own, could, begin) for begin, own in starts.items())

    def _matches(self, seen: Text, own: set[int], could: set[int], start: int) -> bool:
        """Whether a window that begins here is covered by one of its own exemplars and ends where a passage may end, or where
        further windows of any that could be go on to such an end. Where no mark stands before the window, within a
        sentence, the exemplar must be there word for word and be no single word."""
        waiting, done = [(start, own)], set()
        while waiting:
            at, exemplars = waiting.pop()
            if at in done:
                continue
            done.add(at)
            for i in exemplars:
                e, weight = self.residue[i]
                head = ["‹open›"] if at < len(seen.tokens) and seen.opened[at] and e[0] == "‹open›" else []
                if (e[0] == "‹open›" and not head) or set(e).isdisjoint(seen.tokens[at : at + 2]):
                    continue
                if e == [PLACEHOLDER]:
                    if at < len(seen.tokens) and seen.tokens[at] == PLACEHOLDER and not self._is_work(seen.tokens, at, at + 1):
                        return True
                    continue
                begun = seen.begins[at] or seen.opened[at] or at > start if at < len(seen.tokens) else False
                if not begun and not seen.marked[at]:
                    stop = at + len(e)
                    if len(e) >= WITHIN and seen.tokens[at:stop] == e and not self._is_work(seen.tokens, at, stop):
                        return True
                    continue
                cover, precise = (COVER, PRECISE) if begun else (MARKED, MARKED)
                for stop in range(at + max(1, len(e) - len(head) - 2), min(len(seen.tokens), at + len(e) + 2) + 1):
                    window = head + seen.tokens[at:stop]
                    both = self.shared(e, window)
                    if both >= cover * weight and both >= precise * self.weigh(window) and not self._is_work(seen.tokens, at, stop):
                        if seen.ends[stop - 1]:
                            return True
                        waiting.append((stop, could))
        return False

    def _is_work(self, tokens: list[str], start: int, stop: int) -> bool:
        near, own = tokens[max(0, start - 4) : stop + 4], tokens[start:stop]
        for e, weight in self.work:
            if set(own) & set(e) and (PLACEHOLDER not in e or PLACEHOLDER in own):
                part = tokens[max(0, start - 4) : stop] if PLACEHOLDER in e and len(e) <= 3 else near
                if self.shared(e, part) >= WORKS * weight and self.shared(e, part) > self.shared(own, e) + 0.2:
                    return True
        return False


def vocabulary() -> list[str]:
    return sorted({w for e in _lines(RESIDUE) + _lines(combined()) + _lines(WORK) for w in e} - SPECIAL)


class Lookup:
    """Finds hashes of a small sorted set among many."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.low = np.zeros(1 << 16, bool)
        self.low[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in the set, place among all words) of the hashes that are in the set."""
        likely = np.flatnonzero(self.low[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[likely]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[likely]
        likely = likely[hit]
        return row[likely], at[hit], likely


def keyed_vocabulary() -> list[tuple[int, str]]:
    words = vocabulary()
    return sorted((h[0], w) for w, h in zip(words, hash_words(words)) if len(h) == 1)


def word_counts(rows: DataFrame, fields: list[str]) -> tuple[dict[str, int], int]:
    """In how many records each word of the exemplars occurs, over all records, and the number of records.

    What reaches the driver is one count for each word of the exemplars, whatever the corpus."""
    keyed = keyed_vocabulary()
    hashes = np.array([h for h, _ in keyed], np.uint64)
    find = Lookup(hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, np.zeros(len(hashes), np.int64)
        for batch in batches:
            pairs = []
            for i in range(len(fields)):
                row, at, _ = find(*word_hashes(batch.column(i)))
                pairs.append(row * len(hashes) + at)
            found += np.bincount(np.unique(np.concatenate(pairs)) % len(hashes), minlength=len(hashes))
            total += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hashes) + 1)), pa.array(np.append(found, total))], ["word", "n"])

    counted = rows.select(*[F.col(f).cast("string").alias(f"v{i}") for i, f in enumerate(fields)]).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r["word"]: r["n"] for r in counted.collect()}
    return {w: got.get(i, 0) for i, (_, w) in enumerate(keyed)}, got.get(len(hashes), 0)


class Judge:
    """Which texts of Arrow columns hold residue: retrieval for all, scoring for the few whose words can cover an exemplar."""

    def __init__(self, index: Index):
        keyed = keyed_vocabulary()
        self.index, self.find = index, Lookup(np.array([h for h, _ in keyed], np.uint64))
        place = {w: i for i, (_, w) in enumerate(keyed)}
        self.size = len(keyed)
        self.gain = np.zeros((len(keyed), len(index.residue)), np.float32)
        self.need = np.zeros(len(index.residue), np.float32)
        self.span = np.zeros(len(index.residue), np.int64)
        self.times = np.zeros(self.gain.shape, np.int8)
        for j, (e, weight) in enumerate(index.residue):
            self.need[j] = COVER * weight - 1e-3
            for w in e:
                if w in place:
                    self.gain[place[w], j] += index.idf(w)
                    self.times[place[w], j] += 1
                else:  # signs are taken to be there
                    self.need[j] -= index.idf(w)
            # A window is as long as its exemplar and a few words; only a placeholder may be more words, and SIGNS finds those.
            self.span[j] = len(e) + 6
            if not self.gain[:, j].any():
                self.need[j] = np.inf  # made of signs only: SIGNS finds it

    def _near(self, at: np.ndarray, order: np.ndarray, j: int) -> bool:
        """Whether words that can cover an exemplar stand near enough to each other for one window."""
        gain = self.gain[at, j]
        hit = np.flatnonzero(gain > 0)
        times = self.times[at[hit], j]
        words, place, gain, need, span = at[hit].tolist(), order[hit].tolist(), (gain[hit] / times).tolist(), float(self.need[j]), int(self.span[j])
        left = dict(zip(words, times.tolist()))
        for first in range(len(words)):
            total, room = 0.0, dict(left)
            for k in range(first, len(words)):
                if place[k] - place[first] >= span:
                    break
                if room[words[k]]:  # a word counts as often as the exemplar has it
                    room[words[k]] -= 1
                    total += gain[k]
                    if total >= need:
                        return True
        return False

    def __call__(self, columns: list[pa.Array], words: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """columns: plain forms; words: their word_hashes() where known."""
        out = np.zeros(len(columns[0]), bool)
        for i, column in enumerate(columns):
            every = words[i] if words else word_hashes(column)
            row, at, order = self.find(*every)
            likely = pa.compute.match_substring_regex(column, SIGNS).fill_null(False).to_numpy(zero_copy_only=False).copy()
            number, where = np.unique(row, return_inverse=True)
            there = np.zeros((len(number), self.size), np.float32)
            there[where, at] = 1
            bounds = np.searchsorted(where, np.arange(len(number) + 1))
            for a in range(0, len(number), 4096):
                for r, j in zip(*(x.tolist() for x in np.nonzero(there[a : a + 4096] @ self.gain >= self.need))):
                    k = number[a + r]
                    if not likely[k] and not out[k]:
                        own = slice(bounds[a + r], bounds[a + r + 1])
                        likely[k] = self._near(at[own], order[own], j)
            for k in np.flatnonzero(likely & ~out).tolist():
                out[k] = self.index.is_residue(column[k].as_py())
        return out


def flagged(rows: DataFrame, fields: list[str], index: Index | None = None, name: str = "residue") -> DataFrame:
    """rows with a boolean column name: whether one of the fields holds, wholly or in part, residue text.

    A null or empty text is no residue. Very long texts are read whole. All
    columns of rows are kept, whatever their names; repeated rows get the same
    answer. Two scans of the fields, no shuffle but that of the word counts.
    """
    judge = Judge(index or Index(*word_counts(rows, fields)))

    @F.pandas_udf("boolean")
    def holds(*columns):
        import pandas as pd

        return pd.Series(judge([fold_column(pa.array(c, pa.string(), from_pandas=True))[0] for c in columns]))

    return rows.withColumn(name, holds(*[F.col(f).cast("string") for f in fields]))


# Signs of what is no word: brackets of placeholders, runs of question marks or of one letter.
SIGNS = r"\{\{|[$#]\{|\{%|<%|<<|&lt;|<[a-zA-Z_]|\[\[|__|@@|%[A-Za-z_.]+%|\{\s*[a-zA-Z_]|\?\?|(?i:" + "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz") + ")"
