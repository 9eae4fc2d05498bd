"""Variant spellings of names typed by people, linked to the entity they mean (p7).

The official names are put into tries: one of their words, one of the whole
names written together. A name is cleaned of what portals put around it, its
words are looked up, and those not found are run through the trie with a
Levenshtein automaton, which enumerates all words within a bounded distance.
Names that share an identifying word are then checked word by word in any
order. Abbreviations, nicknames and initials have ways of their own. A name
that fits two entities equally well means neither.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.llm.glyphs import fold_column

# Words that portals and people put around a company's name.
AROUND = (
    "vagas vaga trabalhe conosco carreira carreiras logo jobs job careers career work trabaja trabaje nosotros empleos empleo oportunidades oportunidade oficial "
    "site unidade unidad unit"
)
# Short words that go with them.
WITH_AROUND = "na no nas nos em en at with us con for"
# Legal forms, and short words between others.
LEGAL = "ltda limitada sa s/a me epp mei eireli inc llc ltd corp lda sl srl cia companhia"
BETWEEN = "e de da do das dos y and of the &"
# Abbreviations that are not the beginning of their word.
SHORT = {"tech": "tecnologia", "tec": "tecnologia", "innov": "inovacao", "segs": "seguros", "pgtos": "pagamentos", "pagtos": "pagamentos", "svcs": "servicos", "servs": "servicos", "log": "logistica", "educ": "educacao", "eng": "engenharia", "solucs": "solucoes", "indl": "industria", "data": "dados", "systems": "sistemas", "health": "saude", "services": "servicos", "insurance": "seguros", "foods": "alimentos"}
# Words that people add to or leave off a name that means the same company.
ADDED = "grupo group brasil brazil holding"
# Endings of nicknames.
DIMINUTIVE = ("zinha", "zinho", "inha", "inho")
# A word of more official names than this identifies none of them.
COMMON = 4
# Names in one shard of tries.
SHARD = 50_000

_AROUND, _WITH, _LEGAL, _BETWEEN, _ADDED = set(AROUND.split()), set(WITH_AROUND.split()), set(LEGAL.split()), set(BETWEEN.split()), set(ADDED.split())
_BRANCH = re.compile(r"\s*(?:[-–|/(,]\s*)?\b(?:filial|branch|sucursal|sede|matriz|unidade|unidad|unit)\b.*$|\s*\|.*$|\s*\([^)]*\)?\s*$")
_WORDS = re.compile(r"(?:[^\W\d_]\.){2,}[^\W\d_]?\.?|#\w+|s\s?[/.]\s?a\b\.?|[^\W_]+\.?")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def words_of_name(text: str) -> list[str]:
    """The words that count of a name in its plain form; an abbreviation keeps its full stop."""
    name = fold(text)
    cut = _BRANCH.sub("", name)
    while cut != name and cut.strip():
        name, cut = cut, _BRANCH.sub("", cut)
    out = []
    for w in _WORDS.findall(name):
        bare = re.sub(r"[\s.]", "", w)
        if w.startswith("#") or bare.isdigit() or bare.replace("/", "") in ("sa",) and len(w) > 1 or bare in _LEGAL:
            continue
        out.append(bare if w.count(".") > 1 else w)
    kept = [w for w in out if w.rstrip(".") not in _AROUND]
    if len(kept) < len(out):
        kept = [w for w in kept if w not in _WITH]
    return kept or out


def counted_words(text: str) -> list[str]:
    """The words of a name that may identify it."""
    return [w.rstrip(".") for w in words_of_name(text) if w.rstrip(".") not in _BETWEEN]


def initials(words: list[str]) -> str:
    return "".join(w[0] for w in words)


class Trie:
    """Words in a trie; near() runs a Levenshtein automaton over it, where a swap of neighbours is one change too."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str, most: int) -> list[tuple[str, int]]:
        """(word of the trie, distance) of all within the distance."""
        found: list[tuple[str, int]] = []
        n = len(word)
        first = list(range(n + 1))
        stack = [(c, node, "", first, None) for c, node in self.root.items() if c]
        while stack:
            c, node, before, row, older = stack.pop()
            now = [row[0] + 1]
            low = now[0]
            # The states of the automaton after this letter; those beyond the bound are dead.
            for i in range(1, n + 1):
                v = row[i - 1] if word[i - 1] == c else 1 + min(row[i - 1], row[i], now[i - 1])
                if older is not None and i > 1 and word[i - 1] == before and word[i - 2] == c and older[i - 2] + 1 < v:
                    v = older[i - 2] + 1
                now.append(v)
                if v < low:
                    low = v
            if low > most:
                continue
            if "" in node and now[n] <= most:
                found.append((node[""], now[n]))
            stack.extend((d, child, c, now, row) for d, child in node.items() if d)
        return found

    def under(self, prefix: str) -> list[str]:
        """All words that begin with a prefix."""
        node = self.root
        for c in prefix:
            if c not in node:
                return []
            node = node[c]
        out, stack = [], [node]
        while stack:
            at = stack.pop()
            out += [at[""]] if "" in at else []
            stack.extend(child for d, child in at.items() if d)
        return out


def bound(word: str) -> int:
    """Distance up to which a word may be another: none for short ones."""
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


def distance(a: str, b: str, most: int) -> int:
    """The distance of two words, or more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    found = Trie([b]).near(a, most)
    return found[0][1] if found else most + 1


@lru_cache(maxsize=1 << 16)
def alike(word: str, official: str) -> int | None:
    """The cost at which a word stands for an official one: 0 equal, 1 abbreviated, more for each change; None if it doesn't."""
    bare = word.rstrip(".")
    if bare == official:
        return 0
    if SHORT.get(bare) == official:
        return 1
    stem = bare[:-1] if bare.endswith("s") and len(bare) > 3 and not word.endswith(".") else bare
    if len(bare) >= 2 and word.endswith(".") and official.startswith(bare) or len(bare) >= 3 and official.startswith(bare) or len(stem) >= 3 and len(stem) < len(bare) and official.startswith(stem) and len(bare) < len(official) - 1:
        return 1
    most = min(bound(bare), bound(official))
    d = distance(bare, official, most)
    return 2 * d if d <= most else None


class Book:
    """Official names with their tries."""

    def __init__(self, names: list[tuple[int, str]], common: set[str] | None = None):
        """common: the words of more than COMMON names of all books, where this is one of several."""
        self.names = {i: n for i, n in names}
        self.words = {i: counted_words(n) for i, n in names}
        often = Counter(w for ws in self.words.values() for w in set(ws))
        if common is not None:
            often = Counter({w: COMMON + 1 if w in common else 1 for w in often})
        # Words that name an entity; in a name of common words only, all of them do.
        self.own = {i: [w for w in ws if often[w] <= COMMON] or ws for i, ws in self.words.items()}
        self.generic = {w for w, k in often.items() if k > COMMON}
        self.by_own: dict[str, list[int]] = defaultdict(list)
        self.by_whole: dict[str, set[int]] = defaultdict(set)
        self.by_initials: dict[str, list[int]] = defaultdict(list)
        for i, ws in self.words.items():
            for w in set(self.own[i]):
                self.by_own[w].append(i)
            full = [w.rstrip(".") for w in words_of_name(self.names[i])]
            for whole in {"".join(full), "".join(ws)}:
                self.by_whole[whole].add(i)
            self.by_initials[initials(ws)].append(i)
        # No longer text can be within the bound of an official one.
        self.longest_word = max(map(len, self.by_own), default=0) + 2
        self.longest_whole = max(map(len, self.by_whole), default=0) + 2
        self.most_words = max(map(len, self.words.values()), default=0) + 2
        self.trie, self.wholes = Trie(list(self.by_own)), Trie(list(self.by_whole))
        self.near = lru_cache(maxsize=1 << 18)(self._near)

    def _near(self, word: str) -> list[tuple[str, int]]:
        return self.trie.near(word, bound(word)) if len(word) <= self.longest_word else []

    def candidates(self, words: list[str]) -> set[int]:
        """Entities that share an identifying word, exactly or, if none does, within its distance."""
        exact = {i for w in words for i in self.by_own.get(w.rstrip("."), ())}
        return exact or {i for w in words if w not in self.generic for near, _ in self.near(w.rstrip(".")) for i in self.by_own[near]}

    def cost(self, words: list[str], entity: int) -> int | None:
        """The cost of reading words as an entity's name, its words in any order; None if a word stands for none of them
        or none of them identifies it."""
        official = self.words[entity]
        if len(words) > len(official):
            return None
        table = [[alike(w, o) for o in official] for w in words]
        own = {official.index(w) for w in self.own[entity]}
        # Of equal official words the first free one is taken.
        before = [next((k for k in range(o - 1, -1, -1) if official[k] == w), None) for o, w in enumerate(official)]
        long_ = [len(w.rstrip(".")) >= 4 for w in words]
        # By word: for each set of official words taken, whether an identifying one is among them by a long word, and
        # whether the order was kept, the least sum of costs. What differs in nothing else is one state, so all orders of
        # any number of words are covered.
        states: dict[tuple[int, bool, int], int] = {(0, False, -1): 0}
        for w, row in enumerate(table):
            following: dict[tuple[int, bool, int], int] = {}
            for (taken, named, last), total in states.items():
                for o, c in enumerate(row):
                    if c is None or taken >> o & 1 or (before[o] is not None and not taken >> before[o] & 1):
                        continue
                    key = (taken | 1 << o, named or (o in own and long_[w]), o if last is not None and last < o else None)
                    if following.get(key, total + c + 1) > total + c:
                        following[key] = total + c
            states = following
            if not states:
                return None
        ends = [4 * total + 2 * (len(official) - len(words)) + (last is None) for (_, named, last), total in states.items() if named]
        return min(ends, default=None)

    def read(self, text: str) -> tuple[int, int] | None:
        """(cost, entity) of the entity a name in plain form means, or None; (cost, -1) if several fit equally well."""
        every = words_of_name(text)
        words = [w for w in every if w.rstrip(".") not in _BETWEEN]
        if not words:
            return None
        found = self._by_words(words) if len(words) <= self.most_words else {}
        if not found and len(words) <= self.most_words:  # a word written in two parts
            for k in range(len(words) - 1):
                joined = [*words[:k], words[k].rstrip(".") + words[k + 1], *words[k + 2 :]]
                if joined[k].rstrip(".") in self.by_own:
                    found = {i: c + 1 for i, c in self._by_words(joined).items()}
        if not found:  # a common word added to an identifying one that is written right
            bare = [w for w in words if w not in _ADDED]
            if bare and len(bare) < len(words) and any(w in self.by_own for w in bare):
                found = {i: c + 12 for i, c in self._by_words(bare).items()}
        if not found:
            whole = "".join(w.rstrip(".") for w in every)
            if len(whole) >= 8:
                stripped = whole
                for legal in ("eireli", "ltda", "sa", "me"):
                    if stripped.endswith(legal) and len(words) == 1 and stripped not in self.by_whole:
                        stripped = stripped[: -len(legal)]
                        break
                for w in {whole, stripped}:
                    for i in self.by_whole.get(w, ()):
                        found[i] = 1
                if not found and len(whole) <= self.longest_whole:
                    for near, d in self.wholes.near(whole, 2):
                        for i in self.by_whole[near]:
                            found[i] = min(found.get(i, 99), 1 + 8 * d)
        if not found and len(words) == 1:
            found = self._familiar(words[0].rstrip("."))
        if not found:
            return None
        least = min(found.values())
        best = [i for i, c in found.items() if c == least]
        return (least, best[0]) if len(best) == 1 else (least, -1)

    def _by_words(self, words: list[str]) -> dict[int, int]:
        return {i: c for i in self.candidates(words) if (c := self.cost(words, i)) is not None and (len(words) > 1 or c < 12)}

    def _familiar(self, word: str) -> dict[int, int]:
        """Entities by a nickname, the beginning of an identifying word, or initials."""
        stem = next((word[: -len(e)] for e in DIMINUTIVE if word.endswith(e) and len(word) - len(e) >= 4), word)
        if len(stem) >= 4 and (stem != word or len(word) >= 4):
            begun = self.trie.under(stem)
            if begun:
                return {i: 40 for w in begun for i in self.by_own[w]}
        if 2 <= len(word) <= 5:
            return dict.fromkeys(self.by_initials.get(word, ()), 60)
        return {}


def matched(names: DataFrame, official: DataFrame, shard: int = SHARD) -> DataFrame:
    """(spelled, company_id) of the distinct names (spelled) that mean an entity of official (company_id, name).

    The official names are sharded by hash into books of tries, as many as it
    takes to hold shard names each. A task reads a part of the spellings
    against one book; the best reading over all books holds, and words count
    as common by all official names, so the shards change no reading but one:
    a word near to words of two books is compared with both. A reading that two
    entities share counts for neither. Null, blank and foreign names mean
    nothing. The driver sees the number of official names and the words of more
    than COMMON of them, fewer than names / COMMON times the words of one.
    """
    known = official.where("name is not null and company_id is not null").select(F.col("company_id").cast("bigint").alias("company_id"), "name").dropDuplicates(["company_id"])
    shards = max(1, math.ceil(known.count() / shard))
    listed = known.repartition(shards).mapInArrow(_words_of, "word string").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > COMMON)
    common = {r["word"] for r in listed.collect()}
    cores = names.sparkSession.sparkContext.defaultParallelism
    # As many parts of the spellings as keep all cores busy; each needs a copy of the book it reads against.
    parts = max(1, math.ceil(2 * cores / shards))
    left = names.select("spelled", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("spelled"), F.lit(parts)).cast("int").alias("part"))
    right = known.select("company_id", "name", F.pmod(F.xxhash64("company_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        book = Book(list(zip(b.column("company_id").to_pylist(), b.column("name").to_pylist())), common)
        parts = [p for batch in a.to_batches() for p in _read(book, batch.column("spelled"), True)]
        return pa.Table.from_batches(parts, pa.schema([("spelled", pa.string()), ("cost", pa.int32()), ("company_id", pa.int64())]))

    # A number of partitions of our own: the adaptive plan would merge parts that are small in bytes but long to read.
    left, right = (x.repartition(shards * parts, "shard", "part") for x in (left, right))
    read = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(both, "spelled string, cost int, company_id bigint")
    if shards == 1:
        return read.where("company_id >= 0").select("spelled", "company_id")
    best = read.groupBy("spelled").agg(F.min("cost").alias("cost"))
    tied = read.join(best, ["spelled", "cost"]).groupBy("spelled").agg(F.min("company_id").alias("company_id"), F.count("*").alias("n"))
    return tied.where("n = 1 and company_id >= 0").select("spelled", "company_id")


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([w for n in batch.column("name").to_pylist() for w in set(counted_words(n))], pa.string())], ["word"])


def _read(book: Book, column: pa.Array, ties: bool) -> Iterator[pa.RecordBatch]:
    plain, _ = fold_column(column)
    got = [(i, r) for i, text in enumerate(plain.to_pylist()) if text and (r := book.read(text)) is not None and (ties or r[1] >= 0)]
    if got:
        at = pa.array([i for i, _ in got])
        yield pa.RecordBatch.from_arrays([column.take(at), pa.array([r[0] for _, r in got], pa.int32()), pa.array([r[1] for _, r in got], pa.int64())], ["spelled", "cost", "company_id"])


def linked(spellings: DataFrame, official: DataFrame) -> DataFrame:
    """(field, row_id, spelled, company_id) of the spellings (field, row_id, spelled) that mean an entity and are not
    byte for byte its name. Each distinct spelling is read once; a name in a third of all rows is one reading. Repeated
    rows give their rows again."""
    told = spellings.where("spelled is not null")
    readings = matched(told.select("spelled").distinct(), official)
    off = official.select(F.col("company_id").cast("bigint").alias("company_id"), F.col("name").alias("spelled")).distinct()
    return told.join(readings.join(off, ["company_id", "spelled"], "left_anti"), "spelled").select("field", "row_id", "spelled", "company_id")
