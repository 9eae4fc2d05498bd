"""One consistent form for text that looks the same but is stored in different characters (p3).

Arrow text is copied to one numpy array of code points per batch. Lookup-table
gathers give each code point its expansion (compatibility form, ordinary space
or hyphen, nothing for an invisible character), look-alike letters are decided
word by word with segmented reductions, marks are put in canonical order with
one stable sort and composed in vector rounds. No row is touched by a string
call of its own.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "H", "Ӏ": "I", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ү": "y", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "г": "r", "п": "n",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "հ": "h", "յ": "j", "ո": "n", "օ": "o", "ս": "u", "ց": "g", "զ": "q", "Տ": "S", "Օ": "O",
}
# Ranges of scripts whose letters are decided as look-alikes.
OTHER_SCRIPTS = [(0x370, 0x400), (0x400, 0x530), (0x531, 0x590), (0x1F00, 0x2000)]
# Hyphens other than the ordinary one. Dashes, the minus sign too, are other signs and stay.
HYPHENS = "‐‑­֊﹣－"
# Invisible characters that are not of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"
JOINER, SELECTORS, TAGS = 0x200D, (0xFE00, 0xFE10), (0xE0020, 0xE0080)
# Tables hold the code points below LIMIT one by one. Above lie letters of further planes, one block of format characters
# and selectors, and code points for private use or none; places() maps all of them to slots behind LIMIT.
LIMIT, SPECIAL = 0x30000, (0xE0000, 0xE1000)
LETTER_SLOT, PRIVATE_SLOT, SPECIAL_SLOT = LIMIT, LIMIT + 1, LIMIT + 2
SLOTS = SPECIAL_SLOT + SPECIAL[1] - SPECIAL[0]


def places(cps: np.ndarray) -> np.ndarray:
    """The place of each code point in the tables."""
    if not len(cps) or int(cps.max()) < LIMIT:
        return cps
    special = (cps >= SPECIAL[0]) & (cps < SPECIAL[1])
    letter = (cps >= LIMIT) & (cps < 0x40000)
    return np.where(cps < LIMIT, cps, np.where(special, cps - np.uint32(SPECIAL[0] - SPECIAL_SLOT), np.where(letter, LETTER_SLOT, PRIVATE_SLOT))).astype(np.uint32)
LATIN, OTHER = 1, 2
WORD, MARK, ODD, LETTER_BITS = 1 << 31, 1 << 30, 1 << 29, (1 << 21) - 1


class Tables:
    """Lookup tables by code point, made once a process from the Unicode data of Python.

    info packs what most texts need into one gather: the folded base letter, and the bits WORD, MARK and ODD (not plain)."""

    def __init__(self) -> None:
        n = SLOTS
        self.size, self.first = np.ones(n, np.int16), np.full(n, -1, np.int64)
        self.ccc, self.script = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        self.letter, self.emoji, self.plain = np.zeros(n, bool), np.zeros(n, bool), np.ones(n, bool)
        self.twin, self.base = np.zeros(n, np.uint32), np.arange(n, dtype=np.uint32)
        self.word = np.zeros(n, bool)
        self.letter[LETTER_SLOT] = self.word[LETTER_SLOT] = True
        for cp in range(*SPECIAL):  # tags, selectors and what is reserved for such: invisible, all of them
            self.size[cp - SPECIAL[0] + SPECIAL_SLOT], self.plain[cp - SPECIAL[0] + SPECIAL_SLOT] = 0, False
        data: list[int] = []
        pairs: dict[int, int] = {}
        for cp in range(LIMIT):
            if 0xD800 <= cp < 0xE000 or 0x3400 < cp < 0x9FFF or 0x20000 <= cp < 0x2F800 or 0xE000 <= cp < 0xF900:
                self.letter[cp] = self.word[cp] = not (0xD800 <= cp < 0xE000 or 0xE000 <= cp < 0xF900)
                self.first[cp] = -1
                continue
            ch = chr(cp)
            kind = unicodedata.category(ch)
            self.ccc[cp] = unicodedata.combining(ch)
            self.letter[cp], self.emoji[cp] = kind[0] == "L", kind in ("So", "Sk") and cp > 0x2000
            self.word[cp] = kind[0] == "L" or kind == "Nd"
            full = unicodedata.normalize("NFKD", ch)
            if ch in HYPHENS and ch != "­":
                full = "-"
            elif kind == "Zs":
                full = " "
            elif kind == "Cf" or ch in INVISIBLE or SELECTORS[0] <= cp < SELECTORS[1]:
                full = ""
            self.size[cp], self.first[cp] = len(full), -1
            if full != ch:
                self.first[cp] = len(data)
                data.extend(map(ord, full))
            self.plain[cp] = unicodedata.normalize("NFC", full) == ch and not unicodedata.combining(ch)
            canonical = unicodedata.normalize("NFD", ch)
            if len(canonical) > 1 and unicodedata.normalize("NFC", ch) == ch:
                head = unicodedata.normalize("NFC", canonical[:-1])
                if len(head) == 1:
                    pairs[ord(head) << 21 | ord(canonical[-1])] = cp
        for lead in range(19):  # Hangul composes by rule
            for vowel in range(21):
                pairs[(0x1100 + lead) << 21 | (0x1161 + vowel)] = 0xAC00 + (lead * 21 + vowel) * 28
                for tail in range(1, 28):
                    pairs[(0xAC00 + (lead * 21 + vowel) * 28) << 21 | (0x11A7 + tail)] = 0xAC00 + (lead * 21 + vowel) * 28 + tail
        for low, high in OTHER_SCRIPTS:
            self.script[low:high] = np.where(self.letter[low:high], OTHER, 0)
            self.plain[low:high] &= ~self.letter[low:high]
        for low, high in ((0x41, 0x5B), (0x61, 0x7B), (0xAA, 0x250), (0x1E00, 0x1F00)):
            self.script[low:high] = np.where(self.letter[low:high], LATIN, 0)
        for other, latin in LOOKALIKES.items():
            self.twin[ord(other)] = ord(latin)
        self.plain[[k & ((1 << 21) - 1) for k in pairs]] = False  # what may compose with what stands before it
        self.data = np.array(data, np.uint32)
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        for cp in range(0x41, 0x2000):  # folded base letter: no case, no accent; what folds to several letters keeps the first
            flat = [c for c in unicodedata.normalize("NFKD", chr(cp)).casefold() if not unicodedata.combining(c)]
            if flat:
                self.base[cp] = ord(flat[0])
        self.info = self.base | np.where(self.word, WORD, 0).astype(np.uint32) | np.where(self.ccc > 0, MARK, 0).astype(np.uint32) | np.where(self.plain, 0, ODD).astype(np.uint32)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all values together and the first position of each row, one more than there are rows. A null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    octets = raw.to_pybytes()[int(offsets[0]) : int(offsets[-1])] if raw is not None else b""
    cps = np.frombuffer(octets.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(pa.compute.utf8_length(column).to_numpy(zero_copy_only=False), out=bounds[1:])
    return cps, bounds


def info_of(cps: np.ndarray) -> np.ndarray:
    """The packed properties of code points."""
    return tables().info[places(cps)]


def to_arrow(cps: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The inverse of code_points()."""
    width = np.where(cps < 0x80, 1, np.where(cps < 0x800, 2, np.where(cps < 0x10000, 3, 4)))
    ends = np.concatenate([[0], np.cumsum(width)])[bounds].astype(np.int64)
    octets = cps.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(octets)).cast(pa.string())


def _rows(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _bounds(rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(rows, np.arange(n + 1))


def plain_form(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The plain form of every row: NFKC, no invisible characters, ordinary spaces and hyphens, and Latin letters for
    look-alikes in Latin text. Rows already plain are copied; the work falls on the others."""
    t = tables()
    odd = (info_of(cps) & ODD) > 0
    if not odd.any():
        return cps, bounds
    suspect = np.zeros(len(bounds) - 1, bool)
    suspect[np.searchsorted(bounds, np.flatnonzero(odd), side="right") - 1] = True
    n, row = len(suspect), _rows(bounds)
    mine = suspect[row]
    renumber = np.cumsum(suspect) - 1
    done, own = _transform(cps[mine], renumber[row[mine]], int(suspect.sum()), t)
    number = np.flatnonzero(suspect)
    rows = np.concatenate([row[~mine], number[own]])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([cps[~mine], done])[order], _bounds(rows[order], n)


def _transform(cps: np.ndarray, row: np.ndarray, n: int, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    at = places(cps)
    size = t.size[at].astype(np.int64)
    # A joiner or selector that belongs to an emoji is part of it.
    part = (cps == JOINER) | ((cps >= SELECTORS[0]) & (cps < SELECTORS[1])) | ((cps >= TAGS[0]) & (cps < TAGS[1]))
    if part.any():
        k = np.flatnonzero(part)
        owner = np.maximum.accumulate(np.where(part, -1, np.arange(len(cps))))[k]
        size[k[(owner >= 0) & (row[owner] == row[k]) & t.emoji[at[owner]]]] = 1
    keep_self = (t.first[at] < 0) | (part & (size == 1))
    total = int(size.sum())
    source = np.repeat(np.arange(len(cps)), size)
    within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    out = cps[source].copy()
    moved = ~keep_self[source]
    out[moved] = t.data[t.first[at[source[moved]]] + within[moved]]
    row = row[source]
    out = _latin(out, row, n, t)
    out, row = _reorder(out, row, t)
    return _compose(out, row, t)


def _latin(cps: np.ndarray, row: np.ndarray, n: int, t: Tables) -> np.ndarray:
    """Look-alikes to Latin letters. A word with a Latin letter is Latin text; so is a word of nothing but look-alikes of
    two scripts, or in a value that has Latin letters elsewhere. A word wholly in another script stays."""
    at = places(cps)
    script = t.script[at]
    if not (script == OTHER).any():
        return cps
    inside = t.letter[at] | (t.ccc[at] > 0)
    edge = np.ones(len(cps), bool)
    edge[1:] = (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
    word = np.cumsum(edge) - 1
    count = lambda flags, by, size: np.bincount(by[flags], minlength=size)
    words = int(word[-1]) + 1
    greek, cyrillic = (script == OTHER) & (cps < 0x400), (script == OTHER) & (cps >= 0x400) & (cps < 0x530)
    latin, other = count(script == LATIN, word, words) > 0, count(script == OTHER, word, words)
    alike = count((script == OTHER) & (t.twin[at] > 0), word, words)
    mixed = (count(greek, word, words) > 0) & (count(cyrillic, word, words) > 0)
    row_of = row[np.flatnonzero(edge)]
    row_latin = np.zeros(n, bool)
    row_latin[row_of[latin]] = True
    row_latin[row_of[mixed & (alike == other)]] = True
    turned = (other > 0) & (latin | ((alike == other) & (mixed | row_latin[row_of])))
    change = turned[word] & (t.twin[at] > 0)
    out = cps.copy()
    out[change] = t.twin[at[change]]
    return out


def _reorder(cps: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    ccc = t.ccc[places(cps)]
    if not ccc.any():
        return cps, row
    start = (ccc == 0) | np.concatenate([[True], row[1:] != row[:-1]])
    order = np.lexsort((ccc, np.cumsum(start)))
    return cps[order], row[order]


def _pairs(a: np.ndarray, b: np.ndarray, t: Tables) -> np.ndarray:
    key = a.astype(np.int64) << 21 | b.astype(np.int64)
    at = np.minimum(np.searchsorted(t.pair_key, key), len(t.pair_key) - 1)
    return np.where(t.pair_key[at] == key, t.pair_to[at], 0)


def _compose(cps: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    if not len(cps):
        return cps, row
    out = cps.copy()
    ccc = t.ccc[places(out)].astype(np.int64)
    starter = ccc == 0
    head = np.maximum.accumulate(np.where(starter, np.arange(len(out)), -1))
    gone = np.zeros(len(out), bool)
    marks = np.flatnonzero(~starter & (head >= 0))
    marks = marks[row[head[marks]] == row[marks]]
    if len(marks):  # round k takes the k-th mark after each starter
        turn, last = marks - head[marks], np.zeros(len(out), np.int64)
        by_turn = marks[np.argsort(turn, kind="stable")]
        cuts = np.flatnonzero(np.diff(np.sort(turn))) + 1
        for now in np.split(by_turn, cuts):
            h = head[now]
            to = np.where(last[h] < ccc[now], _pairs(out[h], out[now], t), 0)
            hit = to > 0
            out[h[hit]], gone[now[hit]] = to[hit], True
            last[h[~hit]] = ccc[now[~hit]]
    out, row = out[~gone], row[~gone]
    while True:  # starters that compose with the starter before them, as Hangul does
        ccc = t.ccc[places(out)]
        to = np.where((row[1:] == row[:-1]) & (ccc[1:] == 0) & (ccc[:-1] == 0), _pairs(out[:-1], out[1:], t), 0)
        hit = np.flatnonzero(to)
        if not len(hit):
            return out, row
        hit = hit[np.concatenate([[True], np.diff(hit) > 1])]
        out[hit] = to[hit]
        kept = np.ones(len(out), bool)
        kept[hit + 1] = False
        out, row = out[kept], row[kept]


def fold_column(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The plain form of an Arrow string column, nulls kept, and which values change."""
    cps, bounds = code_points(column)
    out, ends = plain_form(cps, bounds)
    if out is cps:
        return column, np.zeros(len(column), bool)
    changed = np.diff(ends) != np.diff(bounds)
    same = np.flatnonzero(~changed)
    row_a, row_b = _rows(bounds), _rows(ends)
    keep = np.zeros(len(changed), bool)
    keep[same] = True
    a, b = cps[keep[row_a]], out[keep[row_b]]
    changed[row_a[keep[row_a]][a != b]] = True
    text = to_arrow(out, ends)
    if column.null_count:
        text = pa.compute.if_else(column.is_valid(), text, pa.scalar(None, pa.string()))
    return text, changed


def consistent(rows: DataFrame, row_id: str, fields: list[str], changed_only: bool = False) -> DataFrame:
    """One row (row_id, field, plain, changed) for each value of the fields; only changed values if so wished.

    A null gives no row, an empty text is plain. Values equal but for their
    characters get equal plain forms. Other columns are not read; repeated rows
    give their rows again. One scan, no shuffle.
    """
    own = rows.select(F.col(row_id).cast("bigint").alias("row_id"), *[F.col(f).cast("string").alias(f"v{i}") for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(fields):
                column = batch.column(f"v{i}")
                text, changed = fold_column(column)
                kept = changed if changed_only else column.is_valid().to_numpy(zero_copy_only=False)
                picked = pa.array(np.flatnonzero(kept))
                if len(picked):
                    yield pa.RecordBatch.from_arrays([batch.column("row_id").take(picked), pa.array([name] * len(picked)), text.take(picked), pa.array(changed).take(picked)], ["row_id", "field", "plain", "changed"])

    return own.mapInArrow(run, "row_id bigint, field string, plain string, changed boolean")


assert sys.byteorder == "little"
