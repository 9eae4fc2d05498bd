"""Vectorised reading of timestamps written in many ways.

Every text becomes a shape mask, one character for each run of equal
characters (digits by their number, words by their meaning, signs as they
are). A distinct mask is matched to a parse plan once; the rows that share the
mask are then converted together with numpy, local times through transition
tables of their zones.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
import zoneinfo
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute

US = 1_000_000
DAY_S = 86_400

# Names of months in Portuguese, English and Spanish.
MONTHS = {
    1: "janeiro january enero jan ene",
    2: "fevereiro february febrero fev feb",
    3: "marco march marzo mar",
    4: "abril april abr apr",
    5: "maio may mayo mai",
    6: "junho june junio jun",
    7: "julho july julio jul",
    8: "agosto august ago aug",
    9: "setembro september septiembre setiembre set sep sept",
    10: "outubro october octubre out oct",
    11: "novembro november noviembre nov",
    12: "dezembro december diciembre dez dec dic",
}
# Zone abbreviations and their offsets in minutes.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "brt": -180, "brst": -120, "art": -180, "amt": -240, "act": -300, "fnt": -120, "clt": -240, "clst": -180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600,
}
# Units of an age, in seconds.
UNITS = {
    60: "minuto minutos minute minutes min mins",
    3600: "hora horas hour hours hr hrs h",
    DAY_S: "dia dias day days",
    7 * DAY_S: "semana semanas week weeks",
}
# Other words that carry meaning.
WEEKDAYS = (
    "mon tue wed thu fri sat sun monday tuesday wednesday thursday friday saturday sunday seg ter qua qui sex sab dom "
    "segunda terca quarta quinta sexta sabado domingo lun mie jue vie lunes martes miercoles jueves viernes"
)
BEFORE = "ha hace faz"
AFTER = "ago atras"
YESTERDAY = "ontem yesterday ayer"
TODAY = "hoje today hoy"
ONE = "um uma un una a an one"
LEADS = (
    "publicada publicado publicacao publicacion publicada postada postado posted published updated atualizada atualizado em "
    "el on de del do of as at ate prazo encerra limite until hasta deadline closes vence inscricoes"
)


def _words() -> dict[str, tuple[str, int]]:
    out: dict[str, tuple[str, int]] = {w: ("e", 0) for w in LEADS.split()}
    out |= {w: ("W", 0) for w in WEEKDAYS.split()}
    out |= {w: ("q", 1) for w in ONE.split()}
    out |= {w: ("U", s) for s, ws in UNITS.items() for w in ws.split()}
    out |= {w: ("M", m) for m, ws in MONTHS.items() for w in ws.split()}
    out |= {w: ("z", 60 * m) for w, m in ZONES.items()}
    out |= {w: ("B", 0) for w in BEFORE.split()} | {w: ("A", 0) for w in AFTER.split()}
    out |= {w: ("O", DAY_S) for w in YESTERDAY.split()} | {w: ("O", 0) for w in TODAY.split()}
    return out | {"t": ("T", 0), "am": ("P", 0), "pm": ("P", 12)}


WORDS = _words()

_DATE = r"(?:(?P<y>y)[-/.](?P<mo>d)[-/.](?P<da>d)|(?P<n1>d)[-/.](?P<n2>d)[-/.](?P<ny>y)|(?P<td>d)(?: e)?[ -](?P<tm>[MA])\.?,?(?: e)?[ -](?P<ty>y)|(?P<um>[MA])\.? (?P<ud>d),? (?P<uy>y)|(?P<ymd>D))"
_TIME = r"(?:(?P<h>d)(?::(?P<mi>d)(?::(?P<s>d)(?:[.,](?P<f>[dtyhDsmuxY]))?)?)?(?: ?(?P<ap>P))?|(?P<hms>[hy]))"
_ZONE = r"(?: ?(?P<z>z)| ?(?P<sg>[-+])(?:(?P<oh>d)(?::?(?P<om>d))?|(?P<ohm>y)))"
_NAME = r"(?P<name>\[.*\])"
ABSOLUTE = re.compile(rf"(?:[eW][:,]? ?)*{_DATE}(?:(?:T|,? e |,? ){_TIME}{_ZONE}?{_NAME}?)?")
STAMP = re.compile(rf"(?:[eW][:,]? ?)*(?P<stamp>Y){_ZONE}?{_NAME}?")
EPOCH = re.compile(r"(?P<epoch>[smu])")
AGE = re.compile(r"(?:e ?)*(?:B (?P<b>[dtyq]) (?P<bu>U)|(?P<a>[dtyq]) (?P<au>U) A|(?P<day>O))")


@lru_cache(maxsize=4096)
def plan_of(mask: str) -> tuple[str, dict[str, int]] | None:
    """The parse plan of a shape mask: its kind and the run that holds each part; None if it denotes no time."""
    for kind, form in (("absolute", ABSOLUTE), ("absolute", STAMP), ("epoch", EPOCH), ("age", AGE)):
        if found := form.fullmatch(mask):
            return kind, {k: found.start(k) for k, v in found.groupdict().items() if v is not None}
    return None


def tzdata_version() -> str:
    """The version of the zone data that the transition tables come from, or 'system'."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


# Weeks from 1970 back to 1850, before which no zone had a time of its own.
FIRST = -120 * 366 // 7


@lru_cache(maxsize=1024)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray]:
    """Local seconds from which the next offset holds, and the offsets, one more than the former.

    A local time before the end of a change counts with the offset before it:
    of a time that occurs twice this is the first, and a skipped one keeps it.
    An unknown zone counts as UTC.
    """
    try:
        tz = zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)

    def offset(at: int) -> int:
        return round((dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=at)).astimezone(tz).utcoffset().total_seconds())

    step = 7 * DAY_S
    edges, offsets = [], [offset(FIRST * step)]
    for at in range((FIRST + 1) * step, 131 * 366 * DAY_S, step):
        now = offset(at)
        if now != offsets[-1]:
            low, high = at - step, at
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == offsets[-1] else (low, mid)
            edges.append(high + max(offsets[-1], now))
            offsets.append(now)
    return np.array(edges, np.int64), np.array(offsets, np.int64)


def to_utc(local: np.ndarray, zone: str) -> np.ndarray:
    """Seconds of local time to seconds UTC."""
    edges, offsets = transitions(zone)
    return local - offsets[np.searchsorted(edges, local, side="right")]


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of proleptic Gregorian dates, and which dates exist."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + (leap & (m == 2))
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (d <= length) & (y >= 1) & (y <= 9999)
    yy = y - (m <= 2)
    era = yy // 400
    yoe = yy - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468, ok


# Character classes of bytes: 1 digit, 2 letter (all bytes of longer characters too), 3 space, and each sign its own.
_CLASS = np.arange(256, dtype=np.int64) + 16
_CLASS[[*range(48, 58)]] = 1
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 2
_CLASS[[9, 10, 13, 32]] = 3
# Digits of a run by their number: d 1-2, t 3, y 4, h 6, D 8, Y 14 (date and time), s epoch seconds, m milliseconds, u
# microseconds, x others.
_DIGITS = np.array(list("xddtyxhxDssxmmYxu") + ["x"] * 16)


def _plain(word: bytes) -> str:
    text = unicodedata.normalize("NFKD", word.decode("utf-8", "replace")).casefold()
    return "".join(c for c in text if not unicodedata.combining(c))


class Shapes:
    """The runs and shape masks of the texts of an Arrow column of binaries; a null is an empty text."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null(b"") if texts.null_count else texts
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if n else None
        flat = self.flat = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        lengths = np.diff(self.offsets)
        row = np.repeat(np.arange(n), lengths)
        cls = _CLASS[flat]
        first = np.ones(len(flat), bool)
        if len(flat):
            first[1:] = (cls[1:] != cls[:-1]) | (row[1:] != row[:-1]) | (cls[1:] > 15)
        self.start = np.flatnonzero(first)
        self.length = np.diff(np.append(self.start, len(flat)))
        kind, at = cls[self.start], row[self.start]
        self.value = np.zeros(len(self.start), np.int64)
        codes = np.full(len(self.start), " ", "<U1")
        digits = np.flatnonzero(kind == 1)
        codes[digits] = _DIGITS[np.minimum(self.length[digits], 32)]
        short = digits[self.length[digits] <= 18]
        for j in range(int(self.length[short].max(initial=0))):
            live = short[self.length[short] > j]
            self.value[live] = self.value[live] * 10 + flat[self.start[live] + j] - 48
        signs = kind > 15
        codes[signs] = np.array([chr(i) for i in range(256)])[flat[self.start[signs]]]
        self._words(np.flatnonzero(kind == 2), codes)
        bounds = np.searchsorted(at, np.arange(n + 1))
        joined, self.row_start = "".join(codes.tolist()), bounds[:-1]
        self.masks = [joined[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def text(self, i: int) -> bytes:
        return self.flat[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def _words(self, runs: np.ndarray, codes: np.ndarray) -> None:
        data = self.flat.tobytes()
        known: dict[bytes, tuple[str, int]] = {}
        meaning = []
        for s, n in zip(self.start[runs].tolist(), self.length[runs].tolist()):
            word = data[s : s + n]
            if word not in known:
                known[word] = WORDS.get(_plain(word), ("?", 0)) if n < 24 else ("?", 0)
            meaning.append(known[word])
        if meaning:
            codes[runs] = [m[0] for m in meaning]
            self.value[runs] = [m[1] for m in meaning]


def _stripped(column: pa.Array) -> pa.Array:
    """The column without white space at the ends of its values."""
    try:
        return pa.compute.ascii_trim_whitespace(column.cast(pa.string())).cast(pa.binary())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return pa.array([None if x is None else x.strip() for x in column.to_pylist()], pa.binary())


CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"


def parse(texts: pa.Array | list[bytes], zones: np.ndarray, day_first: np.ndarray, observed: np.ndarray, end_of_day: bool) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970 UTC of each text and which texts denote an instant.

    zones: the zone of each row that names none; day_first: the order of its
    numeric dates; observed: its reference time in seconds or a negative
    number; end_of_day: a date alone means its last second.
    """
    n = len(texts)
    out, ok = np.zeros(n, np.int64), np.zeros(n, bool)
    if not n:
        return out, ok
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
    shapes = Shapes(_stripped(column))
    groups: dict[str, list[int]] = {}
    for i, mask in enumerate(shapes.masks):
        groups.setdefault(mask, []).append(i)
    for mask, members in groups.items():
        plan = plan_of(mask)
        if plan is None:
            continue
        rows = np.array(members)
        kind, part = plan
        base = shapes.row_start[rows]

        def num(name: str, part=part, base=base) -> np.ndarray | None:
            return shapes.value[base + part[name]] if name in part else None

        if kind == "epoch":
            out[rows] = num("epoch") * {"s": US, "m": 1000, "u": 1}[mask]
            ok[rows] = True
        elif kind == "age":
            count = num("b") if "b" in part else num("a") if "a" in part else 1
            unit = num("bu") if "b" in part else num("au") if "a" in part else num("day")
            out[rows] = (observed[rows] - count * unit) * US
            ok[rows] = observed[rows] >= 0
        else:
            out[rows], ok[rows] = _absolute(shapes, mask, part, base, num, zones[rows], day_first[rows], end_of_day, rows)
    return out, ok


def _absolute(shapes, mask, part, base, num, zones, day_first, end_of_day, rows):
    if "ymd" in part:
        v = num("ymd")
        y, m, d = v // 10_000, v // 100 % 100, v % 100
    elif "stamp" in part:
        v = num("stamp") // 1_000_000
        y, m, d = v // 10_000, v // 100 % 100, v % 100
    elif "n1" in part:
        a, b, y = num("n1"), num("n2"), num("ny")
        m, d = np.where(day_first, b, a), np.where(day_first, a, b)
    else:
        at = "td" if "td" in part else "ud" if "ud" in part else None
        y, m, d = (num("y"), num("mo"), num("da")) if at is None else (num(at[0] + "y"), num(at[0] + "m"), num(at))
        if at and mask[part[at[0] + "m"]] == "A":  # the one word that is both a month and an age
            m = np.full(len(rows), 8)
    days, ok = days_from_civil(y, m, d)
    zero = np.zeros(len(rows), np.int64)
    timed = "h" in part or "hms" in part
    h, mi, s, us = zero, zero, zero, zero
    if "stamp" in part:
        v = num("stamp") % 1_000_000
        h, mi, s = v // 10_000, v // 100 % 100, v % 100
    elif "hms" in part:
        v = num("hms")
        h, mi, s = (v // 10_000, v // 100 % 100, v % 100) if mask[part["hms"]] == "h" else (v // 100, v % 100, zero)
    elif timed:
        h, mi, s = num("h"), num("mi") if "mi" in part else zero, num("s") if "s" in part else zero
        if "ap" in part:
            ok &= (h >= 1) & (h <= 12)
            h = h % 12 + num("ap")
        if "f" in part:
            size = shapes.length[base + part["f"]]
            us = np.where(size <= 6, num("f") * 10 ** np.clip(6 - size, 0, 6), num("f") // 10 ** np.clip(size - 6, 0, 12))
            ok &= size <= 18
    elif end_of_day:
        h, mi, s = zero + 23, zero + 59, zero + 59
    ok &= (h < 24) & (mi < 60) & (s < 60)
    local = days * DAY_S + h * 3600 + mi * 60 + s
    if "z" in part:
        utc = local - num("z")
    elif "sg" in part:
        sign = np.where(shapes.flat[shapes.start[base + part["sg"]]] == ord("-"), -1, 1)
        v = num("ohm") if "ohm" in part else num("oh") * 100 + (num("om") if "om" in part else 0)
        ok &= (v // 100 <= 18) & (v % 100 < 60)
        utc = local - sign * (v // 100 * 3600 + v % 100 * 60)
    else:
        if "name" in part:
            zones = np.array([shapes.text(i).rpartition(b"[")[2].rstrip(b"]").decode("utf-8", "replace") for i in rows], object)
        utc = local.copy()
        for zone in set(zones.tolist()):
            mine = zones == zone
            utc[mine] = to_utc(local[mine], zone)
    return utc * US + us, ok
