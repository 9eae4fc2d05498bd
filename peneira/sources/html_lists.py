"""Landed HTML pages to records: list pages by configured selectors, detail pages by their structured data."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.text import fold

# Elements without an end, elements whose text isn't shown, elements that break words.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = set("head script style template noscript".split())


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    parent: "Node | None" = None
    children: list["Node | str"] = field(default_factory=list)

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        """The visible text below, spaces collapsed."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in HIDDEN and "hidden" not in node.attributes and "display:none" not in node.attributes.get("style", "").replace(" ", ""):
                stack.extend(reversed(node.children))
        return " ".join(" ".join(out).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag, attrs):  # noqa: ANN001
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):  # noqa: ANN001
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):  # noqa: ANN001
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    """The element tree of a page; broken markup gives what can be read."""
    parser = _Tree()
    parser.feed(html or "")
    return parser.root


_PART = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^$]?=)[\"']?([^\"'\]]*)[\"']?)?\]")


def _fits(node: Node, simple: str) -> bool:
    for tag, id_, class_, name, sign, value in _PART.findall(simple):
        own = node.attributes.get(name)
        tests = {"=": lambda: own == value, "*=": lambda: value in own, "^=": lambda: own.startswith(value), "$=": lambda: own.endswith(value), "": lambda: True}
        if (
            tag and tag not in ("*", node.tag) or id_ and node.attributes.get("id") != id_
            or class_ and class_ not in node.attributes.get("class", "").split() or name and (own is None or not tests[sign]())
        ):
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Nodes of a selector: tags, ids, classes, attributes, descendants and alternatives."""
    out = []
    ways = [s.split() for s in selector.split(",") if s.strip()]
    for node in root.walk():
        for parts in ways:
            at, left = node.parent, parts[:-1]
            if not _fits(node, parts[-1]):
                continue
            while left and at is not None:
                if _fits(at, left[-1]):
                    left = left[:-1]
                at = at.parent
            if not left:
                out.append(node)
                break
    return out


def value(root: Node, selector: str | None) -> str | None:
    """The text of the first node, or with ::attr(name) its attribute; null if there is none."""
    if not selector:
        return None
    plain, _, what = selector.partition("::")
    found = select(root, plain) if plain.strip() else [root]
    if not found:
        return None
    name = re.fullmatch(r"attr\(([\w-]+)\)", what)  # ::all is the text of the whole card
    got = found[0].attributes.get(name[1]) if name else found[0].text()
    return got.strip() or None if got else None


LIST_SCHEMA = "url string, pos int, source_job_id string, title string, link string, company string, location string, summary string, next string, status string"


def list_records(pages: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """Cards of list pages (url, html) by selectors card, title, url, and where given id, company, location, summary, next, empty.

    One row per card with a title and an address; a page without any gives one
    row that tells NO_RESULTS, if the page says so, or LAYOUT_CHANGED. A null
    page is an empty one. Pages are parsed where they lie, one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = LIST_SCHEMA.replace(" string", "").replace(" int", "").split(", ")
        kinds = [pa.int32() if n == "pos" else pa.string() for n in names]
        for batch in batches:
            out: list[tuple] = []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                root = tree(html)
                more = value(root, selectors.get("next"))
                more = urljoin(url or "", more) if more else None
                before = len(out)
                for pos, card in enumerate(select(root, selectors["card"])):
                    title, link = value(card, selectors["title"]), value(card, selectors["url"])
                    if title and link:
                        out.append((url, pos, value(card, selectors.get("id")), title, urljoin(url or "", link), *[value(card, selectors.get(k)) for k in ("company", "location", "summary")], more, "OK"))
                if len(out) == before:
                    said = bool(selectors.get("empty")) and bool(select(root, selectors["empty"]))
                    out.append((url, None, *[None] * 6, more, "NO_RESULTS" if said else "LAYOUT_CHANGED"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return pages.select("url", "html").mapInArrow(run, LIST_SCHEMA)


def _postings(node: object) -> Iterator[dict]:
    stack = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, list):
            stack.extend(reversed(at))
        elif isinstance(at, dict):
            kinds = at.get("@type")
            if "JobPosting" in (kinds if isinstance(kinds, list) else [kinds]):
                yield at
            stack.append(at.get("@graph"))


def detail(html: str | None) -> dict[str, str | None]:
    """What a detail page states: by JSON-LD, else by its meta tags, else by its first time element."""
    out: dict[str, str | None] = dict.fromkeys(("published", "deadline", "company", "text"))
    root = tree(html)
    for script in select(root, 'script[type="application/ld+json"]'):
        try:
            data = json.loads("".join(c for c in script.children if isinstance(c, str)))
        except ValueError:
            continue
        for job in _postings(data):
            organization = job.get("hiringOrganization")
            found = {"published": job.get("datePosted"), "deadline": job.get("validThrough"), "company": organization.get("name") if isinstance(organization, dict) else organization}
            out |= {k: v for k, v in found.items() if isinstance(v, str) and v and not out[k]}
    for name in ("article:published_time", "datePublished", "date"):
        for meta in select(root, "meta"):
            if name in (meta.attributes.get("property"), meta.attributes.get("name"), meta.attributes.get("itemprop")):
                out["published"] = out["published"] or meta.attributes.get("content") or None
    times = select(root, "time[datetime]")
    out["published"] = out["published"] or (times[0].attributes["datetime"] if times else None)
    main = " ".join(n.text() for n in select(root, "main, article"))
    out["text"] = (main if len(main) >= 200 else root.text()) or None
    return out


def details(pages: DataFrame) -> DataFrame:
    """(url, published, deadline, company, text) of detail pages (url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [detail(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("url"), *[pa.array([g[k] for g in got], pa.string()) for k in ("published", "deadline", "company", "text")]], ["url", "published", "deadline", "company", "text"])

    return pages.select("url", "html").mapInArrow(run, "url string, published string, deadline string, company string, text string")


# Signs of a blocked page in the order in which they count: the reason, where it is read from, the pattern.
BLOCKS = [
    ("RATE_LIMITED", "status", "^429$"),
    ("ACCESS_DENIED", "status", "^40[13]$"),
    ("LOGIN_REQUIRED", "path", "/(login|signin|sign-in|auth)(/|$)"),
    ("CAPTCHA", "text", "captcha para continuar|complete o captcha|nao sou um robo|i am not a robot"),
    ("TWO_FACTOR", "text", "codigo de verificacao em duas etapas|autenticacao de dois fatores|two-factor authentication"),
    ("ACTIVITY_ALERT", "text", "atividade incomum|atividade suspeita|unusual activity|suspicious activity"),
    ("TWO_FACTOR", "text", "(?<![a-z0-9])2fa(?![a-z0-9])"),
]


def block_reason(status: Column, url: Column, text: Column) -> Column:
    """Why a landed response is no page, by the first sign of BLOCKS it shows; null if it shows none."""
    read = {"status": status.cast("string"), "path": F.lower(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)), "text": fold(text)}
    return F.coalesce(*[F.when(read[where].rlike(pattern), F.lit(reason)) for reason, where, pattern in BLOCKS])


def job_id(url: Column) -> Column:
    """The job id of an address: a UUID in it, else the parameters jk, jobId or job_id, else the last part of the path."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    named = F.regexp_extract(url, r"[?&](?:jk|jobId|job_id)=([^&#]+)", 1)
    uuid = F.regexp_extract(url, r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1)
    last = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(*[F.when(c != "", c) for c in (uuid, named, last)])
