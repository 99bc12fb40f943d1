"""Main text of web pages by consensus host paths.

1. Every page is parsed once; its containers (article, main, section, div, td, body) are scored by running text
   against all text, links counting against them. A page votes for the generalised tag-class path of its best.
2. Votes are counted by host and path in Spark; each host's path with most votes wins.
3. Every page is read again with its host's winning path; a page without such a container (or without a host)
   keeps its own best one.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are known by tag,
role, or the words of class and id; the rest of the container is kept block by block, nothing capped.

Defined results: null or empty html, or a page without text: empty text; references are decoded once; white
space of a block becomes one space; blocks are joined by a line feed in page order; unclosed and stray tags are
tolerated; repeated rows are treated alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablevec.llm.common import pieces
from sablevec.session import materialise

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe|object|select)\b(?>[^>"']|"[^"]*"|'[^']*'|["'])*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>"[^"<>]*"|'[^'<>]*'|"[^"]*"|'[^']*'|[^>"'])*)/?>|<[!?][^>]*>|</[^a-zA-Z][^>]*>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("article main section div td body".split())
_SAFE = frozenset(("html", "body", "article", "main"))
_OUT = frozenset("nav footer aside form button dialog menu head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of a class or id that mark what isn't the article.
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsbygoogle sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup popup modal overlay sidebar rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar "
    "comment comments disqus respond reply replies discussion share sharing social related recommended recommendations pagination pager login search skip copyright legal disclaimer".split()
)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Tags that end an open one of their kind.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOOST = {"article": 2.0, "main": 1.5, "body": 0.5}


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(source)} if source and not source.isspace() else {}


def _outside(tag: str, a: dict[str, str], in_article: bool) -> bool:
    """Whether an element isn't part of an article."""
    if tag in _OUT or tag == "header" and not in_article:
        return True
    if tag in _SAFE:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in _ROLES:
        return True
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = _SPLIT.split(_CAMEL.sub("-", name).lower())
        if words[0] in ("no", "has", "with", "without"):
            continue
        if not _WORDS.isdisjoint(words) or "header" in words and not in_article:
            return True
    return False


def _step(tag: str, a: dict[str, str]) -> str:
    """A tag with its classes, digits taken out."""
    names = sorted({re.sub(r"[0-9]+", "", c.lower()) for c in a.get("class", "").split()} - {""})
    return ".".join([tag, *names])


class Page:
    """Blocks of a page, and its containers as (path, first block, end, depth, tag)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int]] = []  # text and how much of it is in links
        self.containers: list[tuple[str, int, int, int, str]] = []
        stack: list[tuple] = [("", "", 0, False, False)]  # tag, path, first block, outside, in article
        text: list[str] = []
        linked = link = 0
        pos = 0

        def flush() -> None:
            nonlocal linked
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    self.blocks.append((joined, linked))
                text.clear()
            linked = 0

        def close(upto: int) -> None:
            while len(stack) > upto:
                tag, path, first, out, _ = stack.pop()
                if tag in _CONTAINER and not out:
                    self.containers.append((path, first, len(self.blocks), len(stack), tag))

        for m in _TOKEN.finditer(source):
            if m.start() > pos and not stack[-1][3]:
                piece = source[pos : m.start()]
                piece = html.unescape(piece) if "&" in piece else piece
                text.append(piece)
                if link:
                    linked += len(piece)
            pos = m.end()
            if not m[3]:
                continue
            tag = m[3].lower()
            if tag == "br":
                text.append(" ")
                continue
            if tag == "a":
                link = 0 if m[2] else 1
                continue
            if tag in _BLOCK:
                flush()
            elif m[2] or tag in _VOID or not m[4] or m[4].isspace():
                if not m[2]:
                    continue
                if stack[-1][0] != tag:
                    if not any(x[0] == tag for x in stack[1:]):
                        continue
            if m[2]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                continue
            if tag in _VOID:
                continue
            if tag == "p":
                continue  # a paragraph holds no container; its tags only part blocks
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _ENDS.get(tag, ()):
                    close(i)
                elif stack[i][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "td") or tag not in _ENDS:
                    break
            a = _attributes(m[4])
            up = stack[-1]
            in_article = up[4] or tag in ("article", "main") or a.get("role") == "main"
            out = up[3] or _outside(tag, a, up[4])
            if tag not in _BLOCK and not out:
                continue
            stack.append((tag, f"{up[1]}/{_step(tag, a)}" if tag not in ("html",) else "", len(self.blocks), out, in_article))
            if tag in ("body", "html"):
                link = 0
        if not stack[-1][3] and pos < len(source):
            rest = source[pos:]
            cut = rest.rfind("<")  # a tag that the page ends in
            rest = rest[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z]", rest[cut:]) else rest
            text.append(html.unescape(rest))
        flush()
        close(1)
        self.containers.append(("", 0, len(self.blocks), 0, "body"))

    def scored(self) -> list[tuple[float, int, int]]:
        """(score, depth, number) of the containers with text."""
        run, total = [0], [0]
        for text, linked in self.blocks:
            run.append(run[-1] + max(0, len(text) - 2 * linked))
            total.append(total[-1] + len(text))
        out = []
        for i, (_, first, end, depth, tag) in enumerate(self.containers):
            w, t = run[end] - run[first], total[end] - total[first]
            if t:
                out.append((w * w / t * _BOOST.get(tag, 1.0), depth, i))
        return out

    def best(self, path: str | None = None) -> int | None:
        scored = self.scored()
        wanted = [x for x in scored if path is not None and self.containers[x[2]][0] == path]
        return max(wanted or scored, key=lambda x: (x[0], x[1], -x[2]))[2] if scored else None

    def text(self, path: str | None = None) -> str:
        i = self.best(path)
        return "" if i is None else "\n".join(t for t, _ in self.blocks[self.containers[i][1] : self.containers[i][2]])


def _host(url: str) -> str:
    return rf"nullif(regexp_extract(lower({url}), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')"


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "t"):
            hosts, paths = [], []
            for host, source in zip(part.column("host").to_pylist(), part.column("t").to_pylist(), strict=True):
                page = Page(source or "")
                i = page.best()
                if i is not None:
                    hosts.append(host)
                    paths.append(page.containers[i][0])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "path"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "t"):
            out = [Page(source or "").text(path) for source, path in zip(part.column("t").to_pylist(), part.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["k", "url", "text", "n_chars"])


def consensus(pages: DataFrame, source: str = "html", url: str = "url") -> DataFrame:
    """(host, path): each host's winning path."""
    named = pages.select(F.expr(_host(f"`{url}`")).alias("host"), F.col(f"`{source}`").alias("t")).where("host is not null")
    votes = named.mapInArrow(_vote, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("n"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("n", "path")).alias("path"))


def extract(pages: DataFrame, key: str = "page_id", source: str = "html", url: str = "url", broadcast_rows: int = 100_000) -> DataFrame:
    """``key``, url, the main text and its length."""
    paths = materialise(consensus(pages, source, url), "paths")
    if paths.count() <= broadcast_rows:
        paths = F.broadcast(paths)
    named = pages.select(F.col(f"`{key}`").alias("k"), F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("t"), F.expr(_host(f"`{url}`")).alias("at"))
    joined = named.join(paths, F.col("at") == F.col("host"), "left").select("k", "url", "t", "path")
    kind = joined.schema["k"].dataType.simpleString()
    return joined.mapInArrow(_read, f"k {kind}, url string, text string, n_chars bigint").withColumnRenamed("k", key)
