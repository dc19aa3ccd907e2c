"""HTML inside tasks: visual references, blocks, structure. One parse a page, Arrow batches in and out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

# Attributes that refer to something seen, and what each is called.
VISUAL = {
    ("img", "src"): "image", ("source", "src"): "source", ("video", "src"): "video", ("video", "poster"): "poster",
    ("audio", "src"): "audio", ("track", "src"): "track", ("embed", "src"): "embed", ("object", "data"): "object",
    ("iframe", "src"): "frame", ("input", "src"): "input", ("image", "href"): "svg-image", ("use", "href"): "svg-use",
    ("link", "href"): "stylesheet",
}
SKIPPED = {"script", "style", "nav", "footer", "aside", "noscript", "template"}
BLOCKS = {"p", "li", "blockquote", "td", "th", "pre", "dd", "dt", "figcaption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CSS_URL = re.compile(r"url\(\s*['\"]?([^'\")]+)['\"]?\s*\)")


class _Page(HTMLParser):
    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.visuals, self.blocks, self.links = url, [], [], []
        self.headings: list[tuple[int, str]] = []
        self._skip, self._kind, self._text = 0, None, []
        self.tables = self.references = 0

    def _visual(self, kind: str, ref: str) -> None:
        if ref and not ref.startswith("data:"):
            self.visuals.append((kind, urljoin(self.url, ref.strip())))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = {k: v or "" for k, v in attrs}
        for k, v in named.items():
            if (tag, k) in VISUAL and (tag != "link" or "stylesheet" in named.get("rel", "")):
                self._visual(VISUAL[tag, k], v)
            if k == "srcset":
                for part in v.split(","):
                    if part.split():
                        self._visual("srcset", part.split()[0])
            if k == "style":
                for ref in _CSS_URL.findall(v):
                    self._visual("css", ref)
        if tag in SKIPPED:
            self._skip += 1
        self.tables += tag == "table"
        self.references += "reference" in named.get("class", "").split()
        if tag == "a" and named.get("href") and not self._skip:
            self.links.append(urljoin(self.url, named["href"]))
        if tag in BLOCKS or tag in HEADINGS:
            self._close()
            self._kind = tag

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self._skip = max(0, self._skip - 1)
        if tag == self._kind:
            self._close()

    def handle_data(self, data: str) -> None:
        if self._kind and not self._skip:
            self._text.append(data)

    def _close(self) -> None:
        text = " ".join("".join(self._text).split())
        if self._kind and text:
            if self._kind in HEADINGS:
                self.headings.append((int(self._kind[1]), text))
            path = [t for n, (level, t) in enumerate(self.headings) if all(lv > level for lv, _ in self.headings[n + 1 :])]
            self.blocks.append((self._kind, " > ".join(path), text))
        self._kind, self._text = None, []


def parse(html: str | None, url: str | None) -> _Page:
    page = _Page(url or "")
    page.feed(html or "")
    page.close()
    page._close()
    return page


def visual_inventory(pages: DataFrame) -> DataFrame:
    """(page_id, kind, url): every distinct visual reference of each page (page_id, url, html), resolved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, u) for i, url, html in zip(b.page_id, b.url, b.html) for k, u in sorted(set(parse(html, url).visuals))]
            yield pd.DataFrame(rows, columns=["page_id", "kind", "url"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, kind string, url string")


def extract_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, kind, heading_path, text): text blocks in document order; scripts and navigation are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, *block) for i, url, html in zip(b.page_id, b.url, b.html) for n, block in enumerate(parse(html, url).blocks)]
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "kind", "heading_path", "text"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, ordinal int, kind string, heading_path string, text string")


def summarize(pages: DataFrame) -> DataFrame:
    """(page_id, headings, blocks, tables, links, references, visuals): counts of each page's structure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, url, html in zip(b.page_id, b.url, b.html):
                p = parse(html, url)
                rows.append((i, len(p.headings), len(p.blocks), p.tables, len(set(p.links)), p.references, len(set(p.visuals))))
            yield pd.DataFrame(rows, columns=["page_id", "headings", "blocks", "tables", "links", "references", "visuals"])

    kinds = "page_id long, headings int, blocks int, tables int, links int, references int, visuals int"
    return pages.select("page_id", "url", "html").mapInPandas(run, kinds)


# Elements and attributes that sanitised text may keep.
ALLOWED = {
    "a", "abbr", "b", "blockquote", "br", "caption", "cite", "code", "dd", "dl", "dt", "em", "figcaption", "figure", "h1", "h2", "h3",
    "h4", "h5", "h6", "hr", "i", "img", "li", "ol", "p", "pre", "q", "small", "span", "strong", "sub", "sup", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
ALLOWED_ATTRIBUTES = {"a": {"href", "title"}, "img": {"src", "alt", "width", "height"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan", "scope"}}
DROPPED = {"script", "style", "iframe", "object", "embed", "noscript", "template", "form"}
VOID = {"br", "hr", "img"}
SAFE_URL = re.compile(r"^(https?:|/(?!/)|#|\.{1,2}/|[^:/]*(/[^/:][^:]*)?$)", re.I)


class _Sanitizer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.dropped = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.dropped += tag != "embed"
        elif tag in ALLOWED and not self.dropped:
            kept = [(k, v or "") for k, v in attrs if k in ALLOWED_ATTRIBUTES.get(tag, ())]
            kept = [(k, v) for k, v in kept if k not in ("href", "src") or SAFE_URL.match(v.strip())]
            self.out.append(f"<{tag}" + "".join(f' {k}="{escape(v)}"' for k, v in kept) + ">")
            if tag not in VOID:
                self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif tag in self.open and not self.dropped:
            while (last := self.open.pop()) != tag:
                self.out.append(f"</{last}>")
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.out.append(escape(data, quote=False))


def sanitize(html: str | None) -> str:
    """Allowed elements and attributes only, properly nested; scripts and unsafe addresses go."""
    s = _Sanitizer()
    s.feed(html or "")
    s.close()
    return "".join(s.out) + "".join(f"</{t}>" for t in reversed(s.open))


def sanitize_pages(pages: DataFrame) -> DataFrame:
    """(page_id, html): each page's sanitised text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b.page_id, "html": [sanitize(h) for h in b.html]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, html string")
