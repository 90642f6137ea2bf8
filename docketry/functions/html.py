"""Facts from HTML pages, by the standard parser in Arrow batches; one small parser pass a page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DROPPED = {"script", "style", "nav", "header", "footer", "noscript"}
BLOCKS = {"p", "div", "br", "li", "tr", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "td", "ul", "ol"}
CONTAINERS = ("article", "main", "content", "detail", "body")
DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}")


class Page(HTMLParser):
    """Title, text by container, links with their text and whether they lie in an attachment block, and list items."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.links, self.items, self.frames = "", [], [], [], []
        self.dropped, self.stack, self.link, self.item = 0, [], None, None
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        names = f"{tag} {given.get('class', '')} {given.get('id', '')}".lower()
        if tag in ("iframe", "embed"):
            self.frames.append(given.get("src", ""))
        if tag in BLOCKS:
            self.parts.append((self._container(), "\n"))
        if tag == "a" and "href" in given:
            self.link = [given["href"], "", any("attach" in n for _, n in self.stack)]
        if tag in ("li", "tr"):
            self.item = {"link_url": "", "title": "", "date": ""}
        if tag not in ("br", "img", "meta", "link", "input", "hr", "embed"):
            self.stack.append((tag, names))
            self.dropped += tag in DROPPED

    def handle_endtag(self, tag):
        while any(t == tag for t, _ in self.stack):
            open_tag, _ = self.stack.pop()
            self.dropped -= open_tag in DROPPED
            if open_tag == tag:
                break
        if tag in BLOCKS:
            self.parts.append((self._container(), "\n"))
        if tag == "a" and self.link:
            self.links.append(tuple(self.link))
            if self.item is not None and not self.item["link_url"]:
                self.item |= {"link_url": self.link[0], "title": self.link[1].strip()}
            self.link = None
        if tag in ("li", "tr") and self.item is not None:
            if self.item["link_url"]:
                self.items.append(self.item)
            self.item = None

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "title":
            self.title += data
            return
        if self.dropped:
            return
        if self.link is not None:
            self.link[1] += data
        if self.item is not None and (m := DATE.search(data)):
            self.item["date"] = m[0]
        self.parts.append((self._container(), data))

    def _container(self) -> str:
        for _, names in self.stack:
            for c in CONTAINERS[:-1]:
                if c in names:
                    return c
        return "body"

    def main_text(self, least: int = 100) -> str:
        """Text of the first kind of container that has enough of it, lines and blanks collapsed."""
        for kind in CONTAINERS:
            raw = "".join(t for c, t in self.parts if c == kind or kind == "body")
            lines = [re.sub(r"[ \t\xa0]+", " ", x).strip() for x in raw.split("\n")]
            if len(text := "\n".join(x for x in lines if x)) >= least:
                return text
        return ""

    def attachment(self, base: str, suffixes: tuple[str, ...] = (".pdf", ".doc", ".docx")) -> tuple[str, int]:
        """(address, tier) of the best attachment link: in an attachment block, with a telling text, any, or in a frame."""
        fits = lambda href: any(s in href.lower() for s in suffixes)
        tiers = [[h for h, _, inside in self.links if inside and fits(h)], [h for h, t, _ in self.links if ("附件" in t or "attachment" in t.lower()) and fits(h)], [h for h, _, _ in self.links if fits(h)], [s for s in self.frames if fits(s)]]
        return next(((urljoin(base, found[0]), n) for n, found in enumerate(tiers, 1) if found), ("", 0))


#: Titles of pages that say that there is nothing; a number 404 within a title is none.
NOT_FOUND = re.compile(r"^(?:error\s*)?404\b|\bnot found\b|页面不存在", re.IGNORECASE)
PAGE_FACTS = "title string, main_text string, attachment string, attachment_tier int, items array<struct<link_url:string,title:string,date:string>>, soft_404 boolean"
_ITEMS = pa.list_(pa.struct([("link_url", pa.string()), ("title", pa.string()), ("date", pa.string())]))


def page_facts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id with PAGE_FACTS of every page; a null page is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for url, text in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                page = Page(text or "")
                title = page.title.strip()
                for column, value in zip(out, (title, page.main_text(), *page.attachment(url or ""), page.items, bool(NOT_FOUND.search(title)))):
                    column.append(value)
            yield pa.record_batch([batch.column("page_id"), *[pa.array(v, t) for v, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int32(), _ITEMS, pa.bool_()))]], ["page_id", "title", "main_text", "attachment", "attachment_tier", "items", "soft_404"])

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id long, {PAGE_FACTS}")
