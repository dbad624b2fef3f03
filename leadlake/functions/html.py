"""Facts of an HTML page, parsed once in Arrow batches; every decision on them is a Spark expression elsewhere."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

SCHEMA = (
    "struct<title: string, text: string, metas: array<struct<key: string, value: string>>, anchors: array<struct<href: string, text: string, nav: boolean>>, links: array<struct<rel: string, href: string>>, "
    "images: array<struct<src: string, alt: string, marks: string, logo: boolean, header: boolean>>, headings: array<struct<level: int, text: string, after: string>>, paragraphs: array<string>, addresses: array<string>, jsonld: array<string>, "
    "lists: array<struct<heading: string, items: array<string>>>, blocks: array<struct<classes: string, title: string>>, bolds: array<string>, mails: array<struct<email: string, context: string>>, rows: int, items: int, password: boolean, paginated: boolean, dated: boolean, article: boolean, about: boolean>"
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("noscript", "script", "style"))
#: An opening tag ends these open ones.
_ENDS = {"li": {"li"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: The elements whose text says whose address a mail link is.
_CONTEXTS = frozenset("article div li p section td".split())
_FENCE = {"li": {"ol", "ul"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}
AFTER = 600
#: Bytes of markup whose facts are held at once inside a worker, and what any page counts besides its own; a longer page is handled alone and whole.
SLICE, PAGE = 1 << 20, 1 << 10
#: An ampersand with the closed reference that it may begin, and what stands for one that begins none: no decoded text has it.
_AMPERSAND, _HELD = re.compile("&((?:#[0-9]+|#[xX][0-9a-fA-F]+|[0-9A-Za-z]+);)?"), "\ud800"


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict, list[str]]] = []
        self.text: list[str] = []
        self.out: dict = {k: [] for k in ("metas", "anchors", "links", "images", "headings", "paragraphs", "addresses", "jsonld", "lists", "blocks", "bolds", "mails")}
        self.out |= {"title": None, "rows": 0, "items": 0, "password": False, "paginated": False, "dated": False, "article": False, "about": False}
        self.heading: dict | None = None

    def _marks(self, attrs: dict) -> str:
        return f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()

    def _within(self, tags: frozenset[str] | set[str], word: str = "") -> bool:
        return any(t in tags or (word and word in self._marks(a)) for t, a, _ in self.open)

    def handle_starttag(self, tag: str, pairs: list) -> None:
        attrs = {k: v or "" for k, v in reversed(pairs)}
        if tag in _BLOCKS and any(t == "p" for t, _, _ in self.open):
            self._close("p")
        if tag in _ENDS:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in _FENCE.get(tag, ()):
                    break
                if self.open[k][0] in _ENDS[tag]:
                    self._close(self.open[k][0])
                    break
        out, marks = self.out, self._marks(attrs)
        cls = attrs.get("class", "").lower()
        if tag == "meta":
            out["metas"].append({"key": (attrs.get("property") or attrs.get("name") or "").lower(), "value": attrs.get("content", "")})
        elif tag == "link":
            out["links"].append({"rel": attrs.get("rel", "").lower(), "href": attrs.get("href", "")})
        elif tag == "img":
            own = f"{attrs.get('src', '')} {attrs.get('alt', '')} {marks} {attrs.get('title', '')}"
            out["images"].append({"src": attrs.get("src", ""), "alt": attrs.get("alt", ""), "marks": own, "logo": self._within(set(), "logo"), "header": self._within({"header"}) or self._within(set(), "header") or self._within(set(), "top-bar")})
        elif tag == "input" and attrs.get("type", "").lower() == "password":
            out["password"] = True
        elif tag == "tr":
            out["rows"] += 1
        elif tag == "li":
            out["items"] += self._within({"ol", "ul"})
        out["paginated"] |= "paginat" in marks or (tag == "a" and any(x in attrs.get("href", "") for x in ("page=", "str=")))
        out["dated"] |= tag == "time" or any(x in cls for x in ("date", "publish", "posted"))
        out["article"] |= tag == "article" or "article" in cls or "post-content" in cls
        out["about"] |= "about" in marks or "contact" in marks
        if tag in ("ol", "ul"):
            out["lists"].append({"heading": self.heading["text"] if self.heading else None, "items": []})
        if any(x in cls for x in ("service", "solution", "offering", "capability", "feature", "item-title", "card-title", "tile-title", "card", "team", "member", "person")):
            out["blocks"].append({"classes": cls, "title": None})
            attrs["\0block"] = len(out["blocks"]) - 1
        if tag not in _VOID:
            self.open.append((tag, attrs, []))

    def handle_startendtag(self, tag: str, pairs: list) -> None:
        self.handle_starttag(tag, pairs)
        if tag not in _VOID:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        for _, _, text in self.open:
            text.append(data)
        if not any(t in _HIDDEN for t, _, _ in self.open):
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def _close(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.open):
            return
        while self.open:
            name, attrs, parts = self.open.pop()
            self._done(name, attrs, "".join(parts))
            if name == tag:
                return

    def _done(self, tag: str, attrs: dict, text: str) -> None:
        out, plain = self.out, " ".join(text.split())
        if tag == "title" and out["title"] is None:
            out["title"] = text.strip()
        elif tag == "a" and "href" in attrs:
            out["anchors"].append({"href": attrs["href"], "text": text.strip(), "nav": self._within({"footer", "header", "nav"}) or any(a.get("role") == "navigation" for _, a, _ in self.open)})
            if attrs["href"][:7].lower() == "mailto:":
                mail = attrs["href"][7:].split("?")[0].strip().lower()
                for name, above, _ in reversed(self.open):
                    if name in _CONTEXTS:
                        above.setdefault("\0mails", []).append(mail)
                        break
                else:
                    out["mails"].append({"email": mail, "context": plain})
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.heading = {"level": int(tag[1]), "text": plain, "after": ""}
            out["headings"].append(self.heading)
        elif tag == "p":
            out["paragraphs"].append(text.strip())
        elif tag == "address":
            out["addresses"].append(plain)
        elif tag in ("b", "strong"):
            out["bolds"].append(plain)
        elif tag == "script" and "ld+json" in attrs.get("type", "").lower():
            out["jsonld"].append(text)
        elif tag == "li" and out["lists"]:
            out["lists"][-1]["items"].append(plain)
        if tag in ("div", "li", "ol", "p", "ul", "span") and self.heading and plain and len(self.heading["after"]) < AFTER and not self._within({"p", "ul", "ol"}):
            self.heading["after"] = (self.heading["after"] + " " + plain).strip()
        for mail in attrs.get("\0mails", ()):
            out["mails"].append({"email": mail, "context": plain})
        if tag in ("h2", "h3", "h4", "strong"):
            for _, above, _ in self.open:
                if (k := above.get("\0block")) is not None and out["blocks"][k]["title"] is None:
                    out["blocks"][k]["title"] = plain
        if (k := attrs.get("\0block")) is not None and out["blocks"][k]["title"] is None and "title" in attrs.get("class", "").lower():
            out["blocks"][k]["title"] = plain

    def facts(self) -> dict:
        while self.open:
            name, attrs, parts = self.open.pop()
            self._done(name, attrs, "".join(parts))
        return self.out | {"text": "".join(self.text)}


class _ClosedPage(_Page):
    """Decodes only references that end in a semicolon; others, of which browsers decode the older names too, stay as they are written."""

    def feed(self, html: str) -> None:
        super().feed(_AMPERSAND.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else _HELD + m[0][1:], html))

    def handle_starttag(self, tag: str, pairs: list) -> None:
        super().handle_starttag(tag, [(k, v and v.replace(_HELD, "&")) for k, v in pairs])

    def handle_data(self, data: str) -> None:
        super().handle_data(data.replace(_HELD, "&"))


def parse(html: str, unclosed: bool = True) -> dict:
    page = _Page() if unclosed else _ClosedPage()
    page.feed(html)
    page.close()
    return page.facts()


def slices(pages: pa.Array) -> Iterator[pa.Array]:
    """Runs of pages of about ``SLICE`` bytes."""
    low = held = 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(pages), 0).to_pylist()):
        if k > low and held + size + PAGE > SLICE:
            yield pages.slice(low, k - low)
            low, held = k, 0
        held += size + PAGE
    if low < len(pages):
        yield pages.slice(low)


def html_facts(html: str | Column, unclosed: bool = True) -> Column:
    """One parse for all facts; null html gives null. ``unclosed``: whether references without a semicolon (&amp) are decoded, as browsers do.

    A worker holds the facts of one slice at a time, however many rows Spark hands over at once.
    """
    kind = to_arrow_type(StructType.fromDDL(SCHEMA.removeprefix("struct<").removesuffix(">")))

    @F.arrow_udf(SCHEMA)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        none = dict.fromkeys(f.name for f in kind)
        for pages in batches:
            for some in slices(pages):
                yield pa.array((none if p is None else parse(p, unclosed) for p in some.to_pylist()), kind, size=len(some))

    return read(html)


def meta(facts: Column, key: str) -> Column:
    """The first meta value of a name, trimmed; null if there is none."""
    return F.get(F.transform(F.filter(facts["metas"], lambda m: m["key"] == key), lambda m: F.trim(m["value"])), F.lit(0))
