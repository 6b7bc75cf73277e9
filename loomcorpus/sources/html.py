"""HTML pages to sections, from the events of the standard library's parser: no tree is built.

Every open element is a frame that gathers the texts of its children; when it ends, its own text goes to the
frame around it.  Sections are opened and filled on the way and come out in the order in which they began.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcorpus.sources.rst import sectioned

#: Tags by their role.
DROPPED = {"script", "style", "nav", "header", "footer", "aside"}
HEADINGS = {"h1", "h2", "h3", "h4"}
BLOCKS = {"p", "li", "div", "blockquote", "td", "th", "section"}
LOOKED_THROUGH = {"div", "article", "main"}
PAGE = LOOKED_THROUGH | {"html", "body", "section"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Pages that a table of contents links beside its chapters.
NO_CHAPTERS = ("index.html", "landing-page.html")
#: Elements below this depth stand beside each other, as in browsers.
DEPTH = 256


@dataclass
class Section:
    above: Section | None
    name: str
    titled: bool = False
    prose: list[str] = field(default_factory=list)

    def hierarchy(self) -> list[str]:
        return [*(self.above.hierarchy() if self.above else []), self.name]


@dataclass
class Frame:
    tag: str
    literal: bool  # its text is taken as it stands
    said: int  # how many strings came before it
    reached: bool  # from the root through containers of sections alone
    section: Section | None  # that its children belong to
    texts: list[str] = field(default_factory=list)


class Reader(HTMLParser):
    """Calls `child` for each child of a reached frame; the frame at the bottom is the page."""

    containers = LOOKED_THROUGH | {"section"}
    rooted = True

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.strings: list[str] = []
        self.frames = [Frame("", False, 0, self.rooted, None)]

    def opened(self, frame: Frame, attrs: dict[str, str | None]) -> None:
        """A frame begins."""

    def child(self, parent: Frame, tag: str, text: str, strings: list[str]) -> None:
        """A child of a reached frame has ended; strings are those of headings."""

    def read(self, page: str) -> None:
        self.feed(page)
        self.close()
        while len(self.frames) > 1:
            self._end()

    def _add(self, tag: str, text: str, strings: list[str]) -> None:
        self.frames[-1].texts.append(text)
        if self.frames[-1].reached:
            self.child(self.frames[-1], tag, text, strings)

    def _end(self) -> None:
        f = self.frames.pop()
        strings = self.strings[f.said :] if f.literal or f.tag in HEADINGS else []
        if f.tag in DROPPED:
            text = ""
        elif f.literal:
            text = "".join(strings)
        else:
            text = ("\n" if f.tag in BLOCKS else "").join(f.texts)
        self._add(f.tag, text, strings)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in VOID or len(self.frames) >= DEPTH:
            return self.handle_startendtag(tag, attrs)
        top = self.frames[-1]
        literal = tag in ("pre", "code") or (tag == "span" and "math" in (attrs.get("class") or "").split())
        self.frames.append(Frame(tag, literal, len(self.strings), top.reached and tag in self.containers, top.section))
        self.opened(self.frames[-1], attrs)

    def handle_startendtag(self, tag, attrs):
        alt = (dict(attrs).get("alt") or "").strip() if tag == "img" else ""
        self._add(tag, f"[image: {alt}]" if alt else "", [])

    def handle_endtag(self, tag):
        if any(f.tag == tag for f in self.frames[1:]):
            while self.frames[-1].tag != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        self.strings.append(data)
        self._add("", data, [])

    handle_comment = handle_data  # comments are strings of the page, and so part of the text


class MainPlaces(Reader):
    """Of each main element, in order, whether it is named main-content."""

    def __init__(self) -> None:
        super().__init__()
        self.named: list[bool] = []

    def opened(self, frame, attrs):
        if frame.tag == "main":
            self.named.append(attrs.get("id") == "main-content")


class BySections(Reader):
    """The section elements of one main element."""

    rooted = False

    def __init__(self, main: int) -> None:
        super().__init__()
        self.to_come, self.sections = main, []

    def opened(self, frame, attrs):
        if frame.tag == "main":
            frame.reached |= self.to_come == 0
            self.to_come -= 1
        if frame.reached and frame.tag == "section":
            frame.section = Section(frame.section, (attrs.get("id") or "section").replace("-", " ").title())
            self.sections.append(frame.section)

    def child(self, parent, tag, text, strings):
        if parent.tag != "section" or tag == "section":
            return
        if tag in HEADINGS and not parent.section.titled:
            parent.section.titled, parent.section.name = True, "".join(s.strip() for s in strings).rstrip("#").strip()
        elif text.strip():
            parent.section.prose.append(text.strip())


class ByHeadings(Reader):
    """Pages without section elements: what follows a heading belongs to it."""

    containers = PAGE

    def __init__(self, stem: str) -> None:
        super().__init__()
        self.path: dict[int, str] = {}
        self.found: list[tuple[list[str], list[str]]] = [([stem], [])]

    def child(self, parent, tag, text, strings):
        if tag in HEADINGS:
            level = int(tag[1])
            self.path = {k: v for k, v in self.path.items() if k < level} | {level: "".join(strings).strip()}
            self.found.append((list(self.path.values()), []))
        elif tag not in PAGE and tag != "head" and text.strip():
            self.found[-1][1].append(text.strip())


def sections(page: str, stem: str, mode: str = "section") -> Iterator[tuple[list[str], str]]:
    """(hierarchy, prose) of the section elements of the page's main element, or by headings."""
    if mode == "heading":
        by = ByHeadings(stem)
        by.read(page)
        found = by.found
    else:
        mains = MainPlaces()
        mains.read(page)
        if not mains.named:
            return
        of = BySections(mains.named.index(True) if True in mains.named else 0)
        of.read(page)
        found = [(s.hierarchy(), s.prose) for s in of.sections]
    for hierarchy, prose in found:
        if prose:
            yield hierarchy, "\n\n".join(prose).strip()


def readable(page: str) -> str:
    """The text of a whole page."""
    reader = Reader()
    reader.read(page)
    return "".join(reader.frames[0].texts)


def html_sections(rows: DataFrame, source_name: str = "book", mode: str = "section") -> DataFrame:
    """Of rows (path, text), text as string or bytes: sections by section elements, or by headings."""
    return sectioned(rows, lambda text, stem: sections(text, stem, mode), "book", source_name)


def html_texts(rows: DataFrame) -> DataFrame:
    """Of rows (path, text): the readable text of each page, as one section; a page without any gives no row."""
    return sectioned(rows, lambda text, stem: [([stem], t)] if (t := readable(text).strip()) else [], "book", "book")


def read_html(spark: SparkSession, folder: str, source_name: str = "book", mode: str = "section") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    return html_sections(files.select("path", F.col("content").alias("text")), source_name, mode)


#: The address of an anchor, with its quotation marks if it has any.
ANCHOR = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def links(html: str = "html", base: str = "https://example.org/") -> Column:
    """Relative links to .html pages in order of appearance, once each, made absolute; a null page has none."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(ANCHOR), 1)
    hrefs = F.transform(found, lambda h: F.regexp_replace(h, "^[\"']|[\"']$", ""))
    fine = F.filter(hrefs, lambda h: h.endswith(".html") & ~h.rlike(r"^(http|#)") & ~h.isin(*NO_CHAPTERS))
    return F.transform(F.array_distinct(fine), lambda h: F.concat(F.lit(f"{base.rstrip('/')}/"), h))
