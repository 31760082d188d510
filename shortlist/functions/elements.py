"""Element texts of landed pages: one pass over a page's tags with a stack of
the elements that are open.

Spark's built-in functions have no HTML reader, and regular expressions cannot
tell which elements surround a tag, so this is the one part of the library
that reads pages in Python, in Arrow batches. It knows only the fixed selectors
of ``SELECTORS``: an element counts by its class words, its ``data-testid``, or
the class of an element around it.

An end tag closes the innermost open element of its name and all that was
opened within; one that matches nothing is ignored. Elements that never have
content are not kept open; a new ``li``, ``p``, ``option``, ``tr``, ``td`` or
``th`` ends an open one of its kind in the same list or table. Comments,
scripts and styles are no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa

from shortlist.schemas import SELECTORS

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What a size may look like: "10", "10.5", "9 1/2", "42EU".
SIZE_TEXT = re.compile(r"\d[\d./ ]{0,4}[A-Za-z]{0,3}")
#: Other elements stand apart from the text around them.
INLINE = frozenset("a abbr b code em font i label mark small span strong sub sup u".split())
HIDDEN = frozenset(["script", "style", "template", "noscript", "head", "title"])
#: A start tag of the first kind ends an open one, unless an element of the
#: second kinds was opened in between.
ENDS_ITS_LIKE = {"li": {"ul", "ol", "menu"}, "p": {"div", "section", "article", "li", "td", "body"}, "option": {"select"},
                 "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


class Element:
    """An open or closed element: what selectors ask for, and its text."""

    __slots__ = ("tag", "words", "attrs", "parent", "text", "own", "hidden")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.words = attrs.get("class", "").split()
        self.text: list[str] = []
        self.own: str | None = None
        self.hidden = tag in HIDDEN or bool(parent and parent.hidden)

    def shown(self) -> str:
        return " ".join("".join(self.text).split())

    def is_one(self, kind: str, name: str) -> bool:
        """``name`` as a class word, a data-testid, a part of the class, or (``nav``)
        the aria-label of a nav element."""
        if kind == "class":
            return name in self.words
        if kind == "testid":
            return self.attrs.get("data-testid") == name
        if kind == "part":
            return name in self.attrs.get("class", "")
        return self.tag == "nav" and self.attrs.get("aria-label") == name

    def within(self, kind: str, name: str) -> bool:
        outer = self.parent
        while outer is not None:
            if outer.is_one(kind, name):
                return True
            outer = outer.parent
        return False


class Fold(HTMLParser):
    """Reads a page; ``elements`` are all its elements in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.elements: list[Element] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._end_its_like(tag)
        self._apart(tag)
        element = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1] if self.open else None)
        self.elements.append(element)
        if tag not in VOID:
            self.open.append(element)

    def _apart(self, tag: str) -> None:
        if tag not in INLINE:
            for element in self.open:
                element.text.append(" ")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an HTML element

    def _end_its_like(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag and tag in ENDS_ITS_LIKE:
                del self.open[at:]
                return
            if self.open[at].tag in ENDS_ITS_LIKE.get(tag, ()) or tag not in ENDS_ITS_LIKE:
                return

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return self._apart(tag)

    def handle_data(self, data: str) -> None:
        if self.open and not self.open[-1].hidden:
            if self.open[-1].own is None:
                self.open[-1].own = data
            for element in self.open:
                element.text.append(data)


def fold(html: str | None) -> list[Element]:
    reader = Fold()
    reader.feed(html or "")
    reader.close()
    return reader.elements


def selected(elements: list[Element], selectors: list[tuple], each: bool) -> list[str]:
    """The texts of the elements that the selectors name, selector by selector;
    with ``each`` all of a selector's, else the first one's."""
    out = []
    for kind, name, tag in selectors:
        found = [e for e in elements if (e.within(kind, name) and e.tag == tag if tag else e.is_one(kind, name))]
        out += [e.shown() for e in (found if each else found[:1])]
    return out


def feature_lists(elements: list[Element], selectors: list[tuple]) -> list[list[str]]:
    """One list of texts per selector that has any."""
    lists = ([t for t in selected(elements, [s], True) if t] for s in selectors)
    return [x for x in lists if x]


def size_options(elements: list[Element]) -> list[dict]:
    """The elements whose own text may be a size, with what says that it is
    sold out: class and aria-disabled, and the class of the element around."""
    out = []
    for e in elements:
        text = " ".join((e.own or "").split())
        if SIZE_TEXT.fullmatch(text):
            out.append({"text": text, "class": e.attrs.get("class"), "aria_disabled": e.attrs.get("aria-disabled"),
                        "parent_class": e.parent.attrs.get("class") if e.parent else None})
    return out


def page_lists(html: str | None) -> dict:
    """The lists of PRODUCT_PAGES from a page's elements."""
    elements = fold(html)
    body = [e for e in elements if not e.hidden]
    return {"price_texts": [t for t in selected(body, SELECTORS["price"], True) if t],
            "size_options": size_options(body),
            "description_texts": selected(body, SELECTORS["description"], False),
            "review_count_texts": selected(body, SELECTORS["review_count"], False),
            "rating_texts": selected(body, SELECTORS["rating"], False),
            "feature_lists": feature_lists(body, SELECTORS["features"])}


def pagination_hrefs(html: str | None) -> list[str]:
    """The ``href`` values with ``page=`` in the order in which the selectors
    find them: links in pagination blocks, block kind by block kind, then all."""
    links = [e for e in fold(html) if e.tag == "a" and "page=" in e.attrs.get("href", "")]
    out = [e.attrs["href"] for kind, name in SELECTORS["pagination"] for e in links if e.within(kind, name)]
    return out + [e.attrs["href"] for e in links]


def arrow_lists(kinds: pa.Schema):
    """A function over batches (..., html) that puts the ``page_lists`` named
    in ``kinds`` in the place of the html."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [page_lists(h) for h in part.column(part.num_columns - 1).to_pylist()]
                given = [part.column(i) for i in range(part.num_columns - 1)]
                lists = [pa.array([f[x.name] for f in found], x.type) for x in kinds]
                names = part.schema.names[:-1] + kinds.names
                yield pa.RecordBatch.from_arrays(given + lists, names)

    return read


def arrow_hrefs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., html) with ``pagination_hrefs`` in the place of the html."""
    for batch in batches:
        found = [pagination_hrefs(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
        given = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(given + [pa.array(found, pa.list_(pa.string()))],
                                         batch.schema.names[:-1] + ["hrefs"])
