"""HTML tokeniser: the one step that needs Python.  It records structure in one pass.

An element's fate (dropped, in the head, inside a container) is carried on the stack of open
elements, so a page costs time and memory in proportion to its size, however deep it is.
Only what survives cleaning is emitted; text rules are DataFrame expressions over that.
"""

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import types as T

from offerlode.functions import values as V

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option "
    "p pre section summary table tbody td tfoot th thead title tr ul".split())
# Opening one of these ends an open one of the named kind, up to the boundary tags.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
P_BOUNDARY = ("div", "td", "th", "li", "section", "article", "table", "body", "button")

OPEN, TEXT, CLOSE, LINK = 0, 1, 2, 3

# Attributes that rules on kept elements read, and the fields they are kept in.
ATTRIBUTES = {
    "id": "id", "class": "cls", "x-data": "x_data", "data-component-class": "component",
    "property": "property", "content": "content",
}

ELEMENT = [
    ("tag", T.StringType()), *[(name, T.StringType()) for name in ATTRIBUTES.values()],
    ("first", T.IntegerType()), ("last", T.IntegerType()),
    ("start", T.IntegerType()), ("stop", T.IntegerType()),
]
# ``blank``: inside a wrapper that holds nothing.
EVENT = [
    ("kind", T.IntegerType()), ("element", T.IntegerType()), ("line", T.IntegerType()),
    ("blank", T.BooleanType()), ("text", T.StringType()),
]
# A container's strings are numbers ``first`` to ``last`` - 1 of the page's strings.
CONTAINER = [
    ("rank", T.LongType()), ("first", T.IntegerType()), ("last", T.IntegerType()),
    ("start", T.IntegerType()), ("stop", T.IntegerType()),
]
# ``container``: the best one around the string, -1 without any; ``line_no``: place in it.
STRING = [
    ("container", T.IntegerType()), ("line_no", T.IntegerType()), ("text", T.StringType()),
]
PARTS = {"elements": ELEMENT, "events": EVENT, "containers": CONTAINER, "strings": STRING}
FLAGS = ("has_doctype", "has_body", "root_dropped")
TOKEN_FIELDS = [
    *[T.StructField(name, T.ArrayType(T.StructType([T.StructField(*f) for f in fields])))
      for name, fields in PARTS.items()],
    *[T.StructField(name, T.BooleanType()) for name in FLAGS],
    T.StructField("error", T.StringType()),
]


# --- cleaning rules, each a predicate on one element ------------------------------

def is_removed_tag(tag: str) -> bool:
    return tag in V.REMOVED_TAGS


def is_structural_tag(tag: str) -> bool:
    return tag in V.STRUCTURAL_TAGS


def is_hidden(attrs: dict[str, str]) -> bool:
    style = attrs.get("style", "").replace(" ", "").lower()
    return ("hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
            or any(word in style for word in V.HIDDEN_STYLES))


def is_noise(attrs: dict[str, str]) -> bool:
    if attrs.get("role", "").strip(" ").lower() in V.NOISE_ROLES:
        return True
    # Values stay apart, so that no keyword spans two of them; class names are words.
    values = "\x01".join([
        attrs.get("id", ""), *attrs.get("class", "").split(), attrs.get("aria-label", ""),
        attrs.get("data-testid", "")]).lower()
    return any(word in values for word in V.NOISE_ATTRIBUTE_WORDS)


def is_dropped(tag: str, attrs: dict[str, str]) -> bool:
    return (is_removed_tag(tag) or is_structural_tag(tag)
            or bool(attrs) and (is_hidden(attrs) or is_noise(attrs)))


def selector(attrs: dict[str, str]) -> int | None:
    """Number of the first container selector that an element satisfies."""
    names = attrs.get("class", "")
    for number, word in enumerate(V.CONTAINER_CLASS_WORDS):
        if word in names:
            return number
    for number, name in enumerate(V.CONTAINER_DATA_ATTRIBUTES, len(V.CONTAINER_CLASS_WORDS)):
        if name in attrs:
            return number
    return None


class _Element:
    __slots__ = ("tag", "attrs", "href", "gone", "in_head", "own_drop", "selector",
                 "first", "last", "start", "stop")


class _Recorder(HTMLParser):
    """Flat record of one page: elements in document order and events between them."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[_Element] = []
        self.stack: list[int] = []
        self.events: list[tuple[int, int, int, str | None]] = []
        self.line, self.doctype = 0, False
        self.open_tags = Counter()
        self.line_starts = [0, *(found.end() for found in re.finditer("\n", html))]
        self.feed(html)
        self.close()
        while self.stack:
            self._end(len(html))

    def _offset(self) -> int:
        row, column = self.getpos()
        return self.line_starts[row - 1] + column

    def _end(self, stop: int) -> None:
        index = self.stack.pop()
        element = self.elements[index]
        tag = element.tag
        self.open_tags[tag] -= 1
        if tag == "a" and element.href:
            self.events.append((LINK, index, self.line, f"]({element.href})"))
        if tag in BLOCK:
            self.line += 1
        element.last, element.stop = len(self.events), stop
        self.events.append((CLOSE, index, self.line, f"</{tag}>"))

    def _end_implied(self, tag: str, at: int) -> None:
        kinds, bounds = IMPLIED_END.get(tag, ((), ()))
        if tag in BLOCK and not kinds:
            kinds, bounds = ("p",), P_BOUNDARY
        if not any(self.open_tags[kind] for kind in kinds):
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            open_tag = self.elements[self.stack[depth]].tag
            if open_tag in kinds:
                while len(self.stack) > depth:
                    self._end(at)
                return
            if open_tag in bounds:
                return

    def handle_starttag(self, tag, attrs):
        at = self._offset()
        self._end_implied(tag, at)
        if tag in BLOCK or tag == "br":
            self.line += 1
        values = {name: value or "" for name, value in reversed(attrs)}
        around = self.elements[self.stack[-1]] if self.stack else None
        source = self.get_starttag_text() or ""
        index = len(self.elements)
        element = _Element()
        element.tag, element.attrs, element.href = tag, values, values.get("href")
        element.own_drop = is_dropped(tag, values)
        element.gone = element.own_drop or (around is not None and around.gone)
        element.in_head = tag in ("head", "title") or (around is not None and around.in_head)
        element.selector = selector(values) if values else None
        element.first, element.last = len(self.events), len(self.events) + 1
        element.start, element.stop = at, at + len(source)
        self.elements.append(element)
        self.events.append((OPEN, index, self.line, source))
        if tag == "a" and element.href:
            self.events.append((LINK, index, self.line, "["))
        if tag not in VOID:
            self.stack.append(index)
            self.open_tags[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.open_tags[tag]:
            at = self._offset()
            while True:
                ended = self.elements[self.stack[-1]].tag
                self._end(at + len(tag) + 3)
                if ended == tag:
                    return

    def handle_data(self, data):
        self.events.append((TEXT, self.stack[-1] if self.stack else -1, self.line, data))

    def handle_decl(self, decl):
        self.doctype = True

    def parse_marked_section(self, i, report=1):
        """``<![...`` is a comment up to the next ``>``; an open one takes the rest."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_comment(self, i, report=True):
        """A comment that is never closed takes the rest of the page."""
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i):
        """A document type ends behind its internal subset, where it has one."""
        if self.rawdata[i:i + 9].lower() != "<!doctype":
            return super().parse_html_declaration(i)
        end = self.rawdata.find(">", i)
        subset = self.rawdata.find("[", i, end) if end >= 0 else -1
        if subset >= 0:
            closed = self.rawdata.find("]", subset)
            end = self.rawdata.find(">", closed) if closed >= 0 else -1
        end = end if end >= 0 else len(self.rawdata) - 1
        self.handle_decl(self.rawdata[i + 2:end])
        return end + 1


class Page:
    """What is left of a page: rows of each part, and its flags."""

    def __init__(self, html: str):
        self.rows: dict[str, list[tuple]] = {name: [] for name in PARTS}
        self.flags = dict.fromkeys(FLAGS, False)
        self.error = None
        try:
            found = _Recorder(html)
        except Exception as failure:  # a bad page is a row, not a failed job
            self.error = f"{type(failure).__name__}: {failure}"
            return
        has_body = not any(e.tag == "body" and e.gone for e in found.elements)
        self.flags = {
            "has_doctype": found.doctype, "has_body": has_body,
            "root_dropped": not found.doctype and any(
                e.tag == "html" and e.own_drop for e in found.elements)}
        # Elements of the head are not part of a surviving body.
        kept = [not (e.gone or has_body and e.in_head) for e in found.elements]
        self._fill(found, kept)

    def _fill(self, found: _Recorder, kept: list[bool]) -> None:
        elements, events = found.elements, found.events
        numbers, places, content = [-1] * len(elements), [0], [0]
        for index, element in enumerate(elements):
            if kept[index]:
                numbers[index] = len(self.rows["elements"])
                self.rows["elements"].append(None)
        # places and content are running totals of kept events and of those that show
        # something, so what a wrapper holds is one subtraction.
        for kind, index, _, text in events:
            stays = index < 0 or kept[index]
            shows = stays and (
                kind == TEXT and text.strip() != ""
                or kind == OPEN and elements[index].tag in V.NON_EMPTY_MARKERS)
            places.append(places[-1] + stays)
            content.append(content[-1] + shows)
        strings, containers = self.rows["strings"], self.rows["containers"]
        around: list[tuple[int, int]] = []  # open containers: (rank, number), best so far
        blank_until = -1
        for at, (kind, index, line, text) in enumerate(events):
            if index >= 0 and not kept[index]:
                continue
            if kind == OPEN:
                element = elements[index]
                if (at > blank_until and element.tag in V.EMPTY_WRAPPER_TAGS
                        and content[element.last] == content[at]):
                    blank_until = element.last
                if element.selector is not None and element.last > at + 1:
                    rank = (element.selector << 32) + numbers[index]
                    number = len(containers)
                    containers.append([rank, len(strings), None, element.start, element.stop])
                    around.append((index, number, min(
                        (rank, number), around[-1][2] if around else (rank, number))))
            elif kind == CLOSE and around and around[-1][0] == index:
                containers[around.pop()[1]][2] = len(strings)
            elif kind == TEXT and (bare := text.strip()):
                best = around[-1][2][1] if around else -1
                first = containers[best][1] if around else 0
                strings.append((best, len(strings) - first + 1, bare))
            self.rows["events"].append((
                kind, numbers[index] if index >= 0 else -1, line, at <= blank_until, text))
        for element, number in zip(elements, numbers):
            if number >= 0:
                self.rows["elements"][number] = (
                    element.tag, *[element.attrs.get(name) for name in ATTRIBUTES],
                    places[element.first], places[element.last], element.start, element.stop)


def record(html: str) -> dict:
    """One page as plain Python values."""
    page = Page(html)
    parts = {
        name: [dict(zip([field for field, _ in fields], row)) for row in page.rows[name]]
        for name, fields in PARTS.items()}
    return {**parts, **page.flags, "error": page.error}


def _list_column(pages: list[Page], name: str, kind: pa.DataType) -> pa.Array:
    offsets, rows = [0], []
    for page in pages:
        rows += page.rows[name]
        offsets.append(len(rows))
    fields = [kind.value_type.field(at) for at in range(kind.value_type.num_fields)]
    columns = list(zip(*rows)) or [()] * len(fields)
    structs = pa.StructArray.from_arrays(
        [pa.array(column, field.type) for column, field in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, type=kind)


def tokenize_batches(html_column: str, schema: pa.Schema, slice_rows: int = 64):
    """Arrow batch function; small output batches bound the memory of a task."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                part = batch.slice(start, slice_rows)
                pages = [Page(html or "") for html in part.column(html_column).to_pylist()]
                columns = []
                for field in schema:
                    if field.name in PARTS:
                        columns.append(_list_column(pages, field.name, field.type))
                    elif field.name in FLAGS:
                        columns.append(pa.array([page.flags[field.name] for page in pages]))
                    elif field.name == "error":
                        columns.append(pa.array([page.error for page in pages], pa.string()))
                    else:
                        columns.append(part.column(field.name))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
    return run
