"""HTML to Markdown, as a function over a column.

A page becomes a small tree, without the elements that carry no content; each element then says
what it puts around its children: marks, line ends and paragraph ends. Line ends next to each other
count once, and a paragraph end among them makes one blank line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that go with their content, chrome, and attribute words of boilerplate.
DROPPED = frozenset("script style noscript template svg iframe canvas video audio".split())
CHROME = frozenset("nav footer form button dialog select datalist aside".split())
BOXES = frozenset("div section main aside ul ol span".split())
BOILERPLATE = "nav menu sidebar breadcrumb footer header cookie consent banner advert promo popup modal toolbar pagination social share related newsletter subscribe".split()
#: Void elements, block elements, inline marks and entities.
VOID = frozenset("br hr img input meta link source area base col embed param track wbr".split())
BLOCK = frozenset("p div section article main header h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table thead tbody figure figcaption dl dt dd details summary".split())
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "nbsp": " ", "amp": "&"}

LINE, PARAGRAPH = "\0line", "\0paragraph"
DEEPEST = 120  # elements within elements; those further down add their content to the one above
_WORDS = re.compile(rf"\b({'|'.join(BOILERPLATE)})", re.I | re.A)
_HELD = "\ue000"  # stands for an ampersand while the parser works, which then resolves none itself
_REFERENCE = re.compile(_HELD + r"(#?[a-z0-9]+);")
#: Elements that end an open one of the same kind, up to the element that bounds them.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


def decoded(s: str) -> str:
    """Entities, each once: what an ampersand leaves behind is not looked at again."""

    def char(m: re.Match) -> str:
        if m[1] in ENTITIES:
            return ENTITIES[m[1]]
        if re.fullmatch("#[0-9]{1,7}", m[1], re.A) and int(m[1][1:]) < 0x110000:
            return chr(int(m[1][1:]))
        return m[0]

    return _REFERENCE.sub(char, s).replace(_HELD, "&")


class Element:
    __slots__ = ("name", "attributes", "inside", "ended")

    def __init__(self, name: str, attributes: dict[str, str] | None = None):
        self.name, self.attributes, self.inside, self.ended = name, attributes or {}, [], False

    def texts(self) -> Iterator[str]:
        for x in self.inside:
            if isinstance(x, str):
                yield x
            else:
                yield from x.texts()

    def all(self, *names: str) -> Iterator[Element]:
        for x in self.inside:
            if isinstance(x, Element):
                if x.name in names:
                    yield x
                yield from x.all(*names)


class Page(HTMLParser):
    """The tree of a page. An element that is left out lasts to the first end tag of its name."""

    def __init__(self, html: str, strip_chrome: bool):
        super().__init__(convert_charrefs=False)
        self.strip_chrome, self.out = strip_chrome, None
        self.root = Element("")
        self.open = [self.root]
        self.ends: dict[str, int] = {}
        for name in re.findall(r"</([a-zA-Z][a-zA-Z0-9-]*)\s*>", html, re.A):
            self.ends[name.lower()] = self.ends.get(name.lower(), 0) + 1
        self.feed(html.replace("&", _HELD))
        self.close()

    def left_out(self, name: str, attributes: dict[str, str]) -> bool:
        if not self.ends.get(name):  # nothing ends it
            return False
        about = (attributes.get(k, "") for k in ("class", "id", "role", "aria-label"))
        return name in DROPPED or (self.strip_chrome and (name in CHROME or (name in BOXES and any(map(_WORDS.search, about)))))

    def handle_starttag(self, name, attrs):
        attributes = {k: v or "" for k, v in reversed(attrs)}
        if self.out:
            return
        if self.left_out(name, attributes):
            self.out = name
            self.handle_data(" ")
            return
        same, bounds = ENDS.get(name, ((), ()))
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].name in bounds:
                break
            if self.open[at].name in same:
                del self.open[at:]
                break
        element = Element(name, attributes)
        self.open[-1].inside.append(element)
        if name not in VOID and len(self.open) < DEEPEST:
            self.open.append(element)

    def handle_startendtag(self, name, attrs):
        self.handle_starttag(name, attrs)

    def handle_endtag(self, name):
        if name in self.ends:
            self.ends[name] -= 1
        if self.out:
            self.out = None if name == self.out else self.out
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].name == name:
                self.open[at].ended = True
                del self.open[at:]
                return
        # marks stand where the page's tags do, also where those do not pair
        self.open[-1].inside.append(MARKS.get(name, ""))

    def handle_data(self, data):
        if not self.out or data == " ":
            if data != "<":  # a sign that begins no tag is lost
                self.open[-1].inside.append(decoded(data))

    def handle_comment(self, data):
        self.handle_data(" ")


class Verbatim(str):
    """Text that keeps its lines."""


def table(element: Element) -> str:
    rows = [[" ".join(" ".join(cell.texts()).split()) for cell in row.all("td", "th")] for row in element.all("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    wide = max(map(len, rows))
    rows = [r + [""] * (wide - len(r)) for r in rows]
    return "\n".join(f"| {' | '.join(r)} |" for r in [rows[0], ["---"] * wide, *rows[1:]])


def fenced(element: Element) -> str:
    code = re.sub(r"[ \t]+", " ", "".join(element.texts())).rstrip()
    return f"```\n{code}\n```" if code else "```\n```"


def parts(element: Element, numbers: Iterator[int] | None = None) -> Iterator[str]:
    """What an element shows, with LINE and PARAGRAPH between; numbers: those of the list around it."""
    name = element.name
    if name == "pre":
        yield from (LINE, Verbatim(fenced(element)), PARAGRAPH)
        return
    if name == "table":
        yield from (LINE, Verbatim(table(element)), PARAGRAPH)
        return
    if name in VOID:
        yield from {"br": (LINE,), "hr": (PARAGRAPH, "---", PARAGRAPH)}.get(name, ())
        return
    target = decoded(element.attributes.get("href", "")) if name == "a" else ""
    link = target.lower().startswith(("http://", "https://"))
    if name in ("ul", "ol"):
        numbers = count(1) if name == "ol" else None
    yield PARAGRAPH if name in ("ul", "ol") else LINE if name in BLOCK else ""
    if name == "li":
        yield f"{next(numbers)}. " if numbers else "- "
    yield {"blockquote": "> ", "a": "[" if link else ""}.get(name) or MARKS.get(name) or ("#" * int(name[1]) + " " if re.fullmatch("h[1-6]", name) else "")
    for x in element.inside:
        if isinstance(x, str):
            yield re.sub(r"\s+", " ", x)
        else:
            yield from parts(x, numbers)
    if element.ended:
        yield f"]({target})" if link else MARKS.get(name, "")
    if name in BLOCK:
        yield LINE if name == "li" else PARAGRAPH


def assembled(shown: Iterator[str]) -> str:
    out, line, gap = [], "", ""
    for x in (*shown, LINE):
        if x not in (LINE, PARAGRAPH) and not isinstance(x, Verbatim):
            line += x
            continue
        whole = [re.sub(r"[ \t]+", " ", line).strip(), x if isinstance(x, Verbatim) else ""]
        for y in filter(None, whole):
            out.append(gap + y)
            gap = "\n"
        line, gap = "", "\n\n" if x == PARAGRAPH else gap
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(out))).strip()


def to_markdown(html: str | None, strip_chrome: bool = True) -> str:
    return assembled(parts(Page(html or "", strip_chrome).root))


def html_to_markdown(c: Column, strip_chrome: bool = True) -> Column:
    """Pages go to Python some hundred at a time: a worker never holds an Arrow batch of them, with copies, whatever the input."""
    return F.udf(lambda html: to_markdown(html, strip_chrome), "string", useArrow=False)(c)
