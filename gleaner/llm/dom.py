"""Elements and texts of an HTML page, as lists in page order: enough of a tree to measure its parts."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

# Element names of HTML by what they do.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Their content is text without tags; it is never part of a page's main text.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset head header hgroup hr html legend li listing "
    "main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of these doesn't end a paragraph.
WITHIN = frozenset("body caption frameset head html legend optgroup option tbody td tfoot th thead tr".split())
#: End tags within these don't reach what is open outside of them.
SCOPES = frozenset("caption html marquee object table td template th".split())
LISTS = frozenset("dir dl menu ol ul".split())
ITEMS = frozenset("dd dt li".split())
CELLS = frozenset("caption td th".split())
ROWS = frozenset("tbody tfoot thead tr".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
COMMENT_ENDS = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Page:
    """``tag``, ``parent``, ``last`` (one past the last element within) and ``attributes`` of each element, parents before children.

    ``texts`` are (element, text, first of a block, within a link); a line break is a text of one space. End tags that are missing are
    added where HTML has them end: a paragraph at the next block, an item at the next item, all others with what they
    are in. An end tag that fits nothing is passed over. Comments, declarations, and what is left of a tag that never ends are no texts.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.last, self.attributes = ["html"], [-1], [0], [""]
        self.texts: list[tuple[int, str, bool, bool]] = []
        self._open, self._scopes, self._items, self._links = [0], [Counter()], [None], []
        self._head, self._new, self._tables = None, True, 0
        self._read(html)
        while self._open:
            self._leave()

    def named(self, element: int) -> dict[str, str]:
        """Attributes of an element; of repeated ones the first."""
        out: dict[str, str] = {}
        for name, *values in ATTRIBUTE.findall(self.attributes[element]):
            out.setdefault(name.lower(), unescape("".join(values)))
        return out

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            begin = html.find("<", at)
            self._text(html[at : begin if begin >= 0 else size])
            if begin < 0:
                return
            if tag := TAG.match(html, begin):
                at = tag.end()
                name = tag[2].lower()
                if tag[1]:
                    self._end(name)
                elif name in RAW:
                    end = ENDS[name].search(html, at)
                    at = end.start() if end else size
                    self._block()
                elif name == "plaintext":
                    self._text(html[at:])
                    return
                else:
                    self._start(name, tag[3])
                continue
            following = html[begin + 1 : begin + 3]
            if html.startswith("<!--", begin):
                end = COMMENT_ENDS.search(html, begin + 2)
                at = end.end() if end else size
            elif following[:1] in ("!", "?") or following[:1] == "/" and not following[1:].isalpha() and len(following) > 1:
                at = html.find(">", begin) + 1 or size
            elif following[:1].isascii() and following[:1].isalpha() or following[:1] == "/" and len(following) > 1:
                return
            else:
                self._text("<")
                at = begin + 1

    def _text(self, text: str) -> None:
        if not text:
            return
        if "&" in text:
            text = unescape(text)
        if self._head is not None and not text.isspace():
            self._through(self._head)
        self.texts.append((self._open[-1], text, self._new, bool(self._links)))
        self._new = False

    def _block(self) -> None:
        self._new = True

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "body", "head") and (name == "html" or self._scopes[0][name]):
            return
        if self._head is not None and name not in IN_HEAD:
            self._through(self._head)
        if name == "br":
            self.texts.append((self._open[-1], " ", False, False))
            return
        if name in BLOCK:
            self._block()
            if (name in CELLS or name in ROWS) and not self._tables:
                return
            if name not in WITHIN and self._scopes[-1]["p"]:
                self._up("p")
            if name in ITEMS and self._items[-1] is not None:
                self._through(self._items[-1])
            elif name in CELLS or name in ROWS:
                self._cells(name)
            elif name in HEADINGS and self.tag[self._open[-1]] in HEADINGS:
                self._leave()
        elif name == "a":
            if self._links and self._open[-1] == self._links[-1]:
                self._leave()
            self._links.clear()
        if name in VOID:
            return
        element = len(self.tag)
        self.tag.append(name)
        self.parent.append(self._open[-1])
        self.last.append(0)
        self.attributes.append(attributes)
        self._open.append(element)
        self._scopes[-1][name] += 1
        self._tables += name == "table"
        if name in SCOPES:
            self._scopes.append(Counter())
        if name in LISTS or name in SCOPES:
            self._items.append(None)
        elif name in ITEMS:
            self._items[-1] = element
        elif name == "a":
            self._links.append(element)
        elif name == "head":
            self._head = element

    def _cells(self, name: str) -> None:
        """Ends the open cell before another cell or row, and the open row before another row, of the same table."""
        for other in [CELLS] + [{"tr"}, ROWS][: 1 + (name != "tr")] * (name in ROWS):
            for element in reversed(self._open):
                if self.tag[element] in other:
                    self._through(element)
                    break
                if self.tag[element] in SCOPES and self.tag[element] not in CELLS:
                    break

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._block()
        if name == "br":
            self._start(name, "")
        elif name in ("html", "body") or name in VOID:
            return
        elif name == "a" and self._links:
            if self._open[-1] == self._links[-1]:
                self._leave()
            else:
                self._links.pop()
        elif (name in SCOPES or name in ROWS) and name not in ("marquee", "object", "template"):
            for element in reversed(self._open if self._tables else ()):
                if self.tag[element] == name:
                    self._through(element)
                    return
                if self.tag[element] == "table":
                    return
        elif name in HEADINGS:
            if any(self._scopes[-1][h] for h in HEADINGS):
                self._up(*HEADINGS)
        elif self._scopes[-1][name]:
            if name not in BLOCK:
                for element in reversed(self._open):
                    if self.tag[element] == name:
                        break
                    if self.tag[element] in BLOCK:
                        return
            self._up(name)

    def _up(self, *names: str) -> None:
        while self.tag[self._open[-1]] not in names:
            self._leave()
        self._leave()

    def _through(self, element: int) -> None:
        while self._open and self._open[-1] >= element:
            self._leave()

    def _leave(self) -> None:
        element = self._open.pop()
        name = self.tag[element]
        self.last[element] = len(self.tag)
        if name in BLOCK:
            self._block()
        if name in SCOPES and len(self._scopes) > 1:
            self._scopes.pop()
        if (name in LISTS or name in SCOPES) and len(self._items) > 1:
            self._items.pop()
        elif name in ITEMS and self._items[-1] == element:
            self._items[-1] = None
        elif name == "a" and self._links and self._links[-1] == element:
            self._links.pop()
        elif name == "head":
            self._head = None
        self._scopes[-1][name] -= element > 0
        self._tables -= name == "table"
