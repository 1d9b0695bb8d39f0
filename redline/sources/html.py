"""Pages read in one pass over the parser's events: no tree, no recursion; used inside tasks only.

Every open element is a small frame. It knows the first characters of its own text and what its last few
children said, which is all that captions need, so memory follows nesting depth and output, not markup.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag of the left kind ends open elements of the right kinds, up to the nearest table.
CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
# End tags that have no effect on elements outside the table they stand in.
HELD_BY_TABLE = frozenset("td th tr p div span".split())

CAPTION_CHARS = 300
CAPTION_SIBLINGS = 4
BARE_ID = re.compile(r"[a-z0-9\-]{1,39}")


class _Frame:
    """An open element: its name, its text as far as a caption could hold it, and its latest children's."""

    __slots__ = ("name", "said", "recent")

    def __init__(self, name: str):
        self.name, self.said, self.recent = name, "", deque(maxlen=CAPTION_SIBLINGS)

    def say(self, text: str) -> None:
        if len(self.said) <= CAPTION_CHARS:
            self.said += text[:CAPTION_CHARS + 1]

    def captions(self) -> list[str]:
        return [s for s in self.recent if s and len(s) <= CAPTION_CHARS and not BARE_ID.fullmatch(s)]


class PageReader(HTMLParser):
    """Collects ``strings`` (all text nodes) and ``segments``: (kind, text) in document order.

    Prose is one whitespace-collapsed line per text node. An outermost table is one segment: captions in front,
    then ``a | b`` per row that has any text; a cell belongs to every row open around it. ``head`` gives no segments.
    """

    def __init__(self, dropped=()):
        super().__init__(convert_charrefs=True)
        self.dropped = frozenset(dropped)
        self.strings: list[str] = []
        self.segments: list[tuple[str, str]] = []
        self._frames = [_Frame("")]
        self._scopes = [Counter()]  # open names since the page or each open table began
        self._open = Counter()
        self._muted: tuple[str, int] | None = None  # dropped element and how often it is open
        self._pending: list[str] = []  # parts of one text node
        self._prose: list[str] = []
        self._captions: list[str] = []
        self._rows: list[list[list[str]]] = []  # of the outermost table
        self._open_rows: list[list[list[str]]] = []
        self._open_cells: list[list[str]] = []

    # ---- parser events

    def handle_data(self, data):
        if self._muted is None:
            self._pending.append(data)

    def handle_starttag(self, tag, attrs):
        self._end_string()
        if self._muted is not None:
            name, times = self._muted
            self._muted = (name, times + (tag == name))
        elif tag in self.dropped:
            self._muted = (tag, 1)
        else:
            while any(self._scopes[-1][name] for name in CLOSES.get(tag, ())):
                self._pop()
            if tag in VOID:
                self._frames[-1].recent.append("")
            else:
                self._push(tag)

    def handle_startendtag(self, tag, attrs):
        self._end_string()
        if self._muted is None and tag not in self.dropped:
            self._frames[-1].recent.append("")

    def handle_endtag(self, tag):
        self._end_string()
        if self._muted is not None:
            name, times = self._muted
            times -= tag == name
            self._muted = (name, times) if times else None
        elif self._scopes[-1][tag] or (self._open[tag] and tag not in HELD_BY_TABLE):
            while self._pop() != tag:
                pass

    def handle_comment(self, data):
        self._end_string()

    def handle_decl(self, decl):
        self._end_string()

    def handle_pi(self, data):
        self._end_string()

    def unknown_decl(self, data):
        self._end_string()

    def close(self):
        super().close()
        self._end_string()
        while len(self._frames) > 1:
            self._pop()
        self._end_prose()

    # ---- what they mean

    def _end_string(self) -> None:
        text, self._pending = "".join(self._pending), []
        if not text:
            return
        self.strings.append(text)
        self._frames[-1].say(text.strip())
        self._frames[-1].recent.append("")
        for cell in self._open_cells:
            cell.append(text)
        line = " ".join(text.split())
        if line and not self._open["table"] and not self._open["head"]:
            self._prose.append(line)

    def _end_prose(self) -> None:
        if self._prose:
            self.segments.append(("prose", "\n".join(self._prose)))
            self._prose = []

    def _push(self, tag: str) -> None:
        if tag == "table":
            if not self._open["table"] and not self._open["head"]:
                self._end_prose()
                self._captions = [c for f in self._frames[-2:] for c in f.captions()]
            self._scopes.append(Counter())
        elif tag == "tr" and self._open["table"]:
            row: list[list[str]] = []
            self._rows.append(row)
            self._open_rows.append(row)
        elif tag in ("td", "th") and self._open["table"]:
            cell: list[str] = []
            for row in self._open_rows:
                row.append(cell)
            self._open_cells.append(cell)
        # a table counts as open in the scope around it
        self._scopes[-2 if tag == "table" else -1][tag] += 1
        self._open[tag] += 1
        self._frames.append(_Frame(tag))

    def _pop(self) -> str:
        frame = self._frames.pop()
        name = frame.name
        self._frames[-1].say(frame.said)
        self._frames[-1].recent.append(frame.said)
        if name == "table":
            self._scopes.pop()
        self._scopes[-1][name] -= 1
        self._open[name] -= 1
        if name == "tr" and self._open_rows:
            self._open_rows.pop()
        elif name in ("td", "th") and self._open_cells:
            self._open_cells.pop()
        elif name == "table" and not self._open["table"]:
            self._end_table()
        return name

    def _end_table(self) -> None:
        texts = [[" ".join(" ".join(cell).split()) for cell in row] for row in self._rows]
        lines = [" | ".join(row) for row in texts if any(row)]
        if lines and not self._open["head"]:
            self.segments.append(("table", "\n".join([*self._captions, *lines])))
        self._rows, self._open_rows, self._open_cells = [], [], []


def read_page(html: str | None, dropped=()) -> PageReader:
    """The page as read; a null page is an empty one."""
    page = PageReader(dropped)
    page.feed(html or "")
    page.close()
    return page
