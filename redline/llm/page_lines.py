"""Lines of a web page in one scan: every block of text, with what its markup says about it.

A scanner walks from tag to tag; inline elements do not break a block, all others do. It keeps a stack of the open
block elements (and of inline ones that are marked as something else than text), so memory follows nesting depth.
"""

from __future__ import annotations

import html
import re

# Element and role names of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark meter nobr output "
                   "picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var "
                   "wbr".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
        "tr": ("td", "th", "tr"), "option": ("option",)}
SCOPES = frozenset("table td th html body".split())
MUTED = frozenset("applet aside audio button canvas datalist dialog fieldset footer form frameset head header input label legend "
                  "map menu nav noscript object optgroup option search select svg template video".split())
MUTED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status "
                        "tablist toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Words of class and id names that mark a part as something else than the article.
OTHER = frozenset("ad ads adbox adslot advert adverts advertisement advertisements advertising advertorial alert banner banners "
                  "breadcrumb breadcrumbs comment commentlist comments consent cookie cookies discussion disqus footer gdpr "
                  "header login masthead menu menus modal nav navbar navigation navigator newsletter notice notices "
                  "notification overlay pager pagination paywall popup promo promos promotion recommended related replies "
                  "reply respond responses search share sharing sidebar sidenav signup skip social sponsor sponsored "
                  "sponsors subscribe subscription teaser teasers toolbar topbar widget widgets".split())
SAVING = frozenset("free has hide is no not off with without".split())
PROPER = frozenset("articlebody articlecontent articletext entrycontent maincontent postbody postcontent storybody".split())

_TAG_END = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_NAMED = re.compile(r"(?:class|id|role|hidden|style|itemprop|aria-hidden)\b", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_names: dict[str, tuple[bool, bool]] = {}


def named(value: str) -> tuple[bool, bool]:
    """(marks something else, marks the article's own text) of the value of a class or id attribute."""
    if value not in _names:
        if len(_names) > 20_000:
            _names.clear()
        other = proper = False
        for name in value.split():
            words = [w.lower() for w in _WORD.findall(name)]
            if words and not SAVING.intersection(words):
                other |= words[0] in OTHER or words[-1] in OTHER
                proper |= "".join(words) in PROPER
        _names[value] = other, proper and not other
    return _names[value]


def judge_tag(name: str, attributes: str) -> tuple[bool, bool]:
    """(muted, part of the article) of an opening tag."""
    muted, proper = name in MUTED, name in ("article", "main")
    if attributes and _NAMED.search(attributes):
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if key in ("class", "id"):
                other, own = named(value)
                muted |= other and name not in ("html", "body", "main", "article")
                proper |= own
            elif key == "role":
                muted |= value.lower() in MUTED_ROLES
                proper |= value.lower() in ("main", "article")
            elif key == "itemprop":
                proper |= value.lower() == "articlebody"
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (
                    key == "style" and _HIDING.search(value)):
                muted = True
    return muted, proper and not muted


class _Scan:
    """State of one page: the open elements and the block being read."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, bool, bool]] = []  # text, muted or only links, in the article
        self.stack: list[tuple[str, bool, bool]] = []  # name, muted, in the article; both as inherited
        self.parts: list[str] = []
        self.linked = 0
        self.in_link = False
        self.muted = self.proper = False

    def say(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.parts.append(text)
        if self.in_link:
            self.linked += len(text.strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                menu = not self.proper and 5 * self.linked >= 4 * len(text)
                self.lines.append((text, self.muted or menu, self.proper))
            self.parts, self.linked = [], 0

    def push(self, name: str, attributes: str) -> None:
        muted, proper = judge_tag(name, attributes)
        if name in HEADINGS and self.stack and self.stack[-1][0] == "header" and self.proper and not muted:
            self.stack.append((name, False, True))  # a title in the article's own header
            self.muted = False
            return
        if name == "header" and self.proper and not self.muted:
            self.stack.append((name, True, True))
            self.muted = True
            return
        self.muted |= muted
        self.proper = (self.proper or proper) and not self.muted
        self.stack.append((name, self.muted, self.proper))

    def cut(self, depth: int) -> None:
        del self.stack[depth:]
        _, self.muted, self.proper = self.stack[-1] if self.stack else ("", False, False)

    def close(self, names: tuple[str, ...], scoped: bool) -> bool:
        """End the innermost open element of these names, and what is open inside it."""
        for depth in range(len(self.stack) - 1, -1, -1):
            name = self.stack[depth][0]
            if name in names:
                self.cut(depth)
                return True
            if scoped and name in SCOPES:
                return False
        return False

    def start(self, name: str, attributes: str) -> None:
        if name == "a":
            self.in_link = True
        if name in INLINE:
            if name == "br":
                self.say(" ")
            elif name not in VOID and attributes and judge_tag(name, attributes)[0]:
                self.flush()
                self.push(name, attributes)
            elif self.stack and self.stack[-1][0] == name:
                self.stack.append((name, self.muted, self.proper))  # inside a marked one of its name
            return
        self.flush()
        self.in_link = False
        if self.stack and name not in ("meta", "link", "base", "script", "style", "title", "noscript", "template"):
            self.close(("head",), False)
        if name in ENDS_P:
            self.close(("p",), True)
        for other in ENDS.get(name, ()):
            self.close((other,), other != "li" or any(s[0] in ("ul", "ol") for s in self.stack[-1:]))
        if name not in VOID:
            self.push(name, attributes)

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if name in INLINE:
            if self.stack and self.stack[-1][0] == name:
                self.flush()
                self.cut(len(self.stack) - 1)
            return
        self.flush()
        self.close((name,), name not in SCOPES)


def scan(page: str) -> list[tuple[str, bool, bool]]:
    """(text, muted, inside the article) of every block of a page, in page order.

    Muted are menus, headers, footers, sidebars, notices, adverts, forms, comments and blocks that are links only.
    Scripts, styles, titles and markup give no blocks. Unclosed comments and raw elements reach to the end of the page.
    """
    state, at, size = _Scan(), 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            state.say(page[at:])
            break
        if lt > at:
            state.say(page[at:lt])
        nxt = page[lt + 1:lt + 2]
        if nxt == "!" and page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)  # also <!--> and <!--->
            at = size if end < 0 else end + 3
        elif nxt in ("!", "?"):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
        elif nxt.isascii() and nxt.isalpha() or (nxt == "/" and page[lt + 2:lt + 3].isascii()
                                                 and page[lt + 2:lt + 3].isalpha()):
            begin = lt + 1 + (nxt == "/")
            gt = page.find(">", begin)
            if gt >= 0 and "=" in page[begin:gt]:
                m = _TAG_END.match(page, begin)
                gt = m.end() - 1 if m else gt
            if gt < 0:
                break
            body = page[begin:gt]
            name, _, attributes = body.replace("/", " ").partition(" ") if " " not in body and "/" in body else (
                body.partition(" "))
            name = name.split(None, 1)[0].rstrip("/").lower()
            at = gt + 1
            if nxt == "/":
                state.end(name)
            elif name in RAW:
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
                at = end.start() if end else size
                state.flush()
            elif name == "svg" and body.endswith("/"):
                state.flush()
            else:
                state.start(name, body[len(name):])
        else:
            state.say("<")
            at = lt + 1
    state.flush()
    return state.lines
