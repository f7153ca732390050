"""Blocks of text of a web page, each with the path of elements it stands in."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements inside a line of text; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not shown as part of the page's text.
SILENT = frozenset("button canvas datalist head iframe noscript object option script select style svg template textarea title".split())
#: Elements whose inside is no markup.
RAW = frozenset("script style textarea title iframe noscript template svg".split())
#: Elements that may stand in the head; any other, or text, ends a head left open.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: An opening tag of the first kind ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*|[^>]*)>|<[/A-Za-z!?][^>]*\Z|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: The end of a raw element, found in the page itself: lower-casing a text may change its length.
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
#: A slash at the end of a tag that is not part of an unquoted value.
VALUE_WITH_SLASH = re.compile(r"=\s*[^\s\"'>]+/\Z")
PART = re.compile(r"[a-z]+|\d+")
BEFORE_HTML_BLOCK_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@dataclass
class Block:
    """Text with single blanks, the tokens of its path, characters inside links, and a label in training pages."""

    text: str
    path: tuple[str, ...]
    linked: int
    label: int | None = None


@dataclass
class _Open:
    tag: str
    tokens: tuple[str, ...]
    label: int | None


@dataclass
class _Page:
    labelled: bool = True
    stack: list[_Open] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    silent: int = 0
    where: tuple[tuple[str, ...], int | None] | None = None

    def end_head(self) -> None:
        """Close a head that is still open; its end tag may be left out."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == "head":
                while len(self.stack) > i:
                    self.pop()
                return

    def text(self, raw: str) -> None:
        if self.stack and self.stack[-1].tag == "head" and raw.strip():
            self.end_head()
        if self.silent:
            return
        shown = html.unescape(raw) if "&" in raw else raw
        if shown.strip() and self.where is None:
            label = next((o.label for o in reversed(self.stack) if o.label is not None), None)
            self.where = tuple(t for o in self.stack for t in o.tokens), label
        self.parts.append(shown)
        if self.links:
            self.linked += len(shown.strip())

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and self.where:
            self.blocks.append(Block(text, self.where[0], min(self.linked, len(text)), self.where[1]))
        self.parts, self.linked, self.where = [], 0, None

    def open(self, tag: str, attributes: str) -> None:
        if self.silent and tag not in IN_HEAD:
            self.end_head()
        # What is not shown cuts no block, nor does what stands in it.
        if tag not in INLINE and tag not in SILENT and not self.silent:
            self.flush()
            if tag in BEFORE_HTML_BLOCK_ENDS:
                # A paragraph, and inline elements left open in it, end where a block begins.
                while self.stack and (self.stack[-1].tag == "p" or self.stack[-1].tag in INLINE and self.stack[-1].tag not in ("td", "th")):
                    self.pop()
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag in ENDS:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].tag in ENDS[tag]:
                    if self.silent and not any(o.tag in SILENT for o in self.stack[: i + 1]):
                        self.flush()
                    while len(self.stack) > i:
                        self.pop()
                    break
                if self.stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag in VOID:
            return
        tokens, label = [tag], None
        if attributes:
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                value = (a or b or c).lower()
                if name.lower() == "data-y":
                    label = int(value) if self.labelled and value in ("0", "1") else label
                else:
                    tokens.extend(PART.findall(value))
        self.stack.append(_Open(tag, tuple(tokens), label))
        self.links += tag == "a"
        self.silent += tag in SILENT

    def pop(self) -> None:
        tag = self.stack.pop().tag
        self.links -= tag == "a"
        self.silent -= tag in SILENT

    def close(self, tag: str) -> None:
        if tag not in INLINE and tag not in SILENT and not self.silent:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                if self.silent and tag not in INLINE and not any(o.tag in SILENT for o in self.stack[: i + 1]):
                    self.flush()  # the end of a block in which something not shown was left open
                while len(self.stack) > i:
                    self.pop()
                return
            # The end of an inline element does not end blocks opened in it.
            if tag in INLINE and self.stack[i].tag not in INLINE:
                return


def blocks(page: str | None, labelled: bool = True) -> list[Block]:
    """Blocks in page order; none of a null or empty page. Broken markup is read as far as it goes.

    `labelled` pages are those composed for training, whose data-y is a label; of given pages it says nothing.
    """
    if not page:
        return []
    state, at, n = _Page(labelled), 0, len(page)
    while at < n:
        m = PIECE.match(page, at)
        if m is None:  # a tag that never ends
            state.text(page[at : at + 1])
            at += 1
            continue
        at = m.end()
        if m.group(5) is not None:
            state.text(m.group(5))
        elif m.group(1) is not None:
            state.text(m.group(1))
        elif m.group(3):
            tag = m.group(3).lower()
            if m.group(2):
                state.close(tag)
                continue
            alone = m.group(4).endswith("/") and not VALUE_WITH_SLASH.search(m.group(4))
            state.open(tag, m.group(4))
            if tag == "svg" and alone:
                state.close(tag)
            elif tag in RAW and not alone:
                end = RAW_END[tag].search(page, at)
                at = end.start() if end else n
    state.flush()
    return state.blocks
