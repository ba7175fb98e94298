"""The element tree of captured HTML, built by the insertion rules of the HTML standard.

The standard library's tokenizer feeds a stack of open elements: html, head and body are implied; start tags end paragraphs,
items, options, rows and cells that they cannot stand in; text and elements that a table cannot hold go before it; formatting
elements that are closed out of turn are opened again where the text goes on. Elements are open as deep as they are nested,
and nothing here or later recurses, so no text leaves its element. Broken markup never fails a job.

Left out: frames, quirks mode, templates as documents of their own, and what only scripts can see. Tags in a title are elements
there, so that a title is its text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
RAW = frozenset("textarea iframe noembed noframes xmp".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr li dd dt listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
BLOCK_ENDS = (ENDS_P | frozenset(["button"])) - HEADINGS - frozenset("hr li dd dt p plaintext table xmp".split())
SECTIONS = frozenset("tbody tfoot thead".split())
CELLS = frozenset(["td", "th"])
TABLE_PARTS = SECTIONS | CELLS | frozenset("caption col colgroup tr".split())
MARKED = frozenset("applet marquee object".split())
SPECIAL = ENDS_P | HEAD | RAW | TABLE_PARTS | MARKED | VOID - frozenset(["keygen"]) | frozenset("body button colgroup frameset head html select template".split())
SCOPE = frozenset("applet caption html marquee object table td template th foreignobject desc".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
FOREIGN = frozenset(["svg", "math"])
FOREIGN_TEXT = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
LEAVES_FOREIGN = HEADINGS | frozenset("b big blockquote body br center code dd div dl dt em embed head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())

HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!important\s*)?(?:;|$)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "open")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children, self.open = tag, attrs, parent, [], False

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """This element and those below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def inside(self, tags) -> bool:
        return any(node.tag in tags for node in self.ancestors())

    def hidden(self) -> bool:
        return "hidden" in self.attrs or self.attrs.get("aria-hidden") == "true" or bool(HIDDEN_STYLE.search(self.attrs.get("style", "")))


class Builder(HTMLParser):
    """root: the document; deepest: how many elements were open at most, html being the first."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {})
        self.html = self._below(self.root, "html", {})
        self.head = self.body = None
        self.stack, self.count, self.formatting, self.deepest = [], Counter(), [], 1
        self._push(self.html)

    # -- the stack and the tree

    @staticmethod
    def _below(parent: Node, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs, parent)
        parent.children.append(node)
        return node

    @staticmethod
    def _detach(node: Node) -> None:
        siblings = node.parent.children if node.parent is not None else []
        for k in range(len(siblings) - 1, -1, -1):  # the newest are last
            if siblings[k] is node:
                del siblings[k]
                return

    def _push(self, node: Node) -> None:
        self.stack.append(node)
        self.count[node.tag] += 1
        node.open = True
        self.deepest = max(self.deepest, len(self.stack))

    def _pop(self) -> Node:
        node = self.stack.pop()
        self.count[node.tag] -= 1
        node.open = False
        return node

    def _close(self, node: Node) -> None:
        """Take an element from the middle of the stack."""
        self.stack.remove(node)
        self.count[node.tag] -= 1
        node.open = False

    def _pop_through(self, tags) -> None:
        while self._pop().tag not in tags:
            pass

    def _in_scope(self, tags, more=frozenset()) -> bool:
        if not any(self.count[t] for t in tags):
            return False
        for node in reversed(self.stack):
            if node.tag in tags:
                return True
            if node.tag in SCOPE or node.tag in more:
                return False
        return False

    def _imply(self, but: str = "") -> None:
        while self.stack[-1].tag in IMPLIED and self.stack[-1].tag != but:
            self._pop()

    def _end_p(self) -> None:
        if self._in_scope(("p",), ("button",)):
            self._imply("p")
            self._pop_through(("p",))

    def _place(self, parent: Node) -> tuple[Node, int | None]:
        """Where something for ``parent`` is inserted: what a table cannot hold stands before it."""
        if not (self.fostering and (parent.tag == "table" or parent.tag in SECTIONS or parent.tag == "tr")):
            return parent, None
        table = next(n for n in reversed(self.stack) if n.tag == "table")
        if table.parent is None:
            return self.stack[self.stack.index(table) - 1], None
        siblings = table.parent.children
        return table.parent, next(k for k in range(len(siblings) - 1, -1, -1) if siblings[k] is table)

    fostering = False

    def _put(self, what, parent: Node) -> None:
        where, at = self._place(parent)
        if isinstance(what, Node):
            what.parent = where
        where.children.insert(len(where.children) if at is None else at, what)

    def _insert(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self._put(node, self.stack[-1])
        if tag not in VOID:
            self._push(node)
        return node

    def _ensure_body(self, attrs: dict[str, str] | None = None) -> None:
        if self.body is None:
            while len(self.stack) > 1:
                self._pop()
            self.body = self._below(self.html, "body", attrs or {})
            self._push(self.body)

    # -- formatting elements

    def _reopen(self) -> None:
        """Open the formatting elements again that were closed only because what held them was."""
        at = len(self.formatting)
        while at and self.formatting[at - 1] is not None and not self.formatting[at - 1].open:
            at -= 1
        for k in range(at, len(self.formatting)):
            old = self.formatting[k]
            self.formatting[k] = self._insert(old.tag, dict(old.attrs))

    def _remember(self, node: Node) -> None:
        same = []
        for other in reversed(self.formatting):
            if other is None:
                break
            if other.tag == node.tag and other.attrs == node.attrs:
                same.append(other)
        if len(same) >= 3:
            self.formatting.remove(same[-1])
        self.formatting.append(node)

    def _forget_to_marker(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def _adopt(self, tag: str) -> None:
        """The end of a formatting element, wherever it stands: blocks that it opened around keep their own copy."""
        if self.stack[-1].tag == tag and self.stack[-1] not in self.formatting:
            self._pop()
            return
        for _ in range(8):
            since = next((k + 1 for k in range(len(self.formatting) - 1, -1, -1) if self.formatting[k] is None), 0)
            own = next((n for n in reversed(self.formatting[since:]) if n.tag == tag), None)
            if own is None:
                self._end_other(tag)
                return
            if not own.open:
                self.formatting.remove(own)
                return
            if not self._in_scope((tag,)):
                return
            at = self.stack.index(own)
            block = next((n for n in self.stack[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                while self._pop() is not own:
                    pass
                self.formatting.remove(own)
                return
            outer, mark = self.stack[at - 1], self.formatting.index(own)
            last, k, turn = block, self.stack.index(block), 0
            while True:
                k, turn = k - 1, turn + 1
                node = self.stack[k]
                if node is own:
                    break
                if turn > 3 and node in self.formatting:
                    mark -= self.formatting.index(node) < mark
                    self.formatting.remove(node)
                if node not in self.formatting:
                    self._close(node)
                    continue
                copy = Node(node.tag, dict(node.attrs))
                copy.open, node.open = True, False
                self.stack[k] = copy
                place = self.formatting.index(node)
                self.formatting[place] = copy
                if last is block:
                    mark = place + 1
                self._detach(last)
                last.parent = copy
                copy.children.append(last)
                last = copy
            self._detach(last)
            was, self.fostering = self.fostering, True
            self._put(last, outer)
            self.fostering = was
            copy = Node(own.tag, dict(own.attrs), block)
            copy.children, block.children = block.children, [copy]
            for child in copy.children:
                if isinstance(child, Node):
                    child.parent = copy
            mark -= self.formatting.index(own) < mark
            self.formatting.remove(own)
            self.formatting.insert(mark, copy)
            self._close(own)
            self.stack.insert(self.stack.index(block) + 1, copy)
            self.count[copy.tag] += 1
            copy.open = True

    # -- tokens

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<![", i):  # of any name, as in HTML: a comment up to the next >
            return self.parse_bogus_comment(i, report=0)
        return super().parse_html_declaration(i)

    def handle_startendtag(self, tag, attrs):
        foreign = self._foreign() or tag in FOREIGN
        before = self.stack[-1]
        self.handle_starttag(tag, attrs)
        if foreign and self.stack[-1] is not before and self.stack[-1].tag == tag:
            self._pop()
        if tag in ("script", "style"):  # no text follows as the tokenizer takes it
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if self.stack[-1].tag in RAW:
            self.stack[-1].children.append(self.get_starttag_text() or "")
            return
        if tag in ("html", "head") or tag == "body" and self.body is not None:
            if tag == "head" and self.head is None and self.body is None:
                self._ensure_head()
            known = {"html": self.html, "head": self.head, "body": self.body}[tag]
            if known is not None:
                known.attrs.update({k: v for k, v in attrs.items() if k not in known.attrs})
            return
        if self.body is None and self.count["title"] and tag not in ("body", "div", "main"):
            self._insert(tag, attrs)
            return
        if self.body is None and tag in HEAD:
            self._ensure_head()
            self._insert(tag, attrs)
            return
        self._ensure_body(attrs if tag == "body" else None)
        if tag not in ("body", "frame", "frameset"):
            self._start("img" if tag == "image" else tag, attrs)

    def _ensure_head(self) -> None:
        if self.head is None:
            self.head = self._below(self.html, "head", {})
        if self.stack == [self.html]:
            self._push(self.head)

    def _foreign(self) -> bool:
        if not (self.count["svg"] or self.count["math"]):
            return False
        for node in reversed(self.stack):
            if node.tag in FOREIGN:
                return True
            if node.tag in FOREIGN_TEXT or node.tag in SPECIAL:
                return False
        return False

    def _context(self) -> Node | None:
        """The innermost table, part of a table, or select that is open."""
        if not (self.count["table"] or self.count["select"]):
            return None
        return next((n for n in reversed(self.stack) if n.tag == "table" or n.tag in TABLE_PARTS or n.tag in ("select", "template")), None)

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if self._foreign():
            if tag not in LEAVES_FOREIGN and not (tag == "font" and {"color", "face", "size"} & {*attrs}):
                self._insert(tag, attrs)
                return
            while self._foreign():
                self._pop()
        context = self._context()
        kind = context.tag if context is not None else ""
        if kind == "select":
            if tag in ("option", "optgroup", "hr"):
                while self.stack[-1] is not context and (self.stack[-1].tag == "option" or tag != "option"):
                    self._pop()
                self._insert(tag, attrs)
            elif tag in ("select", "input", "keygen", "textarea") or tag in TABLE_PARTS or tag == "table":
                self._pop_through(("select",))
                if tag != "select":
                    self._start(tag, attrs)
            elif tag in ("script", "template"):
                self._insert(tag, attrs)
            return
        if kind == "table" or kind in SECTIONS or kind == "tr":
            if tag in TABLE_PARTS:
                self._table_part(tag, attrs, context)
            elif tag == "table":
                self._pop_through(("table",))
                self._start(tag, attrs)
            elif tag in ("script", "style", "template") or tag == "input" and attrs.get("type", "").lower() == "hidden":
                self._insert(tag, attrs)
            elif tag == "form":
                self._insert(tag, attrs)
                self._pop()
            else:
                self.fostering = True
                self._in_body(tag, attrs)
                self.fostering = False
            return
        if tag in TABLE_PARTS:
            if kind == "colgroup" and tag == "col":
                self._insert(tag, attrs)
            elif kind in CELLS or kind in ("caption", "colgroup"):
                self._pop_through((kind,))
                if kind != "colgroup":
                    self._forget_to_marker()
                self._start(tag, attrs)
            return  # elsewhere such a tag means nothing
        if kind == "colgroup" and self.stack[-1] is context:
            self._pop()
            self._start(tag, attrs)
            return
        self._in_body(tag, attrs)

    def _table_part(self, tag: str, attrs: dict[str, str], context: Node) -> None:
        wanted = {"tr": "section", "td": "tr", "th": "tr", "col": "colgroup"}.get(tag, "table")
        while self.stack[-1] is not context:
            self._pop()
        kind = "section" if context.tag in SECTIONS else context.tag
        if kind == wanted:
            node = self._insert(tag, attrs)
            if tag in CELLS or tag == "caption":
                self.formatting.append(None)
            return node
        below = {"table": {"section": "tbody", "tr": "tbody", "colgroup": "colgroup"}, "section": {"tr": "tr"}}.get(kind, {}).get(wanted)
        if below:
            self._insert(below, {})
        else:
            self._pop()
        return self._start(tag, attrs)

    def _in_body(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("li", "dd", "dt"):
            same = ("li",) if tag == "li" else ("dd", "dt")
            if any(self.count[t] for t in same):
                for node in reversed(self.stack):
                    if node.tag in same:
                        self._imply(node.tag)
                        self._pop_through((node.tag,))
                        break
                    if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                        break
        if tag in ENDS_P:
            self._end_p()
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._pop()
        elif tag == "button" and self._in_scope(("button",)):
            self._imply()
            self._pop_through(("button",))
        elif tag == "a" and any(n is not None and n.tag == "a" for n in self._since_marker()):
            self._adopt("a")
            self.formatting = [n for n in self.formatting if n is None or n.tag != "a" or n not in self._since_marker()]
        elif tag == "nobr" and self._in_scope(("nobr",)):
            self._adopt("nobr")
        elif tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self._pop()
        if tag not in ENDS_P and tag not in HEAD and tag not in ("param", "source", "track"):
            self._reopen()
        node = self._insert(tag, attrs)
        if tag in FORMATTING:
            self._remember(node)
        elif tag in MARKED:
            self.formatting.append(None)

    def _since_marker(self) -> list[Node]:
        out = []
        for node in reversed(self.formatting):
            if node is None:
                break
            out.append(node)
        return out

    def handle_endtag(self, tag):
        if self.stack[-1].tag in RAW and tag != self.stack[-1].tag:
            self.stack[-1].children.append(f"</{tag}>")
            return
        if tag in ("html", "body", "head"):
            if tag == "head" and self.stack[-1] is self.head:
                self._pop()
            return
        if self.body is None:
            if self.count[tag] and self.stack[-1] is not self.head:
                self._pop_through((tag,))
            elif tag in ("br", "p"):
                self._ensure_body()
                self._end(tag)
            return
        self._end(tag)

    def _end(self, tag: str) -> None:
        context = self._context()
        if context is not None and context.tag == "select" and tag not in TABLE_PARTS and tag != "table":
            if tag == "select":
                self._pop_through(("select",))
            elif tag in ("option", "optgroup") and self.count[tag]:
                if tag == "optgroup" and self.stack[-1].tag == "option" and self.stack[-2].tag == "optgroup":
                    self._pop()
                if self.stack[-1].tag == tag:
                    self._pop()
            return
        if tag == "table" or tag in TABLE_PARTS:
            if context is not None and self._in_table_scope(tag):
                while self.stack[-1].tag != tag:
                    if self._pop().tag in CELLS | {"caption"}:
                        self._forget_to_marker()
                self._pop()
                if tag in CELLS or tag == "caption":
                    self._forget_to_marker()
            return
        if tag == "p":
            if not self._in_scope(("p",), ("button",)):
                self._in_body("p", {})
            self._end_p()
        elif tag == "br":
            self._in_body("br", {})
        elif tag in FORMATTING:
            self._adopt(tag)
        elif tag in ("li", "dd", "dt") or tag in BLOCK_ENDS or tag in HEADINGS or tag in MARKED:
            ends = HEADINGS if tag in HEADINGS else (tag,)
            if self._in_scope(ends, ("ol", "ul") if tag == "li" else ()):
                self._imply(tag)
                self._pop_through(ends)
                if tag in MARKED:
                    self._forget_to_marker()
        else:
            self._end_other(tag)

    def _in_table_scope(self, tag: str) -> bool:
        if not self.count[tag]:
            return False
        return next(n.tag for n in reversed(self.stack) if n.tag in (tag, "table", "template", "html")) == tag

    def _end_other(self, tag: str) -> None:
        if not self.count[tag]:
            return
        for node in reversed(self.stack):
            if node.tag == tag:
                self._imply(tag)
                while self._pop() is not node:
                    pass
                return
            if node.tag in SPECIAL:
                return

    def handle_data(self, data):
        if self.body is None:
            if self.stack[-1] is not self.html and self.stack[-1] is not self.head:
                self.stack[-1].children.append(data)
                return
            data = data.lstrip(" \t\n\r\f")
            if not data:
                return
            self._ensure_body()
        if self.stack[-1].tag in RAW or self.stack[-1].tag in ("script", "style"):
            self.stack[-1].children.append(data)
            return
        context = self._context()
        outside = context is not None and self.stack[-1] is context and (context.tag == "table" or context.tag in SECTIONS or context.tag == "tr")
        if outside and data.strip(" \t\n\r\f"):
            self.fostering = True
            self._reopen()
            self._put(data, self.stack[-1])
            self.fostering = False
        elif outside or self._foreign():
            self.stack[-1].children.append(data)
        else:
            self._reopen()
            self.stack[-1].children.append(data)


#: Python converts no decimal number of more than 4300 digits.
LONG_REFERENCE = re.compile(r"&#[0-9]{4000,}")


def _short_reference(m: re.Match) -> str:
    digits = m[0][2:].lstrip("0") or "0"
    return "&#" + (digits if len(digits) < 8 else "1114112")


def built(html: str) -> Builder:
    builder = Builder()
    builder.feed(LONG_REFERENCE.sub(_short_reference, html))
    builder.close()
    builder._ensure_body()
    return builder
