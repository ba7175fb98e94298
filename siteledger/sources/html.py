"""One parse pass over captured HTML, to a struct of everything that later jobs select from.

The tree is built by the rules of the HTML standard (see tree.py). Nothing is cut: pages of over MAX_BLOCKS blocks or
MAX_DEPTH levels are worked out whole and say so in ``limits``. Broken markup never fails a job; null HTML gives an
empty parse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siteledger.sources import jsonld
from siteledger.sources.tree import HEADINGS, Node, built

SKIPPED_SCHEMES = ("data:", "javascript:", "mailto:", "tel:", "blob:")
# Elements that are no content, and those that the ordered walk takes as containers or whole.
HIDDEN = frozenset("script style noscript template iframe frame object embed svg math".split())
CONTROLS = frozenset("button input select textarea".split())
CONTAINERS = frozenset("div section article main aside header footer address dl dt dd figure figcaption details summary".split())
WHOLE = HEADINGS | frozenset("p ul ol table blockquote".split())
PURCHASE = re.compile(r"(?:купить|в\s+корзину|добавить\s+в\s+корзину|заказать|buy|add\s+to\s+cart|order)", re.I)
MAX_BLOCKS, MAX_DEPTH = 10_000, 200
#: Where a batch of pages between Spark and Python ends.
BATCH = "8m"
WIDE = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
FILE_LINK = re.compile(r"\.(?:pdf|docx?|xlsx?|zip|jpe?g|png|gif|webp|avif|svg|mp4|webm)$", re.I)

LINK = "struct<ord:int,href:string,tag:string,label:string,role:string,action_control:boolean,fragment_only:boolean>"
BLOCK = "struct<ord:int,type:string,text:string,level:int,items:array<string>,rows:array<array<string>>,source:string,alt:string>"
ORDERED = "struct<ord:int,type:string,text:string,level:int,items:array<string>,rows:array<array<string>>,href:string,source:string,within:string>"
PAGE_LINK = "struct<ord:int,href:string,label:string,trail:int>"
# What names a breadcrumb trail.
TRAIL_CLASS, TRAIL_LABELS = "breadcrumb", ("breadcrumb", "Хлебные крошки")
FIELDS = {
    "title": "string",
    "description": "string",
    "canonical": "string",
    "base": "string",
    "lang": "string",
    "robots": "string",
    "h1": "array<string>",
    "links": f"array<{LINK}>",
    "media": "array<string>",
    "anchors": "array<string>",
    "headings": "array<struct<ord:int,level:int,text:string>>",
    "structured_data": "array<string>",
    "ld": f"array<{jsonld.NODE}>",
    "primary": "string",
    "blocks": f"array<{BLOCK}>",
    "ordered": f"array<{ORDERED}>",
    "page_links": f"array<{PAGE_LINK}>",
    "og_images": "array<string>",
    "site_names": "array<string>",
    "logos": "array<struct<ord:int,href:string,source:string,alt:string>>",
    "limits": "array<string>",
    "text": "string",
    "forms": "int",
    "search_forms": "int",
    "cart_controls": "int",
    "variant_controls": "int",
    "prices": "array<struct<ord:int,raw:string,role:string,currency:string,amount:string>>",
    "attributes": "array<struct<ord:int,name:string,value:string>>",
    "selections": "array<struct<ord:int,label:string,required:boolean,options:array<string>>>",
    "cards": "array<struct<ord:int,signature:string,href:string,label:string,image:string>>",
}


def text_of(top: Node, gone=HIDDEN, br: str = " ") -> str:
    """The text below an element as it stands, but for elements that are named in ``gone`` or listed in it."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.tag not in gone and node not in gone:
            todo.extend(reversed(node.children))
            if node.tag == "br":
                out.append(br)
    return "".join(out)


def plain(top: Node) -> str:
    return " ".join(text_of(top).split())


def _own(nodes, tag, **attrs):
    return (n for n in nodes if n.tag == tag and all(n.attrs.get(k, "").lower() == v for k, v in attrs.items()))


def _roles(root: Node) -> dict[Node, str]:
    """For each link what the nearest of the elements around it makes of it: navigation, heading, or nothing."""
    out, todo = {}, [(root, "")]
    while todo:
        node, around = todo.pop()
        if node.tag in ("a", "area", "link"):
            out[node] = around
        if node.tag in ("nav", "header", "footer") or node.attrs.get("role") == "navigation":
            around = "navigation"
        elif node.tag in HEADINGS:
            around = "heading"
        todo.extend((c, around) for c in node.elements())
    return out


# -- the primary region -------------------------------------------------------------------------------------


def inactive(region: Node, body_fallback: bool) -> set[Node]:
    """The topmost elements of a region that are no content: scripts, controls, what is hidden, navigation.

    Forms are content; their fields are not. A page's own header and footer count only inside a chosen region.
    """
    tags = HIDDEN | CONTROLS | {"nav", "aside"} | ({"header", "footer"} if body_fallback else set())
    out, todo = set(), region.elements()
    while todo:
        node = todo.pop()
        if node.tag in tags or node.hidden():
            out.add(node)
        else:
            todo.extend(node.elements())
    return out


def _usable(node: Node) -> bool:
    if node.hidden() or any(up.hidden() or up.tag in ("nav", "header", "footer", "aside") for up in node.ancestors()):
        return False
    gone = inactive(node, False)
    return bool(text_of(node, gone).strip(WIDE)) or any(n.tag == "img" for n in content(node, gone))


def content(region: Node, gone: set[Node]) -> Iterator[Node]:
    """The elements below a region that are content, in document order."""
    todo = [c for c in reversed(region.elements()) if c not in gone]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(c for c in reversed(node.elements()) if c not in gone)


def _primary(nodes: list[Node], body: Node) -> tuple[str, Node]:
    """The one usable main region, else a single article that holds the page's first h1, else the body."""
    for name, found in (
        ("main", [n for n in nodes if n.tag == "main"]),
        ("[role=main]", [n for n in nodes if n.attrs.get("role") == "main"]),
        *((f"#{i}", [n for n in nodes if n.attrs.get("id") == i]) for i in ("content", "main", "main-content")),
    ):
        usable = [n for n in found if _usable(n)]
        if len(usable) == 1:
            return name, usable[0]
    articles = [n for n in nodes if n.tag == "article" and _usable(n)]
    h1 = next((n for n in nodes if n.tag == "h1"), None)
    if len(articles) == 1 and (h1 is None or articles[0] in h1.ancestors()):
        return "article", articles[0]
    return "body", body


def _blocks(region: Node, gone: set[Node]) -> list[dict]:
    """Typed blocks in document order; text that stands in no such element is left to the ordered walk."""
    out: list[dict] = []

    def add(kind, text=None, **more):
        out.append({"ord": len(out), "type": kind, "text": text, "level": None, "items": None, "rows": None, "source": None, "alt": None} | more)

    todo = [region]
    while todo:
        node = todo.pop()
        if node in gone:
            continue
        if node.tag in HEADINGS:
            if text := plain(node):
                add("heading", text, level=int(node.tag[1]))
        elif node.tag in ("ul", "ol"):
            items = [t for c in node.elements() if c.tag == "li" and (t := plain(c))]
            if items:
                add("list", items=items)
        elif node.tag == "table":
            rows = [[plain(c) for c in r.elements() if c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
            if rows := [r for r in rows if r]:
                add("table", rows=rows)
        elif node.tag in ("blockquote", "p"):
            if text := plain(node):
                add("quote" if node.tag == "blockquote" else "paragraph", text)
            for n in node.walk():
                if n.tag == "img":
                    add("image", source=n.attrs.get("src"), alt=n.attrs.get("alt"))
        elif node.tag == "img":
            add("image", source=node.attrs.get("src"), alt=node.attrs.get("alt"))
        elif node.tag == "a" and FILE_LINK.search(node.attrs.get("href", "").split("?")[0]):
            add("document", plain(node), source=node.attrs.get("href"))
        else:
            todo.extend(reversed(node.elements()))
    return out


# -- the ordered walk ---------------------------------------------------------------------------------------


class Walk:
    """A region's content in document order, loose text included.

    Text and inline elements are joined to a run until a block begins; runs are paragraphs. Links of the site, cards (of
    repeated siblings with one heading link and one linked image), images and documents are blocks of their own. ``within``
    tells where a link stands: alone in a heading or paragraph, or nested in a block of text that already has its label.
    """

    def __init__(self, region: Node, gone: set[Node], base: str | None):
        self.gone, self.base, self.out = gone, base, []
        self.order = [region, *content(region, gone)]
        self.labels = {n: label for n in self.order if n.tag == "a" and (label := self._label(n)) is not None}
        # Elements below each of which a block stands, so that they are no part of a run.
        self.broken: set[Node] = set()
        for n in self.order:
            if n.tag in CONTAINERS or n.tag in WHOLE or n.tag == "img" or n.tag == "a" and "href" in n.attrs:
                for up in n.ancestors():
                    if up in self.broken:
                        break
                    self.broken.add(up)
        self.cards = self._cards()
        self._run(region)

    def _text(self, node: Node) -> str:
        return text_of(node, self.gone, "").strip(WIDE)

    def _label(self, node: Node) -> str | None:
        """A link's label (it may be empty), or null where the element is no link to a page of the site."""
        href = node.attrs.get("href")
        if href is None or any(k.startswith("on") for k in node.attrs) or node.attrs.get("role") == "button" or {"data-cart", "data-action"} & {*node.attrs}:
            return None
        target = href.strip(WIDE)
        if target.startswith("#") or target.lower().startswith(SKIPPED_SCHEMES) or FILE_LINK.search(re.split("[?#]", target)[0]):
            return None
        try:
            own, parts = urlsplit(self.base or ""), urlsplit(urljoin(self.base or "", target))
        except ValueError:
            return None
        if (parts.scheme, parts.netloc) != (own.scheme, own.netloc):
            return None
        text = self._text(node)
        images = [n for n in content(node, self.gone) if n.tag == "img"]
        return text or (images[0].attrs.get("alt", "").strip(WIDE) if len(images) == 1 else "")

    def _cards(self) -> dict[Node, dict]:
        """Cards by their element. What stands below each element is summed up once, from the leaves upwards."""
        heading, image = {}, {}
        for n in self.order:
            if n.tag == "a" and "href" in n.attrs and n.inside(HEADINGS):
                heading[n] = [n]
            elif n.tag == "img" and (a := next((u for u in n.ancestors() if u.tag == "a"), None)) in self.labels and n.attrs.get("src"):
                image[n] = {(a.attrs["href"], n.attrs["src"])}
        for n in reversed(self.order):
            links = [x for c in n.elements() for x in heading.get(c, ())]
            if links:
                heading[n] = (heading.get(n, []) + links)[:2]
            pictures = {x for c in n.elements() for x in image.get(c, ())}
            if pictures:
                image[n] = set(sorted(pictures)[:64])
        out = {}
        for n in self.order:
            alike: dict[str, list] = {}
            for c in n.elements():
                link = heading.get(c, ())
                if len(link) == 1 and self.labels.get(link[0]):
                    sources = {s for h, s in image.get(c, ()) if h == link[0].attrs["href"]}
                    if len(sources) == 1:
                        alike.setdefault(c.tag + ":" + ",".join(x.tag for x in c.elements()), []).append((c, link[0], *sources))
            for group in alike.values():
                if len(group) > 1:
                    out |= {c: {"text": self.labels[a], "href": a.attrs["href"], "source": s, "items": self._items(c)} for c, a, s in group}
        return out

    def _items(self, card: Node) -> list[str]:
        """The texts of a card but for its headings, images and purchase links."""
        out, run = [], []

        def flush():
            if text := "".join(run).strip(WIDE):
                out.append(text)
            run.clear()

        bare = self.gone | {n for n in content(card, self.gone) if n.tag in HEADINGS or n.tag == "img" or n.tag == "a" and PURCHASE.fullmatch(self._text(n))}
        blocks = {up for n in content(card, bare) if n.tag in CONTAINERS or n.tag in WHOLE for up in n.ancestors()}
        todo: list = [card]
        while todo:
            node = todo.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                run.append(node)
            elif node in bare:
                continue
            elif node.tag == "br":
                run.append("\n")
            elif node.tag in WHOLE or node.tag == "li":
                flush()
                out.extend([text] if (text := text_of(node, bare, "").strip(WIDE)) else [])
            elif node is card or node.tag in CONTAINERS or node in blocks:
                flush()
                todo += [None, *reversed(node.children)]
            else:
                run.append(text_of(node, bare, ""))
        flush()
        return out

    def _add(self, kind: str, text=None, **more) -> None:
        self.out.append({"ord": len(self.out), "type": kind, "text": text, "level": None, "items": None, "rows": None, "href": None, "source": None, "within": None} | more)

    def _link(self, node: Node, within: str | None = None, level: int | None = None) -> bool:
        if not self.labels.get(node):
            return False
        images = [n for n in content(node, self.gone) if n.tag == "img"]
        self._add("link", self.labels[node], href=node.attrs["href"], source=images[0].attrs.get("src") if len(images) == 1 else None, within=within, level=level)
        return True

    def _media(self, node: Node) -> bool:
        if node.tag == "img":
            self._add("image", node.attrs.get("alt"), source=node.attrs.get("src"))
        elif node.tag == "a" and FILE_LINK.search(re.split("[?#]", node.attrs.get("href", ""))[0]):
            self._add("document", self._text(node), source=node.attrs["href"])
        else:
            return False
        return True

    def _whole(self, node: Node) -> None:
        links = [n for n in content(node, self.gone) if n.tag == "a" and "href" in n.attrs]
        text = self._text(node)
        if (node.tag in HEADINGS or node.tag == "p") and len(links) == 1 and links[0] in self.labels and text == self._text(links[0]):
            if self._link(links[0], *(("paragraph",) if node.tag == "p" else ("heading", int(node.tag[1])))):
                return
        if node.tag in HEADINGS and text:
            self._add("heading", text, level=int(node.tag[1]))
        elif node.tag in ("p", "blockquote") and text:
            self._add("paragraph" if node.tag == "p" else "quote", text)
        elif node.tag in ("ul", "ol"):
            self._add("list", items=[self._text(c) for c in node.elements() if c.tag == "li" and c not in self.gone])
        elif node.tag == "table":
            rows, todo = [], list(reversed(node.elements()))
            while todo:  # not into tables in cells
                row = todo.pop()
                if row.tag == "tr":
                    rows.append([self._text(c) for c in row.elements() if c.tag in ("td", "th") and c not in self.gone])
                elif row.tag != "table" and row not in self.gone:
                    todo += reversed(row.elements())
            self._add("table", rows=rows)
        inside: set[Node] = set()
        for n in content(node, self.gone):
            if n.tag == "a" and "href" in n.attrs:
                if self._link(n, "nested"):
                    inside.add(n)
                else:
                    self._media(n)
            elif n.tag == "img" and not inside & {*n.ancestors()}:
                self._media(n)

    def _run(self, region: Node) -> None:
        run: list[str] = []

        def flush():
            if text := "".join(run).strip(WIDE):
                self._add("paragraph", text)
            run.clear()

        todo: list = [region]
        while todo:
            node = todo.pop()
            if node is None:  # a container ends
                flush()
            elif isinstance(node, str):
                run.append(node)
            elif node in self.gone:
                continue
            elif node.tag == "br":
                run.append("\n")
            elif node is not region and node.tag not in CONTAINERS | WHOLE | {"img"} and not (node.tag == "a" and "href" in node.attrs) and node not in self.broken:
                run.append(text_of(node, self.gone, ""))
            else:
                flush()
                if node in self.cards:
                    self._add("card", **self.cards[node])
                elif node.tag in WHOLE:
                    self._whole(node)
                elif not (node.tag == "a" and self._link(node)) and not self._media(node):
                    todo += [None, *reversed(node.children)]
        flush()


def _srcset(value: str) -> list[str]:
    return [part.split()[0] for part in value.split(",") if part.split()]


def _logos(nodes: list[Node]) -> list[dict]:
    """Linked images of the page's header, with their alternative text."""
    out = []
    for n in nodes:
        if n.tag == "img" and n.attrs.get("alt", "").strip(WIDE):
            up = list(n.ancestors())
            link = next((u for u in up if u.tag == "a"), None)
            if link is not None and "href" in link.attrs and any(u.tag == "header" or u.attrs.get("role") == "banner" for u in link.ancestors()):
                out.append({"ord": len(out), "href": link.attrs["href"], "source": n.attrs.get("src", ""), "alt": n.attrs["alt"]})
    return out


def _page_links(region: Node) -> list[dict]:
    """The links of a region that no script acts on, in order; trail numbers the breadcrumb trail that a link stands in."""
    out, todo, trails = [], [(region, None)], 0
    while todo:
        node, trail = todo.pop()
        if node.hidden() or node.tag in ("template", "noscript", "script", "style"):
            continue
        if trail is None and (TRAIL_CLASS in node.attrs.get("class", "").split() or node.attrs.get("aria-label") in TRAIL_LABELS):
            trail, trails = trails, trails + 1
        acts = any(k.startswith("on") for k in node.attrs) or node.attrs.get("role") == "button" or {"data-cart", "data-action"} & {*node.attrs}
        if node.tag == "a" and "href" in node.attrs and not acts:
            out.append({"ord": len(out), "href": node.attrs["href"], "label": plain(node), "trail": trail})
        todo.extend((c, trail) for c in reversed(node.elements()))
    return out


def parse(html: str | None, fields: tuple[str, ...] | None = None, url: str | None = None) -> dict:
    """A value for each of FIELDS, or of the given ones: what none of them needs is not worked out."""
    wanted = set(fields or FIELDS)
    tree = built(html or "")
    root = tree.root
    nodes = list(root.walk())
    first = lambda it: next(iter(it), None)
    meta = lambda name: first(n.attrs.get("content") for n in _own(nodes, "meta", name=name))
    body = tree.body
    roles = _roles(root) if "links" in wanted else {}
    title = first(_own(nodes, "title"))
    canonical = first(n.attrs.get("href") for n in nodes if n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split())
    links, media = [], []
    for n in nodes if wanted & {"links", "media"} else ():
        href = n.attrs.get("href")
        if href is not None and (n.tag in ("a", "area") or n.tag == "link" and "alternate" in n.attrs.get("rel", "").lower().split()):
            if href.strip().lower().startswith(SKIPPED_SCHEMES):
                continue
            control = any(a in n.attrs for a in ("onclick", "data-action")) or n.attrs.get("role") == "button"
            links.append({"ord": len(links), "href": href, "tag": n.tag, "label": plain(n), "role": roles.get(n) or ("heading" if any(x.tag in ("h1", "h2", "h3") for x in n.walk()) else "other"), "action_control": control, "fragment_only": href.startswith("#")})
            if n.tag == "a" and FILE_LINK.search(href.split("?")[0].split("#")[0]):
                media.append(href)
        if n.tag in ("img", "source") and n.attrs.get("src"):
            media.append(n.attrs["src"])
        if n.tag == "video" and n.attrs.get("poster"):
            media.append(n.attrs["poster"])
        if n.attrs.get("srcset"):
            media.extend(_srcset(n.attrs["srcset"]))
        if "url(" in n.attrs.get("style", ""):
            media.extend(m.strip("'\" ") for m in re.findall(r"url\(([^)]*)\)", n.attrs["style"]))
    headings = [n for n in nodes if n.tag in HEADINGS]
    name, region = _primary(nodes, body) if wanted & {"primary", "blocks", "ordered", "page_links", "limits", "text"} else (None, body)
    gone = inactive(region, name == "body") if name else set()
    base = first(n.attrs.get("href") for n in _own(nodes, "base") if n.attrs.get("href"))
    ordered = Walk(region, gone, urljoin(url or "", base or "") or None).out if wanted & {"ordered", "limits"} else []
    limits = [name for name, over in (("DOM_BLOCKS", len(ordered) > MAX_BLOCKS), ("DOM_DEPTH", tree.deepest > MAX_DEPTH)) if over]
    forms = [n for n in nodes if n.tag == "form"]
    scripts = ["".join(c for c in n.children if isinstance(c, str)).strip() for n in _own(nodes, "script", type="application/ld+json")]
    prices, attributes, selections, cards = _commerce(nodes, wanted) if wanted & {"prices", "attributes", "selections", "cards"} else ([], [], [], [])
    found = {
        "title": lambda: plain(title) if title else None,
        "description": lambda: meta("description"),
        "canonical": lambda: canonical,
        "base": lambda: first(n.attrs.get("href") for n in _own(nodes, "base")),
        "lang": lambda: first(n.attrs.get("lang") for n in _own(nodes, "html")),
        "robots": lambda: meta("robots"),
        "h1": lambda: [plain(n) for n in headings if n.tag == "h1"],
        "links": lambda: links,
        "media": lambda: list(dict.fromkeys(media)),
        "anchors": lambda: [v for n in nodes for v in (n.attrs.get("id") or (n.attrs.get("name") if n.tag == "a" else None),) if v],
        "headings": lambda: [{"ord": k, "level": int(n.tag[1]), "text": plain(n)} for k, n in enumerate(headings)],
        "structured_data": lambda: scripts,
        "ld": lambda: jsonld.nodes(scripts),
        "primary": lambda: name,
        "blocks": lambda: _blocks(region, gone),
        "ordered": lambda: ordered,
        "page_links": lambda: _page_links(region),
        "limits": lambda: limits,
        "og_images": lambda: [v for n in _own(nodes, "meta", property="og:image") if (v := n.attrs.get("content"))],
        "site_names": lambda: [v for n in _own(nodes, "meta", property="og:site_name") if (v := n.attrs.get("content", "")).strip(WIDE)],
        "logos": lambda: _logos(nodes),
        "text": lambda: " ".join(text_of(region, gone).split()),
        "forms": lambda: len(forms),
        "search_forms": lambda: sum(1 for f in forms if f.attrs.get("role") == "search" or any(n.tag == "input" and (n.attrs.get("type") == "search" or n.attrs.get("name") in ("q", "s", "query", "search")) for n in f.walk())),
        "cart_controls": lambda: sum(1 for n in nodes if n.tag in ("button", "a", "form") and re.search(r"\bcart\b|basket|add-to", n.attrs.get("class", "") + " " + n.attrs.get("action", ""), re.I)),
        "variant_controls": lambda: sum(1 for n in nodes if n.tag == "select"),
        "prices": lambda: prices,
        "attributes": lambda: attributes,
        "selections": lambda: selections,
        "cards": lambda: cards,
    }
    out = {k: v() for k, v in found.items() if k in wanted}
    for n in nodes:  # trees without cycles go as soon as they are read, not when a collection of garbage finds them
        n.parent = None
    return out


def _commerce(nodes: list[Node], wanted: set[str]) -> tuple[list[dict], list[dict], list[dict], list[dict]]:
    prices, attributes, selections, cards = [], [], [], []
    # The heading links and the first image at or below each element, summed up from the leaves.
    heading: dict[Node, list[Node]] = {}
    image: dict[Node, str | None] = {}
    below: dict[Node, bool] = {}
    for n in reversed(nodes) if "cards" in wanted else ():
        children = n.elements()
        links = [x for c in children for x in heading.get(c, ())]
        below[n] = n.tag in ("h2", "h3", "h4") or any(below[c] for c in children)
        if n.tag == "a" and n.attrs.get("href") and (below[n] or n.inside(("h2", "h3", "h4"))):
            links.insert(0, n)
        if links:
            heading[n] = links[:2]
        if n.tag == "img" or any(c in image for c in children):
            image[n] = n.attrs.get("src") if n.tag == "img" else next(image[c] for c in children if c in image)
    for n in nodes:
        mark = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')} {n.attrs.get('itemprop', '')}".lower()
        if re.search(r"\bprice\b|price[-_]|[-_]price", mark) and plain(n):
            old, new = bool(re.search(r"old|regular|was|crossed", mark)) or n.tag in ("s", "del"), bool(re.search(r"current|new|sale|final", mark))
            role = "UNKNOWN" if old and new else "OLD" if old else "CURRENT"
            prices.append({"ord": len(prices), "raw": plain(n), "role": role, "currency": n.attrs.get("data-currency"), "amount": n.attrs.get("content")})
        if n.tag == "tr":
            cells = [c for c in n.children if isinstance(c, Node) and c.tag in ("td", "th")]
            if len(cells) == 2 and plain(cells[0]):
                attributes.append({"ord": len(attributes), "name": plain(cells[0]).rstrip(":"), "value": plain(cells[1])})
        elif n.attrs.get("itemprop") in ("sku", "brand", "manufacturer", "availability"):
            attributes.append({"ord": len(attributes), "name": n.attrs["itemprop"], "value": n.attrs.get("content") or plain(n)})
        if n.tag == "select":
            options = [plain(o) for o in n.walk() if o.tag == "option" and "disabled" not in o.attrs and plain(o)]
            selections.append({"ord": len(selections), "label": n.attrs.get("aria-label") or n.attrs.get("name") or "", "required": "required" in n.attrs, "options": options})
        same: dict[str, list[tuple[Node, Node]]] = {}
        for c in n.elements() if heading else ():
            inside = heading.get(c, ())
            if len(inside) == 1:
                signature = c.tag + "(" + ",".join(x.tag for x in c.elements()) + ")"
                same.setdefault(signature, []).append((c, inside[0]))
        for signature, found in same.items():
            if len(found) >= 2:  # repeated siblings of one shape
                for c, a in found:
                    cards.append({"ord": len(cards), "signature": signature, "href": a.attrs["href"], "label": plain(a), "image": image.get(c)})
    return prices, attributes, selections, cards


def parsed(pages: DataFrame, html: str = "html", fields: tuple[str, ...] | None = None) -> DataFrame:
    """The pages' other columns and a struct column ``parse``; the HTML itself is dropped, so later shuffles do not carry it.

    fields: those of FIELDS that are wanted; others cost nothing.
    """
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)  # pages can be long
    keep = [c for c in pages.columns if c != html]
    at = keep.index("url") if "url" in keep else None
    kind = T.StructType.fromDDL(",".join(f"{k}:{v}" for k, v in FIELDS.items() if not fields or k in fields))
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("parse", kind)])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # parses are larger than their rows
                part = batch.slice(low, 256)
                urls = part.column(at).to_pylist() if at is not None else [None] * part.num_rows
                structs = pa.array([parse(t, fields, u) for t, u in zip(part.column(len(keep)).to_pylist(), urls, strict=True)], pa.struct(list(arrow)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), structs], [*keep, "parse"])

    return pages.select(*keep, F.col(html).cast("string").alias(html)).mapInArrow(run, schema)


# -- sanitising ---------------------------------------------------------------------------------------------

ALLOWED = {"a": ("href", "title"), **dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol li table thead tbody tr th td strong b em i blockquote br".split(), ())}


def sanitize_one(html: str | None) -> str | None:
    """Allowed tags and attributes only; images become their alt text, links with unsafe targets lose the target."""
    if html is None:
        return None
    from html import escape

    out: list[str] = []
    todo: list = [*reversed(built(html).body.children)]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):  # the end of an element
            out.append(f"</{node[0]}>")
        elif isinstance(node, str):
            out.append(escape(node, quote=False))
        elif node.tag == "img":
            out.append(escape(node.attrs.get("alt", ""), quote=False))
        elif node.tag not in HIDDEN | CONTROLS:
            inner: list = list(reversed(node.children))
            if node.tag in ALLOWED:
                attrs = ""
                for name in ALLOWED[node.tag]:
                    value = node.attrs.get(name)
                    if value is not None and (name != "href" or re.match(r"(?:https?://|/(?!/)|#|\?)", value, re.I)):
                        attrs += f' {name}="{escape(value)}"'
                out.append(f"<{node.tag}{attrs}>")
                inner = [] if node.tag == "br" else [(node.tag,), *inner]
            todo += inner
    return "".join(out)


@F.pandas_udf(T.StringType())
def sanitize(html):
    import pandas as pd

    return pd.Series([sanitize_one(t) for t in html], dtype=object)
