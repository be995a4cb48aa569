"""The main text of web pages by scoring their trees.

A page is read into a tree of elements and a list of blocks: the runs of text between the borders of block elements, in page
order.  Elements that are no part of an article by their tag, role, state or names (menus, page headers and footers, sidebars,
notices, adverts, forms, reader comments) are marked, and what lies in them is left out.  Each block passes points for its
length and its commas to the containers around it, fewer the further away; a container's points are discounted by the share
of its text that stands in links.  The best container is kept (with the article around it, if there is one), and so are those of its
siblings that score like it; lists of links and notices inside are left out.

Every page is read alone and nothing is shuffled, so a host with most of the pages needs no care; each task holds the texts
of a few pages at a time.

Defined cases: null and empty pages, and pages without text, give an empty text; text without any markup is one block; unclosed,
misnested and cut-off markup is read as far as it goes; white space of any kind counts; very long pages are read whole in linear
time; repeated rows and null keys are kept; ties between containers go to the first on the page; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
NAMES = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden|aria-modal|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp", "object", "select")}
CONTAINERS = set("html body div section article main blockquote details fieldset center layer td th table tbody thead tfoot tr figure header #page".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre address aside nav footer form hr hgroup search menu dialog caption figcaption summary button legend label optgroup option".split())
CANDIDATES = set("body div section article main blockquote td #page".split())
LEFT_OUT = set("nav footer aside form button dialog menu search fieldset legend label optgroup option".split())
LEFT_OUT_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar tablist form status".split())
# Closing rules: an opening tag ends an open element of these names, as far as the nearest of the limits.
_HEADS = {f"h{i}" for i in range(1, 7)}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Words of class names and ids of what is not the article.
OUT_WORDS = set("""ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted
    nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pager pagination paging toc
    header masthead topbar footer foot colophon copyright sidebar rail aside widget widgets
    comment comments commentlist disqus respond replies reply discussion guestbook
    cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay lightbox paywall
    subscribe subscription newsletter signup login signin register form search searchbox
    share sharing social follow related recommended recommendations trending popular outbrain taboola
    toolbar skip hidden print""".split())
SAFE_WORDS = set("article content main post entry story body text page wrapper container layout has no with without".split())
STRONG_WORDS = set("comment comments commentlist disqus respond replies sidebar cookie cookies advert advertisement sponsored newsletter breadcrumb breadcrumbs related".split())
GOOD_WORDS = set("article content main post entry story text body blog".split())
NOTICE = re.compile(r"^(?:©|\(c\)\s|copyright\b)|\ball rights reserved\b|\b(?:we|site|website) uses? cookies\b|^advertisement$|^sponsored\b", re.I)
COMMENT_HEADING = re.compile(r"^(?:\d+\s+)?(?:reader |user )?(?:comments?|replies|leave a (?:reply|comment)|related (?:articles|posts|stories)|read (?:more|next)|you may also like)(?:\s*\(?\d*\)?)?:?$", re.I)


class Node:
    __slots__ = ("tag", "parent", "out", "bonus", "points", "length", "links", "article", "box")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, bonus: float = 0.0):
        self.tag, self.parent, self.bonus = tag, parent, bonus
        self.out = out or (parent is not None and parent.out)
        self.article = tag in ("article", "main") or (parent is not None and parent.article)  # inside one
        self.box = self if tag in CANDIDATES else parent.box  # the nearest container
        self.points, self.length, self.links = 0.0, 0, 0


def named(tag: str, attributes: str, inside_article: bool) -> tuple[bool, float]:
    """Whether an element is left out by what its tag and attributes say, and its bonus as a container."""
    if tag in LEFT_OUT or (tag == "header" and not inside_article):
        return True, 0.0
    bonus = {"article": 25.0, "main": 20.0}.get(tag, 0.0)
    if not attributes:
        return False, bonus
    words: set[str] = set()
    for name, value in NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name in ("aria-hidden", "aria-modal") and value.lower() == "true"):
            return True, 0.0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, 0.0
        if name == "role":
            if value.lower() in LEFT_OUT_ROLES:
                return True, 0.0
            bonus += 20.0 * (value.lower() in ("main", "article"))
        if name == "itemprop":
            if value.lower() == "comment":
                return True, 0.0
            bonus += 25.0 * (value.lower() == "articlebody")
        if name in ("class", "id"):
            words.update(w.lower() for w in WORD.findall(value))
    if tag not in ("html", "body", "main") and tag not in _HEADS and tag not in ("p", "a", "span", "b", "i", "em", "strong"):
        bad = words & OUT_WORDS
        if bad and (not words & SAFE_WORDS or (bad & STRONG_WORDS and not words & {"has", "no", "with", "without"})) and not (tag == "article" and not bad & STRONG_WORDS):
            return True, 0.0
    elif tag in ("p", "span") and words & OUT_WORDS and not words & SAFE_WORDS:
        return True, 0.0
    return False, bonus + 5.0 * bool(words & GOOD_WORDS)


def read_page(page: str) -> list[tuple[Node, str, int]]:
    """The blocks of a page in order: (innermost block element, text, characters of it in links)."""
    root = Node("#page", None)
    stack, opened = [root], {"#page": 1}  # how many elements of a name are open, so that a missing one is seen at once
    blocks: list[tuple[Node, str, int]] = []
    run: list[str] = []
    linked = 0
    holder = root  # the innermost block element

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text and not holder.out:
                blocks.append((holder, text, min(linked, len(text))))
            run.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal holder
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1
        holder = next(n for n in reversed(stack) if n.tag in BLOCKS)

    def close(names: set[str], limits: set[str]) -> None:
        if not any(opened.get(n) for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in names:
                flush()
                pop_to(depth)
                return
            if stack[depth].tag in limits:
                return

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        text = page[at:] if lt < 0 else page[at:lt]
        if text:
            if not stack[-1].out:
                run.append(text)
                if opened.get("a"):
                    linked += len(text)
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        m = TAG.match(page, lt)
        if m is None:
            after = page[lt + 1: lt + 2]
            if after in ("!", "?", "/") or after.isalpha():  # a declaration, or a tag that never ends or has a stray quote
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                if not stack[-1].out:
                    run.append("&lt;")
                at = lt + 1
            continue
        closing, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        at = m.end()
        if closing:
            if tag == "br":
                run.append(" ")
            elif opened.get(tag):
                if tag in BLOCKS:
                    flush()
                depth = next(d for d in range(len(stack) - 1, -1, -1) if stack[d].tag == tag)
                if tag in BLOCKS or not any(n.tag in CONTAINERS for n in stack[depth:]):
                    if any(n.tag in BLOCKS for n in stack[depth:]):
                        flush()
                    pop_to(depth)
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else (size if tag in ("script", "style") else at)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                run.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if opened.get("p") and tag not in ("label", "button", "option", "optgroup"):
                close({"p"}, {"td", "th", "button", "table"})
            if tag in _HEADS and stack[-1].tag in _HEADS:
                pop_to(len(stack) - 1)
            if tag in ENDS:
                close(*ENDS[tag])
        parent = stack[-1]
        if not parent.out:
            out, bonus = named(tag, attributes, parent.article)
            # Of the header of an article the headings stay.
            if parent.tag == "header" and tag not in _HEADS | {"hgroup", "div"}:
                out = True
        else:
            out, bonus = True, 0.0
        node = Node(tag, parent, out, bonus)
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
        if tag in BLOCKS:
            holder = node
    flush()
    return blocks


def containers(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node.box
        node = node.box.parent


def inherited(node: Node, known: dict[int, object], value: Callable) -> object:
    """value(node, what its parent has), worked out once for each node on the way from the root."""
    way = []
    while node is not None and id(node) not in known:
        way.append(node)
        node = node.parent
    got = known[id(node)] if node is not None else None
    for n in reversed(way):
        got = known[id(n)] = value(n, got)
    return got


def without_links(blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """Blocks without lists of three entries or more with most of their text in links."""
    lists = ("ul", "ol", "dl")
    inside = {"li", "dt", "dd", "p", "div"}
    known: dict[int, object] = {}
    held: dict[int, list[int]] = {}
    for node, text, links in blocks:
        own = inherited(node, known, lambda n, up: n if n.tag in lists else up if n.tag in inside else None)
        if own is not None:
            n = held.setdefault(id(own), [0, 0, 0])
            n[0] += 1
            n[1] += len(text)
            n[2] += links
    menus = {i for i, (n, length, links) in held.items() if n >= 3 and links > 0.6 * length}
    known = {}
    return [b for b in blocks if not inherited(b[0], known, lambda n, up: id(n) in menus or bool(up and (n.tag in inside or n.tag in lists)))]


def without_comments(blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """Blocks without those that a heading before them in a container of theirs announces as comments or further reading."""
    shut: dict[int, int] = {}
    for i, (node, text, _) in enumerate(blocks):
        if node.tag in _HEADS and COMMENT_HEADING.match(text):
            shut.setdefault(id(node.parent), i)
    if not shut:
        return blocks
    known: dict[int, object] = {}
    never = len(blocks)
    return [b for i, b in enumerate(blocks) if inherited(b[0], known, lambda n, up: min(shut.get(id(n), never), never if up is None else up)) > i]


def main_text(page: str | None) -> str:
    """The text of the article of a page: its blocks in page order, with an empty line between them."""
    blocks = read_page(page or "")
    blocks = without_links([b for b in blocks if not (b[0].tag in CONTAINERS and len(b[1]) < 200 and NOTICE.search(b[1]))])
    blocks = without_comments(blocks)
    scored: dict[int, Node] = {}
    for node, text, links in blocks:
        points = len(text) / 100 if len(text) < 25 else 1 + text.count(",") + min(len(text) / 100, 3)
        for level, box in enumerate(containers(node)):
            if level == 6:
                break
            box.points += points / (1, 2, 6, 9, 12, 15)[level]
            box.length += len(text)
            box.links += links
            scored.setdefault(id(box), box)
    if not scored:
        return ""

    def score(n: Node) -> float:
        return (n.points + n.bonus) * (1 - n.links / max(n.length, 1))

    best = max(scored.values(), key=score)  # the first of equals on the page
    within = list(containers(best))
    best = next((n for n in within if n.tag == "article"), next((n for n in within if n.tag == "main" or n.bonus >= 20), best))
    limit = max(10.0, 0.2 * score(best))
    kept = []
    known: dict[int, object] = {}
    for node, text, links in blocks:
        up = inherited(node, known, lambda n, above: n if n is best or n.parent is best.parent else above)
        if up is best:
            kept.append(text)
        elif up is not None and best.parent is not None:  # a sibling: another container like it, a heading or a paragraph of its own
            density = links / max(len(text), 1)
            if (up.tag in CANDIDATES and score(up) >= limit) or up.tag in _HEADS or (up.tag in ("p", "pre", "blockquote", "ul", "ol") and density < 0.25 and (len(text) > 80 or text[-1:] in ".!?")):
                kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per row of pages: (key, url, text, n_chars)."""
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 32):
                b = batch.slice(at, 32)
                texts = [main_text(p.as_py()) for p in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["k", "u", "text", "n_chars"])

    d = pages.select(pages[f"`{key}`"].cast("bigint").alias("k"), pages[f"`{url}`"].alias("u"), pages[f"`{source}`"].cast("string").alias("h"))
    return d.mapInArrow(run, "k bigint, u string, text string, n_chars bigint").withColumnsRenamed({"k": key, "u": url})
