"""Reading of HTML: tags and texts in order, elements, and blocks of text; each step takes time linear in the page.

The reader follows what browsers do with broken markup: quotes count only in attribute values, an attribute value without its
closing quote ends at the next >, a tag or comment that the page cuts off takes the rest, script and the like end at their own end
tag only, elements nest up to MOST_DEPTH deep.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

# Names of elements, from the HTML standard.
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose content is not text of the page.
UNSEEN = RAW | frozenset("noscript template object svg canvas audio video math head select datalist".split())
#: Elements of a page's head.
HEAD = frozenset("title meta link style script base noscript template head".split())
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd tr td th tbody thead".split())
MOST_DEPTH, LOOK_BACK = 512, 64

GAP, NAME, IS, BARE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")


class Reader:
    """Iterates over a page as (kind, name, attributes): kind is "text" (name is the raw text), "start", "empty" or "end"."""

    def __init__(self, page: str):
        self.page, self.size, self.at = page, len(page), 0
        self.last = {x: page.rfind(x) for x in ('"', "'", ">", "-->")}

    def find(self, what: str, at: int) -> int:
        """The next place of what, -1 if there's none: found out without a search."""
        return self.page.find(what, at) if self.last[what] >= at else -1

    def __iter__(self) -> Iterator[tuple[str, str, dict[str, str]]]:
        page, size = self.page, self.size
        while self.at < size:
            at = page.find("<", self.at)
            if at < 0:
                yield "text", page[self.at :], {}
                return
            closing = page[at + 1 : at + 2] == "/"
            name = TAG_NAME.match(page, at + 1 + closing)
            other = not name and page[at + 1 : at + 2] in ("!", "?", "/") and page[at + 1 : at + 2] != ""
            if not name and not other:
                yield "text", page[self.at : at + 1], {}
                self.at = at + 1
                continue
            if at > self.at:
                yield "text", page[self.at : at], {}
            if other:
                comment = page.startswith("<!--", at)
                end = self.find("-->" if comment else ">", at + 2)
                self.at = size if end < 0 else end + (3 if comment else 1)
                continue
            tag = name[0].lower()
            end = name.end()
            attributes, self.at, slash = ({}, end + 1, False) if page[end : end + 1] == ">" else self.attributes(end)
            if attributes is None:
                return
            yield "end" if closing else "empty" if slash else "start", tag, attributes
            if tag in RAW and not closing:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, self.at)
                yield "raw", page[self.at : end.start() if end else size], {}
                self.at = end.start() if end else size

    def attributes(self, at: int) -> tuple[dict[str, str] | None, int, bool]:
        """A tag's attributes, where it ends, and whether with a slash; None if the page ends first."""
        page, out = self.page, {}
        while True:
            at = GAP.match(page, at).end()
            if at >= self.size:
                return None, at, False
            if page[at] == ">":
                return out, at + 1, page[at - 1] == "/"
            name = NAME.match(page, at)
            at = max(name.end(), at + 1)
            value = ""
            if equals := IS.match(page, at):
                at = equals.end()
                quote = page[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = self.find(quote, at + 1)
                    if end < 0:
                        end = self.find(">", at + 1)
                        if end < 0:
                            return None, self.size, False
                        value, at = page[at + 1 : end], end
                    else:
                        value, at = page[at + 1 : end], end + 1
                else:
                    bare = BARE.match(page, at)
                    value, at = bare[0], bare.end()
            out.setdefault(name[0].lower(), value)


class Element:
    __slots__ = ("tag", "parent", "attributes", "depth", "unseen", "link", "size", "holds", "apart", "within")

    def __init__(self, tag: str, parent: Element | None, attributes: dict[str, str]):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.depth = parent.depth + 1 if parent else 0
        self.unseen = tag in UNSEEN or bool(parent and parent.unseen)
        self.link = tag == "a" or bool(parent and parent.link)
        self.size, self.holds = 0, False


class Block:
    """A piece of text between tags of blocks. linked: how much of the raw text is in links."""

    __slots__ = ("parts", "linked", "holder", "text")

    def __init__(self, holder: Element):
        self.parts, self.linked, self.holder, self.text = [], 0, holder, ""


def blocks_of(page: str, watched: frozenset[str] = frozenset()) -> tuple[list[Block], list[Element], list[list]]:
    """The page's blocks that hold text, in order; its elements, parents first; and the start tags of the watched names, as lists of
    name, attributes and, of raw text elements, the text."""
    found: list[list] = []
    root = Element("#root", None, {})
    stack, elements, out, block = [root], [root], [], None
    opened: Counter = Counter()
    low = page.lower()
    ends: dict[str, int] = {}
    last = ""

    def close(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    def back(tags: tuple[str, ...], tag: str) -> None:
        """Closes an open element of these that only inline ones stand over."""
        if any(opened[x] for x in tags):
            for i in range(len(stack) - 1, max(0, len(stack) - LOOK_BACK), -1):
                if stack[i].tag in tags:
                    return close(i)
                if stack[i].tag not in INLINE:
                    return None
        return None

    for kind, tag, attributes in Reader(page):
        top = stack[-1]
        if kind == "raw":
            if found and found[-1][0] == last:
                found[-1][2] = tag
            continue
        if kind != "end" and kind != "text":
            last = tag
            if tag in watched:
                found.append([tag, attributes, ""])
        if kind == "text":
            if top.unseen:
                continue
            if block is None:
                holder = top
                while holder.tag in INLINE and holder.parent:
                    holder = holder.parent
                block = Block(holder)
                out.append(block)
            block.parts.append(tag)
            block.linked += len(tag) if top.link else 0
            continue
        if tag == "br":
            if block is not None:
                block.parts.append("\n")
            continue
        if tag not in INLINE:
            block = None
        if kind == "end":
            if tag in VOID or not opened[tag]:
                continue
            for i in range(len(stack) - 1, max(0, len(stack) - LOOK_BACK) if tag in INLINE else 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if opened["head"] and tag not in HEAD:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "head":
                    close(i)
                    break
        if tag in ENDS_P:
            back(("p",), tag)
        if tag == "li":
            back(("li",), tag)
        elif tag in ("dt", "dd"):
            back(("dt", "dd"), tag)
        if tag in VOID or kind == "empty" and tag in ("svg", "math", "path"):
            continue
        if tag in UNSEEN and tag not in RAW and tag != "head":
            if tag not in ends:
                ends[tag] = low.rfind(f"</{tag}")
            if ends[tag] < 0:
                continue  # never closed: the tag alone is left out
        if len(stack) < MOST_DEPTH:
            made = Element(tag, stack[-1], attributes)
            stack.append(made)
            elements.append(made)
            opened[tag] += 1
    kept = []
    for b in out:
        b.text = " ".join(entities.unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
    return kept, elements, found
